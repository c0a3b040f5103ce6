"""Review queries on hand-made rows."""

from datetime import datetime

from quirekit.plans import review


def test_issue_outcomes_count_small_values_and_knock_ons(spark):
    at = lambda d: datetime(2024, 1, d, 12)
    rows = [
        (1, at(1), 1, "error", 0.5), (2, at(4), 1, "error", 0.5),
        (3, at(2), 2, "error", 0.5),
        (4, at(3), 3, "error", 99.0),
        (5, at(4), 4, "view", 0.5),
        (6, at(1), 5, "click", 95.0),
        (7, None, 6, "click", 95.0),
        (8, at(1), 7, None, 1.0), (9, at(3), 7, None, 1.0), (10, at(4), 8, None, 1.0),
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert {(r.user_id, r.event_type): r.outcome for r in review.issue_outcomes(df).collect()} == {
        (1, "error"): "unresolved", (2, "error"): "resolved", (3, "error"): "knock-on", (4, "view"): "regression",
        (5, "click"): "resolved", (7, None): "unresolved", (8, None): "knock-on",
    }
    assert review.issue_outcomes(df.limit(0)).count() == 0


def test_duplicates_by_normalized_text(spark, tmp_path):
    rows = [(1, "One two."), (2, "one  TWO"), (3, "One two."), (4, "one, two!"), (5, "onetwo"), (6, None), (7, None), (8, "..."), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda q: sorted(map(tuple, q(spark, str(tmp_path)).collect()))
    assert found(review.normalized_duplicates) == [(2, 1), (3, 1), (4, 1), (9, 8)]
    assert found(review.first_occurrence_duplicates) == [(3, 1)]
