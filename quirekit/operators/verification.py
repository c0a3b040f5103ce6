"""Verification of a corrected document (J10, A29, A10, U6): what a new comparison says about the findings before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates


def signature(key: Column, *parts: Column) -> Column:
    """What makes a finding the same one after the fix, independent of its id."""
    return F.sha2(F.to_json(F.struct(key.alias("k"), *(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def issue_diff(before: DataFrame, after: DataFrame, keys: list[str], type_: str, scope: list[str] | None = None) -> DataFrame:
    """Outcome of every signature (``keys``, which include the type) of either side.

    On both sides it is unresolved, only before resolved, and only after a
    knock-on where its type is unresolved with any signature of the scope, else
    a regression. Rows that repeat a signature are one; null parts are values.
    """
    sides = before.select(*keys, F.lit(True).alias("__b"), F.lit(False).alias("__a")).union(after.select(*keys, F.lit(False), F.lit(True)))
    both = sides.groupBy(*keys).agg(F.bool_or("__b").alias("__b"), F.bool_or("__a").alias("__a"))
    scope = scope or []
    still = both.where("__a and __b").select(*(F.col(k).alias(f"__{k}") for k in [*scope, type_])).distinct().withColumn("__open", F.lit(True))
    same = F.lit(True)
    for k in [*scope, type_]:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    found = both.join(still, same, "left")
    outcome = F.when(F.col("__a") & F.col("__b"), "unresolved").when(F.col("__b"), "resolved").when(F.col("__open"), "knock-on").otherwise("regression")
    return found.select(*keys, outcome.alias("outcome"))


def reopened(issues: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose applied fix didn't resolve them are open again, with a note."""
    o = outcomes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("outcome").alias("__outcome"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    failed = (F.col("__outcome") == "unresolved") & F.col("status").isin("AUTO_FIXED", "APPROVED")
    rows = issues.join(o, same, "left").withColumn("note", F.when(failed, "correction did not resolve the issue"))
    return rows.withColumn("status", F.when(failed, "OPEN").otherwise(F.col("status"))).drop("__outcome", *(f"__{k}" for k in keys))


def scores(counts: DataFrame) -> DataFrame:
    """The six scores of a document from counts, and the overall one.

    Columns: doc, matched_x and n_x for text, image, structure and question,
    and the order and layout scores. Nothing to cover counts 0 for text and
    images, 1 for structure and questions.
    """
    c = lambda k, empty: aggregates.coverage_ratio(F.col(f"matched_{k}"), F.col(f"n_{k}"), empty)
    six = counts.select("doc", c("text", 0.0).alias("text"), c("image", 0.0).alias("image"), c("structure", 1.0).alias("structure"), "order", c("question", 1.0).alias("question"), "layout")
    return six.withColumn("overall", aggregates.overall_score(**{k: F.col(k) for k in aggregates.SCORE_WEIGHTS}))


def verified(after_scores: DataFrame, after_issues: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per document: resolved, unresolved and new findings, quality, and whether every check is passed."""
    i = after_issues.groupBy("doc").agg(F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium"), F.count_if(F.col("type") == "BROKEN_IMAGE_SRC").alias("n_broken"))
    o = outcomes.groupBy("doc").agg(*(F.count_if(F.col("outcome") == x).alias(n) for x, n in (("resolved", "n_resolved"), ("unresolved", "n_unresolved"), ("regression", "n_regressions"), ("knock-on", "n_knock_on"))))
    rows = after_scores.join(i, "doc", "left").join(o, "doc", "left").fillna(0, ["n_high", "n_medium", "n_broken", "n_resolved", "n_unresolved", "n_regressions", "n_knock_on"])
    rows = rows.withColumn("quality", aggregates.quality_score(F.col("overall"), F.col("n_high"), F.col("n_medium"), F.col("n_regressions")))
    passed = aggregates.checklist(rows, ["doc"]).groupBy("doc").agg(F.bool_and("passed").alias("passed"))
    return rows.join(passed, "doc")
