"""The factorisation machine's score against the sum over all pairs, and its edge cases."""

import numpy as np

from quirekit.llm import quality_fm


def test_linear_time_identity_equals_the_sum_over_pairs():
    r = np.random.default_rng(3)
    model = quality_fm.Model(0.3, r.normal(size=quality_fm.N_FEATURES), r.normal(size=(quality_fm.N_FEATURES, 4)))
    rows = [quality_fm.features(t, n, quality_fm._Buckets()) for t, n in (("one two two three. One,\n| x | #", 30), (None, None), ("", 0), ("a " * 500, -1))]
    want = []
    for index, value in rows:
        z = model.w0 + sum(model.w[i] * x for i, x in zip(index, value, strict=True))
        for a in range(len(index)):
            for b in range(a):
                z += float(model.v[index[a]] @ model.v[index[b]]) * value[a] * value[b]
        want.append(z)
    assert np.allclose(model.logits_of(rows), want)
    assert np.allclose(np.concatenate([model.logits_of([x]) for x in rows]), want)
    assert len(model.logits_of([])) == 0


def test_nulls_repeats_long_texts_clashing_columns_and_empty_tables(spark, monkeypatch):
    good, bad = "The river ran quietly past the old mill, and people came to see it. " * 4, "BUY!!! $$$ | | | click | click | " * 9
    rows = [(i, (good if i % 2 else bad) + f" word{i}", 10 * i, "s") for i in range(40)] + [(99, None, None, "s"), (99, "", 0, "s"), (None, good, 5, "s"), (98, good * 5000, 10**6, "s"), (98, good * 5000, 10**6, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, None), (None, 1), (3, 1)], "doc_id long, quality int")
    model = quality_fm.train(docs, labels)
    got = quality_fm.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r.score for r in got}
    assert np.mean([s for (d, _), s in by.items() if d is not None and d < 40 and d % 2]) > np.mean([s for (d, _), s in by.items() if d is not None and d < 40 and not d % 2]) + 0.3
    monkeypatch.setattr(quality_fm, "BATCH_FEATURES", 1)
    assert np.allclose([r.score for r in quality_fm.scored(docs, model).orderBy("doc_id", "text").collect()], [s for _, s in sorted((((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""), r.score) for r in got))])
    kept = quality_fm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score >= quality_fm.THRESHOLD)
    assert quality_fm.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert quality_fm.keep_good(docs.limit(0), labels).count() == 0
