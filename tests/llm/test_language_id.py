"""Language identification with more labels than one block of languages holds."""

import numpy as np

from quirekit.llm import language_id


def test_more_than_five_hundred_labels_give_a_result(spark):
    rows = [(i * 700 + k, f"l{i:03}", f"{chr(0x4E00 + 7 * i)}{chr(0x4E03 + 7 * i)} " * 5) for i in range(501) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert len(model.langs) == 501 == len(model.prior) == sum(b.shape[1] for b in model.logp)
    found = language_id.identified(docs.where("doc_id % 700 = 0"), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.9 * 501


def test_blocks_give_the_model_of_one_matrix(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = language_id.train(docs, max_rows=20)
    monkeypatch.setattr(language_id, "LANGUAGE_BLOCK", 3)
    blocks = language_id.train(docs, max_rows=20)
    assert len(whole.logp) == 1 < len(blocks.logp) and blocks.langs == whole.langs
    assert np.array_equal(np.hstack(blocks.logp), whole.logp[0]) and np.array_equal(blocks.prior, whole.prior)
    texts = [r.text for r in docs.limit(20).collect()]
    assert [x[0] for x in blocks.predict(texts)] == [x[0] for x in whole.predict(texts)]


def brute(model, text):
    """Log-probabilities summed n-gram by n-gram in Python."""
    best = []
    for k in range(len(model.langs)):
        column = model.logp[0][:, k]
        best.append(model.prior[k] + sum(float(column[g]) for part in language_id.grams(text) for g in part.tolist()))
    top = max(range(len(best)), key=best.__getitem__)
    return model.langs[top], 1 / sum(np.exp(x - best[top]) for x in best)


def test_scores_equal_brute_force_in_any_batch(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs, max_rows=30)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    want = [brute(model, t) if t and language_id._LETTER.search(t) else ("und", 0.0) for t in texts]
    for slab in (1 << 20, 64):
        monkeypatch.setattr(language_id, "_SLAB", slab)
        for (a, x), (b, y) in zip(model.predict(texts), want, strict=True):
            assert a == b and abs(x - y) < 1e-4


def test_undetermined_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "aa", "kla kla"), (1, "aa", "kla kla"), (2, "bb", "kla kla"), (3, None, "kla"), (4, "aa", None), (None, "bb", "x"), (5, "aa", ""), (7, "bb", "½ ² ① 12 _"), (9, "aa", "kla " * 300_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, lang string, text string, score string")
    model = language_id.train(df)
    got = language_id.identified(df, model)
    assert sorted(got.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    found = {r.text: (r.lang_pred, r.score) for r in got.collect()}
    assert found[None] == found[""] == found["½ ² ① 12 _"] == ("und", 0.0)
    assert found["kla kla"][0] in ("aa", "bb") and found["kla " * 300_000][0] in ("aa", "bb")
    assert got.count() == len(rows)
    empty = df.limit(0)
    assert language_id.identified(df, language_id.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identified(empty, model).count() == 0
