"""The n-gram join on texts that one shared passage would merge, held to brute force."""

import random

import pytest

from quirekit.llm import ngram_join
from tests.llm.test_contracts import _groups


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_shared_passage_and_near_copies(spark, monkeypatch, width, num):
    """Small blocks and chunks make every component large, so that all steps run."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CHUNK_NGRAMS", 300)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(80)]
    texts = [passage + [word() for _ in range(r.randrange(1, 60))] for _ in range(120)]
    for _ in range(60):  # near copies of one text, from certain links to certain misses
        copy = list(base)
        for _ in range(r.randrange(6)):
            copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    for t in texts[:40:2]:  # and of single texts with the passage
        texts.append(t[:-1] + [word()])
    texts += [base] * 15 + [passage] * 15 + [["a", "b"]] * 3 + [["c"]] + [[]] * 3
    ids = r.sample(range(10**6), len(texts))
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ngram_join.ngram_jaccard_groups(df, width, num, 100).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == _groups(rows, width, num, 100)


def test_keep_one_of_each_with_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, "x", 1), (1, long + " end", "y", 2), (2, None, None, None), (None, long, "z", 3), (5, "", "", 4), (5, "", "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cluster string, bucket long")
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id or -1) for x in kept.collect()) == [-1, 1, 2, 5]
    assert ngram_join.keep_one_of_each(df.limit(0)).count() == 0


def test_keep_one_of_each_where_doc_id_is_no_key(spark):
    """Each row links by its own text, also where another row has its doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b + " end"), (9, c), (9, c), (9, None), (8, "A" + a[1:]), (None, a)]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((x.doc_id or -1, x.text or "") for x in kept.collect()) == [(-1, a), (1, a), (5, b), (9, ""), (9, c)]
