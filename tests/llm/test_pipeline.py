"""Each stage of the pipeline against a plain version of it, on the rows that the stage before kept."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from quirekit.llm import mixing, quality_fm, quality_rules
from tests.llm.test_contracts import _groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before and after every stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs.collect())
        assert name == "bpe" or docs.columns == columns
    return out


def test_classifier_keeps_what_scores_enough(spark, sf_dir, stages):
    before, after = stages["quality_classifier"]
    model = quality_fm.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cache = quality_fm._Buckets()
    z = {r.doc_id: model.logits_of([quality_fm.features(r.text, r.n_chars, cache)])[0] for r in before}
    assert sorted(r.doc_id for r in after) == sorted(d for d, x in z.items() if 1 / (1 + np.exp(-x)) >= 0.3)
    assert 0 < len(after) < len(before)


def test_rules_keep_what_the_sql_keeps(stages):
    before, after = stages["quality_rules"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text) for r in before], columns=["doc_id", "text"]))
    kept = con.execute(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept ORDER BY doc_id").fetchall()
    assert sorted(r.doc_id for r in after) == [d for (d,) in kept] and 0 < len(after) < len(before)


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard"]
    groups = _groups([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, root) in groups.items() if root == d)


def test_mixture_repeats_rows_by_their_rate(stages):
    before, after = stages["mixing"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:  # sources whose share is too much stop at their most, the excess is shared anew
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > mixing.MOST_EPOCHS * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(mixing.MOST_EPOCHS * sizes[s])
            left -= target[s]
        open_ -= full
    want = {}
    for r in before:
        rate = min(3.0, target[r.source] / sizes[r.source]) if sizes[r.source] else 0.0
        u = int(hashlib.md5(f"0:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        if n := int(rate) + (u < rate - int(rate)):
            want[r.doc_id] = n
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    differ = {d for d in got.keys() | want.keys() if got.get(d) != want.get(d)}
    assert not differ


def test_tokens_of_every_row_of_the_mixture(stages):
    before, after = stages["bpe"]
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    want = sorted((r.doc_id, tuple(enc.encode_ordinary(r.text or ""))) for r in before)
    assert sorted((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in after) == want
    assert all(r.round_trip for r in after)


def test_stages_without_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
