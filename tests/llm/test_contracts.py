"""Results of the registered queries against brute force on the small tables."""

import hashlib
import re
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from quirekit.llm import queries
from quirekit.llm.bpe import encoded, read_ranks
from quirekit.llm.ngram_join import ngram_jaccard_groups

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def test_bpe_equals_tiktoken(spark, sf_dir, docs):
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(RANKS)), special_tokens={})
    got = {r.doc_id: r for r in queries.op4_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(text or "")
        assert (got[doc].n_tokens, got[doc].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (1, "")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in encoded(df, read_ranks(RANKS), public_tokenizers.PATTERN).collect()) == [0, 0, 0, 2]
    assert encoded(df.limit(0), read_ranks(RANKS), public_tokenizers.PATTERN).count() == 0


def _groups(rows, width, num, den):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            least, other = sorted((root[a], root[b]))
            root = {d: least if r == other else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in sets}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, docs, width, num):
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)] + [(10**6, None), (10**6 + 1, "A b"), (10**6 + 2, "a  B")]
    got = ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _groups(rows, width, num, 100)


def test_held_out_quality_and_language(spark, docs):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scores = [(r.score, truth[r.doc_id]) for r in queries.op1_quality_classifier(spark, folder).where("held_out").collect() if truth.get(r.doc_id) is not None]
    good, bad = [s for s, y in scores if y], [s for s, y in scores if not y]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.85
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = [(r.lang_pred, lang[r.doc_id]) for r in queries.op7_language_id(spark, folder).where("held_out").collect() if lang[r.doc_id]]
    assert sum(a == b for a, b in found) / len(found) > 0.9


def test_license_base_places_equal_brute_force(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, sf_dir).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
        found = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        r, starts = got[doc], [i for i, _ in found]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(found), ",".join(sorted({x for _, x in found})))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
