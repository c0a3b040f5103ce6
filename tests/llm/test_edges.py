"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, operator by operator."""

import random

import public_tokenizers
import pytest

from quirekit.llm import bpe, common, fingerprint, license_scan, mixing, quality_rules

LONG = "word other third. " * 60_000


def frame(spark, rows, clash):
    return spark.createDataFrame([(*r, 7) for r in rows], f"doc_id long, text string, source string, {clash} int")


ROWS = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (None, "x y", None), (3, "", None), (4, LONG, "t"), (4, "other", "t"), (5, " \n\t ", "t")]


def test_quality_rules(spark):
    df = frame(spark, ROWS, "n_words")
    got = quality_rules.quality_rules(df)
    by = sorted((r.doc_id or 0, r.n_words) for r in got.collect())
    assert by == [(0, 2), (1, 3), (1, 3), (2, 0), (3, 0), (4, 1), (4, 180_000), (5, 0)]
    assert all(r.base_failed and not r.kept for r in got.collect())
    kept = quality_rules.keep_passing(df)
    assert kept.columns == df.columns and kept.count() == 0
    good = " ".join(f"the word{i} other{i} thing{i}" for i in range(60))
    two = quality_rules.keep_passing(frame(spark, [(9, good, None), (9, good, None)], "__kept"))
    assert [r.doc_id for r in two.collect()] == [9, 9]
    assert quality_rules.keep_passing(df.limit(0)).count() == 0


def test_mixing(spark):
    df = frame(spark, ROWS, "copies")
    got = mixing.mixed(df).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 3 for r in got)
    assert {r.source: r.source_size for r in got} == {"s": 6, "t": 180_001, None: 2}
    assert {r.target for r in got if r.source is None} == {6.0} and {r.target for r in got if r.source == "s"} == {18.0}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.where("doc_id = 1").count() == 6
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.copies for r in mixing.mixed(frame(spark, [(1, None, "s"), (2, "", None)], "k")).collect()} == {0}


def test_taken_words_come_near_their_target(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(1, 40), r.choice(("a", "b", "c", "d", None))) for i in range(6000)]
    got = mixing.mixed(frame(spark, rows, "size")).groupBy("source").agg({"target": "max", "size": "sum"}).collect()
    taken = {r.source: r.t for r in mixing.mixed(frame(spark, rows, "size")).selectExpr("source", "size * copies as n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "t").collect()}
    for row in got:
        assert abs(taken[row.source] - row["max(target)"]) < 0.08 * row["max(target)"]


def test_license_scan(spark):
    rows = [*ROWS, (7, "Licensed under the MIT License", "s"), (7, "Licensed under the MIT License", "s")]
    df = frame(spark, rows, "labels")
    got = license_scan.scanned(df)
    assert sorted(got.columns) == sorted({*df.columns, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"})
    found = got.collect()
    assert len(found) == len(rows) and [r.labels for r in found if r.doc_id == 7] == ["mit", "mit"]
    assert {(r.n_words, r.first_word, r.labels, r.score) for r in found if r.doc_id in (2, 3, 5)} == {(0, None, "", 0.0)}
    assert license_scan.scanned(df.limit(0)).count() == 0


def plain_detections(norm):
    """All matches of all rules, without prefilter; those that another of at least their priority contains are dropped."""
    hits = [(m.start(), m.end(), r) for r in license_scan.rules() for m in r.pattern.finditer(norm)]
    out = []
    for i, (a, b, r) in enumerate(hits):
        inside = [(c, d, s) for j, (c, d, s) in enumerate(hits) if j != i and c <= a and b <= d and s.priority >= r.priority]
        if not any((c, d) != (a, b) or s.priority > r.priority for c, d, s in inside):
            out.append((a, b, r.priority))
    return set(out)


@pytest.mark.parametrize("seed", range(6))
def test_rules_priorities_and_containment_equal_brute_force(seed):
    r = random.Random(seed)
    pieces = [
        "licensed under the apache license version 2 0", "apache license", "gnu general public license version 3", "gnu lesser general public license", "mit license", "spdx license identifier bsd 3 clause",
        "permission is hereby granted free of charge to any person obtaining a copy of this software", "all rights reserved", "copyright c 2020 2021 somebody", "may not be copied without permission",
        "proprietary and confidential", "released into the public domain", "creative commons attribution 4 0", "cc by sa 4 0", "plain words in between", "mozilla public licence",
    ]
    norm = license_scan.normal_form(" ".join(r.choice(pieces) for _ in range(30)))
    got = license_scan.detect(norm)
    want = plain_detections(norm)
    words = lambda o: norm.count(" ", 0, o) - 1
    assert {(d.first, d.last, d.priority) for d in got} == {(words(a), words(b), p) for a, b, p in want}


def brute_likeness(a, b):
    tokens = fingerprint._Tokens()
    x, y = fingerprint.digests(a, tokens).tolist(), fingerprint.digests(b, tokens).tolist()
    return 2 * len(set(x) & set(y)) / (len(x) + len(y)) if x or y else 1.0


def test_fingerprint_likeness_equals_sets(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(900)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:300] + ["new"] * 9 + base[300:]), None, "", LONG, LONG, " ".join(base[::-1]), "one\ntwo\none\ntwo"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "twin id", "s"), (None, "no id", "s")]
    df = frame(spark, rows, "fingerprint")
    got = fingerprint.fingerprinted(df).collect()
    assert len(got) == len(rows)
    by_id = {d: t for d, t, _ in rows if d not in (3, None)}
    for x in got:
        if x.doc_id in by_id and x.doc_id >= 5:
            after = by_id[x.doc_id - 1] or ""
            text = by_id[x.doc_id] or ""
            m = len(text) // 3
            edited = text[: len(text) - m] + after[:m]
            assert x.near_edited == pytest.approx(brute_likeness(text, edited)) and x.near_next == pytest.approx(brute_likeness(text, after))
    same = {x.fingerprint for x in got if x.doc_id in (4, 5)}
    assert len(same) == 1


def test_bpe_of_long_texts_and_clashing_columns(spark):
    df = frame(spark, ROWS, "chunk")
    got = bpe.encoded(df, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    assert max(r.n_tokens for r in rows) > 150_000 and sorted(r.n_tokens for r in rows)[0] == 0


def test_bpe_chunks_change_nothing(spark, monkeypatch, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    digest = lambda: sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, ranks, public_tokenizers.PATTERN, keep_ids=False).collect())
    want = digest()
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(bpe, "MOST_OWNERS", 2)
    assert digest() == want


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()

    class Session:
        sparkContext = Context

        class conf:
            set = staticmethod(lambda *a: None)
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.prepare(Session)
