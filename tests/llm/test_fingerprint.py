import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirekit.llm import fingerprint
from quirekit.llm.fingerprint import difference, fingerprinted


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_difference_equals_set_difference(common, a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (common | a, common | b))
    left, right = difference(x, y)
    assert set(left.tolist()) == set(x.tolist()) - set(y.tolist())
    assert set(right.tolist()) == set(y.tolist()) - set(x.tolist())


def test_edits_follow_the_contract_with_nulls_and_empty_texts(spark):
    rows = [(1, "abcdef"), (2, None), (3, "one two three four five six"), (4, ""), (5, "xé" * 40)]
    got = {r.doc_id: r for r in fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    for i, (doc, text) in enumerate(ordered):
        old, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        m = len(old) // 3
        edited = old[: len(old) - m] + after[:m]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc].n_chars == len(old)
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    assert got[2].fingerprint == got[4].fingerprint


def test_empty_table(spark):
    assert fingerprinted(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_ids_are_dealt_over_parts_in_order(spark, monkeypatch):
    """Small parts; a third of the rows have one id, others none."""
    monkeypatch.setattr(fingerprint, "TASK_BYTES", 400)
    rows = [(i, f"text {i} " * 5) for i in range(60)] + [(20, f"hot {i} " * 5) for i in range(60)] + [(None, f"null {i} " * 5) for i in range(40)] + [(7, "same")] * 5 + [(61, None), (62, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = fingerprint.with_next(df).collect()
    parts = {}
    for r in found:
        parts.setdefault(r.part, []).append(r)
    assert len({r.part for r in found if r.doc_id == 20 and not r.extra}) > 3 and len({r.part for r in found if r.doc_id is None and not r.extra}) > 2
    hashed = {t: h for t, h in df.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1] or ""))
    want = sorted(((a[0] or -1, (a[1] or "")), (b[0] or -1, (b[1] or ""))) for a, b in zip(order, order[1:] + order[:1], strict=True))
    got = []
    for own in parts.values():
        line = [r for r in own if not r.extra] + [r for r in own if r.extra][:1]
        got += [((a.doc_id or -1, a.text or ""), (b.doc_id or -1, b.text or "")) for a, b in zip(line, line[1:], strict=False)]
    assert sorted(got) == want
    assert fingerprinted(df).count() == len(rows)
