"""Scalar functions on hand-made values, and similarity kernels against plain dynamic programming."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quirekit.functions import classify, geometry, hashing, misc, text
from quirekit.functions import similarity as sim
from quirekit.operators.sequence import increasing_members


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_kernels_equal_plain_versions():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randrange(14))).strip()
    for _ in range(600):
        a, b = word(), word()
        want = 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert sim.lcs_length(a, b) == lcs(a, b) and sim.ratio(a, b) == want
        short, long = sorted((a, b), key=len)
        n, m = len(short), len(long)
        windows = [long[max(0, e - n) : min(m, e)] for e in range(1, m + n)]
        best = max((2 * lcs(short, w) / (n + len(w)) for w in windows), default=0.0) if n else 0.0
        assert sim.partial_ratio(a, b) == pytest.approx(best)
        s, t = set(a.split()), set(b.split())
        if s and t:
            both, x, y = (" ".join(sorted(v)) for v in (s & t, s - t, t - s))
            joined = [both, f"{both} {x}".strip(), f"{both} {y}".strip()]
            pairs = [(joined[1], joined[2]), *(((both, joined[1]), (both, joined[2])) if both else ())]
            assert sim.token_set_ratio(a, b) == pytest.approx(1.0 if both and not (x and y) else max(2 * (lcs(both, both) + (1 if both and p == joined[1] and q == joined[2] else 0) + lcs(x, y)) / (len(p) + len(q)) if (p, q) == pairs[0] else 2 * len(both) / (len(p) + len(q)) for p, q in pairs))


def test_blended_score_edges():
    assert sim.fuzzy("", "a") == sim.fuzzy(None, "a") == 0.0 and sim.fuzzy("a b", "a b") == 1.0
    assert sim.fuzzy("b a", "a b") == 0.9
    assert sim.fuzzy("needle", "a long text around the needle here") >= 0.85
    assert sim.order_ratio([], []) == 1.0 and sim.order_ratio([1], []) == 0.0 and sim.order_ratio([1, 2, 3], [2, 3, 1]) == 0.6667


def test_increasing_members_are_a_longest_increasing_subsequence():
    r = random.Random(2)
    for _ in range(200):
        v = [r.randrange(9) for _ in range(r.randrange(12))]
        got = increasing_members(v)
        assert all(a < b and v[a] < v[b] for a, b in zip(got, got[1:], strict=False))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best, default=0)


def test_normalize(spark):
    lit = F.lit
    got = one(spark, text.normalize(lit("  “Ex­am‑\nple”  ﬁne…  Été! ")), text.normalize(lit("A, B"), keep_punctuation=True), text.normalize(lit(None).cast("string")), text.normalize(lit("A b"), lowercase=False))
    assert got == ("example fine été", "a, b", "", "A b")
    assert one(spark, text.squash(lit("x × Y – z")), text.strip_cid_tokens(lit("a (cid:12) b (cid:3)")), text.clip(lit(" a\nb "), 9), text.clip(lit("abcdef"), 4)) == ("xxy-z", "a b", "a b", "abc…")
    assert one(spark, text.split_sentences(lit("One. Two?  Three")), text.tokenize(lit("")))[0] == ["One.", "Two?", "Three"]


def test_strings(spark):
    lit = F.lit
    assert one(spark, *(text.csv_cell(lit(x)) for x in ("a", 'a"b', "a,b", None))) == ("a", '"a""b"', '"a,b"', "")
    assert one(spark, *(text.format_bytes(lit(x)) for x in (0, 5, 1536, 5 << 20, 3 << 30, None))) == ("—", "5 B", "1.5 KB", "5.0 MB", "3.0 GB", "—")
    assert one(spark, text.strip_blank_placeholders(lit("[blank]<td class=a> </td><th></th>"))) == ("<td class=a>&nbsp;</td><th>&nbsp;</th>",)
    assert one(spark, text.merge_style(lit("a:1; b: url(x:y)"), lit("A: 2;c:3"))) == ("a: 2; b: url(x:y); c: 3",)


def test_classes(spark):
    lit = F.lit
    heavy = [classify.symbol_heavy(lit(x)) for x in ("x2 + y2 = z2 + 11 = 4", "All perfect squares end with 0, 1, 4, 5, 6 or 9", "a+b", None)]
    assert one(spark, *heavy) == (True, False, False, False)
    assert one(spark, *(classify.looks_like_question(lit(x)) for x in ("3. What is light?", "(iv) explain it", "What is light?", "3. a dog", "1.?"))) == (True, True, False, False, False)
    q = one(spark, classify.parse_question(lit("Q 3) Choose one (a) red (B) blue")), classify.parse_question(lit("no number")))
    assert (q[0].number, q[0].text, q[0].options, q[1]) == ("3", "Choose one", ["(a) red", "(b) blue"], None)
    assert one(spark, *(classify.watermark_hint(lit(x)) for x in ("a sample of watermark", "www.x", "plain", "sample " * 30))) == ("watermark", "www.", None, None)
    assert one(spark, *(classify.math_line(lit(x)) for x in ("1 + 3 = 4", "1 2 3", "x2 = 4 9 16 25", "abc = def", "=="))) == (True, False, True, False, False)
    assert one(spark, *(classify.unreadable(lit(x)) for x in ("(cid:1)(cid:2)", "a (cid:1) long enough text around a token here", "\u0001\u0002a", "", None, "plain"))) == (True, False, True, False, False, False)
    assert one(spark, *(classify.block_kind(lit(x), lit(False)) for x in ("Figure 3: x", "• item", "b) item", "text"))) == ("caption", "list_item", "list_item", "paragraph")
    head = lambda t, size, bold: classify.heading(lit(t), lit(size), lit(bold), lit(10.0))
    assert one(spark, head("A title", 11.0, False), head("A title", 10.0, False), head("A title", 9.9, True), head("ALL CAPS.", 10.0, False), head("A title.", 12.0, False), head("12", 12.0, False)) == (True, False, True, True, False, False)
    assert one(spark, *(classify.confidence_band(lit(x)) for x in (0.9, 0.8, 0.79))) == ("high", "medium", "low")
    assert one(spark, classify.label_like(lit("Level 1")), classify.label_like(lit("Done.")), classify.print_artifact(lit("Chapter 1.indd 4  10-07-2025 14:06:40"))) == (True, False, True)
    d = one(spark, *(classify.fix_decision(lit(s), lit(c), lit(a), lit(x)) for s, c, a, x in (("REJECTED", True, True, 1.0), ("APPROVED", True, False, 0.1), ("OPEN", False, True, 1.0), ("OPEN", True, False, 1.0), ("OPEN", True, True, 0.9), ("OPEN", True, True, 0.95))))
    assert [x.apply for x in d] == [False, True, False, False, False, True]


def test_geometry(spark):
    b = lambda *x: geometry.box(*(F.lit(v).cast("double") for v in x))
    a, c, none = b(0, 0, 4, 4), b(6, 2, 2, 6), b(None, 0, 1, 1)
    assert one(spark, geometry.intersection_area(a, c), geometry.iou(a, c), geometry.overlaps(a, c), geometry.overlaps(a, c, 0.5), geometry.distance(a, c), geometry.iou(a, none), geometry.distance(a, none)) == pytest.approx((4.0, 4 / 28, True, False, 8**0.5, 0.0, float("inf")))
    assert one(spark, *(geometry.horizontal_alignment(b(x, 0, x + 10, 1), F.lit(100.0)) for x in (45, 5, 85)), geometry.horizontal_alignment(none, F.lit(100.0)), geometry.horizontal_alignment(a, F.lit(0.0))) == ("center", "left", "right", "unknown", "unknown")
    assert one(spark, geometry.to_float(F.lit("12.5px")), geometry.to_float(F.lit("x")), geometry.char_colour(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0))), geometry.char_colour(F.array(F.lit(0.0)))) == (12.5, None, "#ff7f00", "#000000")
    assert tuple(one(spark, geometry.clamped(b(-5, 1, 50, 9), F.lit(40.0), F.lit(8.0)))[0]) == (0.0, 1.0, 40.0, 8.0) and one(spark, geometry.clamped(b(39, 0, 50, 9), F.lit(40.0), F.lit(8.0))) == (None,)


def test_hashes(spark):
    lit = F.lit
    h = lambda a, b: hashing.hamming_distance(lit(a), lit(b))
    assert one(spark, h("ff00000000000000", "0f00000000000001"), h("ff", "f"), h("zz", "ff"), h(None, "ff")) == (5, None, None, None)
    score = lambda sha, p, d, s=None: hashing.image_score(lit(sha), lit("s"), lit("00"), lit(p), lit("00"), lit(d), lit(10.0), lit(5.0), lit(20.0), lit(10.0), s)
    assert one(spark, score("s", "ff", None), score("x", "00", None), score("x", "0f", "01"), score("x", "00", None, lit(0.5)), score("x", "00", "00", lit(0.5))) == pytest.approx((1.0, 1.0, round(0.55 * (1 - 4 / 64) + 0.25 * round(1 - 1 / 64, 4) + 0.2, 4), 0.825, 0.85))


def test_misc(spark):
    at, now = F.lit(datetime(2024, 5, 1, 12)), lambda **k: F.lit(datetime(2024, 5, 1, 12)) + F.make_dt_interval(**{n: F.lit(v) for n, v in k.items()})
    assert one(spark, *(misc.relative_time(at, now(**k)) for k in ({"secs": 20}, {"mins": 5}, {"hours": 3}, {"days": 4}, {"days": 45})), misc.relative_time(F.lit(None).cast("timestamp"), now(days=1))) == ("just now", "5m ago", "3h ago", "4d ago", "1 May 2024", "—")
    assert one(spark, *(misc.image_start_number(F.lit(x)) for x in ("7", "0", "x", None)), misc.window_json(F.lit('window.a = {"k": 1};'))) == (7, 1, 1, 1, '{"k": 1}')
    m = misc.overlay(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert one(spark, m, misc.filled_ratio(F.array(F.array(F.lit("a"), F.lit(" ")))), misc.suffix(F.lit("http://x/a.PNG?v=1")), misc.same_src(F.lit("a/b.png"), F.lit("http://c/b.png?x"))) == ({"a": "1", "b": "3"}, 0.5, ".png", True)


def test_shown_sizes_round_as_printf_does(spark):
    r = random.Random(3)
    sizes = [k / 20 * 1024**i for i in (1, 2, 3) for k in range(21, 400, 2)] + [858214.4, 0.5, 1.5, 2.5, 1023.5] + [r.uniform(1024, 1e13) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in sizes], "x double").select("x", text.format_bytes(F.col("x")).alias("shown")).collect()

    def shown(x):
        i = sum(x >= 1024**k for k in (1, 2, 3))
        return f"{x / 1024**i:.{min(i, 1)}f} {('B', 'KB', 'MB', 'GB')[i]}"

    assert [(x.x, x.shown) for x in got] == [(x, shown(x)) for x in sizes]
