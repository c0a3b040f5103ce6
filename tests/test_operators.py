"""Operators on hand-made tables, and matching against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quirekit.functions.similarity import fuzzy
from quirekit.operators import aggregates, api, builders, corrections, layout, matching, rules, sequence, state, verification
from quirekit.sources import dom, files, html
from quirekit.streaming import queue


def greedy(edges, order):
    used_l, used_r, out = set(), set(), []
    for s, left, right in sorted(edges, key=order):
        if left not in used_l and right not in used_r:
            used_l.add(left)
            used_r.add(right)
            out.append((left, right, s))
    return sorted(out)


@pytest.mark.parametrize("image", [False, True])
def test_greedy_matching_equals_plain_python(spark, image):
    r = random.Random(4)
    groups = {g: list({(left, right): (r.randrange(5) / 4, left, right) for left, right in ((r.randrange(9), r.randrange(9)) for _ in range(40))}.values()) for g in range(6)}
    df = spark.createDataFrame([(g, left, right, s) for g, e in groups.items() for s, left, right in e], "g int, s int, t int, score double")
    got = matching.match_images(df, ["g"], 0.0) if image else matching.greedy_one_to_one(df, ["g"], "s", "t", [F.desc("score"), F.desc("s"), F.desc("t")])
    order = (lambda e: (-e[0], e[1], e[2])) if image else (lambda e: (-e[0], -e[1], -e[2]))
    rows = got.collect()
    for g, e in groups.items():
        assert sorted((x.s, x.t, x.score) for x in rows if x.g == g) == greedy(e, order)
    assert matching.match_images(df.limit(0), ["g"]).count() == 0


def test_block_matching_and_its_rest(spark):
    texts = ["the quick brown fox jumps", "lorem ipsum dolor sit amet", "nothing like it at all", "the quick brown fox jumped", "dolor sit amet lorem ipsum"]
    others = ["the quick brown fox jumps over", "lorem ipsum dolor amet", "the quick brown fox jumps"]
    side = lambda t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "doc int, ord long, norm string")
    got = matching.match_blocks(side(texts), side(others), ["doc"])
    want = greedy([(fuzzy(a, b), i, j) for i, a in enumerate(texts) for j, b in enumerate(others) if fuzzy(a, b) >= 0.75], lambda e: (-e[0], -e[1], -e[2]))
    assert sorted((x.s, x.t, x.score) for x in got.collect()) == want
    assert sorted(x.ord for x in matching.unmatched(side(texts), got, ["doc"], "s").collect()) == sorted(set(range(5)) - {s for s, _, _ in want})
    c = matching.coverage(side(texts), got, ["doc"]).first()
    assert (c.n, c.matched, c.coverage) == (5, 3, 0.6)
    assert matching.best_match(side(["zzz"]), side(others), ["doc"], 0.9).first().t is None


def test_asof_falls_back_and_blocks_change_nothing(spark):
    rows = [(u, i, (u * 7 + i * i) % 5 == 0) for u in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "u int, i long, m boolean")
    want = {}
    for u, i, _ in rows:
        marks = [j for v, j, m in rows if v == u and m and j != i]
        want[u, i] = max((j for j in marks if j < i), default=min((j for j in marks if j > i), default=None))
    for block in (3, 4096):
        got = sequence.asof_either_way(df, ["u"], "i", F.col("m"), F.col("i"), block).collect()
        assert {(x.u, x.i): x.anchor for x in got} == want


def test_keep_best_prefers_confidence_then_order(spark):
    df = spark.createDataFrame([("a", None, 0.5, 1), ("a", None, 0.9, 3), ("a", None, 0.9, 2), ("a", "p", 0.1, 4)], "type string, path string, confidence double, seq int")
    assert sorted((x.path or "", x.seq) for x in aggregates.keep_best(df, ["type", "path"], "confidence", ["seq"]).collect()) == [("", 2), ("p", 4)]


PAGE = """<html lang=en><head><title>A &amp; b</title><meta name=Author content="X"><meta property="og:t" content="y"><script type="application/json">{"k": 1}</script><script>window.D = {"z": 2}; var t="</p>";</script></head>
<body><nav><a href="/x">Menu here</a></nav><h1>First</h1><p>One <b>two</b><p>Three<div style="display: none"><p>Hidden text</div>
<h3>Deep</h3><ul><li>x<li>y</ul><ol><li>Explain rain.</li><li>Nothing</li></ol><p>4) What is it? (a) up (b) down</p>
<figure><img src="a.png" alt=""><figcaption>Fig 1</figcaption></figure><img data-src="/b.png"><table><tr><th>h</th><td></td></tr><tr><td>c</td><td>d</td></tr></table></body></html>"""


def test_html_elements(spark):
    df = spark.createDataFrame([(1, "http://s/p/", PAGE), (2, None, None), (3, None, "")], "page_id long, url string, html string")
    found = html.elements(df).cache()
    text = {r.dom_path: r for r in found.where("page_id = 1 and element = 'text'").collect()}
    assert [r.text for r in sorted(text.values(), key=lambda r: r.ord)][:5] == ["Menu here", "First", "One two", "Three", "Hidden text"]
    b = "html > body:nth-of-type(1)"
    assert not text[f"{b} > div:nth-of-type(1) > p:nth-of-type(1)"].visible and text[f"{b} > p:nth-of-type(2)"].visible
    m = html.metadata(found).where("page_id = 1").first()
    assert (m.title, m.lang, m.extra) == ("A & b", "en", {"author": "X", "og:t": "y"})
    assert sorted((r.attrs["id"], r.attrs["type"]) for r in found.where("element = 'data'").collect()) == [("", "application/json"), ("D", "window-global")]
    assert [(r.text, r.level, r.parent_path is None) for r in html.headings(found).orderBy("ord").collect()] == [("First", 1, True), ("Deep", 3, False)]
    assert [(r.number, r.text, r.options) for r in html.questions(found).orderBy("ord").collect()] == [("1", "Explain rain.", []), ("4", "What is it?", ["(a) up", "(b) down"])]
    images = found.where("element = 'image'").orderBy("ord").collect()
    assert [(r.src, r.caption) for r in images] == [("http://s/p/a.png", "Fig 1"), ("http://s/b.png", None)]
    assert found.where("element = 'table'").first().cells == [["h", ""], ["c", "d"]]
    assert sorted(r.page_id for r in found.where("element = 'document'").collect()) == [1, 2, 3]
    assert dom.serialize(dom.parse('<p a="x&quot;">1 &lt; 2<br><!-- c -->')) == '<p a="x&quot;">1 &lt; 2<br><!-- c --></p>'


def test_rules_find_planted_defects(spark):
    base = ["Introduction to the great river", "The river rises in the northern hills and runs south", "Many people live along its banks today", "Its water turns the wheels of seven mills", "In winter the upper part is frozen over"]
    pdf = spark.createDataFrame([(1, i, 1, "heading" if not i else "paragraph", True, t, t.lower()) for i, t in enumerate(base)], "doc long, ord long, page int, kind string, visible boolean, text string, norm string")
    here = [base[0], base[1], "Many people live on the banks of it now", base[4], "Sample watermark text of somebody else"]
    h = spark.createDataFrame([(1, i, f"p{i}", "heading" if not i else "paragraph", True, t, t.lower()) for i, t in enumerate(here)], "doc long, ord long, dom_path string, kind string, visible boolean, text string, norm string")
    pdf, h = rules.content(pdf), rules.content(h)
    matches = matching.match_blocks(pdf.select("doc", "ord", "norm"), h.select("doc", "ord", "norm"), ["doc"], 0.6).cache()
    marks = rules.watermark_rules(h.where("ord = 4").select("doc", "ord", "dom_path", "text", "norm", F.lit("hint").alias("reason")), pdf)
    found = rules.assembled([rules.text_rules(pdf, h, matches), marks, rules.extraction_warning(pdf)], F.lower("text")).orderBy("place").collect()
    assert {(r.type, r.dom_path, r.pdf_ord) for r in found} == {("WATERMARK", "p4", None), ("MISSING_TEXT", None, 3), ("TEXT_MISMATCH", "p2", 2)}
    missing = next(r for r in found if r.type == "MISSING_TEXT")
    best = max(fuzzy(base[3].lower(), t.lower()) for t in here)
    assert missing.confidence == pytest.approx(round(min(0.97, 0.62 + 0.75 - best), 3)) and missing.payload["position"] == "after" and missing.auto_fixable


def test_heading_question_order_image_and_layout_rules(spark):
    head = "doc long, ord long, title string, level int, page int"
    p = spark.createDataFrame([(1, 0, "A", 1, 1), (1, 1, "B", 2, 1), (1, 2, "C", 2, 2)], head)
    h = spark.createDataFrame([(1, 0, "A", 1, "p0"), (1, 1, "B", 3, "p1"), (1, 2, "X", 5, "p2")], "doc long, ord long, title string, level int, dom_path string")
    m = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 1.0)], "doc long, s long, t long, score double")
    anchors = spark.createDataFrame([(1, 1, 5, "q5"), (1, 2, 9, "q9"), (1, 3, 11, "q11")], "doc long, page int, ord long, dom_path string")
    got = rules.structure_rules(p, h, m, anchors).collect()
    assert {(r.type, r.severity, r.dom_path, r.target) for r in got} == {
        ("HEADING_LEVEL_MISMATCH", "MEDIUM", "p1", "p1"), ("MISSING_SECTION", "HIGH", None, "q9"), ("STRUCTURE_MISMATCH", "LOW", "p2", None), ("HEADING_LEVEL_MISMATCH", "LOW", "p2", "p2"),
    }
    q = "doc long, ord long, number string, text string, norm string, numbering_explicit boolean, answer string"
    pq = spark.createDataFrame([(1, 0, "1", "a", "a", True, "yes", 1), (1, 1, "2", "b", "b", True, None, 1)], q + ", page int")
    hq = spark.createDataFrame([(1, 0, "7", "a", "a", True, None, "ol > li:1"), (1, 1, "8", "a", "a", True, None, "ol > li:2")], q + ", dom_path string")
    qm = spark.createDataFrame([(1, 0, 0, 0.8)], "doc long, s long, t long, score double")
    got = rules.question_rules(pq, hq, qm).collect()
    assert sorted((r.type, r.severity) for r in got) == [("DUPLICATE_QUESTION", "MEDIUM"), ("MISSING_ANSWER", "MEDIUM"), ("MISSING_QUESTION", "HIGH"), ("QUESTION_MISMATCH", "LOW"), ("QUESTION_MISMATCH", "MEDIUM")]
    assert next(r for r in got if r.type == "MISSING_QUESTION").target == "ol"
    order = spark.createDataFrame([(1, i, t, f"x{t}", "s", "paragraph") for i, t in enumerate((0, 3, 1, 2, 4))], "doc long, s long, t long, dom_path string, section_path string, kind string")
    none = order.limit(0)
    assert [(r.dom_path, r.payload["after_dom_path"]) for r in rules.order_rules(none, order).collect()] == [("x3", "x0")]
    image = "doc long, ord long, caption string, page int"
    ip = spark.createDataFrame([(1, 0, "Cap", 1), (1, 1, "Other", 1), (1, 2, None, 2), (1, 3, None, 2)], image)
    ih = spark.createDataFrame([(1, 0, "a", "", None, "s"), (1, 1, "b", None, None, "s"), (1, 2, "c", None, "dead", "s"), (1, 3, "d", None, None, "s")], "doc long, ord long, dom_path string, alt string, error string, src string")
    pair = lambda *x: spark.createDataFrame([(1, *v) for v in x], "doc long, s long, t long")
    got = rules.image_rules(ip, ih, pair((0, 0)), pair((1, 1)), pair((2, 2)), spark.createDataFrame([(1, 3, "z", "after")], "doc long, s long, anchor string, position string"), spark.createDataFrame([(1, True)], "doc long, reliable boolean")).collect()
    assert sorted((r.type, r.confidence) for r in got) == [("EXTRA_IMAGE", 0.6), ("IMAGE_MISMATCH", 0.92), ("IMAGE_MISMATCH", 0.95), ("MISSING_ALT_TEXT", 0.97), ("MISSING_IMAGE", 0.96)]


def test_corrections_are_planned_and_applied(spark):
    page = "<html><body><header><p>Top</p></header><h1>T</h1><p>First one</p><ul><li>a</li></ul><h2>S2</h2><p>body two</p><h2>S1</h2><p>body one</p><img src='x/a.png'><p>Watermark</p></body></html>"
    at = dom.paths(dom.parse(page))
    root = dom.parse(page)
    at = {n.tag + n.text()[:8]: path for n in root.elements() for path in [dom.paths(root)[id(n)]]}
    steps = [
        ("SET_ALT_TEXT", at["img"], {"alt": "A"}), ("FIX_HEADING_LEVEL", at["h1T"], {"level": "2"}), ("INSERT_TEXT", at["lia"], {"text": "one", "tag": "p", "position": "after"}), ("INSERT_TEXT", at["lia"], {"text": "two", "tag": "p", "position": "after"}),
        ("REMOVE_WATERMARK", at["pWatermar"], {}), ("INSERT_TEXT", at["pTop"], {"text": "never", "position": "after"}), ("REORDER_ELEMENT", at["h2S2"], {"scope": "section", "after_scope": "section", "after_dom_path": at["h2S1"]}),
        ("REPLACE_IMAGE", "stale", {"target_src": "http://c/a.png", "hosted_url": "http://c/new.png"}), ("REPLACE_TEXT", at["h1T"], {}),
    ]
    todo = spark.createDataFrame([(1, "OPEN", a, 0.99, True, 0, i, t, p) for i, (a, t, p) in enumerate(steps)], "doc long, status string, action string, confidence double, auto_fixable boolean, list int, seq int, target string, payload map<string,string>")
    plan = corrections.plan(todo)
    assert [r.action for r in plan.orderBy("step").collect()][:4] == ["SET_ALT_TEXT", "REPLACE_IMAGE", "INSERT_TEXT", "INSERT_TEXT"]
    done = corrections.applied(spark.createDataFrame([(1, page), (2, "<p>x")], "doc long, html string"), plan)
    rows = {r.doc: r for r in done.collect()}
    out = rows[1].html
    assert '<img src="http://c/new.png" alt="A" data-inserted="replaced">' in out and "Watermark" not in out and "never" not in out
    assert "</ul><p data-inserted=\"text\">one</p><p data-inserted=\"text\">two</p>" in out and out.index("body one") < out.index("body two") and "<h2>T</h2>" in out
    assert sorted(s.error or "" for s in rows[1].steps)[-2:] == ["no anchor in the content", "unsupported action REPLACE_TEXT"]
    assert rows[2].html == "<p>x</p>" and rows[2].steps == []


def test_verification(spark):
    issue = "doc long, type string, severity string, dom_path string, status string"
    before = spark.createDataFrame([(1, "A", "HIGH", "p", "AUTO_FIXED"), (1, "B", "LOW", None, "AUTO_FIXED"), (1, "C", "LOW", "r", "OPEN")], issue)
    after = spark.createDataFrame([(1, "B", "LOW", None, "OPEN"), (1, "B", "LOW", "new", "OPEN"), (1, "D", "MEDIUM", "n", "OPEN")], issue)
    keys = ["doc", "type", "dom_path"]
    out = verification.issue_diff(before, after, keys, "type", ["doc"])
    assert sorted((r.type, r.dom_path or "", r.outcome) for r in out.collect()) == [("A", "p", "resolved"), ("B", "", "unresolved"), ("B", "new", "knock-on"), ("C", "r", "resolved"), ("D", "n", "regression")]
    assert sorted((r.type, r.status) for r in verification.reopened(before, out, keys).collect()) == [("A", "AUTO_FIXED"), ("B", "OPEN"), ("C", "OPEN")]
    counts = spark.createDataFrame([(1, 9, 10, 0, 0, 0, 0, 1, 1, 0.95, 1.0)], "doc long, matched_text int, n_text int, matched_image int, n_image int, matched_structure int, n_structure int, matched_question int, n_question int, `order` double, layout double")
    s = verification.scores(counts)
    assert s.first().overall == round(0.3 * 0.9 + 0.15 + 0.095 + 0.15 + 0.05, 4)
    v = verification.verified(s, after, out).first()
    assert (v.n_resolved, v.n_unresolved, v.n_regressions, v.n_knock_on, v.passed) == (2, 1, 1, 1, False) and v.quality == pytest.approx(s.first().overall - 0.06)


def test_layout_of_printed_pages(spark):
    line = lambda p, top, x0, t, size=10.0, font="Serif": (1, p, float(top), float(top) + 10, float(x0), float(x0) + 100, size, font, t)
    rows = [line(1, 100, 50, "A heading", 16.0, "Serif-Bold"), line(1, 130, 50, "first line"), line(1, 142, 50, "second line"), line(1, 180, 50, "Figure 2: cap"), *(line(p, 780, 50, "Running title") for p in (1, 2, 3))]
    lines = spark.createDataFrame(rows, "doc long, page int, top double, bottom double, x0 double, x1 double, size double, font string, text string")
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in (1, 2, 3)], "doc long, page int, width double, height double")
    blocks = layout.furniture(layout.text_blocks(lines), pages)
    assert [(r.text, r.kind) for r in blocks.orderBy("ord").collect()][:4] == [("A heading", "heading"), ("first line second line", "paragraph"), ("Figure 2: cap", "caption"), ("Running title", "furniture")]
    figures = spark.createDataFrame([(1, 0, 1, (50.0, 100.0, 90.0, 175.0)), (1, 1, 2, (0.0, 0.0, 9.0, 9.0))], "doc long, s int, page int, box struct<x0: double, top: double, x1: double, bottom: double>")
    assert [r.caption for r in layout.captions(figures, blocks).orderBy("s").collect()] == ["Figure 2: cap", None]
    shapes = [(100 + 10 * i, 300, 108 + 10 * i, 340) for i in range(4)] + [(50, 700, 590, 701)] + [(40 * i + 60, 500, 40 * i + 64, 506) for i in range(8)]
    found = layout.figure_boxes([tuple(map(float, s)) for s in shapes], [((90.0, 310.0, 104.0, 320.0), "Axis")], 600.0, 800.0)
    assert any(b[0] <= 90 and b[2] >= 138 for b in found) and not any(b[1] > 690 for b in found)
    assert layout.figure_boxes([], [], 600.0, 800.0) == []


def test_store_and_its_refusals(spark):
    t = lambda s, *rows: spark.createDataFrame(list(rows), s)
    store = api.Store(
        t("id string, name string", ("p", "P")), t("id string, project_id string, type string, created_at int", ("d1", "p", "PDF", 1), ("d2", "p", "PDF", 2)),
        t("id string, project_id string, status string, progress int, image_start_number int, created_at int, logs array<string>", ("j", "p", "FAILED", 40, 1, 1, ["a", "b"]), ("k", "p", "COMPLETED", 100, 1, 2, [])),
        t("id string, project_id string, job_id string, type string, severity string, status string, confidence double, auto_fixable boolean, suggestion string, selector string, html_text string, pdf_text string, message string, created_at int",
          ("i1", "p", "j", "MISSING_TEXT", "CRITICAL", "PENDING_REVIEW", 0.97, True, "fix", "s", None, None, "m", 1), ("i2", "p", "j", "FORMATTING", "INFO", "APPROVED", 0.5, False, None, "s", None, None, "m", 2)),
        t("id string, issue_id string, job_id string, selector string, before string, after string, applied_by string, status string", ("c", "i2", "j", "s", "", "x", "MANUAL", "APPLIED")),
    )
    assert tuple(api.health(store).first()) == (2, 0, 0)
    p = api.projects_with_stats(store).first()
    assert (p.documents, p.jobs, p.completed, p.pending) == (2, 2, 1, 1)
    rows, counters = api.job_issues(store, "j", severity="critical")
    assert [r.id for r in rows.collect()] == ["i1"] and {r.counter: r.n for r in counters.collect()} == {"CRITICAL": 1, "status:PENDING_REVIEW": 1}
    report = api.job_report(store, "j").first()
    assert (report.total, report.quality_score, report.corrections_applied, len(report.recommendations)) == (2, 90, 1, 2)
    assert api.job_report(store, "k").first().recommendations == ["No issues detected"]
    after, jobs = api.decide(api.Store(store.projects, store.documents, store.jobs, store.issues, store.corrections.drop("id", "job_id")), t("id string", ("i1",), ("i2",)), "PENDING_REVIEW")
    assert sorted((r.id, r.status) for r in after.issues.collect()) == [("i1", "AUTO_FIXED"), ("i2", "PENDING_REVIEW")]
    assert after.corrections.first().status == "REVERTED" and [r.job_id for r in jobs.collect()] == ["j"]
    retried = api.change_job(store, "j", "retry")
    assert api.one(retried.jobs, "j").first()[2:4] == ("QUEUED", 0)
    for job, action, value, code in (("k", "cancel", None, 409), ("k", "retry", None, 409), ("j", "set-image-start", "0", 400), ("none", "cancel", None, 404)):
        with pytest.raises(api.Refused) as e:
            api.change_job(store, job, action, value)
        assert e.value.code == code
    assert api.delete(store, "jobs", "j").jobs.count() == 1 and store.jobs.where("id = 'j'").select(state.reversed_logs(F.col("logs")).alias("l")).first().l == ["b", "a"]
    assert api.last_documents(store).first().id == "d2"


def test_files_and_builders(spark, tmp_path):
    (tmp_path / "a.html").write_bytes('<meta charset="latin-1">é'.encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("é".encode())
    got = files.read_bytes(spark, str(tmp_path)).withColumn("text", files.decoded(F.col("content"), F.lit(None).cast("string"))).orderBy("path").collect()
    assert [r.text for r in got] == ['<meta charset="latin-1">é', "é"] and len(got[0].checksum) == 64
    a = lambda u: files.asset_id(F.lit(u), "cdn.x")
    assert tuple(spark.range(1).select(a("https://cdn.x/u/upload/w_100,c_fit/v12/books/one.pdf").alias("a"), a("https://other/upload/x.pdf").alias("b")).first()) == ("books/one", None)
    blocks = spark.createDataFrame([(1, 0, "paragraph", None, "pre & post"), (1, 1, "heading", 2, "One"), (1, 2, "paragraph", None, "x"), (2, 0, "paragraph", None, "y")], "doc long, ord int, kind string, level int, text string")
    r = {x.doc: x for x in builders.rendered(blocks, "None").collect()}
    assert r[1].title == "One" and r[1].n_sections == 2 and '<section id="s1"><p>pre &amp; post</p></section><section id="s2"><h2>One</h2><p>x</p></section>' in r[1].html and r[2].title == "None"
    p = "doc long, position int, title string, heading_levels array<int>, n_images int, numbers array<long>"
    x, y = spark.createDataFrame([(1, 1, "t", [1, 2], 2, [1, 3]), (1, 2, "t", [], 0, [])], p), spark.createDataFrame([(1, 1, "t", [1], 2, [1, 4])], p)
    assert sorted(v.problem for v in builders.structure_problems(x, y).collect()) == ["headings: 2 and 1", "numbers missing in a: 2", "numbers missing in b: 2,3", "questions only in a: 3", "questions only in b: 4", "section only in a"]


def test_queue_states_and_slots(spark):
    e = spark.createDataFrame([("a", 1, 1, "QUEUED"), ("a", 2, 2, "CANCELLED"), ("a", 3, 3, "PROCESSING"), ("b", 1, 4, "CANCELLED"), ("b", 2, 5, "QUEUED"), ("b", 3, 6, "PROCESSING"), (None, 1, 7, "QUEUED")], "id string, at int, seq int, status string")
    assert {r.id: r.status for r in queue.folded_states(e, "id", "at", "seq", "status").collect()} == {"a": "CANCELLED", "b": "PROCESSING"}
    jobs = spark.createDataFrame([(str(i), s, i) for i, s in enumerate(("PROCESSING", "QUEUED", "QUEUED", "COMPLETED"))], "id string, status string, created_at int")
    assert [r.id for r in queue.running_slots(jobs, 2).collect()] == ["1"] and queue.poll_delay(3) == 3 and queue.poll_delay(20) == 10
