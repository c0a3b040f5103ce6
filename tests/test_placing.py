"""Operators that place things: context, anchors, panels, containment, stamps and hidden panels, on hand-made tables."""

from pyspark.sql import functions as F

from quirekit.functions import geometry
from quirekit.operators import builders, corrections, matching
from quirekit.sources import html

BOX = "struct<x0: double, top: double, x1: double, bottom: double>"


def test_placeholders_and_figures_meet_by_their_neighbours(spark):
    block = lambda page, top, norm, ok=True: (1, page, (0.0, float(top), 100.0, float(top) + 20), norm, ok)
    blocks = spark.createDataFrame([
        block(1, 100, "the river rises in the hills"), block(1, 400, "mills stand along its banks"), block(1, 120, "an equation", False),
        block(1, 700, "the last words of the page stand here"), block(2, 600, "something else entirely on page two"),
    ], f"doc int, page int, box {BOX}, norm string, eligible boolean")
    figures = spark.createDataFrame([(1, 0, 1, (0.0, 150.0, 90.0, 380.0)), (1, 1, 2, (0.0, 50.0, 90.0, 200.0)), (1, 2, 1, None)], f"doc int, s int, page int, box {BOX}")
    holes = spark.createDataFrame([(1, 0, "the last words of the page stand here"), (1, 1, "mills stand along its banks"), (1, 2, ""), (1, 3, "the river rises in the hills")], "doc int, t int, norm string")
    got = matching.match_by_context(holes, figures, blocks, ["doc"]).collect()
    assert sorted((r.s, r.t, round(r.score, 3)) for r in got) == [(0, 1, 1.0), (1, 0, 0.95)]
    assert matching.match_by_context(holes.limit(0), figures, blocks, ["doc"]).count() == 0


def test_figures_are_anchored_by_caption_then_place(spark):
    blocks = spark.createDataFrame([(1, 0, 1, 100.0, "intro text", "p0"), (1, 1, 1, 140.0, "figure one shows a mill", "p1"), (1, 2, 2, 90.0, "page two", "p2")], "doc int, ord int, page int, bottom double, norm string, dom_path string")
    figures = spark.createDataFrame([(1, 0, 1, 300.0, "figure one shows a mill"), (1, 1, 1, 101.0, ""), (1, 2, 3, 50.0, "")], "doc int, s int, page int, top double, norm string")
    assert [(r.anchor, r.position) for r in builders.anchors_for_images(figures, blocks).orderBy("s").collect()] == [("p1", "before"), ("p0", "after"), (None, "after")]


def test_sections_go_to_the_panels_that_their_votes_elect(spark):
    sections = spark.createDataFrame([(1, i, f"<s{i}>") for i in range(4)], "doc int, section int, markup string")
    votes = spark.createDataFrame([(1, 0, "a", 1.0, 20), (1, 0, "a", 1.0, 20), (1, 0, "b", 1.0, 99), (1, 1, "b", 1.0, 10), (1, 2, "c", 0.5, 4)], "doc int, section int, panel string, score double, words int")
    panels = spark.createDataFrame([(1, "z", 0), (1, "a", 1)], "doc int, panel string, ord int")
    got = {r.panel: r.markup for r in builders.merged_into_panels(sections, votes, panels).collect()}
    assert got == {"a": "<s0>", "b": "<s1><s2><s3>"}


def test_containment_and_neighbourhood(spark):
    parts = spark.createDataFrame([(1, "ab"), (1, ""), (2, "zz")], "doc int, squashed string")
    wholes = spark.createDataFrame([(1, "xaby"), (2, "xaby")], "doc int, whole string")
    assert [tuple(r) for r in matching.squashed_containment(parts, wholes, ["doc"]).collect()] == [(1, "ab", "xaby")]
    b = lambda top, bottom: geometry.box(F.lit(0.0), F.lit(float(top)), F.lit(1.0), F.lit(float(bottom)))
    assert tuple(spark.range(1).select(geometry.beside(b(0, 10), b(5, 30)).alias("x"), geometry.beside(b(0, 10), b(6, 30)).alias("y"), geometry.contains_centre(b(0, 10), b(8, 12)).alias("z")).first()) == (True, False, True)
    points = spark.createDataFrame([(1, 5.0, 5.0), (1, 9.0, 1.0), (2, 5.0, 5.0)], "page int, x double, y double")
    boxes = spark.createDataFrame([("a", 1, 0.0, 0.0, 5.0, 9.0), ("b", 1, 5.0, 5.0, 5.0, 5.0)], "id string, page int, x0 double, top double, x1 double, bottom double")
    assert sorted((r.id, r.x) for r in matching.point_in_box(points, boxes, ["page"], "x", "y", 2.0).collect()) == [("a", 5.0), ("b", 5.0)]
    paths = spark.createDataFrame([("a > b > c",), ("a > bb",)], "p string")
    assert [tuple(r) for r in matching.prefix_join(paths, spark.createDataFrame([("a > b",), ("a > b > c > d",)], "q string"), "p", "q").collect()] == [("a > b > c", "a > b")]


def test_figures_of_a_page_and_parts_of_a_section(spark):
    row = lambda page, area, key, error=None, deco=False: (1, page, 5, float(area), 1000.0, key, error, deco)
    images = spark.createDataFrame([row(1, 100, "a"), row(1, 0.5, "b"), row(1, 900, "c"), row(1, 100, "d", "bad"), row(1, 100, "e", None, True), *(row(p, 100, "r") for p in (1, 2, 3))], "doc int, page int, pages int, area double, page_area double, source_key string, error string, decorative boolean")
    assert [r.source_key for r in builders.page_images(images).collect()] == ["a"]
    parts = spark.createDataFrame([(1, "12"), (1, "1 2 3"), (1, "a word"), (1, "matched"), (1, "1 2 3 4")], "doc int, text string")
    assert sorted(r.text for r in builders.missing_in_section(parts, spark.createDataFrame([(1, "matched")], "doc int, text string"), ["doc", "text"]).collect()) == ["1 2 3 4", "a word"]


def test_stamps_hidden_panels_and_geometry(spark):
    page = spark.createDataFrame([('<html><head><base href="x"><script>go()</script><script type="application/json">{}</script></head><body>a</body></html>',)], "h string")
    stamped = page.select(corrections.frozen(corrections.stamped(corrections.stamped(F.col("h"), F.lit(1), "T"), F.lit(2), "T")).alias("h")).first().h
    assert stamped == '<html><head><script type="application/json">{}</script><!-- corrections: 2 applied T --></head><body>a</body></html>'
    words = "word " * 50
    markup = f'<body><div hidden><section><p>{words}</p></section><p>{words}</p></div><div style="opacity: 0"><p>short</p></div><p>{words}</p></body>'
    found = html.elements(spark.createDataFrame([(1, markup)], "page_id long, html string"))
    assert [r.dom_path for r in html.hidden_panels(found).collect()] == ["body:nth-of-type(1) > div:nth-of-type(1)"]
    g = spark.createDataFrame([(1, "body:nth-of-type(1) > p:nth-of-type(1)", (0.0, 0.0, 1.0, 1.0), False, 1.0, 10.0, "700")], f"page_id long, dom_path string, box {BOX}, shown boolean, opacity double, font_size double, font_weight string")
    r = html.with_geometry(found.where("element = 'text'"), g).where("box is not null").first()
    assert (r.visible, r.bold, r.font_size) == (False, True, 10.0)
