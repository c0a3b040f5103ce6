"""Join queries: matching, anti, as-of, spatial and positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, hashing
from ..functions.similarity import jaccard
from ..functions.text import normalize, normalize_sql, tokenize
from ..operators import images, matching
from ..sources.tables import table
from .catalog import register

_NORM_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Rows up to which a table may be broadcast once it is counted.
BROADCAST_ROWS = 100_000
#: Jaccard similarity of words from which a document and a passage are linked.
LEAST_JACCARD = 0.15


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint, if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1's edges by U3: documents and passages that share words, through an inverted index of the passages' words."""
    words = lambda df, id_: df.select(id_, F.array_distinct(tokenize(normalize_sql(F.col("text")))).alias("words")).where(F.size("words") > 0)
    docs, items = words(table(spark, sf_dir, "documents").where("text is not null"), "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id")
    # The index is of the passages; a document meets only those with which it has a word in common.
    index = items.select(F.explode("words").alias("word"), "item_id", F.size("words").alias("m"))
    common = docs.select("doc_id", F.size("words").alias("n"), F.explode("words").alias("word")).join(small(index), "word")
    return common.groupBy("doc_id", "item_id", "n", "m").agg(F.count("*").alias("common")).select("doc_id", "item_id", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("score")).where(F.col("score") >= LEAST_JACCARD)


_EDGES_SQL = f"""
d AS (SELECT doc_id, list_distinct(list_filter(string_split({_NORM_SQL.format("text")}, ' '), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_distinct(list_filter(string_split({_NORM_SQL.format("text")}, ' '), lambda w: w <> '')) AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d), iw AS (SELECT item_id, len(w) AS m, unnest(w) AS word FROM i),
e AS (SELECT doc_id, item_id, round(CAST(count(*) AS DOUBLE) / (n + m - count(*)), 6) AS score FROM dw JOIN iw USING (word) GROUP BY doc_id, item_id, n, m HAVING round(CAST(count(*) AS DOUBLE) / (n + m - count(*)), 6) >= {LEAST_JACCARD})"""


@register("token_jaccard_join", f"WITH {_EDGES_SQL} SELECT * FROM e")
def token_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, J1's edges."""
    return token_edges(spark, sf_dir)


@register("unmatched_both_sides", f"""
WITH {_EDGES_SQL} SELECT 'document' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT 'passage', item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM e)""")  # fmt: skip
def unmatched_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    edges = token_edges(spark, sf_dir)
    side = lambda name, id_, of: table(spark, sf_dir, name).join(edges.select(id_).distinct(), id_, "left_anti").select(F.lit(of).alias("side"), F.col(id_).alias("id"))
    return side("documents", "doc_id", "document").union(side("benchmark", "item_id", "passage"))


@register("token_containment_match", f"""
SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {_NORM_SQL.format("text")} || ' ' AS t FROM documents) JOIN (SELECT item_id, ' ' || {_NORM_SQL.format("text")} || ' ' AS p FROM benchmark) ON contains(t, p) AND p <> '  '""")  # fmt: skip
def token_containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages inside documents. Only documents that have a passage's longest word are searched for it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", normalize_sql(F.col("text")).alias("part")).where("part <> ''")
    longest = F.array_max(F.transform(F.split("part", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    index = small(items.select("item_id", "part", longest["w"].alias("word")))
    docs = table(spark, sf_dir, "documents").select("doc_id", normalize_sql(F.col("text")).alias("whole")).where("whole <> ''")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    words = docs.select("doc_id", "whole", F.explode(F.array_distinct(F.split("whole", " "))).alias("word"))
    return words.join(index, "word").where(F.contains(pad("whole"), pad("part"))).select("doc_id", "item_id")


@register("fuzzy_indel_match_greedy")
def fuzzy_indel_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a conversation's questions matched to lines of its answers, one to one."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("norm", normalize(F.col("line"))).where("norm <> ''")
    ord_ = (F.col("turn") * 10_000 + F.col("i")).alias("ord")
    side = lambda role: lines.where(F.col("role") == role).select("conv_id", ord_, "norm")
    return matching.match_blocks(side("user"), side("assistant"), ["conv_id"])


@register("greedy_one_to_one_match", """
WITH RECURSIVE s AS (SELECT l_orderkey AS g, l_partkey % 4 AS l, l_suppkey % 4 AS r, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS score FROM lineitem GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, l DESC, r DESC) AS i FROM s),
w AS (SELECT g, i, [l] AS ls, [r] AS rs, [score] AS ss FROM e WHERE i = 1
  UNION ALL SELECT w.g, e.i, CASE WHEN list_contains(ls, e.l) OR list_contains(rs, e.r) THEN ls ELSE list_append(ls, e.l) END, CASE WHEN list_contains(ls, e.l) OR list_contains(rs, e.r) THEN rs ELSE list_append(rs, e.r) END,
    CASE WHEN list_contains(ls, e.l) OR list_contains(rs, e.r) THEN ss ELSE list_append(ss, e.score) END FROM w JOIN e ON e.g = w.g AND e.i = w.i + 1)
SELECT g, unnest(ls) AS l, unnest(rs) AS r, unnest(ss) AS score FROM (SELECT g, ls, rs, ss FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1)""")  # fmt: skip
def greedy_one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1's matching on sums of prices, ties to the greater ends; one order is a group."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 4).alias("l"), (F.col("l_suppkey") % 4).alias("r")).agg(F.round(F.sum("l_extendedprice") * 100).cast("long").alias("score"))
    return matching.greedy_one_to_one(edges, ["g"], "l", "r", [F.desc("score"), F.desc("l"), F.desc("r")])


@register("claims_in_turn", """
WITH RECURSIVE s AS (SELECT l_orderkey AS g, l_linenumber AS l, l_suppkey % 5 AS r, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
o AS (SELECT g, l, list({'r': r, 'score': score} ORDER BY score DESC, r) AS c, row_number() OVER (PARTITION BY g ORDER BY l) AS i FROM s GROUP BY g, l),
w AS (SELECT g, i, [c[1].r] AS rs, l, c[1].r AS r FROM o WHERE i = 1
  UNION ALL SELECT w.g, o.i, CASE WHEN len(list_filter(o.c, lambda x: NOT list_contains(w.rs, x.r))) > 0 THEN list_append(w.rs, list_filter(o.c, lambda x: NOT list_contains(w.rs, x.r))[1].r) ELSE w.rs END, o.l, list_filter(o.c, lambda x: NOT list_contains(w.rs, x.r))[1].r FROM w JOIN o ON o.g = w.g AND o.i = w.i + 1)
SELECT g, l, r FROM w WHERE r IS NOT NULL""")  # fmt: skip
def claims_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order claim suppliers' groups in turn."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("l"), (F.col("l_suppkey") % 5).alias("r")).agg(F.max("l_quantity").alias("score"))
    return matching.claim_in_turn(edges, ["g"], "l", "r", "score").select("g", "l", "r")


_SIGN_SQL = "list_transform(range(0, 16), lambda g: list_sum(list_transform(range(0, 4), lambda k: CASE WHEN embedding[4 * g + k + 1] > 0 THEN (8 >> k) ELSE 0 END)))"
_STEP_SQL = "list_transform(range(0, 16), lambda g: list_sum(list_transform(range(0, 4), lambda k: CASE WHEN embedding[4 * g + k + 1] > coalesce(embedding[4 * g + k], 0) THEN (8 >> k) ELSE 0 END)))"


def _hex(bits):
    digits = F.lit("0123456789abcdef")
    value = lambda g: sum((F.when(bits(4 * g + k), 8 >> k).otherwise(0) for k in range(1, 4)), F.when(bits(4 * g), 8).otherwise(0))
    return F.concat(*(F.substring(digits, value(g) + 1, F.lit(1)) for g in range(16)))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the hash of their signs and that of their steps, in the role of images' hashes."""
    e = F.col("embedding")
    sign = _hex(lambda i: F.get(e, F.lit(i)) > 0)
    step = _hex(lambda i: F.get(e, F.lit(i)) > (F.get(e, F.lit(i - 1)) if i else F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", sign.alias("phash"), step.alias("dhash"), "label")


_HASHED_SQL = f"""h AS (SELECT vec_id, label, array_to_string(list_transform({_SIGN_SQL}, lambda v: substr('0123456789abcdef', CAST(v AS INT) + 1, 1)), '') AS phash, array_to_string(list_transform({_STEP_SQL}, lambda v: substr('0123456789abcdef', CAST(v AS INT) + 1, 1)), '') AS dhash FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.phash AS pa, b.phash AS pb, a.dhash AS da, b.dhash AS db, a.vec_id % 7 * 10.0 + 40 AS wa, b.vec_id % 7 * 10.0 + 40 AS wb, CAST(list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(strpos('0123456789abcdef', a.phash[i]) - 1, strpos('0123456789abcdef', b.phash[i]) - 1)))) AS INTEGER) AS dp,
  CAST(list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(strpos('0123456789abcdef', a.dhash[i]) - 1, strpos('0123456789abcdef', b.dhash[i]) - 1)))) AS INTEGER) AS dd FROM h a JOIN h b ON b.vec_id = a.vec_id + 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hashed(spark, sf_dir)
    b = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("phash").alias("pb"), F.col("dhash").alias("db"))
    return h.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.col("phash").alias("pa"), "pb", F.col("dhash").alias("da"), "db", (F.col("vec_id") % 7 * 10.0 + 40).alias("wa"), (F.col("b") % 7 * 10.0 + 40).alias("wb"))


@register("sign_hash_hamming", f"WITH {_HASHED_SQL} SELECT a, b, pa, pb, dp AS distance, round(1 - dp / 64.0, 6) AS similarity FROM p")
def sign_hash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, H4 of neighbouring vectors."""
    return _pairs(spark, sf_dir).select("a", "b", "pa", "pb", hashing.hamming_distance(F.col("pa"), F.col("pb")).alias("distance"), F.round(hashing.hash_similarity(F.col("pa"), F.col("pb")), 6).alias("similarity"))


@register("image_score_blend", f"""WITH {_HASHED_SQL} SELECT a, b, CAST(floor(1000 * (0.55 * (1 - dp / 64.0::DOUBLE) + 0.25 * round(1 - dd / 64.0::DOUBLE, 4) + 0.2 * greatest(0, 1 - abs(wa / 100 - wb / 100) / greatest(wa / 100, wb / 100))) + 0.45) AS BIGINT) AS score FROM p""")
def image_score_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 of neighbouring vectors, in thousandths, cut where the engines' rounding can't differ."""
    c, none, high = F.col, F.lit(None).cast("string"), F.lit(100.0)
    return _pairs(spark, sf_dir).select("a", "b", F.floor(1000 * hashing.image_score(none, none, c("pa"), c("pb"), c("da"), c("db"), c("wa"), high, c("wb"), high) + 0.45).alias("score"))


@register("image_match_greedy")
def image_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even and odd ids with one label, matched by H5 from 0.6 on; ties to the smaller ids."""
    h = _hashed(spark, sf_dir)
    side = lambda rest, name: h.where(F.col("vec_id") % 2 == rest).select("label", F.col("vec_id").alias(name), "phash", "dhash")
    return images.match_hashed(side(0, "s"), side(1, "t"), ["label"], 0.6)


@register("positional_zip_compare", """
WITH c AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS position FROM conversations)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CAST(coalesce(a.position, b.position) AS INTEGER) AS position, CAST(a.n AS INTEGER) AS a_n, CAST(b.n AS INTEGER) AS b_n FROM (SELECT * FROM c WHERE role = 'user') a FULL JOIN (SELECT * FROM c WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.position = b.position""")  # fmt: skip
def positional_zip_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th question beside the n-th answer."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text", F.length("text").alias("n"))
    side = lambda role: rows.where(F.col("role") == role).drop("role")
    return matching.positional_zip(side("user"), side("assistant"), ["conv_id"], ["turn", "text"], ["turn", "text"]).select("conv_id", "position", "a_n", "b_n")


@register("prefix_path_join", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), f AS (SELECT DISTINCT regexp_extract(path, '^(http://[^/]+/[^/]+)', 1) AS prefix FROM p WHERE regexp_matches(path, '^http://[^/]+/[^/]+'))
SELECT page_id, prefix FROM p JOIN f ON path = prefix OR starts_with(path, prefix || '/')""")  # fmt: skip
def prefix_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the first steps of paths that lead to them."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    first = rows.select(F.regexp_extract("path", "^(http://[^/]+/[^/]+)", 1).alias("prefix")).where("prefix <> ''").distinct()
    return matching.prefix_join(rows, first, "path", "prefix", "/").select("page_id", "prefix")


_BOXES_SQL = "(SELECT s_suppkey, s_suppkey % 10 AS page, s_suppkey % 40 * 1.0 AS x0, s_suppkey % 40 + 4.0 AS x1, s_nationkey % 8 * 1.0 AS top, s_nationkey % 8 + 2.0 AS bottom FROM supplier)"


@register("point_in_box_range_join", f"""
SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n_points FROM {_BOXES_SQL} b JOIN (SELECT l_suppkey % 10 AS page, l_quantity AS x, l_discount * 100 AS y FROM lineitem) p ON p.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN top AND bottom GROUP BY s_suppkey""")  # fmt: skip
def point_in_box_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points in suppliers' boxes, by the cells that both are in."""
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 10).alias("page"), (k % 40 * 1.0).alias("x0"), (k % 40 + 4.0).alias("x1"), (F.col("s_nationkey") % 8 * 1.0).alias("top"), (F.col("s_nationkey") % 8 + 2.0).alias("bottom"))
    points = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("page"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return matching.point_in_box(points, boxes, ["page"], "x", "y", 4.0).groupBy("s_suppkey").agg(F.count("*").alias("n_points"))


_TWO_SQL = """t AS (SELECT p_partkey, p_size * 1.0 AS ax0, p_size + 20.0 AS ax1, p_partkey % 30 * 1.0 AS atop, p_partkey % 30 + 10.0 AS abottom, p_size * 0.5 + 10 AS bx0, p_size * 0.5 + 25 AS bx1, p_partkey % 17 * 2.0 AS btop, p_partkey % 17 * 2 + 12.0 AS bbottom FROM part),
u AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(abottom, bbottom) - greatest(atop, btop)) AS inter FROM t)"""


def _two_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    a = geometry.box(s * 1.0, k % 30 * 1.0, s + 20.0, k % 30 + 10.0)
    b = geometry.box(s * 0.5 + 10, k % 17 * 2.0, s * 0.5 + 25, k % 17 * 2 + 12.0)
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))


@register("iou_overlap", f"""WITH {_TWO_SQL} SELECT p_partkey, CAST(inter AS DOUBLE) AS intersection, round(inter / (200 + 180 - inter), 6) AS iou, inter > 0 AS overlaps, round(sqrt(((ax0 + ax1 - bx0 - bx1) / 2) ** 2 + ((atop + abottom - btop - bbottom) / 2) ** 2), 6) AS distance FROM u""")
def iou_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G3, G4."""
    a, b = F.col("a"), F.col("b")
    return _two_boxes(spark, sf_dir).select("p_partkey", geometry.intersection_area(a, b).alias("intersection"), F.round(geometry.iou(a, b), 6).alias("iou"), geometry.overlaps(a, b).alias("overlaps"), F.round(geometry.distance(a, b), 6).alias("distance"))


@register("alignment_class", f"""WITH {_TWO_SQL} SELECT p_partkey, CASE WHEN abs(ax0 / 70 - (1 - ax1 / 70)) <= 0.08 THEN 'center' WHEN ax0 / 70 < 1 - ax1 / 70 THEN 'left' ELSE 'right' END AS alignment FROM t""")
def alignment_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 on a page 70 wide."""
    return _two_boxes(spark, sf_dir).select("p_partkey", geometry.horizontal_alignment(F.col("a"), F.lit(70.0)).alias("alignment"))


@register("layout_score_avg", f"""
WITH {_TWO_SQL}, s AS (SELECT p_partkey % 25 AS doc, greatest(0, 1 - least(1, abs(least(1, ax0 / 60) - least(1, bx0 / 60)) + abs(20 / 60.0 - 15 / 60.0))) AS score FROM t) SELECT doc, round(avg(score), 4) AS layout FROM s GROUP BY doc""")  # fmt: skip
def layout_score_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G8, A17 on pages 60 wide."""
    from ..operators.aggregates import mean_or_one

    w = F.lit(60.0)
    return _two_boxes(spark, sf_dir).groupBy((F.col("p_partkey") % 25).alias("doc")).agg(mean_or_one(geometry.layout_score(F.col("a"), F.col("b"), w, w, w, w)).alias("layout"))


@register("position_and_adjustment", f"""
WITH {_TWO_SQL}, n AS (SELECT p_partkey, least(1, ax0 / 60) AS ax0, least(1, ax1 / 60) AS ax1, least(1, atop / 60) AS atop, least(1, abottom / 60) AS abottom, least(1, bx0 / 60) AS bx0, least(1, bx1 / 60) AS bx1, least(1, btop / 60) AS btop, least(1, bbottom / 60) AS bbottom FROM t)
SELECT p_partkey, round(greatest(0, 1 - (0.7 * sqrt(((ax0 + ax1 - bx0 - bx1) / 2) ** 2 + ((atop + abottom - btop - bbottom) / 2) ** 2) / 1.4142 + 0.3 * (abs((ax1 - ax0) - (bx1 - bx0)) + abs((abottom - atop) - (bbottom - btop))) / 2)), 6) AS similarity, round((ax0 + ax1) / 2 - (ax1 - ax0) + 0.25, 6) AS moved_x0 FROM n""")  # fmt: skip
def position_and_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G5, G6 on unit pages."""
    w = F.lit(60.0)
    rows = _two_boxes(spark, sf_dir).select("p_partkey", geometry.normalized(F.col("a"), w, w).alias("a"), geometry.normalized(F.col("b"), w, w).alias("b"))
    return rows.select("p_partkey", F.round(geometry.position_similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(geometry.adjusted(F.col("a"), F.lit(0.25), F.lit(0.0), F.lit(2.0))["x0"], 6).alias("moved_x0"))


@register("containment_dedup", """
WITH RECURSIVE b AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_discount * 100 AS x0, l_discount * 100 + l_quantity AS x1 FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x1 - x0 DESC, id) AS i FROM b),
w AS (SELECT g, i, id, x0, x1, [{'a': x0, 'b': x1}] AS kept, true AS k FROM o WHERE i = 1
  UNION ALL SELECT o.g, o.i, o.id, o.x0, o.x1, CASE WHEN len(list_filter(w.kept, lambda c: greatest(0, least(c.b, o.x1) - greatest(c.a, o.x0)) >= 0.7 * (o.x1 - o.x0))) > 0 THEN w.kept ELSE list_append(w.kept, {'a': o.x0, 'b': o.x1}) END,
    len(list_filter(w.kept, lambda c: greatest(0, least(c.b, o.x1) - greatest(c.a, o.x0)) >= 0.7 * (o.x1 - o.x0))) = 0 FROM w JOIN o ON o.g = w.g AND o.i = w.i + 1)
SELECT g, CAST(id AS INTEGER) AS id FROM w WHERE k""")  # fmt: skip
def containment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of an order, one high, that no kept longer one holds to 70 %."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x0 = F.col("l_discount") * 100
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), at.alias("id"), geometry.box(x0, F.lit(0.0), x0 + F.col("l_quantity"), F.lit(1.0)).alias("box"))
    return matching.containment_kept(boxes, ["g"], "id").select("g", "id")


@register("span_claims", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(n_nationkey) AS section FROM lineitem JOIN nation ON l_suppkey % 5 = n_regionkey AND l_extendedprice BETWEEN n_nationkey * 3000 - 200 AND n_nationkey * 3000 + 1200 GROUP BY ALL""")  # fmt: skip
def span_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section whose widened span holds an image."""
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (F.col("l_suppkey") % 5).cast("int").alias("page"), F.col("l_extendedprice").alias("top"))
    spans = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("section"), (F.col("n_nationkey") * 3000).alias("low"), (F.col("n_nationkey") * 3000 + 1000).alias("high"))
    return matching.span_claims(rows, small(spans), ["page"], "id").select("id.*", "section")


@register("jaccard_of_lists", """
WITH e AS (SELECT user_id, event_id, event_type || CAST(floor(value / 20) AS BIGINT) AS k FROM events),
a AS (SELECT user_id, list_distinct(list(k) FILTER (event_id % 2 = 0)) AS x, list_distinct(list(k) FILTER (event_id % 2 = 1)) AS y FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) ELSE 0.0 END AS similarity,
  array_to_string(list_sort(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v))), ',') AS only_even, array_to_string(list_sort(list_filter(coalesce(y, []), lambda v: NOT list_contains(coalesce(x, []), v))), ',') AS only_odd FROM a""")  # fmt: skip
def jaccard_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and sizes of a user's even and odd events, and what only one side has."""
    kind = F.concat("event_type", F.floor(F.col("value") / 20).cast("string"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.collect_set(F.when(F.col("event_id") % 2 == r, kind)).alias(n) for r, n in ((0, "x"), (1, "y"))))
    only = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return rows.select("user_id", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("similarity"), only("x", "y").alias("only_even"), only("y", "x").alias("only_odd"))
