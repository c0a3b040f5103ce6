"""Sequence queries: window and fold operators over events, line items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import order_similarity
from ..operators import sequence
from ..sources.tables import table
from .catalog import register

#: Heading levels of the event types, in the role of headings.
LEVELS = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}
_LEVEL_SQL = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END"


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.coalesce(*(F.when(F.col("event_type") == k, n) for k, n in LEVELS.items()))
    return table(spark, sf_dir, "events").withColumn("level", level)


@register("dense_rank_levels", """
SELECT p_partkey, CAST(least(6, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)) AS INTEGER) AS level FROM part""")  # fmt: skip
def dense_rank_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return table(spark, sf_dir, "part").select("p_partkey", sequence.dense_levels(F.col("p_size"), ["p_brand"]).alias("level"))


@register("level_jump_lag", f"""
SELECT event_id, previous_level, level FROM (SELECT event_id, {_LEVEL_SQL} AS level, lag({_LEVEL_SQL}) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_level FROM events) WHERE level > previous_level + 1""")  # fmt: skip
def level_jump_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return sequence.level_jumps(_headings(spark, sf_dir), ["user_id"], ["event_id"], "level").select("event_id", "previous_level", "level")


@register("heading_parent_nearest_smaller", f"""
WITH h AS (SELECT event_id, user_id, {_LEVEL_SQL} AS level FROM events)
SELECT a.event_id, max(b.event_id) AS parent FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.level < a.level GROUP BY a.event_id""")  # fmt: skip
def heading_parent_nearest_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return sequence.nearest_smaller(_headings(spark, sf_dir), ["user_id"], ["event_id"], "level", "event_id").select("event_id", "parent")


@register("carry_forward_heading", """
SELECT event_id, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events""")  # fmt: skip
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return table(spark, sf_dir, "events").select("event_id", sequence.carried_forward(F.col("event_id"), F.col("event_type") == "view", ["user_id"], ["event_id"]).alias("heading"))


@register("longest_increasing_subseq_len", """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
d AS (SELECT user_id, i, [value] AS v, [1::BIGINT] AS l FROM e WHERE i = 1
  UNION ALL SELECT d.user_id, e.i, list_append(d.v, e.value), list_append(d.l, 1 + coalesce(list_max(list_transform(range(1, len(d.v) + 1), lambda j: CASE WHEN d.v[j] < e.value THEN d.l[j] ELSE 0 END)), 0)) FROM d JOIN e ON e.user_id = d.user_id AND e.i = d.i + 1)
SELECT user_id, CAST(list_max(arg_max(l, i)) AS INTEGER) AS n FROM d GROUP BY user_id""")  # fmt: skip
def longest_increasing_subseq_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's values stand in increasing order."""
    values = table(spark, sf_dir, "events").groupBy("user_id").agg(sequence.in_order_array(F.col("event_id"), F.col("value")).alias("v"))
    return values.select("user_id", F.size(sequence.longest_increasing(F.col("v"))).alias("n"))


@register("order_similarity_difflib")
def order_similarity_difflib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types of even and of odd events as two sequences."""
    side = lambda r: sequence.in_order_array(F.col("event_id"), F.when(F.col("event_id") % 2 == r, F.col("event_type")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.filter(side(r), lambda x: x.isNotNull()).alias(n) for r, n in ((0, "a"), (1, "b"))))
    return rows.select("user_id", order_similarity(F.col("a"), F.col("b")).alias("similarity"))


@register("out_of_order_elements")
def out_of_order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose ship date is out of the order of their numbers, 25 of an order at most."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.unix_date(F.col("l_shipdate").cast("date")).alias("shipped"), F.col("l_partkey").alias("part"))
    return sequence.first_after_cap(sequence.out_of_order(rows, ["l_orderkey"], "at", "shipped", "part"), 0, ["l_orderkey"], ["rank"])


@register("paragraph_sessions", """
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity AS x0, l_tax * 100 AS size, row_number() OVER w AS i, row_number() OVER w * 10.0 + l_discount * 100 AS top FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
g AS (SELECT *, top - lag(top + 8) OVER w > 0.85 * 8 OR abs(size - lag(size) OVER w) > 1.5 OR abs(x0 - lag(x0) OVER w) > 18 AS brk FROM r WINDOW w AS (PARTITION BY l_suppkey ORDER BY i))
SELECT l_suppkey, CAST(i AS INTEGER) AS i, CAST(1 + sum(CASE WHEN i > 1 AND brk THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY i) AS BIGINT) AS paragraph FROM g""")  # fmt: skip
def paragraph_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three reasons for a break, over line items laid out as lines; sizes are whole here, so a difference of over 1 is over 1.5."""
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w)).select("l_suppkey", "i", (F.col("i") * 10.0 + F.col("l_discount") * 100).alias("top"), F.round(F.col("l_tax") * 100).alias("size"), F.col("l_quantity").alias("x0"))
    rows = rows.withColumn("bottom", F.col("top") + 8)
    starts = sequence.paragraph_breaks("top", "bottom", "x0", "size", ["l_suppkey"], ["i"])
    return rows.withColumn("brk", starts).select("l_suppkey", "i", sequence.sessions(F.coalesce("brk", F.lit(True)), ["l_suppkey"], ["i"]).alias("paragraph"))


@register("interval_island_merge", """
WITH s AS (SELECT l_suppkey, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT l_suppkey, CAST(island AS BIGINT) AS island, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n_spans FROM i GROUP BY l_suppkey, island""")  # fmt: skip
def interval_island_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of days that are at most two days apart."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))
    return sequence.islands(spans, ["l_suppkey"], "a", "b", F.lit(2))


@register("column_counts", """
WITH s AS (SELECT l_suppkey, l_linenumber, l_quantity * 10 AS x0, l_quantity * 10 + l_discount * 1000 AS x1 FROM lineitem WHERE l_discount > 0),
m AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 30 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
c AS (SELECT l_suppkey, l_linenumber, max(x1) - min(x0) AS w FROM i GROUP BY l_suppkey, l_linenumber, island)
SELECT l_suppkey, l_linenumber, CAST(greatest(1, count(*) FILTER (w > 75)) AS BIGINT) AS n_columns FROM c GROUP BY ALL""")  # fmt: skip
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of text spans, which have a width, on pages 500 wide."""
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + F.col("l_discount") * 1000).alias("x1"), F.lit(500.0).alias("width"))
    return sequence.column_count(spans, ["l_suppkey", "l_linenumber"], "width")


@register("continuous_numbering", """
WITH f AS (SELECT source, min(doc_id) AS first_at FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, first_at, CAST(row_number() OVER (ORDER BY first_at, source) + 6 AS BIGINT) AS number, printf('%02d', row_number() OVER (ORDER BY first_at, source) + 6) AS label FROM f""")  # fmt: skip
def continuous_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources numbered on from 7 as they first come."""
    return sequence.continuous_numbers(table(spark, sf_dir, "documents"), "source", "doc_id", 7)


@register("section_segmentation", r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
s AS (SELECT doc_id, sum(CASE WHEN i = 1 OR length(line) <= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(count(*) AS BIGINT) AS n_lines FROM s GROUP BY ALL""")  # fmt: skip
def section_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section begins at every short line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", sequence.sessions(F.length("line") <= 40, ["doc_id"], ["i"]).alias("section")).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


@register("reading_order_places", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, round_even(l_quantity / 6, 0), l_discount, l_extendedprice, l_partkey, l_suppkey) AS INTEGER) AS place FROM lineitem""")  # fmt: skip
def reading_order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a grid, halves to even."""
    order = sequence.reading_order(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order, "l_extendedprice", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", place.alias("place"))


@register("reading_stream", """
WITH e AS (SELECT l_orderkey AS page, l_quantity AS top, l_discount AS x0, md5(concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(18,2))) AS element_id, CASE l_returnflag WHEN 'N' THEN 'text' WHEN 'R' THEN 'figure' ELSE 'table' END AS kind FROM lineitem)
SELECT page, element_id, kind, CAST(row_number() OVER (PARTITION BY page ORDER BY top, x0, CASE kind WHEN 'text' THEN 0 ELSE 1 END, element_id) AS INTEGER) AS stream FROM e""")  # fmt: skip
def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    c = F.col
    key = F.md5(F.concat_ws("|", *(c(x).cast("string") for x in ("l_linenumber", "l_partkey", "l_suppkey")), c("l_extendedprice").cast("decimal(18,2)").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), c("l_quantity").alias("top"), c("l_discount").alias("x0"), key.alias("element_id"), "l_returnflag")
    of = lambda flag: rows.where(c("l_returnflag") == flag).drop("l_returnflag")
    return sequence.reading_stream(of("N"), of("R"), of("A")).select("page", "element_id", "kind", "stream")


@register("pair_with_next", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS f, event_type IN ('click', 'error') AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
n AS (SELECT *, coalesce(f AND lead(s) OVER (PARTITION BY user_id ORDER BY i), false) AS b FROM e),
r AS (SELECT user_id, event_id, i, b AS pairs FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, n.b AND NOT r.pairs FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, pairs FROM r""")  # fmt: skip
def pair_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs don't overlap."""
    first, second = F.col("event_type").isin("view", "click"), F.col("event_type").isin("click", "error")
    return table(spark, sf_dir, "events").select("event_id", sequence.pairs_with_next(first, second, ["user_id"], ["event_id"]).alias("pairs"))


@register("section_extents", f"""
WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id, {_LEVEL_SQL} AS level FROM events)
SELECT a.event_id, CAST(coalesce(min(b.i) - 1, max(m.n)) AS INTEGER) AS extent_end FROM h a JOIN (SELECT user_id, max(i) AS n FROM h GROUP BY 1) m ON m.user_id = a.user_id
LEFT JOIN h b ON b.user_id = a.user_id AND b.i > a.i AND b.level <= a.level GROUP BY a.event_id""")  # fmt: skip
def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20."""
    rows = _headings(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return sequence.section_extent(rows, ["user_id"], "i", "level").select("event_id", "extent_end")


@register("insertion_chains", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS chain FROM events")
def insertion_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor is a user and a type."""
    return sequence.insertion_chain(table(spark, sf_dir, "events").withColumn("anchor", F.struct("user_id", "event_type")), "anchor", ["event_id"]).select("event_id", "chain")


@register("inversion_pairs", """
WITH s AS (SELECT l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)
SELECT a.l_orderkey, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND a.v > b.v QUALIFY row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.i, b.i) <= 200""")  # fmt: skip
def inversion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 pairs of an order's quantities in the wrong order."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sequence.in_order_array(at, F.col("l_quantity")).alias("v"))
    return rows.select("l_orderkey", F.inline(sequence.inversions(F.col("v"))))


@register("nearest_within_band", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at FROM events)
SELECT a.event_id, arg_min(b.event_id, (abs(b.at - a.at), b.event_id)) AS nearest FROM (SELECT * FROM e WHERE event_type = 'error') a
LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') b ON a.user_id = b.user_id AND b.at - a.at >= -4000000 AND b.at - a.at < 36000000000 GROUP BY a.event_id""")  # fmt: skip
def nearest_within_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error the user's nearest view from four seconds before to ten hours after."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    of = lambda t: rows.where(F.col("event_type") == t).drop("event_type")
    return sequence.nearest_within(of("error"), of("view"), ["user_id"], "at", "at", -4_000_000, 36_000_000_000, "event_id", 36_000_000_000).select("event_id", "nearest")


@register("doubled_characters")
def doubled_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document, with characters printed twice in every third one."""
    first = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    shown = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("line", "(.)", "$1$1")).otherwise(F.col("line"))
    chars = first.select("doc_id", F.posexplode(F.split(shown, "")).alias("i", "char")).where("char <> ''")
    place = F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("i") / 2) * 6.0).otherwise(F.col("i") * 6.0)
    found = sequence.overstruck(chars.withColumns({"x0": place, "top": F.lit(0.0)}), ["doc_id"], ["i"])
    return found.select("doc_id", "doubled", F.md5(F.col("text").cast("binary")).alias("digest"))
