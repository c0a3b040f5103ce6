"""Issue-rule queries whose matches are given, so that SQL can follow them: events in the role of headings, questions and images of a user's document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import rules
from ..sources.tables import ensure_checkpoint_dir, table
from .catalog import register
from .sequences import _LEVEL_SQL, _headings

# Even events are the source's side, odd ones the other; the n-th ones match unless one is a view.
_SIDES_SQL = f"""e AS (SELECT user_id AS doc, event_id, event_type, value, {_LEVEL_SQL} AS level, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS ord FROM events),
p AS (SELECT * FROM e WHERE side = 0), h AS (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY ord) AS before FROM e WHERE side = 1),
m AS (SELECT p.doc, p.ord FROM p JOIN h ON p.doc = h.doc AND p.ord = h.ord WHERE p.event_type <> 'view' AND h.event_type <> 'view')"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ord_ = (F.row_number().over(W.partitionBy("user_id", F.col("event_id") % 2).orderBy("event_id")) - 1).cast("long")
    e = _headings(spark, sf_dir).select(F.col("user_id").alias("doc"), "event_id", "event_type", "value", "level", F.col("event_id").cast("string").alias("title"), F.lit(1).alias("page"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("dom_path"), ord_.alias("ord"))
    p, h = e.where("event_id % 2 = 0").drop("dom_path"), e.where("event_id % 2 = 1").drop("page")
    at = lambda df, name: df.where("event_type <> 'view'").select("doc", "ord", F.col("ord").alias(name))
    return p, h, at(p, "s").join(at(h, "t"), ["doc", "ord"]).select("doc", "s", "t", F.lit(1.0).alias("score"))


@register("structure_rules_ranked", f"""
WITH {_SIDES_SQL}, i AS (
  SELECT p.doc, 'HEADING_LEVEL_MISMATCH' AS type, 1 AS rank, 0.96 AS confidence, p.ord AS seq, 'x' || h.event_id AS dom_path FROM m JOIN p USING (doc, ord) JOIN h USING (doc, ord) WHERE p.level <> h.level
  UNION ALL SELECT doc, 'MISSING_SECTION', 0, 0.9, 1048576 + ord, NULL FROM p ANTI JOIN m USING (doc, ord)
  UNION ALL SELECT doc, 'STRUCTURE_MISMATCH', 2, 0.6, 2097152 + ord, 'x' || event_id FROM h ANTI JOIN m USING (doc, ord)
  UNION ALL SELECT h.doc, 'HEADING_LEVEL_MISMATCH', 2, 0.88, 4194304 + h.ord, 'x' || h.event_id FROM h WHERE level > before + 1 AND NOT EXISTS (SELECT 1 FROM m JOIN p USING (doc, ord) WHERE m.doc = h.doc AND m.ord = h.ord AND p.level <> h.level))
SELECT doc, type, dom_path, CAST(seq AS BIGINT) AS seq, CAST(row_number() OVER (PARTITION BY doc ORDER BY rank, confidence DESC, seq) AS INTEGER) AS place FROM i""")  # fmt: skip
def structure_rules_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12, A16, O1: HEADING_LEVEL_MISMATCH of both kinds, MISSING_SECTION, STRUCTURE_MISMATCH, deduplicated and ranked."""
    p, h, m = _sides(spark, sf_dir)
    anchors = h.select("doc", F.lit(1).alias("page"), "ord", "dom_path").limit(0)
    return rules.ranked(rules.deduplicated(rules.structure_rules(p, h, m, anchors))).select("doc", "type", "dom_path", "seq", "place")


@register("image_rules_findings", f"""
WITH {_SIDES_SQL}
SELECT doc, type, pdf_ord, html_ord, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT p.doc, 'MISSING_ALT_TEXT' AS type, p.ord AS pdf_ord, h.ord AS html_ord, 0.97 AS confidence FROM m JOIN p USING (doc, ord) JOIN h USING (doc, ord) WHERE p.value >= 20 AND h.value < 50
UNION ALL SELECT doc, 'MISSING_IMAGE', ord, NULL, 0.85 FROM p ANTI JOIN m USING (doc, ord)
UNION ALL SELECT doc, CASE WHEN value < 30 THEN 'BROKEN_IMAGE_SRC' ELSE 'EXTRA_IMAGE' END, NULL, ord, CASE WHEN value < 30 THEN 0.98 ELSE 0.6 END FROM h ANTI JOIN m USING (doc, ord))""")  # fmt: skip
def image_rules_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: MISSING_ALT_TEXT, MISSING_IMAGE, BROKEN_IMAGE_SRC and EXTRA_IMAGE; small values stand for what an image lacks."""
    p, h, m = _sides(spark, sf_dir)
    pdf = p.withColumn("caption", F.when(F.col("value") >= 20, "c"))
    here = h.withColumns({"alt": F.when(F.col("value") >= 50, "a").otherwise(" "), "error": F.when(F.col("value") < 30, "dead"), "src": F.lit("s")})
    none = m.limit(0)
    anchors = none.select("doc", "s", F.lit(None).cast("string").alias("anchor"), F.lit("after").alias("position"))
    found = rules.image_rules(pdf, here, m, none, none, anchors, none.select("doc", F.lit(True).alias("reliable")))
    return found.select("doc", "type", "pdf_ord", "html_ord", "confidence")


@register("question_rules_findings", f"""
WITH {_SIDES_SQL}
SELECT p.doc, 'MISSING_QUESTION' AS type, 'HIGH' AS severity, p.ord AS seq FROM p ANTI JOIN m USING (doc, ord)
UNION ALL SELECT p.doc, 'QUESTION_MISMATCH', 'LOW', p.ord + 2621440 FROM m JOIN p USING (doc, ord) JOIN h USING (doc, ord) WHERE p.event_type <> h.event_type
UNION ALL SELECT p.doc, 'MISSING_ANSWER', 'MEDIUM', p.ord + 4194304 FROM m JOIN p USING (doc, ord) JOIN h USING (doc, ord) WHERE p.value >= 50 AND h.value < 50
UNION ALL SELECT doc, 'DUPLICATE_QUESTION', 'MEDIUM', ord + 1048576 FROM h QUALIFY row_number() OVER (PARTITION BY doc, event_type, CAST(floor(value) AS BIGINT) ORDER BY ord) > 1""")  # fmt: skip
def question_rules_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: MISSING_QUESTION, DUPLICATE_QUESTION, QUESTION_MISMATCH by number and MISSING_ANSWER; types are numbers, types and values texts."""
    p, h, m = _sides(spark, sf_dir)
    made = lambda df: df.withColumns({"number": F.col("event_type"), "text": F.col("title"), "norm": F.concat("event_type", F.floor("value").cast("string")), "numbering_explicit": F.lit(True), "answer": F.when(F.col("value") >= 50, "yes")})
    return rules.question_rules(made(p), made(h), m).select("doc", "type", "severity", "seq")


@register("order_rules_findings")
def order_rules_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12, W5, W15, W16: ORDER_MISMATCH of line items in the order of their ship dates, 25 of an order at most."""
    ensure_checkpoint_dir(spark)
    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), at.cast("long").alias("s"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("t"), F.concat(F.lit("x"), at.cast("string")).alias("dom_path"), F.lit("s").alias("section_path"), F.lit("paragraph").alias("kind"))
    return rules.order_rules(rows.limit(0), rows).select("doc", "dom_path", F.col("html_ord").alias("position"), F.col("payload")["after_dom_path"].alias("after"))
