"""Review-workflow, reporting and sequence queries over the star-schema tables.

Roles: customers are projects, orders are jobs with a status and a priority,
line items and events are findings, line breaks of documents part blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_sql
from ..operators import sequence
from ..sources.tables import table
from .catalog import register

#: Fixed event types of the zero-filled counts, in their order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: Penalty of an order by its priority.
PENALTIES = {"1-URGENT": 15, "2-HIGH": 8, "3-MEDIUM": 4}

_long = lambda c: c.cast("long")


@register("project_stats_left_joins", """
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_jobs, CAST(coalesce(sum(n_items), 0) AS BIGINT) AS n_findings, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_done
FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderstatus, n_items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey) ON o_custkey = c_custkey
GROUP BY c_custkey""")  # fmt: skip
def project_stats_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, findings and finished jobs of every project; findings are counted per job before they are joined."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"))
    jobs = table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    jobs = jobs.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_jobs"), F.sum("n_items").alias("n_findings"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "customer").join(jobs, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", zero("n_jobs"), zero("n_findings"), zero("n_done"))


@register("zero_filled_pivot_counts", "SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS BIGINT) AS n_{t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def zero_filled_pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a count of every type per user, 0 where none."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in EVENT_TYPES))


@register("weighted_penalty_score", """
SELECT o_custkey, CAST(greatest(0, 100 - sum(CASE o_orderpriority WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 8 WHEN '3-MEDIUM' THEN 4 ELSE 1 END)) AS BIGINT) AS score FROM orders GROUP BY o_custkey""")  # fmt: skip
def weighted_penalty_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 with penalties by priority."""
    penalty = F.coalesce(*(F.when(F.col("o_orderpriority") == p, n) for p, n in PENALTIES.items()), F.lit(1))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(_long(F.greatest(F.lit(0), 100 - F.sum(penalty))).alias("score"))


@register("severity_ranked_topk", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50""")  # fmt: skip
def severity_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty gravest jobs: a top-k without a global sort."""
    return table(spark, sf_dir, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("status_rate_summary", """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders), 6) AS rate FROM orders GROUP BY o_orderstatus""")  # fmt: skip
def status_rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by status; the window runs over a row per status."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.select("o_orderstatus", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("rate"))


@register("project_search_filter", """
SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '00012') OR contains(lower(n_name), 'nation_1'))""")  # fmt: skip
def project_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 with fixed parameters."""
    found = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return found.where(F.lower("c_name").contains("00012") | F.lower("n_name").contains("nation_1")).select("c_custkey", "c_name", "n_name")


@register("queue_claim_oldest", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def queue_claim_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest open job, a top-1 without a sort of all."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@register("dedup_keep_best", """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_discount FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_extendedprice) = 1""")  # fmt: skip
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding of each key with the highest confidence: a minimum, combined before the shuffle, not a window."""
    best = F.min(F.struct((-F.col("l_discount")).alias("d"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")).alias("b")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(best).select("l_partkey", "l_suppkey", "b.l_orderkey", "b.l_linenumber", "b.l_discount")


@register("first_occurrence_duplicates", """
SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first_id""")  # fmt: skip
def first_occurrence_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of the same raw text with the first one's id, as its SQL says; ``normalized_duplicates`` compares normalized texts."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return later_copies(docs, F.col("text"))


def later_copies(docs: DataFrame, key: Column) -> DataFrame:
    """Later rows of a key with the first one's id. Keys are shuffled as strong digests; a hot key is one row per task before the join."""
    docs = docs.select("doc_id", F.unhex(F.sha2(key, 256)).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return docs.join(first, "digest").where("doc_id <> first_id").select("doc_id", "first_id")


@register("normalized_duplicates", r"""
SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first_id""")  # fmt: skip
def normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies by normalized text, so also those that differ in case, blanks or punctuation alone."""
    return later_copies(table(spark, sf_dir, "documents").where("text is not null"), normalize_sql(F.col("text")))


@register("confidence_band_groups", """
SELECT l_returnflag, CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END AS band, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL""")  # fmt: skip
def confidence_band_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, R13 by flag and band."""
    band = F.when(F.col("l_discount") >= 0.08, "high").when(F.col("l_discount") >= 0.04, "medium").otherwise("low").alias("band")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", band).agg(F.count("*").alias("n"))


@register("decision_reset_verdict", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'REJECTED' WHEN l_linestatus = 'F' AND l_discount >= 0.095 THEN 'AUTO_FIXED' ELSE 'PENDING_REVIEW' END AS verdict FROM lineitem""")  # fmt: skip
def decision_reset_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reset would restore."""
    verdict = F.when(F.col("l_returnflag") == "R", "REJECTED").when((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.095), "AUTO_FIXED").otherwise("PENDING_REVIEW")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"))


def issue_outcomes(events: DataFrame) -> DataFrame:
    """Outcome of every signature (user_id, event_type) over all events, split at the middle day of the table.

    Found on both sides it is unresolved, only before resolved, and only after
    a knock-on where its type is still unresolved with any signature, else a
    regression. Events without a time are on neither side.
    """
    day = F.col("ts").cast("date")
    cut = events.agg(F.expr("date_add(min(cast(ts as date)), cast((datediff(max(cast(ts as date)), min(cast(ts as date))) + 1) div 2 as int))").alias("cut"))
    dated = events.where("ts is not null").crossJoin(F.broadcast(cut))
    both = dated.groupBy("user_id", "event_type").agg(F.bool_or(day < F.col("cut")).alias("b"), F.bool_or(day >= F.col("cut")).alias("a"))
    still = both.where("a and b").select(F.col("event_type").alias("open_type"), F.lit(True).alias("open")).distinct()
    found = both.join(still, F.col("event_type").eqNullSafe(F.col("open_type")), "left")
    outcome = F.when(F.col("a") & F.col("b"), "unresolved").when(F.col("b"), "resolved").when(F.col("open"), "knock-on").otherwise("regression")
    return found.select("user_id", "event_type", outcome.alias("outcome"))


@register("full_outer_before_after", """
WITH cut AS (SELECT min(CAST(ts AS DATE)) + CAST((max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1) // 2 AS INTEGER) AS cut FROM events),
s AS (SELECT user_id, event_type, bool_or(CAST(ts AS DATE) < cut) AS b, bool_or(CAST(ts AS DATE) >= cut) AS a FROM events, cut WHERE ts IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN a AND b THEN 'unresolved' WHEN b THEN 'resolved'
  WHEN EXISTS (SELECT 1 FROM s AS o WHERE o.a AND o.b AND o.event_type IS NOT DISTINCT FROM s.event_type) THEN 'knock-on' ELSE 'regression' END AS outcome FROM s""")  # fmt: skip
def full_outer_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings before and after a fix, by signature, over the whole table."""
    return issue_outcomes(table(spark, sf_dir, "events"))


@register("asof_previous_or_next", """
SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS anchor FROM events""")  # fmt: skip
def asof_previous_or_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier anchor of the same user, else the nearest later one; found in blocks, so that a hot user isn't one task's."""
    events = table(spark, sf_dir, "events")
    return sequence.asof_either_way(events, ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_id"), 1 << 16).select("event_id", "anchor")


@register("gap_sessionize", """
SELECT event_id, CAST(sum(CASE WHEN gap > 3600000000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session
FROM (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)""")  # fmt: skip
def gap_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 by time: sessions of a user, cut where an hour passes; numbered in blocks of a day, so that a hot user isn't one task's."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return sequence.gap_sessions(events, ["user_id"], "at", "event_id", 3_600_000_000, 86_400_000_000).select("event_id", "session")


@register("numbering_gaps", """
SELECT l_orderkey, CAST(max(l_linenumber) - count(DISTINCT l_linenumber) AS BIGINT) AS n_missing FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers an order lacks."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_long(F.max("l_linenumber") - F.countDistinct("l_linenumber")).alias("n_missing"))


@register("weighted_mode", """
SELECT source, lang, n FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")  # fmt: skip
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language with the most characters in each source; two aggregations, texts unread."""
    sums = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("n"))
    return sums.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("d"), "lang", "n")).alias("b")).select("source", "b.lang", "b.n")


@register("html_meta", """
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a\\s')) AS BIGINT) AS n_links FROM pages""")  # fmt: skip
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 by expressions alone: language, title and number of links."""
    find = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", find('<html lang="([^"]*)"').alias("lang"), find("<title>([^<]*)</title>").alias("title"), _long(F.regexp_count("html", F.lit(r"<a\s"))).alias("n_links"))
