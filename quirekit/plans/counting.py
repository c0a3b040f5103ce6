"""Counting and scoring queries: aggregation operators over findings (line items, events) and jobs (orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, hashing, misc
from ..operators import aggregates, sequence, state
from ..sources import files
from ..sources.tables import table
from .catalog import register

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: Findings' roles of the line items' columns.
SEVERITY = {"R": "CRITICAL", "A": "MAJOR", "N": "MINOR"}
STATUS = {"F": "APPROVED", "O": "OPEN"}
_SEVERITY_SQL = "CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'MAJOR' WHEN 'N' THEN 'MINOR' END"
_STATUS_SQL = "CASE l_linestatus WHEN 'F' THEN CASE WHEN l_discount >= 0.08 THEN 'AUTO_FIXED' ELSE 'APPROVED' END ELSE CASE WHEN l_tax >= 0.07 THEN 'REJECTED' WHEN l_tax <= 0.0 THEN 'UNFIXABLE' ELSE 'OPEN' END END"
_TYPE_SQL = "CASE l_linenumber WHEN 1 THEN 'MISSING_TEXT' WHEN 2 THEN 'EXTRA_TEXT' WHEN 3 THEN 'TEXT_MISMATCH' WHEN 4 THEN 'IMAGE_MISSING' WHEN 5 THEN 'ORDER_MISMATCH' WHEN 6 THEN 'TABLE_STRUCTURE' ELSE 'FORMATTING' END"
_F = f"(SELECT *, {_SEVERITY_SQL} AS severity, {_STATUS_SQL} AS status, {_TYPE_SQL} AS type, 0.75 + 2.5 * l_discount AS confidence, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice::DECIMAL(18,2))) AS id FROM lineitem)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings: severity, status, type, confidence and a deterministic id."""
    c = F.col
    kinds = {1: "MISSING_TEXT", 2: "EXTRA_TEXT", 3: "TEXT_MISMATCH", 4: "IMAGE_MISSING", 5: "ORDER_MISMATCH", 6: "TABLE_STRUCTURE"}
    status = F.when(c("l_linestatus") == "F", F.when(c("l_discount") >= 0.08, "AUTO_FIXED").otherwise("APPROVED")).otherwise(F.when(c("l_tax") >= 0.07, "REJECTED").when(c("l_tax") <= 0.0, "UNFIXABLE").otherwise("OPEN"))
    key = F.md5(F.concat_ws("|", *(c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")), c("l_extendedprice").cast("decimal(18,2)").cast("string")))
    return table(spark, sf_dir, "lineitem").withColumns({
        "severity": state.mapped(c("l_returnflag"), SEVERITY), "status": status,
        "type": F.coalesce(*(F.when(c("l_linenumber") == n, k) for n, k in kinds.items()), F.lit("FORMATTING")), "confidence": 0.75 + 2.5 * c("l_discount"), "id": key,
    })


@register("filtered_counters", f"""
WITH f AS (SELECT * FROM {_F} WHERE l_linestatus = 'F')
SELECT counter, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([severity, 'status:' || status]) AS counter FROM f) WHERE counter IS NOT NULL GROUP BY counter""")  # fmt: skip
def filtered_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity and by status over all findings that a filter keeps."""
    return aggregates.mixed_counters(state.matching(findings(spark, sf_dir), {"l_linestatus": "f", "severity": "ALL"}), "severity", "status")


@register("filtered_counts_then_limit", """
WITH f AS (SELECT * FROM events WHERE event_type = 'error')
SELECT event_id, user_id, value, (SELECT CAST(count(*) AS BIGINT) FROM f) AS total FROM f ORDER BY value DESC, event_id LIMIT 500""")  # fmt: skip
def filtered_counts_then_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 of the kept rows, a top-k, beside the count of all of them."""
    kept = state.matching(table(spark, sf_dir, "events"), {"event_type": "ERROR", "user_id": None})
    first, _ = aggregates.limited_with_counters(kept, "event_type", "event_type", [F.desc("value"), "event_id"])
    return first.crossJoin(F.broadcast(kept.agg(F.count("*").alias("total")))).select("event_id", "user_id", "value", "total")


@register("status_counts_and_rate", f"""
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS issues_found, CAST(count(*) FILTER (status = 'AUTO_FIXED') AS BIGINT) AS auto_fixed, CAST(count(*) FILTER (status = 'APPROVED') AS BIGINT) AS approved,
  CAST(count(*) FILTER (status = 'REJECTED') AS BIGINT) AS rejected, CAST(count(*) FILTER (status = 'OPEN') AS BIGINT) AS needs_review, CAST(count(*) FILTER (status = 'UNFIXABLE') AS BIGINT) AS unfixable,
  round(CAST(count(*) FILTER (status IN ('AUTO_FIXED', 'APPROVED')) AS DOUBLE) / count(*), 4) AS auto_fix_rate
FROM {_F} GROUP BY l_suppkey""")  # fmt: skip
def status_counts_and_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 per supplier."""
    return aggregates.status_summary(findings(spark, sf_dir), ["l_suppkey"], "status")


@register("severity_penalty_score", f"""
SELECT l_orderkey, CAST(greatest(0, 100 - sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'MAJOR' THEN 4 WHEN 'MINOR' THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM {_F} GROUP BY l_orderkey""")  # fmt: skip
def severity_penalty_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 with the fixed penalties."""
    return findings(spark, sf_dir).groupBy("l_orderkey").agg(aggregates.penalty_score(F.col("severity")).alias("score"))


@register("pending_by_project", f"""
SELECT o_custkey, CAST(count(*) AS BIGINT) AS pending FROM {_F} JOIN orders ON l_orderkey = o_orderkey WHERE status = 'OPEN' GROUP BY o_custkey""")  # fmt: skip
def pending_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: open findings per job are counted before jobs are joined."""
    per_job = aggregates.filtered_counts(findings(spark, sf_dir), ["l_orderkey"], F.col("status") == "OPEN")
    return per_job.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("pending"))


@register("project_stats", f"""
SELECT c_custkey AS project_id, CAST((SELECT count(*) FROM documents WHERE doc_id % 997 = c_custkey % 997) AS BIGINT) AS documents,
  CAST(coalesce(j.jobs, 0) AS BIGINT) AS jobs, CAST(coalesce(j.completed, 0) AS BIGINT) AS completed, CAST(coalesce(i.pending, 0) AS BIGINT) AS pending
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS jobs, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY 1) j ON j.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS pending FROM {_F} JOIN orders ON l_orderkey = o_orderkey WHERE status = 'OPEN' GROUP BY 1) i ON i.o_custkey = c_custkey""")  # fmt: skip
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, jobs, completed jobs and pending findings of every project; documents belong to the customers of their residue."""
    orders = table(spark, sf_dir, "orders")
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    shelf = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 997).alias("shelf")).agg(F.count("*").alias("documents"))
    jobs = orders.select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("QUEUED").alias("status"))
    issues = findings(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("project_id"), F.when(F.col("status") == "OPEN", "PENDING_REVIEW").otherwise(F.col("status")).alias("status"))
    none = projects.select("project_id").limit(0)
    found = state.project_stats(projects, none, jobs, issues).drop("documents")
    return found.join(shelf, F.col("project_id") % 997 == F.col("shelf"), "left").select("project_id", F.coalesce("documents", F.lit(0)).alias("documents"), "jobs", "completed", "pending")


@register("issue_type_ranking", f"""
WITH c AS (SELECT type, CAST(count(*) AS BIGINT) AS n FROM {_F} GROUP BY type)
SELECT type, n, CAST(row_number() OVER (ORDER BY n DESC, type) AS INTEGER) AS place, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS bar FROM c""")  # fmt: skip
def issue_type_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, O12."""
    return aggregates.type_ranking(findings(spark, sf_dir), "type")


@register("issue_groups", f"""
WITH f AS (SELECT severity, type, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.8 THEN 'medium' ELSE 'low' END AS band, l_quantity < 10 AS mathy, id, status = 'OPEN' AS p FROM {_F})
SELECT severity, type, band, mathy, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p) AS BIGINT) AS n_pending, array_to_string(list_sort(list(id))[1:3], ',') AS sample, CAST(greatest(0, count(*) - 3) AS BIGINT) AS n_more FROM f GROUP BY ALL""")  # fmt: skip
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of findings with their first ids."""
    f = findings(spark, sf_dir)
    found = aggregates.issue_groups(f, F.col("severity"), F.col("type"), classify.confidence_band(F.col("confidence")), F.col("l_quantity") < 10, "id", F.col("status") == "OPEN")
    return found.withColumn("sample", F.array_join("sample", ",")).withColumn("n_more", F.col("n_more").cast("long"))


@register("dashboard_totals", """
SELECT CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS completed, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS pending, CAST(count(DISTINCT o_custkey) AS BIGINT) AS projects FROM orders""")  # fmt: skip
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, A26, A28."""
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("jobs"), status("F").alias("completed"), status("P").alias("pending"), F.countDistinct("o_custkey").alias("projects"))


@register("distinct_domains", "SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()


@register("top4_most_common", """
WITH c AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_at FROM events GROUP BY ALL)
SELECT user_id, event_type, n, first_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_at) AS INTEGER) AS place FROM c QUALIFY place <= 4""")  # fmt: skip
def top4_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal counts the one seen first."""
    return aggregates.top_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@register("count_maps", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of counts by type, shown as text."""
    found = aggregates.counter_map(table(spark, sf_dir, "events"), ["user_id"], "event_type", "m")
    return found.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("counts"))


@register("report_recommendations", f"""
WITH s AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (status = 'OPEN') AS pending, count(*) FILTER (type = 'IMAGE_MISSING') AS images, count(*) FILTER (type = 'TABLE_STRUCTURE') AS tables FROM {_F} GROUP BY l_orderkey)
SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN critical > 0 THEN critical || ' critical issue(s) need manual review' END, CASE WHEN pending > 0 THEN pending || ' correction(s) wait for a decision' END,
  CASE WHEN images > 0 THEN images || ' image(s) are absent' END, CASE WHEN tables > 0 THEN 'Table structure differs' END, CASE WHEN coalesce(total, 0) = 0 THEN 'No issues detected' END], lambda x: x IS NOT NULL), '; ') AS notes
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")  # fmt: skip
def report_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job's report advises."""
    n = lambda column, v: F.count_if(F.col(column) == v)
    per_job = findings(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("total"), n("severity", "CRITICAL").alias("critical"), n("status", "OPEN").alias("pending"), n("type", "IMAGE_MISSING").alias("images"), n("type", "TABLE_STRUCTURE").alias("tables"))
    rows = table(spark, sf_dir, "orders").join(per_job, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["total", "critical", "pending", "images", "tables"])
    return rows.select("o_orderkey", F.array_join(aggregates.report_recommendations(*(F.col(c) for c in ("critical", "pending", "images", "tables", "total"))), "; ").alias("notes"))


_SCORES_SQL = """(SELECT o_orderkey AS doc, round(least(1, n / 4.0), 4) AS text, round(least(1, n / 6.0), 4) AS image, 1.0::DOUBLE AS structure, 0.9::DOUBLE AS "order", 1.0::DOUBLE AS question, 0.85::DOUBLE AS layout, high, medium, n
  FROM (SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS high, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS medium FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey))"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("high"), F.count_if(F.col("l_returnflag") == "A").alias("medium"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["n", "high", "medium"])
    share = lambda d: F.round(F.least(F.lit(1.0), F.col("n") / d), 4)
    return rows.select(F.col("o_orderkey").alias("doc"), share(4.0).alias("text"), share(6.0).alias("image"), F.lit(1.0).alias("structure"), F.lit(0.9).alias("order"), F.lit(1.0).alias("question"), F.lit(0.85).alias("layout"), "high", "medium", "n")


@register("overall_and_quality_score", f"""
WITH s AS (SELECT *, round(0.30 * text + 0.25 * image + 0.15 * structure + 0.10 * "order" + 0.15 * question + 0.05 * layout, 4) AS overall FROM {_SCORES_SQL})
SELECT doc, overall, round(greatest(0, overall - least(0.35, 0.05 * high + 0.02 * medium + 0.04 * (n // 5))), 4) AS quality FROM s""")  # fmt: skip
def overall_and_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, A10, X17."""
    s = _scores(spark, sf_dir).withColumn("overall", aggregates.overall_score(**{k: F.col(k) for k in aggregates.SCORE_WEIGHTS}))
    return s.select("doc", "overall", aggregates.quality_score(F.col("overall"), F.col("high"), F.col("medium"), F.floor(F.col("n") / 5)).alias("quality"))


@register("checklist", f"""
WITH s AS (SELECT * FROM {_SCORES_SQL}), c AS (
  SELECT doc, unnest([
    {{'seq': 0, 'name': 'Text coverage', 'passed': text >= 0.95, 'score': text}}, {{'seq': 1, 'name': 'Image coverage', 'passed': image >= 0.98, 'score': image}},
    {{'seq': 2, 'name': 'Structure integrity', 'passed': structure >= 0.95, 'score': structure}}, {{'seq': 3, 'name': 'Element order', 'passed': "order" >= 0.90, 'score': "order"}},
    {{'seq': 4, 'name': 'Question coverage', 'passed': question >= 1, 'score': question}}, {{'seq': 5, 'name': 'Visual layout', 'passed': layout >= 0.80, 'score': layout}},
    {{'seq': 6, 'name': 'No high-severity issues remaining', 'passed': high = 0, 'score': CASE WHEN high = 0 THEN 1.0 ELSE 0.0 END}},
    {{'seq': 7, 'name': 'No regressions introduced', 'passed': n // 5 = 0, 'score': CASE WHEN n // 5 = 0 THEN 1.0 ELSE 0.0 END}},
    {{'seq': 8, 'name': 'All image URLs resolve', 'passed': true, 'score': 1.0}}]) AS i FROM s)
SELECT doc, CAST(i.seq AS INTEGER) AS seq, i.name AS name, i.passed AS passed, CAST(i.score AS DOUBLE) AS score FROM c""")  # fmt: skip
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine rows per job."""
    s = _scores(spark, sf_dir).withColumns({"n_high": F.col("high"), "n_regressions": F.floor(F.col("n") / 5), "n_broken": F.lit(0)})
    return aggregates.checklist(s, ["doc"])


@register("weighted_mode_first_seen", """
WITH s AS (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS w, min(doc_id) AS o FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, lang AS mode, w AS weight FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, o, lang) = 1""")  # fmt: skip
def weighted_mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal weights the one seen first; texts are unread."""
    return aggregates.weighted_mode(table(spark, sf_dir, "documents"), ["source"], F.col("lang"), F.col("n_chars"), F.col("doc_id"))


@register("repeated_line_threshold", r"""
WITH l AS (SELECT DISTINCT source, doc_id, trim(line) AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
SELECT source, line, CAST(count(*) AS BIGINT) AS n FROM l JOIN p USING (source) GROUP BY source, line, pages HAVING count(*) >= 3 AND count(*) >= 0.01 * pages""")  # fmt: skip
def repeated_line_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents and a hundredth of a source's have."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", F.trim("line").alias("line")).where("line <> ''")
    return aggregates.repeated_keys(lines, ["source"], "line", "doc_id", docs.groupBy("source").agg(F.count("*").alias("pages")), 3, 0.01)


@register("capped_vote_argmax", """
WITH s AS (SELECT l_orderkey, l_suppkey, sum(least(25, l_quantity)) AS w FROM lineitem GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, l_suppkey) = 1)
SELECT l_orderkey, CASE WHEN w >= 30 THEN l_suppkey END AS l_suppkey, w AS votes FROM b""")  # fmt: skip
def capped_vote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with most capped votes of an order, if they are enough."""
    return aggregates.capped_votes(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", F.col("l_quantity"))


@register("home_panel_votes", """
WITH s AS (SELECT l_returnflag, l_orderkey, l_suppkey, sum(least(25, l_quantity)) AS w FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_orderkey, max(w) AS w FROM s GROUP BY ALL),
o AS (SELECT l_returnflag, l_suppkey, sum(least(25, l_quantity)) AS w FROM lineitem JOIN b USING (l_returnflag, l_orderkey) WHERE b.w < 30 GROUP BY ALL)
SELECT l_returnflag, l_suppkey, w AS votes FROM o QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY w DESC, l_suppkey) = 1""")  # fmt: skip
def home_panel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel for what A20 leaves undecided."""
    votes, w = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    return aggregates.home_panel(votes, aggregates.capped_votes(votes, ["l_returnflag", "l_orderkey"], "l_suppkey", w), ["l_returnflag"], "l_orderkey", "l_suppkey", w)


@register("numbering_gap_sets", """
WITH n AS (SELECT l_orderkey, list_distinct(list(CAST(l_linenumber AS BIGINT))) AS l FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(range(1, list_max(l) + 1), lambda x: NOT list_contains(l, x)), ',') AS gaps FROM n""")  # fmt: skip
def numbering_gap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that are missing."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("l"))
    return sets.select("l_orderkey", F.array_join(aggregates.numbering_gaps(F.col("l")), ",").alias("gaps"))


@register("reliable_text", """
WITH k AS (SELECT source, length(text) < 400 AS bad FROM documents) SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS n_unreadable, count(*) FILTER (bad) < 0.4 * count(*) AS reliable FROM k GROUP BY source""")  # fmt: skip
def reliable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30 with short texts in the role of unreadable blocks."""
    rows = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.length("text") < 400, "unreadable").otherwise("paragraph"))
    return aggregates.reliable_text(rows, ["source"], "kind")


@register("document_stats", r"""
SELECT source, CAST(count(*) AS BIGINT) AS n_blocks, CAST(coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))), 0) AS BIGINT) AS n_words, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS n_headings, CAST(count(*) FILTER (n_chars > 100) AS BIGINT) AS n_visible FROM documents GROUP BY source""")  # fmt: skip
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 with English texts in the role of headings and longer ones in that of visible blocks."""
    rows = table(spark, sf_dir, "documents").withColumns({"kind": F.when(F.col("lang") == "en", "heading").otherwise("paragraph"), "visible": F.col("n_chars") > 100})
    return aggregates.document_stats(rows, ["source"], "text", "kind", "visible")


@register("envelopes", "SELECT l_suppkey, min(l_quantity) AS x0, min(l_discount) AS top, max(l_quantity) AS x1, max(l_discount) AS bottom, round(avg(l_tax), 6) AS size FROM lineitem GROUP BY 1")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and smallest box."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", c("l_quantity").alias("x0"), c("l_discount").alias("top"), c("l_quantity").alias("x1"), c("l_discount").alias("bottom"), c("l_tax").alias("size"), c("l_returnflag").alias("font"), c("l_orderkey").alias("ord"))
    return aggregates.line_features(rows, ["l_suppkey"]).select("l_suppkey", "box.x0", "box.top", "box.x1", "box.bottom", F.round("size", 6).alias("size"))


@register("joined_blocks", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '')) AS digest FROM conversations GROUP BY conv_id")
def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's text in order."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(aggregates.joined_text("text", "turn").cast("binary")).alias("digest"))


@register("page_counts", """
SELECT o_orderkey, CAST(count(l_orderkey) FILTER (l_returnflag = 'R') AS BIGINT) AS n_images, CAST(count(l_orderkey) FILTER (l_returnflag <> 'R') AS BIGINT) AS n_blocks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")  # fmt: skip
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of two kinds per page."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return aggregates.page_counts(table(spark, sf_dir, "orders").select("o_orderkey"), {"images": items.where("l_returnflag = 'R'"), "blocks": items.where("l_returnflag <> 'R'")}, ["o_orderkey"])


@register("section_profiles", """
SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey), ',') AS levels, array_to_string(list_sort(list(DISTINCT CAST(l_quantity AS BIGINT))), ',') AS numbers,
  CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_images FROM lineitem GROUP BY 1""")  # fmt: skip
def section_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in order and sorted distinct numbers of a section."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.col("l_linenumber").alias("level"), F.col("l_quantity").cast("long").alias("number"), F.when(F.col("l_returnflag") == "R", "img").otherwise("p").alias("tag"))
    found = aggregates.section_profile(rows, ["l_orderkey"], "at")
    return found.select("l_orderkey", F.array_join(F.col("heading_levels").cast("array<string>"), ",").alias("levels"), F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), "n_images")


@register("csv_projection", f"""
SELECT severity || ',' || type || ',' || status || ',' || CAST(round(confidence * 100) AS INTEGER) || '%' || ',' || l_linenumber || ',' || '"' || l_orderkey || ',' || l_partkey || '"' AS value FROM {_F}""")  # fmt: skip
def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the export, here without the message."""
    rows = findings(spark, sf_dir).select(F.col("type").alias("severity"), F.col("severity").alias("type"), "status", F.round("confidence", 6).alias("confidence"), F.col("l_linenumber").alias("page"), F.concat_ws(",", "l_orderkey", "l_partkey").alias("selector"), F.lit(None).cast("string").alias("message"))
    return files.csv_lines(rows).select(F.regexp_replace("value", ",$", "").alias("value"))


@register("vocab_map_projection", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'IMAGE_MISSING' WHEN 'error' THEN 'MISSING_TEXT' WHEN 'purchase' THEN 'TEXT_MISMATCH' WHEN 'signup' THEN 'FORMATTING' ELSE 'FORMATTING' END AS type,
  CASE WHEN value >= 80 THEN 'CRITICAL' WHEN value >= 40 THEN 'MAJOR' WHEN value >= 20 THEN 'MINOR' ELSE 'INFO' END AS severity, 'PENDING_REVIEW' AS status, event_type AS message, NULLIF('p' || user_id, '') AS selector, props AS pdf_text FROM events""")  # fmt: skip
def vocab_map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 with the fixed vocabularies."""
    kinds = {"click": "MISSING_IMAGE", "error": "MISSING_SECTION", "purchase": "QUESTION_MISMATCH", "signup": "ALIGNMENT", "view": "SOMETHING_ELSE"}
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), state.mapped(F.col("event_type"), kinds).alias("type"), F.when(v >= 80, "HIGH").when(v >= 40, "MEDIUM").otherwise("LOW").alias("severity"), F.when(v < 50, "OPEN").otherwise("UNFIXABLE").alias("status"),
        F.when(v >= 20, 0.7).otherwise(0.5).alias("confidence"), F.lit(1).alias("page"), F.lit("").alias("dom_path"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("location"), F.col("event_type").alias("description"), F.lit("").alias("suggestion"),
        F.create_map(F.lit("pdf_text"), F.lit(" "), F.lit("text"), F.col("props")).alias("evidence"),
    )
    return state.issue_documents(rows).select(F.col("id").alias("event_id"), "type", "severity", "status", "message", "selector", "pdf_text")


@register("shown_sizes_and_times", """
WITH o AS (SELECT o_orderkey, CAST(o_totalprice * (o_orderkey % 7) * (o_orderkey % 11) * 37 AS DOUBLE) AS b, datediff('minute', TIMESTAMP '1998-01-01', o_orderdate) AS m FROM orders)
SELECT o_orderkey, CASE WHEN b = 0 THEN '—' WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size,
  CASE WHEN -m < 1 THEN 'just now' WHEN -m < 60 THEN (-m) || 'm ago' WHEN floor(-m / 60.0 + 0.5) < 24 THEN CAST(floor(-m / 60.0 + 0.5) AS BIGINT) || 'h ago' WHEN floor(floor(-m / 60.0 + 0.5) / 24.0 + 0.5) < 30 THEN CAST(floor(floor(-m / 60.0 + 0.5) / 24.0 + 0.5) AS BIGINT) || 'd ago' ELSE 'earlier' END AS age FROM o""")  # fmt: skip
def shown_sizes_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14 and relative times; dates over a month old are only told as earlier here."""
    from ..functions.text import format_bytes

    size = (F.col("o_totalprice") * (F.col("o_orderkey") % 7) * (F.col("o_orderkey") % 11) * 37).cast("double")
    age = misc.relative_time(F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", format_bytes(size).alias("size"), F.when(age.rlike("ago$|now$"), age).otherwise("earlier").alias("age"))


@register("digest_of_texts", "SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def digest_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, S16."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", hashing.sha256(F.col("text")).alias("checksum"))


@register("exact_duplicate_docs", """
SELECT sha256(text) AS checksum, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def exact_duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; digests alone are shuffled."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(hashing.sha256(F.col("text")).alias("checksum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("later_line_occurrences", r"""
WITH l AS (SELECT source, doc_id, i, trim(lines[i]) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS r FROM l WHERE line <> '') WHERE r > 1 GROUP BY doc_id""")  # fmt: skip
def later_line_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document that came before somewhere."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.trim("line").alias("line")).where("line <> ''")
    return sequence.later_occurrences(lines, F.col("line"), F.struct("doc_id", "i"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
