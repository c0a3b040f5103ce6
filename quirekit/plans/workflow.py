"""Workflow queries: state, decisions, queue and report operators over orders, line items and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, misc
from ..operators import corrections, state, verification
from ..sources.tables import ensure_checkpoint_dir, table
from ..streaming import queue
from .catalog import register
from .counting import _F, findings

_UI_SQL = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'QUEUED' END"


@register("lexicographic_vs_ranked_sort", """
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) AS INTEGER) AS by_text,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS by_rank FROM orders""")  # fmt: skip
def lexicographic_vs_ranked_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's place by its severity's text and by a rank of severities."""
    from pyspark.sql import Window as W

    rank = state.mapped(F.col("o_orderpriority"), {"2-HIGH": "0", "1-URGENT": "1", "3-MEDIUM": "2"}, "3")
    place = lambda *order: F.row_number().over(W.partitionBy("o_custkey").orderBy(*order, "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", place(F.desc("o_orderpriority"), "o_orderdate").alias("by_text"), place(rank, F.desc("o_totalprice")).alias("by_rank"))


@register("pagination_window", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 9 OFFSET 18")
def pagination_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of nine, here of an order that has no ties."""
    return state.page_of(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), "c_custkey"], 3).select("c_custkey", "c_name")


@register("newest_first_top", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_first_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5, O6."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@register("project_search", """
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND (contains(lower(c_name), '7') OR contains(lower(n_name), '7'))""")  # fmt: skip
def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, with a wildcard for the nation."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return state.search(rows, " 7 ", ["c_name", "n_name"], c_mktsegment="machinery", n_name="ALL").select("c_custkey")


@register("bulk_targets", f"""
SELECT l_orderkey, CAST(count(*) FILTER (status IN ('APPROVED', 'REJECTED')) AS BIGINT) AS to_reset, CAST(count(*) FILTER (status <> 'APPROVED') AS BIGINT) AS to_approve FROM {_F} GROUP BY l_orderkey""")  # fmt: skip
def bulk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per job that a reset and an approval of all would change."""
    f = findings(spark, sf_dir)
    n = lambda d, name: state.bulk_targets(f, "status", d).groupBy("l_orderkey").agg(F.count("*").alias(name))
    jobs = f.select("l_orderkey").distinct()
    return jobs.join(n("PENDING_REVIEW", "to_reset"), "l_orderkey", "left").join(n("APPROVED", "to_approve"), "l_orderkey", "left").fillna(0, ["to_reset", "to_approve"])


@register("fix_decisions", f"""
SELECT id, CASE WHEN status = 'REJECTED' THEN 'rejected by reviewer' WHEN l_linenumber = 7 THEN 'no correction available' WHEN status = 'APPROVED' THEN NULL WHEN l_quantity < 5 THEN 'not auto-fixable' WHEN confidence < 0.9 THEN 'confidence below threshold' END AS reason,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 2 WHEN 5 THEN 7 WHEN 6 THEN 0 ELSE 8 END, confidence DESC, id) AS INTEGER) AS step FROM {_F}""")  # fmt: skip
def fix_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which findings are fixed without review, why not, and in which order."""
    actions = {1: "INSERT_TEXT", 2: "REMOVE_WATERMARK", 3: "REPLACE_TEXT", 4: "INSERT_IMAGE", 5: "REORDER_ELEMENT", 6: "SET_ALT_TEXT"}
    rows = findings(spark, sf_dir).withColumns({"doc": F.col("l_orderkey"), "action": F.coalesce(*(F.when(F.col("l_linenumber") == n, a) for n, a in actions.items())), "auto_fixable": F.col("l_quantity") >= 5, "list": F.lit(0), "seq": F.col("id")})
    return corrections.plan(rows, 0.9).select("id", "reason", "step")


@register("bulk_decision_reset", f"""
SELECT id, CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_quantity >= 5 AND confidence >= 0.95 THEN 'AUTO_FIXED' ELSE 'PENDING_REVIEW' END ELSE status END AS status FROM {_F}""")  # fmt: skip
def bulk_decision_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings after a reset of some suppliers' ones."""
    rows = findings(spark, sf_dir).withColumn("auto_fixable", F.col("l_quantity") >= 5)
    return state.decided(rows, rows.where(F.col("l_suppkey") % 3 == 0).select("id"), "PENDING_REVIEW").select("id", "status")


@register("correction_upsert", """
WITH c AS (SELECT o_orderkey AS issue_id, 'old' AS after, CASE WHEN o_orderstatus = 'F' THEN 'MANUAL' ELSE 'AUTO' END AS applied_by, 'APPLIED' AS status FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT * FROM c WHERE issue_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000) UNION ALL SELECT o_orderkey, 'to ' || o_orderstatus, 'MANUAL', 'APPLIED' FROM orders WHERE o_totalprice > 250000""")  # fmt: skip
def correction_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections after an approval of the dear jobs."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("issue_id"), F.lit("s").alias("selector"), F.lit("").alias("before"), F.lit("old").alias("after"), F.when(F.col("o_orderstatus") == "F", "MANUAL").otherwise("AUTO").alias("applied_by"), F.lit("APPLIED").alias("status"))
    issues = orders.select(F.col("o_orderkey").alias("id"), F.lit("s").alias("selector"), F.lit(None).cast("string").alias("html_text"), F.concat(F.lit("to "), "o_orderstatus").alias("suggestion"), "o_totalprice")
    return state.corrections_after(old, issues, issues.where("o_totalprice > 250000").select("id"), "APPROVED").select("issue_id", "after", "applied_by", "status")


@register("correction_revert", """
SELECT o_orderkey AS issue_id, CASE WHEN o_totalprice > 250000 AND o_orderstatus = 'F' THEN 'REVERTED' ELSE 'APPLIED' END AS status FROM orders""")  # fmt: skip
def correction_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset of the dear jobs reverts what was applied by hand."""
    orders = table(spark, sf_dir, "orders")
    old = orders.select(F.col("o_orderkey").alias("issue_id"), F.when(F.col("o_orderstatus") == "F", "MANUAL").otherwise("AUTO").alias("applied_by"), F.lit("APPLIED").alias("status"))
    return state.corrections_after(old, orders, orders.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("id")), "PENDING_REVIEW").select("issue_id", "status")


@register("affected_jobs", "SELECT DISTINCT o_custkey AS job_id FROM orders WHERE o_totalprice > 400000")
def affected_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that a decision on many findings rebuilds, each once."""
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), "o_totalprice")
    return state.affected_jobs(issues, issues.where("o_totalprice > 400000"))


@register("decision_fold_back", """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'APPROVED' WHEN o_orderpriority = '2-HIGH' THEN 'OPEN' ELSE 'E' || o_orderstatus END AS status FROM orders""")  # fmt: skip
def decision_fold_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3: the engine's findings with the reviewer's decision where there is a known one."""
    orders = table(spark, sf_dir, "orders")
    shown = orders.select(F.col("o_orderkey").alias("id"), state.mapped(F.col("o_orderpriority"), {"1-URGENT": "APPROVED", "2-HIGH": "PENDING_REVIEW"}, "SOMETHING").alias("status"))
    engine = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("E"), "o_orderstatus").alias("status"))
    return state.folded_back(engine, shown, "id").select("id", "status")


_OLD_SQL = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderpriority <> '5-LOW'"
_NEW_SQL = "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_custkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderpriority <> '1-URGENT'"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..functions.hashing import content_hash

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_custkey", "o_orderpriority")
    old = orders.where("o_orderpriority <> '5-LOW'").withColumns({"digest": content_hash("status", "price"), "created_at": F.lit(1), "updated_at": F.lit(1)})
    new = orders.where("o_orderpriority <> '1-URGENT'").withColumn("price", F.when(F.col("o_custkey") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return old, new


@register("change_detection_hash", f"WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL}) SELECT n.id, n.price FROM n LEFT JOIN o ON o.id = n.id WHERE o.id IS NULL OR o.status <> n.status OR o.price <> n.price")
def change_detection_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are new or whose digest changed."""
    old, new = _snapshots(spark, sf_dir)
    return state.changed(new, old, "id", ["status", "price"]).select("id", "price")


@register("upsert_snapshot", f"""
WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL}) SELECT n.id, n.status, n.price, CASE WHEN o.id IS NULL THEN 2 ELSE 1 END AS created_at, CASE WHEN o.status = n.status AND o.price = n.price THEN 1 ELSE 2 END AS updated_at FROM n LEFT JOIN o ON o.id = n.id""")  # fmt: skip
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, U4: the next state, without the keys that are gone."""
    old, new = _snapshots(spark, sf_dir)
    return state.upserted(old, new, "id", ["status", "price"], F.lit(2)).select("id", "status", "price", "created_at", "updated_at")


@register("latest_state_merge", """
WITH h AS (SELECT *, CAST(ts AS DATE) < DATE '2024-01-16' AS early FROM events),
j AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(value) AS best FROM h WHERE early GROUP BY 1), s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM h WHERE NOT early AND event_type IN ('error', 'purchase') GROUP BY 1)
SELECT coalesce(j.user_id, s.user_id) AS user_id, best, coalesce(s.status, j.status) AS status FROM j FULL JOIN s ON j.user_id = s.user_id""")  # fmt: skip
def latest_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier half's last state of a job with the later one's over it."""
    events = table(spark, sf_dir, "events")
    early = F.col("ts").cast("date") < F.lit("2024-01-16").cast("date")
    first = events.where(early)
    jobs = state.latest(first, ["user_id"], "ts", "event_id").select("user_id", F.col("event_type").alias("status")).join(first.groupBy("user_id").agg(F.max("value").alias("best")), "user_id")
    later = state.latest(events.where(~early & F.col("event_type").isin("error", "purchase")), ["user_id"], "ts", "event_id").select("user_id", F.col("event_type").alias("status"))
    return state.overlaid(jobs, later, ["user_id"], ["status"])


@register("latest_per_type", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1."""
    return state.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@register("job_documents", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'own' ELSE c_name END AS pdf_url, n_name AS html_url, CASE WHEN n_name IS NULL THEN 'no HTML document' END AS error
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 30""")  # fmt: skip
def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both documents of a job, its own URL first; some have none."""
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("url")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("pdf_document_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string")).alias("html_document_id"), F.when(F.col("o_orderkey") % 5 == 0, "own").otherwise("").alias("pdf_url"), F.lit(None).cast("string").alias("html_url"))
    return state.resolved_documents(jobs, docs).select("o_orderkey", "pdf_url", "html_url", "error")


@register("skip_reasons", f"""
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, p_type AS reason FROM lineitem a LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25""")  # fmt: skip
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup that some keys lack."""
    reasons = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return state.with_lookup(table(spark, sf_dir, "lineitem"), reasons, "l_partkey", "p_type", "reason").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")


@register("corrections_by_run", """
WITH n AS (SELECT l_orderkey, count(*) AS n_corrections, count(*) FILTER (l_linestatus = 'F') AS n_applied FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(n_corrections AS BIGINT) AS n_corrections, CAST(n_applied AS BIGINT) AS n_applied, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders JOIN n ON l_orderkey = o_orderkey""")  # fmt: skip
def corrections_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of each run, a project's newest run first."""
    jobs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_linestatus") == "F", "APPLIED").otherwise("REVERTED").alias("status"))
    return state.corrections_by_run(jobs, done, ["o_custkey"]).select("o_orderkey", "n_corrections", "n_applied", "place")


@register("job_transitions", f"""
WITH j AS (SELECT o_orderkey, {_UI_SQL} AS s, ['cancel', 'retry', 'set-image-start', 'other'][CAST(o_custkey % 4 + 1 AS INT)] AS a, CAST(o_custkey % 3 AS VARCHAR) AS v FROM orders),
c AS (SELECT *, CASE a WHEN 'cancel' THEN CASE WHEN s = 'COMPLETED' THEN 409 ELSE 200 END WHEN 'retry' THEN 409 WHEN 'set-image-start' THEN CASE WHEN v <> '0' THEN 200 ELSE 400 END ELSE 400 END AS code FROM j)
SELECT o_orderkey, CASE WHEN code = 200 AND a = 'cancel' THEN 'CANCELLED' ELSE s END AS status, code FROM c""")  # fmt: skip
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    status = state.mapped(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "PROCESSING"}, "QUEUED")
    action = F.element_at(F.array(*map(F.lit, ("cancel", "retry", "set-image-start", "other"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", state.job_transition(status, action, (F.col("o_custkey") % 3).cast("string")).alias("t")).select("o_orderkey", "t.status", "t.code")


@register("job_state_update", f"""
SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'COMPLETED' ELSE {_UI_SQL} END AS status, CASE WHEN o_custkey % 3 = 0 THEN 100 ELSE 10 END AS progress, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'e' END AS error,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'COMPARING' END AS stage, 'u' AS url, CASE WHEN o_custkey % 3 = 0 THEN 87 ELSE 5 END AS quality FROM orders""")  # fmt: skip
def job_state_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A final state is laid over some jobs: it clears error and stage, but not the URL."""
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(F.col("o_orderkey").alias("id"), state.mapped(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "PROCESSING"}, "QUEUED").alias("status"), F.lit(10).alias("progress"), F.lit("e").alias("error"), F.lit("COMPARING").alias("stage"), F.lit("u").alias("url"), F.lit(5).alias("quality"))
    fields = {"status": "COMPLETED", "progress": "100", "error": None, "stage": "completed", "url": "", "quality": "0.87"}
    update = orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), F.lit(v).cast("string")))).alias("state"))
    return state.job_update(jobs, update)


@register("stage_steps", """
WITH j AS (SELECT o_orderkey, o_orderstatus AS s, o_custkey % 6 AS now FROM orders), e AS (SELECT *, unnest(range(1, 6)) AS place FROM j)
SELECT o_orderkey, CAST(place - 1 AS INTEGER) AS step, CASE WHEN s = 'F' THEN 'done' WHEN now > 0 AND place < now THEN 'done' WHEN now > 0 AND place = now THEN CASE WHEN s = 'P' THEN 'failed' ELSE 'active' END ELSE 'pending' END AS state FROM e""")  # fmt: skip
def stage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    stage = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, state.STAGES)), (F.col("o_custkey") % 6).cast("int"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", state.mapped(F.col("o_orderstatus"), {"F": "COMPLETED", "P": "FAILED"}, "PROCESSING").alias("status"), stage.alias("stage"))
    return state.stage_steps(jobs).select("o_orderkey", "step", "state")


@register("remaining_time", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 100 >= 5 THEN round(3600000.0 / ((o_custkey % 100) / 100.0) - 3600000, 3) END AS remaining, CAST(3600000 AS BIGINT) AS elapsed FROM orders""")  # fmt: skip
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8, durations: an hour after the start."""
    start = F.col("o_orderdate").cast("timestamp")
    now = start + F.expr("interval 1 hour")
    left = misc.remaining_ms(F.when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("QUEUED"), F.col("o_custkey") % 100, start, now)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(left, 3).alias("remaining"), misc.duration_ms(start, now).alias("elapsed"))


@register("form_faults", """
SELECT p_partkey, CASE WHEN length(trim(p_name[1:2] || repeat('x', p_partkey % 3))) < 3 THEN 'name needs three characters' WHEN p_partkey % 4 = 0 THEN 'subject is required' END AS fault, greatest(1, p_partkey % 5 - 1) AS start FROM part""")  # fmt: skip
def form_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X21."""
    name = F.concat(F.substring("p_name", 1, 2), F.expr("repeat('x', cast(p_partkey % 3 as int))"))
    start = F.when(F.col("p_partkey") % 5 == 0, "no number").otherwise((F.col("p_partkey") % 5 - 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", state.valid_project(name, F.when(F.col("p_partkey") % 4 == 0, " ").otherwise("s")).alias("fault"), misc.image_start_number(start).cast("long").alias("start"))


@register("engine_verdicts", f"SELECT id, CASE WHEN l_quantity >= 5 AND confidence >= 0.95 THEN 'AUTO_FIXED' ELSE 'PENDING_REVIEW' END AS verdict FROM {_F}")
def engine_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 with the fixed threshold."""
    return findings(spark, sf_dir).select("id", classify.engine_verdict(F.col("l_quantity") >= 5, F.col("confidence")).alias("verdict"))


@register("issue_diff", """
WITH s AS (SELECT l_suppkey AS doc, l_linenumber AS type, l_returnflag AS k, bool_or(l_shipdate < TIMESTAMP '1998-01-01') AS b, bool_or(l_shipdate >= TIMESTAMP '1998-01-01') AS a FROM lineitem GROUP BY ALL)
SELECT doc, type, k, CASE WHEN a AND b THEN 'unresolved' WHEN b THEN 'resolved' WHEN EXISTS (SELECT 1 FROM s o WHERE o.doc = s.doc AND o.type = s.type AND o.a AND o.b) THEN 'knock-on' ELSE 'regression' END AS outcome FROM s""")  # fmt: skip
def issue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, U6 of each document: findings before and since 1998."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("type"), F.col("l_returnflag").alias("k"), "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return verification.issue_diff(rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut), ["doc", "type", "k"], "type", ["doc"])


@register("folded_job_states", """
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'CANCELLED' WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'PROCESSING' END AS s FROM events),
f AS (SELECT user_id, arg_max(s, (ts, event_id)) AS last, max((ts, event_id)) FILTER (s = 'CANCELLED') AS c, max((ts, event_id)) FILTER (s = 'QUEUED') AS q, count(*) AS n FROM e GROUP BY 1)
SELECT user_id, CASE WHEN c IS NOT NULL AND (q IS NULL OR q < c) THEN 'CANCELLED' ELSE last END AS status, CAST(n AS BIGINT) AS n_events FROM f""")  # fmt: skip
def folded_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.9: a cancellation holds against progress that comes later."""
    status = state.mapped(F.col("event_type"), {"error": "CANCELLED", "signup": "QUEUED", "purchase": "COMPLETED"}, "PROCESSING")
    return queue.folded_states(table(spark, sf_dir, "events").withColumn("status", status), "user_id", "ts", "event_id", "status")


@register("claimed_jobs", "SELECT o_orderkey AS id, 'PROCESSING' AS status, 0 AS progress FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 2")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10, claims: the two oldest queued jobs."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state.mapped(F.col("o_orderstatus"), {"P": "QUEUED"}, "COMPLETED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return queue.claimed(jobs, 2).select("id", "status", "progress")


_SLOT = 6 * 3600


@register("stream_queue_coalesce", f"SELECT user_id, CAST(epoch_us(ts) // {_SLOT * 1_000_000} AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS n_requests FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def stream_queue_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.9: requests as a stream, run to its end; a user's requests within six hours lead to one rebuild."""
    folder = f"{ensure_checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    requests = spark.readStream.schema(schema).parquet(source if _is_folder(spark, source) else f"{sf_dir}/events*.parquet")
    return queue.run_coalesced(spark, requests, f"{folder}/out", f"{folder}/state", "user_id", "ts", _SLOT)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files, in whatever store; a stream reads folders, or files by a pattern."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
