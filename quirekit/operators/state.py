"""State and data-changing operators (M1-M10, J13-J19, J30, P3-P7, P14-P18, U4, X1, X7, X9, X18): every one returns the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, hashing

# How the engine's vocabulary is shown, and the other way round.
TYPE_MAP = {
    "MISSING_IMAGE": "IMAGE_MISSING", "BROKEN_IMAGE_SRC": "IMAGE_MISSING", "IMAGE_MISMATCH": "IMAGE_MISMATCH", "EXTRA_IMAGE": "IMAGE_MISMATCH",
    "MISSING_TEXT": "MISSING_TEXT", "MISSING_SECTION": "MISSING_TEXT", "MISSING_QUESTION": "MISSING_TEXT", "MISSING_ANSWER": "MISSING_TEXT",
    "EXTRA_TEXT": "EXTRA_TEXT", "DUPLICATE_QUESTION": "EXTRA_TEXT", "WATERMARK": "EXTRA_TEXT", "TEXT_MISMATCH": "TEXT_MISMATCH", "QUESTION_MISMATCH": "TEXT_MISMATCH",
    "MISSING_ALT_TEXT": "FORMATTING", "HEADING_LEVEL_MISMATCH": "FORMATTING", "STRUCTURE_MISMATCH": "FORMATTING", "ALIGNMENT": "FORMATTING", "LAYOUT_MISMATCH": "FORMATTING",
    "ORDER_MISMATCH": "ORDER_MISMATCH", "EXTRACTION_WARNING": "FORMATTING",
}
STATUS_TO_UI = {"OPEN": "PENDING_REVIEW", "UNFIXABLE": "PENDING_REVIEW", "AUTO_FIXED": "AUTO_FIXED", "APPROVED": "APPROVED", "REJECTED": "REJECTED"}
STATUS_FROM_UI = {"PENDING_REVIEW": "OPEN", "AUTO_FIXED": "AUTO_FIXED", "APPROVED": "APPROVED", "REJECTED": "REJECTED"}
STAGES = ("ANALYZING_PDF", "ANALYZING_HTML", "COMPARING", "CORRECTING", "VERIFYING")
STAGE_MAP = {
    "resolving": "ANALYZING_PDF", "downloading": "ANALYZING_PDF", "analyzing-pdf": "ANALYZING_PDF", "analyzing-html": "ANALYZING_HTML",
    "comparing": "COMPARING", "correcting": "CORRECTING", "verifying": "VERIFYING", "publishing": "VERIFYING",
}
DECISIONS = ("APPROVED", "REJECTED", "PENDING_REVIEW")


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A lookup in a fixed vocabulary; ``default`` for what it lacks."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(default))


def ui_severity(severity: Column, confidence: Column) -> Column:
    """CRITICAL, MAJOR, then MINOR from a confidence of 0.7 on, else INFO."""
    return F.when(severity == "HIGH", "CRITICAL").when(severity == "MEDIUM", "MAJOR").when(confidence >= 0.7, "MINOR").otherwise("INFO")


def matching(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Rows that equal every value given; None and ALL match anything. Values are compared in upper case, as filters of the interface are."""
    tests = [F.upper(F.col(c).cast("string")) == v.upper() for c, v in wanted.items() if v is not None and v != "ALL"]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def search(df: DataFrame, text: str, columns: list[str], **wanted: str | None) -> DataFrame:
    """P5: rows that match ``wanted`` and of whose columns one contains the text, whatever the case; an empty text matches all."""
    found = matching(df, wanted)
    if not text.strip():
        return found
    return found.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.strip().lower())), F.lit(False)) for c in columns)))


def bulk_targets(df: DataFrame, status: str, decision: str) -> DataFrame:
    """The rows that a decision would change: a reset those decided, another one those that don't have it yet."""
    return df.where(F.col(status).isin("APPROVED", "REJECTED") if decision == "PENDING_REVIEW" else F.col(status) != decision)


def issue_documents(issues: DataFrame) -> DataFrame:
    """Findings as the interface shows them. Columns of ``issues``: id, type, severity, status, confidence, page, dom_path, location, description, suggestion and evidence, a map."""
    evidence = lambda *keys: F.coalesce(*(F.when(F.trim(F.col("evidence")[k]) != "", F.substring(F.col("evidence")[k], 1, 2000)) for k in keys))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return issues.select(
        "id", mapped(F.col("type"), TYPE_MAP, "FORMATTING").alias("type"), ui_severity(F.col("severity"), F.col("confidence")).alias("severity"), mapped(F.col("status"), STATUS_TO_UI, "PENDING_REVIEW").alias("status"),
        F.round("confidence", 4).alias("confidence"), "page", F.coalesce(empty("dom_path"), empty("location")).alias("selector"), F.col("description").alias("message"),
        evidence("pdf_text", "text", "caption", "title").alias("pdf_text"), evidence("html_text", "src", "html_src").alias("html_text"), empty("suggestion").alias("suggestion"),
    )


def correction_documents(issues: DataFrame) -> DataFrame:
    """A record per applied correction. Columns: id, status, dom_path, target_dom_path, evidence and payload (maps), note."""
    p = lambda k: F.nullif(F.col("payload")[k], F.lit(""))
    after = F.coalesce(p("hosted_url"), p("text"), p("alt"), p("title"), F.concat(F.lit("h"), F.col("payload")["level"]), F.col("note"), F.lit(""))
    e = lambda k: F.when(F.trim(F.col("evidence")[k]) != "", F.substring(F.col("evidence")[k], 1, 2000))
    return issues.select(
        F.col("id").alias("issue_id"), F.coalesce(F.nullif("target_dom_path", F.lit("")), "dom_path").alias("selector"), F.coalesce(e("html_text"), e("src"), e("html_src"), F.lit("")).alias("before"),
        F.substring(after, 1, 2000).alias("after"), F.when(F.col("status") == "APPROVED", "MANUAL").otherwise("AUTO").alias("applied_by"), F.lit("APPLIED").alias("status"),
    )


def job_update(jobs: DataFrame, update: DataFrame) -> DataFrame:
    """Jobs with a partial state laid over them.

    ``update`` has id and ``state``, a map of the fields that are set. Status,
    progress and error are taken where they are set, null included; URLs only
    where they aren't empty; a stage is cleared once the status is final;
    quality is shown of 100.
    """
    s = F.col("state")
    has = lambda k: F.coalesce(F.map_contains_key(s, F.lit(k)), F.lit(False))
    taken = lambda k, old: F.when(has(k), s[k]).otherwise(F.col(old))
    stage = mapped(s["stage"], STAGE_MAP)
    final = s["status"].isin("COMPLETED", "FAILED", "CANCELLED")
    return jobs.join(update.select("id", "state"), "id", "left").select(
        "id", taken("status", "status").alias("status"), taken("progress", "progress").cast("int").alias("progress"), taken("error", "error").alias("error"),
        F.when(has("stage") & stage.isNotNull(), stage).when(has("stage") & F.coalesce(final, F.lit(False)), None).otherwise(F.col("stage")).alias("stage"),
        F.coalesce(F.nullif(s["url"], F.lit("")), "url").alias("url"), F.coalesce(F.round(s["quality"].try_cast("double") * 100).cast("int"), "quality").alias("quality"),
    )


def overlaid(rows: DataFrame, update: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the columns of ``update`` where it has a value, and its rows of other keys added (full outer, right wins)."""
    u = update.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    rest = [c for c in rows.columns if c not in keys and c not in columns]
    return rows.join(u, keys, "full_outer").select(*keys, *rest, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def resolved_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs with the URLs of both documents, a job's own first; ``error`` where one has none."""
    d = lambda side: documents.select(F.col("id").alias(f"{side}_document_id"), F.col("url").alias(f"__{side}"))
    found = jobs.join(d("pdf"), "pdf_document_id", "left").join(d("html"), "html_document_id", "left")
    found = found.withColumns({f"{s}_url": F.coalesce(F.nullif(f"{s}_url", F.lit("")), f"__{s}") for s in ("pdf", "html")}).drop("__pdf", "__html")
    return found.withColumn("error", F.when(F.col("pdf_url").isNull(), "no PDF document").when(F.col("html_url").isNull(), "no HTML document"))


def with_lookup(rows: DataFrame, other: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows with the value that another table has for their key, null without one."""
    return rows.join(other.select(F.col(key), F.col(value).alias(name)).dropDuplicates([key]), key, "left")


def corrections_by_run(jobs: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections per job, a project's (``keys``) newest job first in ``place``."""
    n = corrections.groupBy("job_id").agg(F.count("*").alias("n_corrections"), F.count_if(F.col("status") == "APPLIED").alias("n_applied"))
    return jobs.join(n, "job_id").withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("created_at"), "job_id")))


def changed(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that are new or whose digest isn't the stored one, with ``digest``; ``old`` has key and digest."""
    now = new.withColumn("digest", hashing.content_hash(*columns))
    return now.join(old.select(key, F.col("digest").alias("__old")), key, "left").where(~F.col("digest").eqNullSafe(F.col("__old"))).drop("__old")


def upserted(old: DataFrame, new: DataFrame, key: str, columns: list[str], now: Column, scope: list[str] | None = None) -> DataFrame:
    """M1, U4, M6: the next state of a table (key, columns, digest, created_at, updated_at).

    New keys come in; rows with another digest are replaced and keep their
    creation time; others stay as they are; keys that are no longer there go.
    An empty ``new`` leaves nothing. Both sides hold a key once.
    """
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns), hashing.content_hash(*columns).alias("__digest"))
    both = n.join(old, key, "left")
    same = F.col("digest").eqNullSafe(F.col("__digest"))
    return both.select(
        key, *(F.when(same, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns), F.col("__digest").alias("digest"),
        F.coalesce("created_at", now).alias("created_at"), F.when(same, F.col("updated_at")).otherwise(now).alias("updated_at"),
    )


def kept_status(rebuilt: DataFrame, stored: DataFrame, key: str, status: str) -> DataFrame:
    """M2: rebuilt rows with the status that a reviewer gave them, their own where there is none stored."""
    return rebuilt.join(stored.select(key, F.col(status).alias("__kept")), key, "left").withColumn(status, F.coalesce("__kept", status)).drop("__kept")


def folded_back(engine: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """M3: the engine's findings with the decision that the interface shows; an unknown one leaves the engine's status."""
    s = shown.select(key, F.col("status").alias("ui_status"))
    return engine.join(s, key, "left").withColumn("status", F.coalesce(mapped(F.col("ui_status"), STATUS_FROM_UI), "status"))


def decided(issues: DataFrame, ids: DataFrame, decision: str, threshold: float = 0.95) -> DataFrame:
    """Issues (id, status, auto_fixable, confidence) after one decision on ``ids``; a reset restores the engine's verdict."""
    if decision not in DECISIONS:
        raise ValueError(f"no decision: {decision}")
    new = classify.engine_verdict(F.col("auto_fixable"), F.col("confidence"), threshold) if decision == "PENDING_REVIEW" else F.lit(decision)
    return issues.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left").withColumn("status", F.when(F.col("__hit"), new).otherwise(F.col("status"))).drop("__hit")


def corrections_after(corrections: DataFrame, issues: DataFrame, ids: DataFrame, decision: str) -> DataFrame:
    """Corrections (issue_id, selector, before, after, applied_by, status) after a decision.

    Approval applies an issue's suggestion by hand, over its correction or as a
    new one; rejection reverts; a reset reverts what was applied by hand.
    """
    hit = ids.select(F.col("id").alias("issue_id")).distinct()
    if decision == "APPROVED":
        given = issues.where(F.coalesce(F.col("suggestion"), F.lit("")) != "").join(hit, F.col("id") == F.col("issue_id"), "left_semi")
        fresh = given.select(F.col("id").alias("issue_id"), "selector", F.coalesce("html_text", F.lit("")).alias("before"), F.col("suggestion").alias("after"), F.lit("MANUAL").alias("applied_by"), F.lit("APPLIED").alias("status"))
        return corrections.join(fresh, "issue_id", "left_anti").unionByName(fresh)
    gone = F.lit(True) if decision == "REJECTED" else F.col("applied_by") == "MANUAL"
    marked = corrections.join(hit.withColumn("__hit", F.lit(True)), "issue_id", "left")
    return marked.withColumn("status", F.when(F.col("__hit") & gone, "REVERTED").otherwise(F.col("status"))).drop("__hit")


def affected_jobs(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct jobs of the decided issues, each of which is rebuilt once."""
    return issues.join(ids.select("id").distinct(), "id", "left_semi").select("job_id").distinct()


def toggled(corrections: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """M10."""
    if status not in ("APPLIED", "REVERTED"):
        raise ValueError(f"no state of a correction: {status}")
    return corrections.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left").withColumn("status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status"))).drop("__hit")


def job_transition(status: Column, action: Column, value: Column | None = None) -> Column:
    """M8: ``struct(status, code)``; code 200 where the action is allowed, 409 where the state forbids it, 400 for unknown actions and bad numbers."""
    number = value if value is not None else F.lit(None).cast("string")
    code = (
        F.when(action == "cancel", F.when(status.isin("COMPLETED", "CANCELLED"), 409).otherwise(200))
        .when(action == "retry", F.when(status.isin("FAILED", "CANCELLED"), 200).otherwise(409))
        .when(action == "set-image-start", F.when(number.try_cast("int") >= 1, 200).otherwise(400))
        .otherwise(400)
    )
    new = F.when((code == 200) & (action == "cancel"), "CANCELLED").when((code == 200) & (action == "retry"), "QUEUED").otherwise(status)
    return F.struct(new.alias("status"), code.alias("code"))


def inserted(df: DataFrame, new: DataFrame) -> DataFrame:
    """M9."""
    return df.unionByName(new)


def deleted(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """M9: without the rows of these ids; nothing that refers to them goes with them."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def replaced(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """M6, M7: the rows of every key that ``new`` has are its rows, others stay."""
    return df.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    """X1, progress logs: the newest row of each key, of several the greatest id: a maximum, not a window."""
    return df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max(F.struct(at, id_, F.struct(*df.columns).alias("__row"))).alias("__m")).select("__m.__row.*")


def project_stats(projects: DataFrame, documents: DataFrame, jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """Projects with counts of documents, jobs, completed jobs and pending issues, 0 where none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    d = documents.groupBy("project_id").agg(F.count("*").alias("documents"))
    j = jobs.groupBy("project_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    i = issues.where(F.col("status") == "PENDING_REVIEW").groupBy("project_id").agg(F.count("*").alias("pending"))
    return projects.join(d, "project_id", "left").join(j, "project_id", "left").join(i, "project_id", "left").select(*projects.columns, *map(zero, ("documents", "jobs", "completed", "pending")))


def page_of(df: DataFrame, order: list, page: int, size: int = 9) -> DataFrame:
    """One page of a total order; the rows before it are cut by a top-k, not by a numbering of all rows."""
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def stage_steps(jobs: DataFrame) -> DataFrame:
    """A row per stage of each job: done, active, failed or pending."""
    names = F.array(*map(F.lit, STAGES))
    now = F.array_position(names, F.coalesce("stage", F.lit("")))
    each = jobs.select("*", now.alias("__now"), F.posexplode(names).alias("step", "step_name"))
    at = F.col("step") + 1
    state = (
        F.when(F.col("status") == "COMPLETED", "done").when((F.col("__now") > 0) & (at < F.col("__now")), "done")
        .when((F.col("__now") > 0) & (at == F.col("__now")), F.when(F.col("status").isin("FAILED", "CANCELLED"), "failed").otherwise("active")).otherwise("pending")
    )
    return each.withColumn("state", state).drop("__now")


def valid_project(name: Column, subject: Column) -> Column:
    """The first fault of a form, null without one."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(text(name)) < 3, "name needs three characters").when(text(subject) == "", "subject is required")


def reversed_logs(logs: Column) -> Column:
    """X3."""
    return F.reverse(logs)
