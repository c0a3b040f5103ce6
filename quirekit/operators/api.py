"""The query surface (§2.15) as functions over a store of tables. Reads return tables; writes return a new store.

Tables: projects, documents, jobs, jobstates, issues, corrections and reports.
Store, not service: nothing is served here, and each function is one query that a
route would run.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files
from . import aggregates, state

#: Most ids of one bulk decision.
MOST_IDS = 5000


@dataclass(frozen=True)
class Store:
    projects: DataFrame
    documents: DataFrame
    jobs: DataFrame
    issues: DataFrame
    corrections: DataFrame
    jobstates: DataFrame | None = None
    reports: DataFrame | None = None


class Refused(ValueError):
    """A request that a route would refuse, with its status code."""

    def __init__(self, code: int, why: str):
        super().__init__(why)
        self.code = code


def health(store: Store) -> DataFrame:
    """Jobs by status, one row."""
    of = lambda s: F.count_if(F.col("status") == s)
    return store.jobs.agg(F.count("*").alias("jobs"), of("QUEUED").alias("queued"), of("PROCESSING").alias("processing"))


def listed(df: DataFrame, wanted: Mapping[str, str | None], order: list | None = None) -> DataFrame:
    """A collection by equality on the given parameters, newest first unless an order is given."""
    return state.matching(df, dict(wanted)).orderBy(*(order or [F.desc("created_at"), "id"]))


def one(df: DataFrame, id_: str, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == id_)


def projects_with_stats(store: Store) -> DataFrame:
    rename = lambda df: df.withColumnRenamed("projectId", "project_id") if "projectId" in df.columns else df
    return state.project_stats(store.projects.withColumnRenamed("id", "project_id"), rename(store.documents), rename(store.jobs), rename(store.issues))


def job(store: Store, id_: str) -> DataFrame:
    """A job with its engine state over it."""
    mine = one(store.jobs, id_)
    if store.jobstates is None:
        return mine
    shared = [c for c in store.jobstates.columns if c in store.jobs.columns and c != "id"]
    return state.overlaid(mine, one(store.jobstates, id_), ["id"], shared)


def job_issues(store: Store, id_: str, severity: str | None = None, status: str | None = None, type_: str | None = None, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first findings of a job and the counters of all that the filter keeps."""
    kept = state.matching(store.issues.where(F.col("job_id") == id_), {"severity": severity, "status": status, "type": type_})
    return aggregates.limited_with_counters(kept, "severity", "status", ["severity", F.desc("confidence"), "id"], limit)


def issue_list(store: Store, **wanted: str | None) -> DataFrame:
    """O3: severities in the order of their text."""
    return listed(store.issues, wanted, ["severity", "created_at", "id"])


def issue_preview(store: Store, id_: str) -> DataFrame:
    """X2."""
    return issue_list(store, job_id=id_).limit(3)


def job_report(store: Store, id_: str) -> DataFrame:
    """A1, A2, A28, A32 of one job, one row; a job without findings has a report too."""
    n = lambda column, v: F.count_if(F.col(column) == v)
    found = store.issues.where(F.col("job_id") == id_).agg(
        F.count("*").alias("total"), *(n("status", s).alias(s.lower()) for s in ("AUTO_FIXED", "APPROVED", "REJECTED", "PENDING_REVIEW")), n("severity", "CRITICAL").alias("critical"),
        n("type", "IMAGE_MISSING").alias("image_missing"), n("type", "TABLE_STRUCTURE").alias("table_structure"), aggregates.penalty_score(F.col("severity")).alias("quality_score"),
    )
    applied = store.corrections.where((F.col("job_id") == id_) & (F.col("status") == "APPLIED")).agg(F.count("*").alias("corrections_applied"))
    notes = aggregates.report_recommendations(*(F.col(c) for c in ("critical", "pending_review", "image_missing", "table_structure", "total")))
    return found.crossJoin(F.broadcast(applied)).withColumn("recommendations", notes)


def decide(store: Store, ids: DataFrame, decision: str) -> tuple[Store, DataFrame]:
    """M4, M5: the store after a decision, and the jobs to rebuild. Refused for unknown decisions, without ids, and with too many."""
    n = ids.select("id").distinct().count()
    if decision not in state.DECISIONS:
        raise Refused(400, "invalid status")
    if not n:
        raise Refused(400, "no issues given")
    if n > MOST_IDS:
        raise Refused(413, f"too many issues, at most {MOST_IDS}")
    after = replace(store, issues=state.decided(store.issues, ids, decision), corrections=state.corrections_after(store.corrections, store.issues, ids, decision))
    return after, state.affected_jobs(store.issues, ids)


def change_job(store: Store, id_: str, action: str, value: str | None = None) -> Store:
    """M8; refused where the job's state or the action forbids it, or there is no such job."""
    found = one(store.jobs, id_).select(state.job_transition(F.col("status"), F.lit(action), F.lit(value).cast("string")).alias("t")).select("t.*").first()
    if found is None:
        raise Refused(404, "job not found")
    if found.code != 200:
        raise Refused(found.code, f"{action} is not possible")
    mine = F.col("id") == id_
    jobs = store.jobs.withColumn("status", F.when(mine, F.lit(found.status)).otherwise(F.col("status")))
    if action == "retry":
        jobs = jobs.withColumn("progress", F.when(mine, 0).otherwise(F.col("progress")))
    if action == "set-image-start":
        jobs = jobs.withColumn("image_start_number", F.when(mine, int(value)).otherwise(F.col("image_start_number")))
    return replace(store, jobs=jobs)


def delete(store: Store, table: str, id_: str) -> Store:
    """M9; what refers to the row stays."""
    return replace(store, **{table: getattr(store, table).where(~F.col("id").eqNullSafe(F.lit(id_)))})


def create(store: Store, table: str, row: DataFrame) -> Store:
    return replace(store, **{table: getattr(store, table).unionByName(row, allowMissingColumns=True)})


def toggle_corrections(store: Store, ids: DataFrame, status: str) -> Store:
    return replace(store, corrections=state.toggled(store.corrections, ids, status))


def image_bundle(images: DataFrame, id_: str) -> DataFrame:
    """The entries of a job's bundle."""
    return files.bundle_manifest(images.where(F.col("job_id") == id_))


def last_documents(store: Store) -> DataFrame:
    """The newest document of each type of a project."""
    return state.latest(store.documents, ["project_id", "type"], "created_at", "id")


def log_lines(store: Store, id_: str) -> DataFrame:
    """A job's log, the newest line first."""
    return one(store.jobs, id_).select(F.posexplode(state.reversed_logs(F.col("logs"))).alias("place", "entry")).select("place", "entry.*")


def review_groups(store: Store, id_: str) -> DataFrame:
    """A24, X6."""
    from ..functions import classify

    rows = store.issues.where(F.col("job_id") == id_)
    text = F.coalesce(F.nullif("pdf_text", F.lit("")), "message")
    mathy = F.col("type").isin("MISSING_TEXT", "TEXT_MISMATCH") & classify.ui_mathy(text)
    groups = aggregates.issue_groups(rows, F.col("severity"), F.col("type"), classify.confidence_band(F.col("confidence")), mathy, "id", F.col("status") == "PENDING_REVIEW")
    return groups.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "severity", "type", "band", "mathy")))
