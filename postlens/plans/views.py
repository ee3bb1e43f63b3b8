"""Listing, detail, version and overview queries over the state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.filters import JobFilter
from ..operators.history import latest_per
from ..operators.joins import join_salted
from ..operators.paging import ordered, page_frame

LIST_COLUMNS = (
    "id", "source_id", "company_id", "external_id", "canonical_url", "title", "company_name", "department",
    "location_text", "employment_type", "workplace_type", "remote_scope", "eligible_from_korea", "async_level",
    "required_timezone", "required_overlap_hours", "salary_currency", "salary_min", "salary_max",
    "salary_interval", "posted_at", "first_seen_at", "last_seen_at", "status", "score", "confidence", "skills",
    "evidence", "content_hash",
)
ACTION_COLUMNS = ("action", "dismiss_reason", "notes", "applied_at", "action_updated_at", "version_count")


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("job_id").agg(F.count(F.lit(1)).alias("version_count"))


def listing(jobs: DataFrame, actions: DataFrame, versions: DataFrame) -> DataFrame:
    """Postings with the user's action and the number of stored versions, all columns kept."""
    own = actions.select(
        F.col("job_id").alias("id"), "action", "dismiss_reason", "notes", "applied_at",
        F.col("updated_at").alias("action_updated_at"),
    )
    counts = version_counts(versions).withColumnRenamed("job_id", "id")
    return (
        jobs.join(own, "id", "left")
        .join(counts, "id", "left")
        .withColumns(
            {
                "version_count": F.coalesce("version_count", F.lit(0).cast("bigint")),
                "skills_text": F.array_join("skills", " "),
            }
        )
    )


def list_view(listed: DataFrame) -> DataFrame:
    """Columns of the list: everything but bodies, so those are never read."""
    return listed.select(*LIST_COLUMNS, *ACTION_COLUMNS)


def list_page(
    jobs: DataFrame, actions: DataFrame, versions: DataFrame, f: JobFilter = JobFilter(), limit=None, cursor=None
) -> DataFrame:
    """One page of the list with its look-ahead row.

    The top-k runs on postings alone whenever the filter allows it; actions and version
    counts are then looked up for the page only, instead of for the whole table.
    """
    rows = jobs.withColumn("skills_text", F.array_join("skills", " "))
    if f.action or f.changed:
        rows = listing(jobs, actions, versions)
    best = page_frame(rows, f, limit, cursor).select(*jobs.columns)
    wanted = best.select(F.col("id").alias("job_id"))
    own, stored = actions.join(wanted, "job_id", "left_semi"), versions.join(wanted, "job_id", "left_semi")
    return ordered(list_view(listing(best, own, stored)))


def job_detail(jobs: DataFrame, actions: DataFrame, versions: DataFrame, companies: DataFrame, sources: DataFrame, job_id: str | None = None) -> DataFrame:
    """Full posting rows with action, company links and source state."""
    if job_id is not None:
        jobs = jobs.filter(F.col("id") == job_id)
        actions = actions.filter(F.col("job_id") == job_id)
        versions = versions.filter(F.col("job_id") == job_id)
    company = companies.select(F.col("id").alias("company_id"), "careers_url", "remote_policy_url")
    source = sources.select(
        F.col("id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("url").alias("source_url"),
        F.col("status").alias("source_status"),
    )
    rows = listing(jobs, actions, versions).drop("action_updated_at")
    return join_salted(join_salted(rows, company, ["company_id"], ["id"]), source, ["source_id"], ["id"])


def job_versions(versions: DataFrame, job_id: str, newest: int | None = None) -> DataFrame:
    """All versions of a posting, newest first, or the ``newest`` ones."""
    rows = versions.filter(F.col("job_id") == job_id).orderBy(F.col("observed_at").desc())
    return (rows if newest is None else rows.limit(newest)).select("content_hash", "snapshot_json", "observed_at")


def latest_runs(source_runs: DataFrame) -> DataFrame:
    """Outcome of the newest run of every source."""
    rows = latest_per(source_runs, ["source_id"], ["started_at", "id"], ["http_status", "error_code", "error_message"])
    return rows.select(
        "source_id",
        F.col("http_status").alias("last_http_status"),
        F.col("error_code").alias("last_error_code"),
        F.col("error_message").alias("last_error_message"),
    )


def source_list(sources: DataFrame, companies: DataFrame, source_runs: DataFrame) -> DataFrame:
    company = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("active").alias("company_active"),
        F.col("priority").alias("_priority"),
    )
    runs = latest_runs(source_runs).withColumnRenamed("source_id", "id")
    rows = sources.join(company, "company_id").join(runs, "id", "left")
    return rows.orderBy(F.col("_priority").desc(), "company_name", "kind").drop("_priority")


def company_rollup(companies: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Companies with their sources and open postings, each side counted before the join."""
    source_counts = sources.groupBy("company_id").agg(F.count(F.lit(1)).alias("source_count"))
    open_counts = jobs.filter(F.col("status") == "open").groupBy("company_id").agg(F.count(F.lit(1)).alias("open_job_count"))
    rows = companies.withColumnRenamed("id", "company_id").join(source_counts, "company_id", "left").join(open_counts, "company_id", "left")
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns(
        {"source_count": F.coalesce("source_count", zero), "open_job_count": F.coalesce("open_job_count", zero)}
    )
    return rows.withColumnRenamed("company_id", "id")


def company_list(companies: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    return company_rollup(companies, sources, jobs).orderBy(F.col("priority").desc(), "name")


def recent_runs(crawl_runs: DataFrame, n: int = 5) -> DataFrame:
    columns = (
        "id", "runner_type", "status", "planned_source_count", "completed_source_count", "failed_source_count",
        "started_at", "completed_at",
    )
    return crawl_runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n).select(*columns)
