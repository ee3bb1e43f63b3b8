"""Retention rules as filters over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .history import keep_latest
from .state import cascade

# Days kept per table and versions kept per posting.
BATCH_DAYS = 30
SOURCE_RUN_DAYS = 30
RUN_DAYS = 90
CLOSED_DAYS = 180
VERSIONS_KEPT = 3
DAY = 86_400


def newest_versions(versions: DataFrame, n: int = VERSIONS_KEPT) -> DataFrame:
    order = [F.col("observed_at").desc(), F.col("content_hash")]
    return keep_latest(versions, ["job_id"], order, n)


def kept_jobs(jobs: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """All postings but those closed long ago that the user never acted on."""
    acted = actions.select(F.col("job_id").alias("id")).distinct().withColumn("_acted", F.lit(True))
    old = (F.col("status") == "closed") & (F.col("closed_at") < now - CLOSED_DAYS * DAY)
    rows = jobs.join(acted, "id", "left")
    return rows.filter(~F.coalesce(old & F.col("_acted").isNull(), F.lit(False))).select(*jobs.columns)


def apply_retention(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """New content of every table the rules touch, deletions cascading to children."""
    day = F.lit(DAY).cast("bigint")
    runs = tables["crawl_runs"]
    old_runs = runs.filter(F.col("started_at") < now - RUN_DAYS * day)
    source_runs = tables["source_runs"].filter(F.col("started_at") >= now - SOURCE_RUN_DAYS * day)
    jobs = kept_jobs(tables["jobs"], tables["job_actions"], now)
    removed = tables["jobs"].select("id").join(jobs.select("id"), "id", "left_anti")
    return {
        "ingest_batches": tables["ingest_batches"].filter(F.col("received_at") >= now - BATCH_DAYS * day),
        "crawl_runs": runs.filter(F.col("started_at") >= now - RUN_DAYS * day),
        "source_runs": cascade(old_runs, source_runs, "run_id"),
        "jobs": jobs,
        "job_versions": cascade(removed, newest_versions(tables["job_versions"]), "job_id"),
        "job_actions": tables["job_actions"],
    }


def retention_report(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """Rows each rule removes by itself, one row per rule. Every count is one small aggregation."""
    day = F.lit(DAY).cast("bigint")
    acted = tables["job_actions"].select(F.col("job_id").alias("id"))
    old = (F.col("status") == "closed") & (F.col("closed_at") < now - CLOSED_DAYS * day)
    extra = F.greatest(F.col("count") - VERSIONS_KEPT, F.lit(0))
    removed = {
        "ingest_batches": tables["ingest_batches"].agg(F.count_if(F.col("received_at") < now - BATCH_DAYS * day)),
        "source_runs": tables["source_runs"].agg(F.count_if(F.col("started_at") < now - SOURCE_RUN_DAYS * day)),
        "crawl_runs": tables["crawl_runs"].agg(F.count_if(F.col("started_at") < now - RUN_DAYS * day)),
        "job_versions": tables["job_versions"].groupBy("job_id").count().agg(F.coalesce(F.sum(extra), F.lit(0))),
        "jobs": tables["jobs"].filter(old).join(acted, "id", "left_anti").agg(F.count(F.lit(1))),
    }
    parts = [df.toDF("removed").select(F.lit(name).alias("table"), F.col("removed").cast("bigint")) for name, df in removed.items()]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
