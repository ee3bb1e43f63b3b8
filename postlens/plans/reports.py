"""Dashboard counters, totals, run summaries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.sources import run_outcome


def dashboard_jobs(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """Posting counters in one pass over two narrow inputs."""
    acted = actions.select(F.col("job_id").alias("id")).distinct().withColumn("_acted", F.lit(True))
    rows = jobs.select("id", "status", "score", "eligible_from_korea", "async_level").join(acted, "id", "left")
    is_open = F.col("status") == "open"
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_open).alias("open"),
        F.count_if(is_open & F.col("_acted").isNull()).alias("new"),
        F.count_if(is_open & (F.col("score") >= 85)).alias("top_matches"),
        F.count_if(is_open & F.col("eligible_from_korea").isin("yes", "likely")).alias("korea_eligible"),
        F.count_if(is_open & F.col("async_level").isin("explicit", "strong")).alias("async_friendly"),
    )


def dashboard_actions(actions: DataFrame) -> DataFrame:
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("saved", "dismissed", "applied")])


def dashboard_sources(sources: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    company = companies.select(F.col("id").alias("company_id"), F.col("active").alias("_company_active"))
    rows = sources.join(company, "company_id")
    active = (F.col("status") == "active") & F.col("_company_active")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(active & (F.col("next_due_at") < now)).alias("overdue"),
    )


def company_totals(rollup: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rollup.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("active").alias("active"),
        F.coalesce(F.sum("source_count"), zero).alias("sources"),
        F.coalesce(F.sum("open_job_count"), zero).alias("jobs"),
    )


def source_totals(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("status") == "active") & F.col("company_active")).alias("active"),
        F.count_if("browser_required").alias("browser"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
    )


def run_summary(source_obs: DataFrame) -> DataFrame:
    """Planned, completed and failed sources of every run with its outcome."""
    done = F.col("status").isin("healthy", "not_modified")
    totals = source_obs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed")
    )
    return totals.withColumn("status", run_outcome(F.col("completed"), F.col("failed")))


def source_outcomes(source_obs: DataFrame) -> DataFrame:
    """One row per (run, source): the detail part of a run summary."""
    return source_obs.select(
        "run_id", "source_id", "status", F.col("fetched_job_count").alias("job_count"),
        F.col("received_batch_count").alias("batch_count"), F.col("error_code").alias("reason"),
    )


def export_user_data(companies: DataFrame, sources: DataFrame, actions: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """What a user may take along, each part in its fixed order."""
    titles = jobs.select(F.col("id").alias("job_id"), "title", "company_name", "canonical_url")
    return {
        "companies": companies.orderBy(F.col("priority").desc(), "name"),
        "sources": sources.orderBy("company_id", "id"),
        "job_actions": actions.join(titles, "job_id").orderBy(F.col("updated_at").desc()),
    }


def write_export(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
