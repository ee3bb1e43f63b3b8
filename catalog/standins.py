"""State tables derived from the driver tables, once in Spark and once in SQL.

nation -> companies, customer -> sources, orders -> postings and runs, lineitem ->
versions. Every row of the base tables takes part, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import epoch, table

NOW = 904_694_400
DAY = 86_400
_KINDS = {
    "AUTOMOBILE": "greenhouse", "BUILDING": "lever", "FURNITURE": "ashby", "HOUSEHOLD": "static-html", "MACHINERY": "playwright",
}
_LEVELS = {
    "AUTOMOBILE": "explicit", "BUILDING": "strong", "FURNITURE": "weak", "HOUSEHOLD": "synchronous", "MACHINERY": "unknown",
}
_ELIGIBLE = {"1-URGENT": "yes", "2-HIGH": "likely", "3-MEDIUM": "unknown", "4-NOT SPECIFIED": "no", "5-LOW": "no"}
_SCOPES = {0: "worldwide", 1: "apac", 2: "country-list", 3: "region-limited", 4: "unknown"}
_ACTIONS = {"1-URGENT": "saved", "2-HIGH": "applied", "3-MEDIUM": "dismissed"}


def pick(c: Column, mapping: dict) -> Column:
    chosen = None
    for key, value in mapping.items():
        chosen = F.when(c == key, value) if chosen is None else chosen.when(c == key, value)
    return chosen


def pick_sql(c: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in mapping.items())
    return f"CASE {c} {whens} END"


def companies(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("company_"), key.cast("string")).alias("id"),
        F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("slug"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("https://careers.example.com/"), key.cast("string")).alias("careers_url"),
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit("https://policy.example.com/"), key.cast("string"))).alias("remote_policy_url"),
        ((key * 37) % 101).cast("int").alias("priority"),
        (F.col("n_regionkey") != 2).alias("active"),
        F.lit(0).cast("bigint").alias("created_at"),
        F.lit(0).cast("bigint").alias("updated_at"),
    )


COMPANIES = """
SELECT 'company_' || n_nationkey AS id, lower(replace(n_name, ' ', '-')) AS slug, n_name AS name,
  'https://careers.example.com/' || n_nationkey AS careers_url,
  CASE WHEN n_regionkey = 1 THEN 'https://policy.example.com/' || n_nationkey END AS remote_policy_url,
  CAST((n_nationkey * 37) % 101 AS INTEGER) AS priority, n_regionkey <> 2 AS active,
  CAST(0 AS BIGINT) AS created_at, CAST(0 AS BIGINT) AS updated_at
FROM nation"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key, nation, balance = F.col("c_custkey").cast("string"), F.col("c_nationkey"), F.col("c_acctbal")
    kind = pick(F.col("c_mktsegment"), _KINDS)
    trusted = balance > 2_000
    return c.select(
        F.concat(F.lit("source_"), key).alias("id"),
        F.concat(F.lit("company_"), nation.cast("string")).alias("company_id"),
        kind.alias("kind"),
        F.concat(F.lit("https://feeds.example.com/"), key).alias("url"),
        F.when(kind.isin("greenhouse", "lever", "ashby"), F.concat(F.lit("key"), key)).alias("adapter_key"),
        F.when(kind.isin("static-html", "playwright"), '{"listSelector":"li.job","titleSelector":"a"}').otherwise("{}").alias("config_json"),
        (kind == "playwright").alias("browser_required"),
        F.when(nation < 8, 360).when(nation < 16, 720).otherwise(1440).alias("crawl_interval_minutes"),
        F.concat(F.lit("e"), key).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(trusted, F.sha2("c_name", 256)).alias("content_fingerprint"),
        F.when(trusted, "run_1997").alias("snapshot_run_id"),
        nation.cast("bigint").alias("previous_job_count"),
        F.when(balance < 0, 2).otherwise(0).alias("consecutive_failures"),
        F.lit(None).cast("bigint").alias("last_success_at"),
        F.lit(None).cast("bigint").alias("last_failure_at"),
        (F.lit(NOW - 50_000) + F.floor(balance).cast("bigint") * 10).alias("next_due_at"),
        F.when(F.col("c_mktsegment") == "BUILDING", "run_1998").alias("lease_owner"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(NOW + 1_000) - nation.cast("bigint") * 100).alias("lease_until"),
        F.when(nation < 19, "active").when(nation < 22, "paused").otherwise("quarantined").alias("status"),
        F.lit(0).cast("bigint").alias("created_at"),
        F.lit(0).cast("bigint").alias("updated_at"),
    )


SOURCES = f"""
SELECT 'source_' || c_custkey AS id, 'company_' || c_nationkey AS company_id,
  {pick_sql('c_mktsegment', _KINDS)} AS kind, 'https://feeds.example.com/' || c_custkey AS url,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'key' || c_custkey END AS adapter_key,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN '{{"listSelector":"li.job","titleSelector":"a"}}' ELSE '{{}}' END AS config_json,
  c_mktsegment = 'MACHINERY' AS browser_required,
  CASE WHEN c_nationkey < 8 THEN 360 WHEN c_nationkey < 16 THEN 720 ELSE 1440 END AS crawl_interval_minutes,
  'e' || c_custkey AS etag, CAST(NULL AS VARCHAR) AS last_modified,
  CASE WHEN c_acctbal > 2000 THEN sha256(c_name) END AS content_fingerprint,
  CASE WHEN c_acctbal > 2000 THEN 'run_1997' END AS snapshot_run_id,
  CAST(c_nationkey AS BIGINT) AS previous_job_count,
  CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS consecutive_failures,
  CAST(NULL AS BIGINT) AS last_success_at, CAST(NULL AS BIGINT) AS last_failure_at,
  {NOW - 50_000} + CAST(floor(c_acctbal) AS BIGINT) * 10 AS next_due_at,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'run_1998' END AS lease_owner,
  CASE WHEN c_mktsegment = 'BUILDING' THEN {NOW + 1_000} - CAST(c_nationkey AS BIGINT) * 100 END AS lease_until,
  CASE WHEN c_nationkey < 19 THEN 'active' WHEN c_nationkey < 22 THEN 'paused' ELSE 'quarantined' END AS status,
  CAST(0 AS BIGINT) AS created_at, CAST(0 AS BIGINT) AS updated_at
FROM customer"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Postings by order, in the columns the queries use."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    seen = epoch("o_orderdate")
    closed = F.col("o_orderstatus") == "F"
    key = F.col("o_orderkey").cast("string")
    title = F.concat(F.col("c_mktsegment"), F.lit(" engineer "), F.substring("o_orderpriority", 3, 20))
    return rows.select(
        F.concat(F.lit("job_"), key).alias("id"),
        F.concat(F.lit("source_"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.concat(F.lit("company_"), F.col("c_nationkey").cast("string")).alias("company_id"),
        key.alias("external_id"),
        F.sha2(F.concat(F.lower("n_name"), F.lit("\n"), F.lower(title), F.lit("\n"), F.col("n_name")), 256).alias("dedupe_key"),
        F.concat(F.lit("https://jobs.example.com/"), key).alias("canonical_url"),
        title.alias("title"),
        F.col("n_name").alias("company_name"),
        F.lit(None).cast("string").alias("department"),
        F.col("n_name").alias("location_text"),
        F.lit(None).cast("string").alias("employment_type"),
        F.col("c_name").alias("description_text"),
        F.concat(title, F.lit("\n"), F.col("c_name")).alias("search_text"),
        F.array(F.initcap("c_mktsegment"), F.substring("o_orderpriority", 3, 20)).alias("skills"),
        F.lit("remote").alias("workplace_type"),
        pick(F.col("n_regionkey"), _SCOPES).alias("remote_scope"),
        pick(F.col("o_orderpriority"), _ELIGIBLE).alias("eligible_from_korea"),
        pick(F.col("c_mktsegment"), _LEVELS).alias("async_level"),
        F.lit(None).cast("string").alias("required_timezone"),
        F.lit(None).cast("double").alias("required_overlap_hours"),
        F.lit("USD").alias("salary_currency"),
        F.col("o_totalprice").alias("salary_min"),
        F.lit(None).cast("double").alias("salary_max"),
        F.lit(None).cast("string").alias("salary_interval"),
        seen.alias("posted_at"),
        seen.alias("first_seen_at"),
        (seen + DAY).alias("last_seen_at"),
        F.concat(F.lit("run_"), F.year("o_orderdate").cast("string")).alias("last_seen_run_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("missing_count"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        F.when(closed, seen + 30 * DAY).alias("closed_at"),
        F.least(F.floor(F.col("o_totalprice") / 5_000), F.lit(100)).cast("int").alias("score"),
        F.lit(0.5).alias("confidence"),
        F.lit(None).cast("array<struct<field:string,effect:int,text:string,source:string>>").alias("evidence"),
        F.sha2(key, 256).alias("content_hash"),
        seen.alias("created_at"),
        seen.alias("updated_at"),
    )


JOBS = f"""
SELECT 'job_' || o_orderkey AS id, 'source_' || o_custkey AS source_id, 'company_' || c_nationkey AS company_id,
  CAST(o_orderkey AS VARCHAR) AS external_id,
  sha256(lower(n_name) || chr(10) || lower(c_mktsegment || ' engineer ' || substr(o_orderpriority, 3)) || chr(10) || n_name) AS dedupe_key,
  'https://jobs.example.com/' || o_orderkey AS canonical_url,
  c_mktsegment || ' engineer ' || substr(o_orderpriority, 3) AS title, n_name AS company_name,
  CAST(NULL AS VARCHAR) AS department, n_name AS location_text, c_name AS description_text,
  c_mktsegment || ' engineer ' || substr(o_orderpriority, 3) || chr(10) || c_name AS search_text,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || substr(o_orderpriority, 3) AS skills_text,
  {pick_sql('n_regionkey', _SCOPES)} AS remote_scope, {pick_sql('o_orderpriority', _ELIGIBLE)} AS eligible_from_korea,
  {pick_sql('c_mktsegment', _LEVELS)} AS async_level, o_totalprice AS salary_min,
  CAST(epoch(o_orderdate) AS BIGINT) AS first_seen_at, CAST(epoch(o_orderdate) AS BIGINT) + {DAY} AS last_seen_at,
  'run_' || year(o_orderdate) AS last_seen_run_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS missing_count,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) + {30 * DAY} END AS closed_at,
  CAST(least(floor(o_totalprice / 5000), 100) AS INTEGER) AS score, sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash,
  CAST(epoch(o_orderdate) AS BIGINT) AS created_at, CAST(epoch(o_orderdate) AS BIGINT) AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """User actions on the high-priority open orders."""
    o = table(spark, sf, "orders")
    chosen = o.filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin(*_ACTIONS))
    action = pick(F.col("o_orderpriority"), _ACTIONS)
    return chosen.select(
        F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id"),
        action.alias("action"),
        F.when(action == "dismissed", "too far").alias("dismiss_reason"),
        F.lit(None).cast("string").alias("notes"),
        F.when(action == "applied", epoch("o_orderdate") + 7).alias("applied_at"),
        (epoch("o_orderdate") + 9).alias("updated_at"),
    )


ACTIONS = f"""
SELECT 'job_' || o_orderkey AS job_id, {pick_sql('o_orderpriority', _ACTIONS)} AS action,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'too far' END AS dismiss_reason, CAST(NULL AS VARCHAR) AS notes,
  CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(epoch(o_orderdate) AS BIGINT) + 7 END AS applied_at,
  CAST(epoch(o_orderdate) AS BIGINT) + 9 AS updated_at
FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Version observations by order line."""
    line = table(spark, sf, "lineitem")
    content = F.concat_ws(":", F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("int").cast("string"))
    return line.select(
        F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.sha2(content, 256).alias("content_hash"),
        F.concat(F.lit('{"v":"'), content, F.lit('"}')).alias("snapshot_json"),
        epoch("l_shipdate").alias("observed_at"),
    )


OBSERVATIONS = """
SELECT 'job_' || l_orderkey AS job_id,
  sha256(l_returnflag || ':' || l_linestatus || ':' || CAST(l_quantity AS INTEGER)) AS content_hash,
  '{"v":"' || l_returnflag || ':' || l_linestatus || ':' || CAST(l_quantity AS INTEGER) || '"}' AS snapshot_json,
  CAST(epoch(l_shipdate) AS BIGINT) AS observed_at
FROM lineitem"""

VERSIONS = """
SELECT job_id, content_hash, min(snapshot_json) AS snapshot_json, min(observed_at) AS observed_at
FROM observations GROUP BY ALL"""


def source_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One source run per order."""
    o = table(spark, sf, "orders")
    started = epoch("o_orderdate")
    failed = F.col("o_orderstatus") == "F"
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(F.lit("sr_"), key).alias("id"),
        F.date_format("o_orderdate", "'run_'yyyyMMdd").alias("run_id"),
        F.concat(F.lit("source_"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.when(failed, "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("healthy").alias("status"),
        F.when(failed, 503).otherwise(200).alias("http_status"),
        (F.col("o_orderkey") % 50).alias("fetched_job_count"),
        F.lit(10).cast("bigint").alias("previous_job_count"),
        F.lit(None).cast("string").alias("response_hash"),
        F.when(failed, F.concat(F.lit("http-"), F.substring("o_orderpriority", 1, 1))).alias("error_code"),
        F.when(failed, F.col("o_orderpriority")).alias("error_message"),
        started.alias("started_at"),
        F.when(F.col("o_orderstatus") != "P", started + 60).alias("completed_at"),
    )


SOURCE_RUNS = """
SELECT 'sr_' || o_orderkey AS id, 'run_' || strftime(o_orderdate, '%Y%m%d') AS run_id, 'source_' || o_custkey AS source_id,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'healthy' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 503 ELSE 200 END AS http_status, o_orderkey % 50 AS fetched_job_count,
  CAST(10 AS BIGINT) AS previous_job_count, CAST(NULL AS VARCHAR) AS response_hash,
  CASE WHEN o_orderstatus = 'F' THEN 'http-' || o_orderpriority[1] END AS error_code,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error_message,
  CAST(epoch(o_orderdate) AS BIGINT) AS started_at,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(epoch(o_orderdate) AS BIGINT) + 60 END AS completed_at
FROM orders"""


def crawl_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per order day."""
    sr = source_runs(spark, sf)
    rows = sr.groupBy(F.col("run_id").alias("id")).agg(
        F.count(F.lit(1)).alias("planned_source_count"),
        F.count_if(F.col("status") == "healthy").alias("completed_source_count"),
        F.count_if(F.col("status") == "failed").alias("failed_source_count"),
        F.min("started_at").alias("started_at"),
        F.count_if(F.col("status") == "running").alias("_open"),
    )
    return rows.select(
        "id",
        F.when(F.col("planned_source_count") % 2 == 0, "fast").otherwise("browser").alias("runner_type"),
        F.lit("schedule").alias("trigger_type"),
        "planned_source_count", "completed_source_count", "failed_source_count", "started_at",
        F.when(F.col("_open") == 0, F.col("started_at") + 600).alias("completed_at"),
        F.when(F.col("_open") > 0, "running").when(F.col("failed_source_count") == 0, "completed").otherwise("partial").alias("status"),
    )


CRAWL_RUNS = """
SELECT run_id AS id, CASE WHEN count(*) % 2 = 0 THEN 'fast' ELSE 'browser' END AS runner_type, 'schedule' AS trigger_type,
  count(*) AS planned_source_count, count(*) FILTER (status = 'healthy') AS completed_source_count,
  count(*) FILTER (status = 'failed') AS failed_source_count, min(started_at) AS started_at,
  CASE WHEN count(*) FILTER (status = 'running') = 0 THEN min(started_at) + 600 END AS completed_at,
  CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'running' WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed'
    ELSE 'partial' END AS status
FROM source_runs GROUP BY run_id"""


SQL = {
    "companies": COMPANIES,
    "sources": SOURCES,
    "jobs": JOBS,
    "actions": ACTIONS,
    "observations": OBSERVATIONS,
    "versions": VERSIONS,
    "source_runs": SOURCE_RUNS,
    "crawl_runs": CRAWL_RUNS,
}


def ctes(*names: str) -> dict[str, str]:
    return {n: SQL[n] for n in names}
