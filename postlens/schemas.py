"""Record shapes and enum sets shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Enums of the data model.
SOURCE_KINDS = ("greenhouse", "lever", "ashby", "jsonld", "static-html", "playwright")
BOARD_KINDS = ("greenhouse", "lever", "ashby")
HTML_KINDS = ("static-html", "playwright")
BROWSER_KIND = "playwright"
SOURCE_STATUSES = ("active", "paused", "quarantined", "disabled")
RUN_STATUSES = ("running", "completed", "partial", "failed")
OBSERVATION_STATUSES = ("healthy", "not_modified", "quarantined", "failed")
POSTING_STATUSES = ("open", "closed")
ACTIONS = ("saved", "dismissed", "applied")
WORKPLACES = ("remote", "hybrid", "onsite", "unknown")
SCOPES = ("worldwide", "apac", "country-list", "region-limited", "unknown")
ELIGIBILITIES = ("yes", "likely", "unknown", "no")
ASYNC_LEVELS = ("explicit", "strong", "weak", "synchronous", "unknown")
EVIDENCE_SOURCES = ("job-description", "title", "location", "metadata")

EVIDENCE = "array<struct<field:string,effect:int,text:string,source:string>>"
SALARY = "struct<currency:string,min:double,max:double,interval:string>"
POSTED = "struct<num:double,text:string>"
CONFIG_TEXTS = (
    "listSelector",
    "titleSelector",
    "locationSelector",
    "linkSelector",
    "departmentSelector",
    "detailDescriptionSelector",
    "waitForSelector",
)
CONFIG = "struct<" + "".join(f"{name}:string," for name in CONFIG_TEXTS) + "headers:map<string,string>>"

RAW_POSTING = (
    "source_id string, run_id string, ordinal int, external_id string, canonical_url string, "
    "title string, company_name string, department string, location_text string, "
    f"employment_type string, description_text string, posted {POSTED}, salary {SALARY}"
)

RESPONSE = (
    "source_id string, run_id string, role string, status int, url string, body string, "
    "content_type string, etag string, last_modified string, not_modified boolean, fetched_at bigint"
)

COMPANIES = (
    "id string, slug string, name string, careers_url string, remote_policy_url string, "
    "priority int, active boolean, created_at bigint, updated_at bigint"
)

SOURCES = (
    "id string, company_id string, kind string, url string, adapter_key string, config_json string, "
    "browser_required boolean, crawl_interval_minutes int, etag string, last_modified string, "
    "content_fingerprint string, snapshot_run_id string, previous_job_count bigint, "
    "consecutive_failures int, last_success_at bigint, last_failure_at bigint, next_due_at bigint, "
    "lease_owner string, lease_until bigint, status string, created_at bigint, updated_at bigint"
)

CRAWL_RUNS = (
    "id string, runner_type string, trigger_type string, planned_source_count bigint, "
    "completed_source_count bigint, failed_source_count bigint, started_at bigint, "
    "completed_at bigint, status string"
)

SOURCE_RUNS = (
    "id string, run_id string, source_id string, status string, http_status int, "
    "fetched_job_count bigint, previous_job_count bigint, response_hash string, error_code string, "
    "error_message string, started_at bigint, completed_at bigint"
)

JOBS = (
    "id string, source_id string, company_id string, external_id string, dedupe_key string, "
    "canonical_url string, title string, company_name string, department string, "
    "location_text string, employment_type string, description_text string, search_text string, "
    "skills array<string>, workplace_type string, remote_scope string, eligible_from_korea string, "
    "async_level string, required_timezone string, required_overlap_hours double, "
    "salary_currency string, salary_min double, salary_max double, salary_interval string, "
    "posted_at bigint, first_seen_at bigint, last_seen_at bigint, last_seen_run_id string, "
    "missing_count int, status string, closed_at bigint, score int, confidence double, "
    f"evidence {EVIDENCE}, content_hash string, created_at bigint, updated_at bigint"
)

JOB_VERSIONS = "job_id string, content_hash string, snapshot_json string, observed_at bigint"

JOB_ACTIONS = (
    "job_id string, action string, dismiss_reason string, notes string, applied_at bigint, updated_at bigint"
)

INGEST_BATCHES = "batch_id string, run_id string, source_id string, job_count bigint, received_at bigint"

SOURCE_OBS = (
    "run_id string, source_id string, status string, http_status int, fetched_job_count bigint, "
    "previous_job_count bigint, received_batch_count bigint, expected_batch_count bigint, "
    "response_hash string, content_fingerprint string, etag string, last_modified string, "
    "error_code string, error_message string, signals array<string>"
)

TABLES = {
    "companies": COMPANIES,
    "sources": SOURCES,
    "crawl_runs": CRAWL_RUNS,
    "source_runs": SOURCE_RUNS,
    "jobs": JOBS,
    "job_versions": JOB_VERSIONS,
    "job_actions": JOB_ACTIONS,
    "ingest_batches": INGEST_BATCHES,
}

# What identifies a row of each table.
KEYS = {
    "companies": ("id",),
    "sources": ("id",),
    "crawl_runs": ("id",),
    "source_runs": ("source_id", "run_id"),
    "jobs": ("source_id", "external_id"),
    "job_versions": ("job_id", "content_hash"),
    "job_actions": ("job_id",),
    "ingest_batches": ("batch_id",),
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
