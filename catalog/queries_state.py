"""History, upserts, state transitions, retention and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postlens.operators import history, retention, rollups, sources as source_state, state
from postlens.operators.joins import join_shuffled
from postlens.plans import views
from postlens.plans.collect import collect_run, cut
from postlens.schemas import INGEST_BATCHES, JOB_VERSIONS, JOBS, KEYS, TABLES, struct
from postlens.session import shared_folder
from postlens.sources.details import enrich_details
from postlens.sources.registry import parse_board_c
from postlens.sources.tables import Delta, Tables
from postlens.streaming import ingest, presence

from . import standins as st
from .base import query, table, with_ctes
from .standins import DAY, NOW, ctes


def _now():
    return F.lit(NOW).cast("bigint")



@query(
    "newest_versions",
    with_ctes(
        ctes("observations", "versions"),
        """SELECT job_id, content_hash, observed_at FROM versions
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY observed_at DESC, content_hash) <= 3""",
    ),
)
def newest_versions(spark, sf):
    versions = history.build_versions(st.observations(spark, sf))
    return retention.newest_versions(versions).select("job_id", "content_hash", "observed_at")


@query("first_versions", with_ctes(ctes("observations"), st.VERSIONS))
def first_versions(spark, sf):
    return history.build_versions(st.observations(spark, sf))


@query("version_counts", with_ctes(ctes("observations", "versions"), "SELECT job_id, count(*) AS version_count FROM versions GROUP BY job_id"))
def version_counts(spark, sf):
    return views.version_counts(history.build_versions(st.observations(spark, sf)))


@query(
    "conversation_versions",
    "SELECT CAST(conv_id AS VARCHAR) AS job_id, sha256(text) AS content_hash, min(turn) AS observed_at FROM conversations GROUP BY ALL",
)
def conversation_versions(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("snapshot_json"), F.col("turn").alias("observed_at"),
    )
    return history.build_versions(turns).drop("snapshot_json")


_LIMBS = [(s, min(6, 65 - s)) for s in range(1, 65, 6)]
_PRINT_SQL = (
    "SELECT source_id, count(*) AS posting_count, sha256(CAST(count(*) AS VARCHAR) || "
    + " || ".join(f"',' || CAST(sum(CAST('0x' || substr(h, {s}, {n}) AS BIGINT)) AS VARCHAR)" for s, n in _LIMBS)
    + ") AS content_fingerprint FROM (SELECT source_id, sha256('[\"' || external_id || '\",\"' || content_hash || '\"]') AS h FROM jobs) GROUP BY source_id"
)


@query("source_fingerprints", with_ctes(ctes("jobs"), _PRINT_SQL))
def source_fingerprints(spark, sf):
    return history.fingerprint(st.jobs(spark, sf), ["source_id"])


@query(
    "last_of_each_key",
    """SELECT user_id, event_type, max(event_id) AS event_id, min(event_id) AS first_ordinal, arg_max(value, event_id) AS value
FROM events GROUP BY user_id, event_type""",
)
def last_of_each_key(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return history.dedupe_last(rows, ["user_id", "event_type"], "event_id")


@query("latest_event_per_user", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_event_per_user(spark, sf):
    return history.latest_per(table(spark, sf, "events"), ["user_id"], ["event_id"], ["event_type", "value"])


_PRESENCE_SQL = """WITH runs AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS no, count(*) OVER (PARTITION BY event_type) AS total
  FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events)),
seen AS (SELECT DISTINCT e.event_type, user_id, no, day, total FROM events e JOIN runs r ON CAST(ts AS DATE) = day AND e.event_type = r.event_type),
gaps AS (SELECT *, coalesce(lead(no) OVER w - 1, total) - no AS absent, lead(no) OVER w IS NULL AS is_last FROM seen WINDOW w AS (PARTITION BY event_type, user_id ORDER BY no)),
ends AS (SELECT *, coalesce(sum(CASE WHEN absent >= 2 OR is_last THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM gaps),
isl AS (SELECT event_type, user_id, island, min(day) AS first_seen, max(day) AS last_seen, count(*) AS runs_seen, max(no) AS last_no, max(CASE WHEN absent >= 2 OR is_last THEN absent END) AS runs_absent FROM ends GROUP BY ALL)
SELECT isl.event_type AS source_id, CAST(user_id AS VARCHAR) AS external_id, CAST(island AS BIGINT) AS island, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, runs_seen, {absent}
  CAST(r.day AS VARCHAR) AS closed_at FROM isl LEFT JOIN runs r ON runs_absent >= 2 AND r.no = last_no + 2 AND r.event_type = isl.event_type"""


def _sightings(events):
    """Every event type is a source whose postings are its users; a day with an event of the type is a run."""
    seen = events.select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("external_id"), F.to_date("ts").cast("string").alias("run_at"))
    return seen, seen.select("source_id", "run_at")


@query("presence_history", _PRESENCE_SQL.replace("{absent}", "runs_absent,"))
def presence_history(spark, sf):
    return history.presence_history(*_sightings(table(spark, sf, "events")))


# Two overlapping parts of the whole table: an older state and a newer delta.
_OLD, _NEW = 820_454_400, 788_918_400


@query(
    "appended_versions",
    with_ctes(
        ctes("observations"),
        f"""SELECT job_id, content_hash, min(observed_at) AS observed_at FROM observations WHERE observed_at < {_OLD} GROUP BY ALL
UNION ALL SELECT job_id, content_hash, min(observed_at) FROM observations o WHERE observed_at >= {_NEW}
  AND NOT EXISTS (SELECT 1 FROM observations b WHERE b.observed_at < {_OLD} AND b.job_id = o.job_id AND b.content_hash = o.content_hash) GROUP BY ALL""",
    ),
)
def appended_versions(spark, sf):
    rows = st.observations(spark, sf)
    base = history.build_versions(rows.filter(F.col("observed_at") < _OLD))
    return state.append_versions(base, rows.filter(F.col("observed_at") >= _NEW)).drop("snapshot_json")


_STATE_OUT = "external_id, source_id, score, status, missing_count, last_seen_run_id, first_seen_at, created_at, updated_at, closed_at"


@query(
    "upserted_postings",
    with_ctes(
        {
            **ctes("jobs"),
            "old": f"SELECT * FROM jobs WHERE first_seen_at < {_OLD}",
            "delta": f"SELECT * FROM jobs WHERE first_seen_at >= {_NEW}",
        },
        f"""SELECT coalesce(d.external_id, o.external_id) AS external_id, coalesce(d.source_id, o.source_id) AS source_id, coalesce(d.score + 1, o.score) AS score,
  CASE WHEN d.id IS NULL THEN o.status ELSE 'open' END AS status, CASE WHEN d.id IS NULL THEN o.missing_count ELSE 0 END AS missing_count,
  CASE WHEN d.id IS NULL THEN o.last_seen_run_id ELSE 'run_1999' END AS last_seen_run_id, coalesce(o.first_seen_at, {NOW}) AS first_seen_at,
  coalesce(o.created_at, {NOW}) AS created_at, CASE WHEN d.id IS NULL THEN o.updated_at ELSE {NOW} END AS updated_at, CASE WHEN d.id IS NULL THEN o.closed_at END AS closed_at
FROM old o FULL JOIN delta d ON o.source_id = d.source_id AND o.external_id = d.external_id""",
    ),
)
def upserted_postings(spark, sf):
    jobs = st.jobs(spark, sf)
    delta = jobs.filter(F.col("first_seen_at") >= _NEW).withColumns(
        {"score": F.col("score") + 1, "run_id": F.lit("run_1999"), "fetched_at": _now()}
    )
    merged = state.upsert_jobs(jobs.filter(F.col("first_seen_at") < _OLD), state.incoming_jobs(delta, _now()))
    return merged.select(*_STATE_OUT.split(", "))


@query(
    "user_actions_set",
    with_ctes(
        ctes("jobs", "actions"),
        f"""SELECT job_id, action, dismiss_reason, applied_at, updated_at FROM actions WHERE job_id NOT IN (SELECT id FROM jobs WHERE score >= 50)
UNION ALL SELECT id, CASE WHEN score >= 85 THEN 'applied' ELSE 'saved' END, NULL, CASE WHEN score >= 85 THEN {NOW} END, {NOW} FROM jobs WHERE score >= 50""",
    ),
)
def user_actions_set(spark, sf):
    jobs = st.jobs(spark, sf)
    changes = jobs.filter(F.col("score") >= 50).select(
        F.col("id").alias("job_id"), F.when(F.col("score") >= 85, "applied").otherwise("saved").alias("action"),
        F.lit(None).cast("string").alias("dismiss_reason"), F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("bigint").alias("applied_at"),
    )
    return state.set_actions(st.actions(spark, sf), changes, jobs, _now()).drop("notes")


@query(
    "user_actions_cleared",
    with_ctes(ctes("jobs", "actions"), "SELECT job_id, action FROM actions WHERE job_id NOT IN (SELECT id FROM jobs WHERE score < 50)"),
)
def user_actions_cleared(spark, sf):
    low = st.jobs(spark, sf).filter(F.col("score") < 50).select(F.col("id").alias("job_id"))
    return state.clear_actions(st.actions(spark, sf), low).select("job_id", "action")


# One report for each source; those of the last nations are not decided yet.
_DISP_SQL = """SELECT 'source_' || c_custkey AS source_id, CASE WHEN c_nationkey < 10 THEN 'complete' WHEN c_nationkey < 15 THEN 'retry' ELSE 'quarantine' END AS kind,
  CASE WHEN c_nationkey < 5 THEN 'healthy' WHEN c_nationkey < 12 THEN 'not_modified' ELSE 'failed' END AS status, 'run_1998' AS run_id,
  CASE WHEN c_acctbal > 2000 THEN 'run_1997' END AS stored_snapshot_run_id, CASE WHEN c_nationkey >= 18 THEN 2 ELSE 0 END AS stored_batches,
  c_nationkey BETWEEN 10 AND 11 AS bad_snapshot, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'e-new' END AS etag, CASE WHEN c_nationkey < 5 THEN sha256(c_name || '2') END AS content_fingerprint, c_custkey % 40 AS fetched_job_count
FROM customer"""


def _dispositions(spark, sf):
    """Every report handed in twice, and for a third of the sources an older one that says something else."""
    n, key = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    kind = F.when(n < 10, "complete").when(n < 15, "retry").otherwise("quarantine")
    reason = F.when(n >= 10, F.concat(F.lit("reason-"), n.cast("string")))
    reports = table(spark, sf, "customer").select(
        F.concat(F.lit("source_"), key).alias("source_id"),
        F.lit("run_1998").alias("run_id"),
        F.lit(2).alias("reported_at"),
        F.when(n < 5, "healthy").when(n < 12, "not_modified").otherwise("failed").alias("status"),
        F.struct(kind.alias("kind"), reason.alias("reason")).alias("disposition"),
        F.when(F.col("c_acctbal") > 2_000, "run_1997").alias("stored_snapshot_run_id"),
        F.when(n >= 18, 2).otherwise(0).cast("bigint").alias("stored_batches"),
        n.between(10, 11).alias("bad_snapshot"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "e-new").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(n < 5, F.sha2(F.concat("c_name", F.lit("2")), 256)).alias("content_fingerprint"),
        (F.col("c_custkey") % 40).alias("fetched_job_count"),
        F.lit(10).cast("bigint").alias("previous_job_count"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("response_hash"),
        F.when(n == 13, "boom").alias("error_message"),
        F.array(F.lit("s1"), F.lit("s2")).alias("signals"),
    )
    older = reports.withColumns({"reported_at": F.lit(1), "status": F.lit("healthy"), "etag": F.lit("e-older"), "disposition": F.struct(
        F.when(F.col("disposition.kind") == "complete", "retry").otherwise("complete").alias("kind"), F.lit("older").alias("reason"))})
    return reports.unionByName(reports).unionByName(older.where(F.pmod(F.xxhash64("source_id"), F.lit(3)) == 0))


_AGED = {
    **ctes("jobs"),
    "disp": _DISP_SQL,
    "base": "SELECT source_id, CASE WHEN status = 'healthy' THEN run_id ELSE stored_snapshot_run_id END AS b FROM disp WHERE kind = 'complete'",
    "hit": """SELECT j.*, j.status = 'open' AND b IS NOT NULL AND j.last_seen_run_id IS DISTINCT FROM b AS aged FROM jobs j LEFT JOIN base USING (source_id)""",
}


@query(
    "aged_postings",
    with_ctes(
        _AGED,
        f"""SELECT id, missing_count + CAST(aged AS INTEGER) AS missing_count, CASE WHEN aged AND missing_count + 1 >= 2 THEN 'closed' ELSE status END AS status,
  CASE WHEN aged AND missing_count + 1 >= 2 THEN {NOW} ELSE closed_at END AS closed_at, CASE WHEN aged THEN {NOW} ELSE updated_at END AS updated_at FROM hit""",
    ),
)
def aged_postings(spark, sf):
    rows = state.age_missing(st.jobs(spark, sf), _dispositions(spark, sf), _now())
    return rows.select("id", "missing_count", "status", "closed_at", "updated_at")


@query("missing_postings", with_ctes(_AGED, "SELECT id, source_id, last_seen_run_id FROM hit WHERE aged"))
def missing_postings(spark, sf):
    return state.missing_postings(st.jobs(spark, sf), _dispositions(spark, sf)).select("id", "source_id", "last_seen_run_id")


_SOURCE_OUT = (
    "id", "etag", "content_fingerprint", "snapshot_run_id", "previous_job_count", "consecutive_failures", "last_success_at",
    "last_failure_at", "next_due_at", "lease_owner", "status", "updated_at",
)


@query(
    "advanced_sources",
    with_ctes(
        {**ctes("sources"), "disp": _DISP_SQL, "j": """SELECT s.*, d.kind AS k, d.status AS ds, d.etag AS de, d.content_fingerprint AS df, d.fetched_job_count AS dc,
  d.kind <> 'complete' AND (d.stored_batches > 0 OR d.bad_snapshot) AS distrust, d.kind IS NOT NULL AS hit FROM sources s LEFT JOIN disp d ON d.source_id = s.id"""},
        f"""SELECT id, CASE WHEN k = 'complete' THEN coalesce(de, etag) WHEN distrust THEN NULL ELSE etag END AS etag,
  CASE WHEN k = 'complete' THEN coalesce(df, content_fingerprint) WHEN distrust THEN NULL ELSE content_fingerprint END AS content_fingerprint,
  CASE WHEN k = 'complete' AND ds = 'healthy' THEN 'run_1998' WHEN distrust THEN NULL ELSE snapshot_run_id END AS snapshot_run_id,
  CASE WHEN k = 'complete' AND ds = 'healthy' THEN dc ELSE previous_job_count END AS previous_job_count,
  CASE WHEN NOT hit THEN consecutive_failures WHEN k = 'complete' THEN 0 ELSE consecutive_failures + 1 END AS consecutive_failures,
  CASE WHEN k = 'complete' THEN {NOW} ELSE last_success_at END AS last_success_at, CASE WHEN hit AND k <> 'complete' THEN {NOW} ELSE last_failure_at END AS last_failure_at,
  CASE WHEN NOT hit THEN next_due_at WHEN k = 'complete' THEN {NOW} + crawl_interval_minutes * 60 ELSE {NOW} + greatest(crawl_interval_minutes, 720) * 60 END AS next_due_at,
  CASE WHEN hit THEN NULL ELSE lease_owner END AS lease_owner, CASE WHEN NOT hit THEN status WHEN k = 'quarantine' THEN 'quarantined' ELSE 'active' END AS status,
  CASE WHEN hit THEN {NOW} ELSE updated_at END AS updated_at FROM j""",
    ),
)
def advanced_sources(spark, sf):
    return source_state.advance_sources(st.sources(spark, sf), _dispositions(spark, sf), _now()).select(*_SOURCE_OUT)


@query(
    "recorded_source_runs",
    with_ctes(
        {**ctes("source_runs"), "disp": _DISP_SQL},
        f"""SELECT run_id || ':' || source_id AS id, source_id, CASE WHEN kind = 'complete' THEN status WHEN kind = 'retry' THEN 'failed' ELSE 'quarantined' END AS status,
  CASE WHEN kind <> 'complete' THEN 'reason-' || n END AS error_code, CASE WHEN kind <> 'complete' THEN CASE WHEN n = 13 THEN 'boom' ELSE 's1; s2' END END AS error_message, {NOW} AS started_at, {NOW} AS completed_at
FROM disp JOIN (SELECT 'source_' || c_custkey AS source_id, c_nationkey AS n FROM customer) USING (source_id)
UNION ALL SELECT id, source_id, status, error_code, error_message, started_at, completed_at FROM source_runs""",
    ),
)
def recorded_source_runs(spark, sf):
    rows = source_state.record_source_runs(st.source_runs(spark, sf), _dispositions(spark, sf), _now())
    return rows.select("id", "source_id", "status", "error_code", "error_message", "started_at", "completed_at")


@query(
    "run_counters",
    with_ctes({"disp": _DISP_SQL}, "SELECT run_id, count(*) FILTER (kind = 'complete') AS completed_source_count, count(*) FILTER (kind <> 'complete') AS failed_source_count FROM disp GROUP BY run_id"),
)
def run_counters(spark, sf):
    return source_state.run_counters(_dispositions(spark, sf))


_REPORT_SQL = {
    **ctes("source_runs", "crawl_runs"),
    "reports": """SELECT id AS run_id, CASE WHEN failed_source_count = 0 THEN 'completed' ELSE 'partial' END AS status,
  planned_source_count - failed_source_count AS completed_source_count, failed_source_count + CAST(started_at % 7 = 0 AS INTEGER) AS failed_source_count FROM crawl_runs""",
    "judged": """SELECT r.*, CASE WHEN c.completed_at IS NOT NULL AND c.status = r.status AND c.completed_source_count = r.completed_source_count AND c.failed_source_count = r.failed_source_count THEN 'already-completed'
  WHEN c.completed_at IS NOT NULL THEN 'RUN_ALREADY_FINALIZED' WHEN r.completed_source_count + r.failed_source_count <> c.planned_source_count THEN 'RUN_COUNT_MISMATCH'
  WHEN r.status = 'completed' AND r.failed_source_count <> 0 THEN 'INVALID_RUN_STATUS' WHEN r.status = 'partial' AND (r.completed_source_count = 0 OR r.failed_source_count = 0) THEN 'INVALID_RUN_STATUS' ELSE 'applied' END AS verdict
FROM reports r JOIN crawl_runs c ON c.id = r.run_id""",
}


def _reports(spark, sf):
    off = (F.col("started_at") % 7 == 0).cast("int")
    return st.crawl_runs(spark, sf).select(
        F.col("id").alias("run_id"),
        F.when(F.col("failed_source_count") == 0, "completed").otherwise("partial").alias("status"),
        (F.col("planned_source_count") - F.col("failed_source_count")).alias("completed_source_count"),
        (F.col("failed_source_count") + off).alias("failed_source_count"),
    )


def _finalized(spark, sf):
    sources = st.sources(spark, sf)
    newest = st.source_runs(spark, sf).groupBy(F.col("source_id").alias("id")).agg(F.max("run_id").alias("_run"))
    leased = sources.join(newest, "id", "left").withColumn("lease_owner", F.col("_run")).select(*sources.columns)
    return source_state.finalize_runs(st.crawl_runs(spark, sf), st.source_runs(spark, sf), leased, _reports(spark, sf), _now())


@query(
    "judged_run_reports",
    with_ctes(
        _REPORT_SQL,
        """SELECT j.run_id, verdict, CASE WHEN verdict = 'applied' THEN (SELECT count(*) FROM source_runs s WHERE s.run_id = j.run_id AND s.status = 'running') ELSE 0 END AS dangling FROM judged j""",
    ),
)
def judged_run_reports(spark, sf):
    return _finalized(spark, sf)[3].select("run_id", "verdict", "dangling")


@query(
    "finalized_runs",
    with_ctes(
        _REPORT_SQL,
        f"""SELECT c.id, CASE WHEN verdict = 'applied' THEN j.status ELSE c.status END AS status, CASE WHEN verdict = 'applied' THEN {NOW} ELSE c.completed_at END AS completed_at,
  CASE WHEN verdict = 'applied' THEN j.completed_source_count ELSE c.completed_source_count END AS completed_source_count FROM crawl_runs c LEFT JOIN judged j ON j.run_id = c.id""",
    ),
)
def finalized_runs(spark, sf):
    return _finalized(spark, sf)[0].select("id", "status", "completed_at", "completed_source_count")


@query(
    "finalized_source_runs",
    with_ctes(
        _REPORT_SQL,
        f"""SELECT s.id, CASE WHEN d THEN 'failed' ELSE s.status END AS status, CASE WHEN d THEN 'run-finalized-without-source-complete' ELSE s.error_code END AS error_code, CASE WHEN d THEN {NOW} ELSE s.completed_at END AS completed_at
FROM (SELECT s.*, s.status = 'running' AND coalesce(j.verdict = 'applied', false) AS d FROM source_runs s LEFT JOIN judged j ON j.run_id = s.run_id) s""",
    ),
)
def finalized_source_runs(spark, sf):
    return _finalized(spark, sf)[1].select("id", "status", "error_code", "completed_at")


@query(
    "finalized_sources",
    with_ctes(
        {
            **ctes("sources"), **_REPORT_SQL,
            "leased": "SELECT s.* REPLACE ((SELECT max(run_id) FROM source_runs r WHERE r.source_id = s.id) AS lease_owner) FROM sources s",
            "reset": """SELECT DISTINCT s.source_id, s.run_id FROM source_runs s JOIN judged j ON j.run_id = s.run_id WHERE s.status = 'running' AND verdict = 'applied'""",
        },
        f"""SELECT l.id, CASE WHEN r.run_id IS NULL THEN etag END AS etag, CASE WHEN r.run_id IS NULL THEN lease_owner END AS lease_owner,
  consecutive_failures + CAST(r.run_id IS NOT NULL AS INTEGER) AS consecutive_failures,
  CASE WHEN r.run_id IS NULL THEN next_due_at ELSE {NOW} + greatest(crawl_interval_minutes, 720) * 60 END AS next_due_at, CASE WHEN r.run_id IS NULL THEN l.status ELSE 'active' END AS status
FROM leased l LEFT JOIN reset r ON r.source_id = l.id AND r.run_id = l.lease_owner""",
    ),
)
def finalized_sources(spark, sf):
    return _finalized(spark, sf)[2].select("id", "etag", "lease_owner", "consecutive_failures", "next_due_at", "status")


@query(
    "edited_sources",
    with_ctes(
        ctes("sources"),
        f"""SELECT id, CASE WHEN p = 0 THEN 'https://new.example.com/' || id ELSE url END AS url, CASE WHEN p = 2 THEN 90 ELSE crawl_interval_minutes END AS crawl_interval_minutes,
  CASE WHEN p = 0 OR (p = 1 AND adapter_key IS NOT NULL) THEN NULL ELSE etag END AS etag, CASE WHEN p IN (0, 3) OR (p = 1 AND adapter_key IS NOT NULL) THEN NULL ELSE lease_owner END AS lease_owner,
  CASE WHEN p = 0 OR (p = 1 AND adapter_key IS NOT NULL) THEN 0 ELSE previous_job_count END AS previous_job_count, CASE WHEN p = 3 THEN 'paused' WHEN p = 4 THEN 'active' ELSE status END AS status,
  CASE WHEN p IN (0, 4) OR (p = 1 AND adapter_key IS NOT NULL) THEN {NOW} ELSE next_due_at END AS next_due_at, CASE WHEN p < 6 THEN {NOW} ELSE updated_at END AS updated_at
FROM (SELECT *, previous_job_count % 8 AS p FROM sources)""",
    ),
)
def edited_sources(spark, sf):
    """Address, key, schedule, pause, resume and reordered-configuration edits."""
    sources = st.sources(spark, sf)
    p = F.col("previous_job_count") % 8
    named = F.when(p == 0, "url").when(p == 1, "adapter_key").when(p == 2, "crawl_interval_minutes").when(p.isin(3, 4), "active").otherwise("config_json")
    none = F.lit(None).cast("string")
    edits = sources.filter(p < 6).select(
        "id",
        F.array(named).alias("provided"),
        none.alias("company_id"),
        none.alias("kind"),
        F.when(p == 0, F.concat(F.lit("https://new.example.com/"), "id")).alias("url"),
        F.when(p == 1, " ").alias("adapter_key"),
        F.when(F.col("config_json") == "{}", "{ }").otherwise('{"titleSelector":"a", "listSelector":"li.job"}').alias("config_json"),
        F.lit(90).alias("crawl_interval_minutes"),
        (p == 4).alias("active"),
    )
    rows = source_state.apply_source_edits(sources, edits, _now())
    return rows.select("id", "url", "crawl_interval_minutes", "etag", "lease_owner", "previous_job_count", "status", "next_due_at", "updated_at")


@query(
    "created_sources",
    with_ctes(
        ctes("sources"),
        f"""SELECT id, company_id, kind, adapter_key, browser_required, crawl_interval_minutes, next_due_at, status FROM sources
UNION ALL SELECT 'source_s' || s_suppkey, 'company_' || s_nationkey, CASE WHEN s_acctbal < 0 THEN 'playwright' ELSE 'lever' END, CASE WHEN s_nationkey > 9 THEN 'k' || s_nationkey END, s_acctbal < 0, 720, {NOW},
  CASE WHEN s_nationkey = 3 THEN 'paused' ELSE 'active' END FROM supplier""",
    ),
)
def created_sources(spark, sf):
    n = F.col("s_nationkey")
    inputs = table(spark, sf, "supplier").select(
        F.concat(F.lit("source_s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("company_"), n.cast("string")).alias("company_id"),
        F.when(F.col("s_acctbal") < 0, "playwright").otherwise("lever").alias("kind"),
        F.lit("https://s.example.com").alias("url"),
        F.when(n > 9, F.concat(F.lit(" k"), n.cast("string"))).otherwise(" ").alias("adapter_key"),
        F.lit(None).cast("string").alias("config_json"),
        F.lit(None).cast("int").alias("crawl_interval_minutes"),
        F.when(n == 3, False).alias("active"),
    )
    rows = source_state.create_sources(st.sources(spark, sf), inputs, _now())
    return rows.select("id", "company_id", "kind", "adapter_key", "browser_required", "crawl_interval_minutes", "next_due_at", "status")


@query(
    "migrated_sources",
    with_ctes(ctes("sources"), "SELECT id, CASE WHEN crawl_interval_minutes = 360 THEN 720 ELSE crawl_interval_minutes END AS crawl_interval_minutes, kind = 'playwright' AS browser_required FROM sources"),
)
def migrated_sources(spark, sf):
    legacy = st.sources(spark, sf).withColumn("browser_required", F.col("kind") == "lever")
    return source_state.migrate_sources(legacy).select("id", "crawl_interval_minutes", "browser_required")


def _requeue_sql(reset: bool) -> str:
    failures = "CASE WHEN h THEN 0 ELSE consecutive_failures END" if reset else "consecutive_failures"
    return with_ctes(
        ctes("sources"),
        f"""SELECT id, CASE WHEN h THEN 'active' ELSE status END AS status, CASE WHEN h THEN {NOW} ELSE next_due_at END AS next_due_at, {failures} AS consecutive_failures,
  CASE WHEN h THEN NULL ELSE lease_owner END AS lease_owner FROM (SELECT *, status = 'quarantined' OR consecutive_failures > 0 AS h FROM sources)""",
    )


def _unhealthy(sources):
    return sources.filter((F.col("status") == "quarantined") | (F.col("consecutive_failures") > 0))


_QUEUE_OUT = ("id", "status", "next_due_at", "consecutive_failures", "lease_owner")


@query("requeued_sources", _requeue_sql(False))
def requeued_sources(spark, sf):
    sources = st.sources(spark, sf)
    return source_state.requeue(sources, _unhealthy(sources), _now()).select(*_QUEUE_OUT)


@query("reset_sources", _requeue_sql(True))
def reset_sources(spark, sf):
    sources = st.sources(spark, sf)
    return source_state.reset_health(sources, _unhealthy(sources), _now()).select(*_QUEUE_OUT)


@query(
    "stale_claims",
    with_ctes(
        ctes("sources"),
        f"""SELECT id, CASE WHEN h THEN NULL ELSE etag END AS etag, CASE WHEN h THEN NULL ELSE snapshot_run_id END AS snapshot_run_id, CASE WHEN h THEN NULL ELSE lease_owner END AS lease_owner,
  CASE WHEN h THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *, coalesce(lease_owner IS NOT NULL AND (lease_until IS NULL OR lease_until < {NOW}), false) AS h FROM sources)""",
    ),
)
def stale_claims(spark, sf):
    rows = source_state.invalidate_stale(st.sources(spark, sf), _now())
    return rows.select("id", "etag", "snapshot_run_id", "lease_owner", "updated_at")


@query(
    "created_companies",
    with_ctes(
        ctes("companies"),
        """SELECT id, slug, priority FROM companies UNION ALL SELECT 'company_p' || min(p_partkey), slug, 50 FROM
(SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS k, CASE WHEN p_size = 1 THEN 'nation_1' ELSE replace(p_name, ' ', '-') || '-' || p_size END AS slug FROM part) WHERE slug NOT IN (SELECT slug FROM companies) GROUP BY slug""",
    ),
)
def created_companies(spark, sf):
    """New companies from parts; a slug taken already or claimed twice is refused."""
    slug = F.when(F.col("p_size") == 1, "nation_1").otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"))
    )
    inputs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), slug.alias("slug"), F.col("p_brand").alias("name"))
    wide = inputs.withColumn("id", F.format_string("%012d", F.col("id")))
    companies, _ = source_state.create_companies(st.companies(spark, sf), wide, _now())
    plain = F.when(F.col("id").rlike("^[0-9]+$"), F.concat(F.lit("company_p"), F.col("id").cast("bigint").cast("string"))).otherwise(F.col("id"))
    return companies.select(plain.alias("id"), "slug", "priority")


@query(
    "edited_companies",
    with_ctes(
        {**ctes("companies"), "best": "SELECT c_nationkey, max(c_custkey) AS k, count(*) AS n FROM customer GROUP BY c_nationkey"},
        f"""SELECT id, CASE WHEN n % 2 = 0 THEN 'Renamed ' || k ELSE name END AS name, CASE WHEN n % 2 = 1 THEN NULL ELSE careers_url END AS careers_url, priority, {NOW} AS updated_at
FROM companies JOIN best ON id = 'company_' || c_nationkey""",
    ),
)
def edited_companies(spark, sf):
    best = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("k"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    even = F.col("n") % 2 == 0
    edits = best.select(
        F.concat(F.lit("company_"), F.col("c_nationkey").cast("string")).alias("id"),
        F.array(F.when(even, "name").otherwise("careers_url")).alias("provided"),
        none.alias("slug"), F.concat(F.lit("Renamed "), F.col("k").cast("string")).alias("name"), none.alias("careers_url"),
        none.alias("remote_policy_url"), F.lit(1).alias("priority"), F.lit(False).alias("active"),
    )
    rows = source_state.apply_company_edits(st.companies(spark, sf), edits, _now())
    return rows.select("id", "name", "careers_url", "priority", "updated_at")


@query(
    "cascaded_postings",
    with_ctes(ctes("jobs", "sources"), "SELECT id, source_id FROM jobs WHERE source_id NOT IN (SELECT id FROM sources WHERE status = 'quarantined')"),
)
def cascaded_postings(spark, sf):
    gone = st.sources(spark, sf).filter(F.col("status") == "quarantined")
    return state.cascade(gone, st.jobs(spark, sf), "source_id", spread_by=["id"]).select("id", "source_id")


_LATER = 915_148_800


def _state_tables(spark, sf):
    batches = st.source_runs(spark, sf).select(
        F.col("id").alias("batch_id"), "run_id", "source_id", F.lit(1).cast("bigint").alias("job_count"), F.col("started_at").alias("received_at")
    )
    return {
        "jobs": st.jobs(spark, sf),
        "job_actions": st.actions(spark, sf),
        "job_versions": history.build_versions(st.observations(spark, sf)),
        "source_runs": st.source_runs(spark, sf),
        "crawl_runs": st.crawl_runs(spark, sf),
        "ingest_batches": batches,
    }


@query(
    "retention_report",
    with_ctes(
        ctes("jobs", "actions", "observations", "versions", "source_runs", "crawl_runs"),
        f"""SELECT 'ingest_batches' AS "table", count(*) AS removed FROM source_runs WHERE started_at < {_LATER - 30 * DAY}
UNION ALL SELECT 'source_runs', count(*) FROM source_runs WHERE started_at < {_LATER - 30 * DAY} UNION ALL SELECT 'crawl_runs', count(*) FROM crawl_runs WHERE started_at < {_LATER - 90 * DAY}
UNION ALL SELECT 'job_versions', coalesce(sum(greatest(n - 3, 0)), 0) FROM (SELECT count(*) AS n FROM versions GROUP BY job_id)
UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE status = 'closed' AND closed_at < {_LATER - 180 * DAY} AND id NOT IN (SELECT job_id FROM actions)""",
    ),
)
def retention_report(spark, sf):
    return retention.retention_report(_state_tables(spark, sf), F.lit(_LATER).cast("bigint"))


_KEPT = f"SELECT * FROM jobs WHERE NOT coalesce(status = 'closed' AND closed_at < {_LATER - 180 * DAY} AND id NOT IN (SELECT job_id FROM actions), false)"


@query("retained_postings", with_ctes(ctes("jobs", "actions"), f"SELECT id, status, closed_at FROM ({_KEPT})"))
def retained_postings(spark, sf):
    kept = retention.apply_retention(_state_tables(spark, sf), F.lit(_LATER).cast("bigint"))["jobs"]
    return kept.select("id", "status", "closed_at")


@query(
    "retained_versions",
    with_ctes(
        {**ctes("jobs", "actions", "observations", "versions"), "kept": _KEPT},
        """SELECT job_id, content_hash FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY observed_at DESC, content_hash) <= 3)
WHERE job_id NOT IN (SELECT id FROM jobs EXCEPT SELECT id FROM kept)""",
    ),
)
def retained_versions(spark, sf):
    kept = retention.apply_retention(_state_tables(spark, sf), F.lit(_LATER).cast("bigint"))["job_versions"]
    return kept.select("job_id", "content_hash")


_BATCH_SQL = """SELECT event_id, 'b' || user_id || '_' || CAST(value AS INTEGER) AS batch_id, 'run_' || strftime(ts, '%Y%m%d') AS run_id, 'source_' || event_type AS source_id, CAST(1 AS BIGINT) AS job_count, ts FROM events"""


def _batches(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("_"), F.rint("value").cast("int").cast("string")).alias("batch_id"),
        F.date_format("ts", "'run_'yyyyMMdd").alias("run_id"),
        F.concat(F.lit("source_"), "event_type").alias("source_id"),
        F.lit(1).cast("bigint").alias("job_count"),
        "ts",
    )


@query(
    "admitted_batches",
    with_ctes(
        {
            "b": _BATCH_SQL,
            "ledger": "SELECT DISTINCT ON (batch_id) batch_id, run_id, source_id FROM b WHERE ts < '2024-01-08' ORDER BY batch_id, event_id",
            "incoming": "SELECT * FROM b WHERE ts >= '2024-01-06'",
            "firsts": "SELECT batch_id, min(event_id) AS first_id, arg_min(run_id, event_id) AS run_id, arg_min(source_id, event_id) AS source_id FROM incoming GROUP BY batch_id",
        },
        """SELECT i.event_id, CASE WHEN l.batch_id IS NULL AND i.event_id = f.first_id THEN 'new'
  WHEN i.run_id = coalesce(l.run_id, f.run_id) AND i.source_id = coalesce(l.source_id, f.source_id) THEN 'duplicate' ELSE 'collision' END AS admission
FROM incoming i JOIN firsts f USING (batch_id) LEFT JOIN ledger l USING (batch_id)""",
    ),
)
def admitted_batches(spark, sf):
    rows = _batches(spark, sf)
    before = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-08 00:00:00"))
    after = F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-06 00:00:00"))
    ledger = state.insert_ignore(rows.filter(F.lit(False)), rows.filter(before), ["batch_id"], F.col("event_id"))
    return state.admit_batches(ledger, rows.filter(after), "event_id").select("event_id", "admission")


@query(
    "ledger_counts",
    with_ctes({"b": _BATCH_SQL}, "SELECT run_id, source_id, count(*) AS stored_batches FROM b GROUP BY ALL"),
)
def ledger_counts(spark, sf):
    return state.ledger_counts(_batches(spark, sf))


_CONTEXT_SQL = {
    **ctes("sources", "source_runs", "crawl_runs"),
    "obs": "SELECT o_orderkey, 'run_' || strftime(o_orderdate, '%Y%m%d') AS run_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'source_x' ELSE 'source_' || o_custkey END AS source_id FROM orders",
    "leased": "SELECT s.* REPLACE ((SELECT max(run_id) FROM source_runs r WHERE r.source_id = s.id) AS lease_owner) FROM sources s",
    "sr": "SELECT run_id, source_id, max(status) AS status, max(completed_at) AS completed_at FROM source_runs GROUP BY ALL",
    "ctx": """SELECT o.*, l.id AS sid, l.lease_owner, sr.status AS srs, sr.completed_at AS src, c.status AS crs FROM obs o LEFT JOIN leased l ON l.id = o.source_id
LEFT JOIN sr ON sr.run_id = o.run_id AND sr.source_id = o.source_id LEFT JOIN crawl_runs c ON c.id = o.run_id""",
}


def _context(spark, sf):
    runs = st.source_runs(spark, sf)
    sources = st.sources(spark, sf)
    newest = runs.groupBy(F.col("source_id").alias("id")).agg(F.max("run_id").alias("_run"))
    leased = sources.join(newest, "id", "left").withColumn("lease_owner", F.col("_run")).select(*sources.columns)
    unique = runs.groupBy("run_id", "source_id").agg(F.max("status").alias("status"), F.max("completed_at").alias("completed_at"))
    obs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "'run_'yyyyMMdd").alias("run_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "source_x").otherwise(F.concat(F.lit("source_"), F.col("o_custkey").cast("string"))).alias("source_id"),
    )
    return state.run_context(obs, leased, unique, st.crawl_runs(spark, sf), ["o_orderkey"])


@query(
    "admitted_writes",
    with_ctes(
        _CONTEXT_SQL,
        """SELECT o_orderkey, CASE WHEN sid IS NULL THEN 'SOURCE_NOT_FOUND' WHEN lease_owner IS DISTINCT FROM run_id THEN 'LEASE_MISMATCH'
  WHEN NOT coalesce(srs = 'running' AND crs = 'running', false) THEN 'RUN_NOT_ACTIVE' END AS reject_reason FROM ctx""",
    ),
)
def admitted_writes(spark, sf):
    return state.admit_writes(_context(spark, sf)).select("o_orderkey", "reject_reason")


@query(
    "admitted_completions",
    with_ctes(
        _CONTEXT_SQL,
        """SELECT o_orderkey, CASE WHEN sid IS NULL THEN 'SOURCE_NOT_FOUND' WHEN src IS NOT NULL THEN 'ALREADY_COMPLETED' WHEN srs IS NULL THEN 'SOURCE_RUN_NOT_FOUND'
  WHEN lease_owner IS DISTINCT FROM run_id THEN 'LEASE_MISMATCH' END AS reject_reason FROM ctx""",
    ),
)
def admitted_completions(spark, sf):
    return state.admit_completions(_context(spark, sf)).select("o_orderkey", "reject_reason")


_DETAIL_SQL = """WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)"""


def _detail_inputs(spark, sf):
    e = table(spark, sf, "events")
    key = F.col("event_id").cast("string")
    base = e.select(
        F.col("user_id").cast("string").alias("source_id"), F.lit("run_1").alias("run_id"), F.col("event_id").cast("int").alias("ordinal"),
        F.concat(F.lit("https://d.example.com/"), key).alias("canonical_url"), F.lit("short").alias("description_text"), "event_type",
    )
    body = F.concat(F.lit("<html><div class=\"d\">Detail "), "ordinal", F.lit(" &amp; more</div></html>"))
    pages = base.filter(F.col("event_type") != "error").select(
        "source_id", "run_id", F.col("canonical_url").alias("url"), F.when(F.col("event_type") == "view", "<p>").otherwise(body).alias("body"),
        F.lit("div.d").alias("selector"), F.lit(None).cast("string").alias("error"),
    )
    return base.drop("event_type"), pages


@query(
    "detail_descriptions",
    _DETAIL_SQL + """ SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(event_id AS INTEGER) AS ordinal,
  CASE WHEN event_type NOT IN ('error', 'view') THEN 'Detail ' || event_id || ' & more' ELSE 'short' END AS description_text FROM p""",
)
def detail_descriptions(spark, sf):
    return enrich_details(*_detail_inputs(spark, sf))[0].select("source_id", "ordinal", "description_text")


@query(
    "detail_signals",
    _DETAIL_SQL + """ SELECT CAST(user_id AS VARCHAR) AS source_id, CASE event_type WHEN 'view' THEN 'detail-selector-not-found:https://d.example.com/' || event_id
  ELSE 'detail-fetch-failed:https://d.example.com/' || event_id || ':not landed' END AS signal FROM p WHERE event_type IN ('error', 'view')""",
)
def detail_signals(spark, sf):
    return enrich_details(*_detail_inputs(spark, sf))[1].select("source_id", "signal")


@query(
    "capped_details",
    _DETAIL_SQL + """ SELECT CAST(user_id AS VARCHAR) AS source_id, CASE WHEN event_type = 'view' THEN 'detail-selector-not-found:https://d.example.com/' || event_id
  ELSE 'detail-fetch-failed:https://d.example.com/' || event_id || ':not landed' END AS signal FROM p WHERE event_type IN ('error', 'view') AND n <= 3
UNION ALL SELECT CAST(user_id AS VARCHAR), 'detail-fetch-capped:' || (max(total) - 3) FROM p WHERE total > 3 GROUP BY user_id""",
)
def capped_details(spark, sf):
    """The first three postings of each source are looked up, the others counted."""
    return enrich_details(*_detail_inputs(spark, sf), cap=3)[1].select("source_id", "signal")


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_versions(spark, sf):
    """Two commits of the versions table: the older part, then what the newer observations add to it."""
    tables = Tables(spark, _fresh(spark, "tables"), {"job_versions": JOB_VERSIONS})
    rows = st.observations(spark, sf)
    tables.replace("job_versions", history.build_versions(rows.filter(F.col("observed_at") < _OLD)))
    at = tables.snapshot()
    fresh = state.fresh_versions(at.read("job_versions"), rows.filter(F.col("observed_at") >= _OLD))
    tables.commit({"job_versions": Delta(fresh, append=True)}, base=at.version)
    return tables


@query("stored_versions", with_ctes(ctes("observations", "versions"), "SELECT job_id, content_hash, snapshot_json, observed_at FROM versions"))
def stored_versions(spark, sf):
    """State table round trip: an older commit, then one that adds the rest."""
    return _stored_versions(spark, sf).read("job_versions")


@query(
    "older_versions",
    with_ctes(
        {**ctes("observations"), "old": f"SELECT * FROM observations WHERE observed_at < {_OLD}"},
        "SELECT job_id, content_hash, min(observed_at) AS observed_at FROM old GROUP BY ALL",
    ),
)
def older_versions(spark, sf):
    """The version before the newest, read after the newest was published."""
    tables = _stored_versions(spark, sf)
    return tables.read("job_versions", tables.version() - 1).drop("snapshot_json")


@query(
    "stored_postings",
    with_ctes(
        {
            **ctes("jobs"),
            "old": f"SELECT * FROM jobs WHERE first_seen_at < {_OLD}",
            "delta": f"SELECT * FROM jobs WHERE first_seen_at >= {_NEW}",
        },
        f"""SELECT coalesce(d.external_id, o.external_id) AS external_id, coalesce(d.source_id, o.source_id) AS source_id, coalesce(d.score + 1, o.score) AS score,
  coalesce(o.first_seen_at, {NOW}) AS first_seen_at, CASE WHEN d.id IS NULL THEN o.updated_at ELSE {NOW} END AS updated_at
FROM old o FULL JOIN delta d ON o.source_id = d.source_id AND o.external_id = d.external_id
WHERE coalesce(d.score + 1, o.score) <> 50""",
    ),
)
def stored_postings(spark, sf):
    """Postings in keyed buckets: a delta takes the place of stored rows, then some keys go."""
    tables = Tables(spark, _fresh(spark, "tables"), {"jobs": JOBS})
    jobs = st.jobs(spark, sf)
    tables.replace("jobs", jobs.filter(F.col("first_seen_at") < _OLD))
    delta = jobs.filter(F.col("first_seen_at") >= _NEW).withColumns(
        {"score": F.col("score") + 1, "run_id": F.lit("run_1999"), "fetched_at": _now()}
    )
    at = tables.snapshot()
    merged = state.upsert_jobs(at.read("jobs"), state.incoming_jobs(delta, _now()), mark="touched")
    tables.commit({"jobs": Delta(merged.filter("touched").drop("touched"))}, base=at.version)
    stored = tables.read("jobs")
    tables.commit({"jobs": Delta(stored.limit(0), gone=stored.where("score = 50"))})
    return tables.read("jobs").select("external_id", "source_id", "score", "first_seen_at", "updated_at")


@query(
    "rollup_by_deltas",
    with_ctes(
        {
            **ctes("jobs"),
            "merged": f"""SELECT coalesce(d.company_id, o.company_id) AS company_id, coalesce(d.source_id, o.source_id) AS source_id, coalesce(d.score + 1, o.score) AS score,
  CASE WHEN d.id IS NULL THEN o.status ELSE 'open' END AS status FROM (SELECT * FROM jobs WHERE first_seen_at < {_OLD}) o
  FULL JOIN (SELECT * FROM jobs WHERE first_seen_at >= {_NEW}) d ON o.source_id = d.source_id AND o.external_id = d.external_id""",
            "aged": "SELECT company_id, source_id, score, CASE WHEN score % 5 = 0 THEN 'closed' ELSE status END AS status FROM merged WHERE score % 11 <> 0",
        },
        """SELECT company_id, source_id, count(*) AS postings, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status <> 'open') AS closed,
  count(*) FILTER (status = 'open' AND score >= 70) AS good, CAST(sum(score) AS BIGINT) AS score_sum FROM aged GROUP BY ALL""",
    ),
)
def rollup_by_deltas(spark, sf):
    """Counts after an upsert, a closing and a removal, each taken from the change alone and published with it."""
    tables = Tables(spark, _fresh(spark, "tables"), {"jobs": JOBS, "rollup": rollups.ROLLUP}, {"jobs": KEYS["jobs"], "rollup": rollups.ROLLUP_KEY}, buckets=4)
    jobs = st.jobs(spark, sf)
    old = jobs.filter(F.col("first_seen_at") < _OLD)
    tables.commit({"jobs": old, "rollup": rollups.rollup(old)})

    def publish(at, change):
        change = tables.stage("jobs", change, base=at.version)
        before = rollups.changed_postings(at.read("jobs"), change)
        tables.commit({"jobs": change, "rollup": rollups.rollup_delta(at.read("rollup"), before, change.rows)}, base=at.version)

    at = tables.snapshot()
    delta = jobs.filter(F.col("first_seen_at") >= _NEW).withColumns({"score": F.col("score") + 1, "run_id": F.lit("run_1999"), "fetched_at": _now()})
    merged = state.upsert_jobs(at.read("jobs"), state.incoming_jobs(delta, _now()), mark="touched")
    publish(at, Delta(merged.filter("touched").drop("touched")))
    at = tables.snapshot()
    publish(at, Delta(at.read("jobs").filter("score % 5 = 0").withColumn("status", F.lit("closed"))))
    at = tables.snapshot()
    publish(at, Delta(at.read("jobs").limit(0), gone=at.read("jobs").filter("score % 11 = 0")))
    return tables.read("rollup").drop("groups")


_FEED_RUN = "run_feed"


def _feed_state(spark, sf, kind, config="{}"):
    """State over which a run is opened: every customer is a source of one kind that is due."""
    sources = st.sources(spark, sf).withColumns(
        {"kind": F.lit(kind), "config_json": F.lit(config), "status": F.lit("active"), "lease_owner": F.lit(None).cast("string"),
         "lease_until": F.lit(None).cast("bigint"), "previous_job_count": F.lit(0).cast("bigint"), "content_fingerprint": F.lit(None).cast("string")}
    )
    empty = {name: spark.createDataFrame([], struct(ddl)) for name, ddl in TABLES.items()}
    opened = source_state.open_run(sources, empty["source_runs"], empty["crawl_runs"], sources, _FEED_RUN, _now())
    return {**empty, "companies": st.companies(spark, sf), **opened}


def _feed_bodies(spark, sf):
    """One response for each source with an order: its orders as postings of a board."""
    key = F.col("o_orderkey").cast("string")
    posting = F.struct(key.alias("id"), F.concat(F.lit("Order "), key, F.lit(" "), "o_orderpriority").alias("title"), F.concat(F.lit("https://o.example.com/"), key).alias("jobUrl"))
    bodies = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(posting)).alias("jobs"))).alias("body"))
    return bodies.select(
        F.concat(F.lit("source_"), F.col("o_custkey").cast("string")).alias("source_id"), F.lit(_FEED_RUN).alias("run_id"), F.lit("list").alias("role"),
        F.lit(200).alias("status"), F.lit("https://feeds.example.com").alias("url"), "body", F.lit("application/json").alias("content_type"),
        *[F.lit(None).cast("string").alias(n) for n in ("etag", "last_modified")], F.lit(False).alias("not_modified"), _now().alias("fetched_at"),
    )


class _LostOnce(Tables):
    """Tables whose second commit is lost after its data were written and before it was published."""

    lost = 0

    def commit(self, *args, **kwargs):
        if self.lost == 0 and self.version() == 2:
            self.files.create, create = self._lose, self.files.create
            try:
                return super().commit(*args, **kwargs)
            finally:
                self.files.create = create
        return super().commit(*args, **kwargs)

    def _lose(self, *_):
        self.lost += 1
        raise OSError("lost before the manifest")


def _collected_stream(spark, sf):
    """Responses landed in two parts and run through the whole collection, one micro-batch each. The second batch fails
    between its data and its manifest; the stream is started again and replays it."""
    root = _fresh(spark, "stream")
    tables = _LostOnce(spark, f"{root}/tables", buckets=2)
    tables.commit(_feed_state(spark, sf, "ashby"))
    bodies = cut(_feed_bodies(spark, sf), "bodies")
    for part in range(2):
        bodies.where(F.pmod(F.xxhash64("source_id"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    landed = ingest.read_landed(spark, f"{root}/landed", maxFilesPerTrigger="1")
    sink = ingest.ingest_sink(tables, _now)
    try:
        ingest.run_available(landed, sink, f"{root}/cp").awaitTermination()
    except StreamingQueryException as e:
        if not tables.lost:
            raise e
    ingest.run_available(landed, sink, f"{root}/cp").awaitTermination()
    if tables.lost != 1 or tables.version() != 3:
        raise RuntimeError(f"the failure did not take place: version {tables.version()}")
    return tables


@query(
    "stream_collected_postings",
    f"""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'source_' || o_custkey AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
  'https://o.example.com/' || o_orderkey AS canonical_url, '{_FEED_RUN}' AS last_seen_run_id, 'open' AS status, {NOW} AS first_seen_at,
  n AS previous_job_count, 'healthy' AS run_status, n AS stored_jobs, (SELECT count(*) FROM n) AS completed, CAST(0 AS BIGINT) AS failed
FROM orders JOIN n USING (o_custkey)""",
)
def stream_collected_postings(spark, sf):
    """Postings with what the stream has left in their source, its run, the ledger and the run's counters."""
    tables = _collected_stream(spark, sf).read_all()
    jobs = tables["jobs"].select("source_id", "external_id", "title", "canonical_url", "last_seen_run_id", "status", "first_seen_at")
    runs = tables["source_runs"].select("source_id", F.col("status").alias("run_status"), "run_id")
    run = tables["crawl_runs"].select(F.col("id").alias("run_id"), F.col("completed_source_count").alias("completed"), F.col("failed_source_count").alias("failed"))
    batches = tables["ingest_batches"].select("source_id", F.col("job_count").alias("stored_jobs"))
    sources = tables["sources"].select(F.col("id").alias("source_id"), "previous_job_count")
    return jobs.join(sources, "source_id").join(runs, "source_id").join(run, "run_id").join(batches, "source_id").drop("run_id")


_DETAIL_CONFIG = '{"listSelector":"li.job","titleSelector":"a","detailDescriptionSelector":"div.d"}'


@query(
    "collected_details",
    """SELECT 'source_' || o_custkey AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Detail ' || o_orderkey || ' & more' WHEN 3 THEN repeat('long ', 40) || 'text' ELSE '' END AS description,
  CASE o_orderkey % 4 WHEN 1 THEN 'detail-selector-not-found:https://feeds.example.com/j/' || o_orderkey
    WHEN 2 THEN 'detail-fetch-failed:https://feeds.example.com/j/' || o_orderkey || ':' || CASE WHEN o_orderkey % 8 = 2 THEN 'HTTP 500 for https://feeds.example.com/j/' || o_orderkey ELSE 'not landed' END END AS signal
FROM orders""",
)
def collected_details(spark, sf):
    """Lists and detail pages landed together in one run; a description that is long enough is not looked up."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    kind, url = F.col("o_orderkey") % 4, F.concat(F.lit("https://feeds.example.com/j/"), F.col("o_orderkey").cast("string"))
    inline = F.when(kind == 3, F.concat(F.lit("<div class=d>"), F.repeat(F.lit("long "), 40), F.lit("text</div>"))).otherwise("")
    card = F.concat(F.lit('<li class="job" data-id="'), key, F.lit('"><a href="/j/'), key, F.lit('">Order '), key, F.lit("</a>"), inline, F.lit("</li>"))
    lists = o.groupBy("o_custkey").agg(F.concat(F.lit("<html><body><ul>"), F.array_join(F.array_sort(F.collect_list(card)), " "), F.lit("</ul>" + "<p>end of this list</p>" * 9 + "</body></html>")).alias("body"))
    source = F.concat(F.lit("source_"), F.col("o_custkey").cast("string")).alias("source_id")
    lists = lists.select(source, F.lit("list").alias("role"), F.lit(200).alias("status"), F.lit("https://feeds.example.com").alias("url"), "body")
    body = F.when(kind == 1, F.lit("<p>nothing here</p>")).otherwise(F.concat(F.lit('<div class="d">Detail '), key, F.lit(" &amp; more</div>")))
    details = o.where((kind != 2) | (F.col("o_orderkey") % 8 == 2)).select(
        source, F.lit("detail").alias("role"), F.when(kind == 2, 500).otherwise(200).alias("status"), url.alias("url"), body.alias("body")
    )
    rest = [F.lit(_FEED_RUN).alias("run_id"), F.lit("text/html").alias("content_type"), *[F.lit(None).cast("string").alias(n) for n in ("etag", "last_modified")], F.lit(False).alias("not_modified"), _now().alias("fetched_at")]
    result = collect_run(lists.unionByName(details).select("*", *rest), _feed_state(spark, sf, "static-html", _DETAIL_CONFIG), _now())
    jobs = result.tables["jobs"].select("source_id", "external_id", F.col("description_text").alias("description"))
    told = result.signals.where(F.col("signal").startswith("detail-")).select("source_id", F.regexp_extract("signal", r"/j/(\d+)", 1).alias("external_id"), "signal")
    return join_shuffled(jobs, told, ["source_id", "external_id"], "left")


def _event_stream(spark, sf):
    schema = struct("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_presence", _PRESENCE_SQL.replace("{absent}", ""))
def stream_presence(spark, sf):
    """Presence kept as state over four micro-batches; only islands that a batch changes are written."""
    root = _fresh(spark, "stream")
    days = F.to_date("ts")
    events = table(spark, sf, "events")
    bounds = events.agg(F.min(days).alias("low"), F.max(days).alias("high")).first()
    width = (bounds["high"] - bounds["low"]).days // 4 + 1 if bounds["low"] else 1
    for part in range(4):
        own = events.where(F.floor(F.datediff(days, F.lit(bounds["low"]).cast("date")) / width) == part)
        # One file is one micro-batch; files are taken in the order in which they were written.
        own.select("event_type", "user_id", "ts").coalesce(1).write.mode("append").parquet(f"{root}/landed")
    stream = spark.readStream.schema("event_type string, user_id bigint, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    tables = Tables(spark, f"{root}/tables", {"presence": presence.PRESENCE}, {"presence": presence.PRESENCE_KEY})
    presence.use_rocksdb(spark)
    changes = presence.presence_changes(presence.presence_input(*_sightings(stream)))
    sink = ingest.once(tables, "presence", presence.keep_presence())
    query_ = changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    query_.awaitTermination()
    return tables.read("presence")


@query("stream_replays_dropped", with_ctes({"b": _BATCH_SQL}, "SELECT DISTINCT batch_id FROM b"))
def stream_replays_dropped(spark, sf):
    root = _fresh(spark, "stream")
    batch_id = F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("_"), F.rint("value").cast("int").cast("string"))
    stream = _event_stream(spark, sf).select(batch_id.alias("batch_id"), F.col("ts").cast("timestamp").alias("at"))
    unique = ingest.drop_replays(stream, "at", "60 days")
    ingest.run_available(unique, ingest.sightings_sink(f"{root}/ids", ["batch_id"]), f"{root}/cp").awaitTermination()
    return spark.read.schema("batch_id string").parquet(f"{root}/ids").select("batch_id")


@query(
    "stream_ledger",
    with_ctes({"b": _BATCH_SQL}, f"SELECT batch_id, arg_min(run_id, event_id) AS run_id, arg_min(source_id, event_id) AS source_id, {NOW} AS received_at FROM b GROUP BY batch_id"),
)
def stream_ledger(spark, sf):
    root = _fresh(spark, "stream")
    tables = Tables(spark, f"{root}/tables", {"ingest_batches": INGEST_BATCHES})
    batch_id = F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("_"), F.rint("value").cast("int").cast("string"))
    stream = _event_stream(spark, sf).select(
        "event_id", batch_id.alias("batch_id"), F.date_format("ts", "'run_'yyyyMMdd").alias("run_id"),
        F.concat(F.lit("source_"), "event_type").alias("source_id"), F.lit(1).cast("bigint").alias("job_count"),
    )
    ingest.run_available(stream, ingest.ledger_sink(tables, "event_id", _now), f"{root}/cp").awaitTermination()
    return tables.read("ingest_batches").select("batch_id", "run_id", "source_id", "received_at")


@query(
    "late_runs",
    """SELECT event_id, CAST(ts AS DATE) <= DATE '2024-01-01' + CAST(user_id % 20 AS INTEGER) AS late FROM events""",
)
def late_runs(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("source_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("run_no")
    )
    applied = events.select("source_id").distinct().withColumn("last_run_no", F.col("source_id") % 20)
    on_time, late = ingest.split_late(events, applied)
    parts = [df.select("event_id", F.lit(flag).alias("late")) for df, flag in ((on_time, False), (late, True))]
    return parts[0].unionByName(parts[1])


@query(
    "stream_ingested_postings",
    """WITH e AS (SELECT *, user_id || '-' || event_type AS k FROM events)
SELECT k AS external_id, 'https://s.example.com/' || k AS canonical_url, 'Event ' || max(event_id) AS title FROM e GROUP BY k""",
)
def stream_ingested_postings(spark, sf):
    """Board bodies arriving as a stream: parsed, deduplicated and kept as the newest posting per id."""
    root = _fresh(spark, "stream")
    key = F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type")
    body = F.concat(
        F.lit('{"jobs":[{"id":"'), key, F.lit('","title":"Event '), F.col("event_id").cast("string"),
        F.lit('","jobUrl":"https://s.example.com/'), key, F.lit('"}]}'),
    )
    stream = _event_stream(spark, sf).select(
        F.lit("feed").alias("source_id"), F.col("event_id").cast("string").alias("run_id"), body.alias("body"),
        F.lit("https://s.example.com").alias("source_url"), F.lit("Co").alias("company_name"),
    )

    def sink(batch, number):
        raw = parse_board_c(batch).withColumn("arrival", F.col("run_id").cast("bigint"))
        newest = history.dedupe_last(raw.select("external_id", "canonical_url", "title", "arrival"), ["external_id"], "arrival")
        newest.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    ingest.run_available(stream, sink, f"{root}/cp").awaitTermination()
    stored = spark.read.schema("external_id string, canonical_url string, title string, arrival bigint").parquet(f"{root}/out")
    return history.dedupe_last(stored, ["external_id"], "arrival").select("external_id", "canonical_url", "title")
