"""Filters, search, paging, detail, joins and overview reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import values
from postlens.operators import filters, history, paging, sources as source_state, state
from postlens.operators.filters import JobFilter
from postlens.plans import reports, views

from . import standins as st
from .base import epoch, query, table, with_ctes
from .standins import NOW, ctes

_KEYS = ["id", "score", "first_seen_at"]


def _listed(spark, sf):
    versions = history.build_versions(st.observations(spark, sf))
    return views.listing(st.jobs(spark, sf), st.actions(spark, sf), versions)


_LISTED = {
    **ctes("jobs", "actions", "observations", "versions"),
    "version_counts": "SELECT job_id, count(*) AS version_count FROM versions GROUP BY job_id",
    "listed": """
SELECT j.*, a.action, a.dismiss_reason, a.notes, a.applied_at, a.updated_at AS action_updated_at,
  coalesce(v.version_count, 0) AS version_count
FROM jobs j LEFT JOIN actions a ON a.job_id = j.id LEFT JOIN version_counts v ON v.job_id = j.id""",
}
_ROWS = "SELECT id, score, first_seen_at FROM listed WHERE "
_ORDER = " ORDER BY score DESC, first_seen_at DESC, id DESC"


def _filtered(name: str, chosen: JobFilter, where: str) -> None:
    @query(name, with_ctes(_LISTED, _ROWS + where))
    def run(spark, sf):
        return filters.filter_jobs(_listed(spark, sf), chosen).select(*_KEYS)


_LIST_OUT = (
    "id", "source_id", "company_id", "canonical_url", "title", "company_name", "location_text", "remote_scope",
    "eligible_from_korea", "async_level", "salary_min", "first_seen_at", "last_seen_at", "status", "score",
    "content_hash", "action", "dismiss_reason", "applied_at", "action_updated_at", "version_count",
)


@query("posting_list_columns", with_ctes(_LISTED, f"SELECT {', '.join(_LIST_OUT)} FROM listed"))
def list_columns(spark, sf):
    return views.list_view(_listed(spark, sf)).select(*_LIST_OUT)


_filtered("filter_default_open", JobFilter(), "status = 'open'")
_filtered("filter_all_statuses", JobFilter(status="all"), "true")
_filtered("filter_min_score", JobFilter(min_score="72.9"), "status = 'open' AND score >= 72")
_filtered(
    "filter_in_lists",
    JobFilter(status="all", eligibility="yes, likely", async_level="explicit,strong", remote_scope="apac,,worldwide"),
    "eligible_from_korea IN ('yes', 'likely') AND async_level IN ('explicit', 'strong') AND remote_scope IN ('apac', 'worldwide')",
)
_filtered("filter_company", JobFilter(status="closed", company_id="company_7"), "status = 'closed' AND company_id = 'company_7'")
_filtered("filter_no_action", JobFilter(action="none"), "status = 'open' AND action IS NULL")
_filtered("filter_action", JobFilter(action="applied"), "status = 'open' AND action = 'applied'")
_filtered(
    "filter_skills",
    JobFilter(status="all", skills=("MACHINE", "urgent")),
    "(contains(lower(skills_text), 'machine') OR contains(lower(skills_text), 'urgent'))",
)
_filtered("filter_changed", JobFilter(changed=True), "status = 'open' AND version_count > 1")
_VIEW_SQL = {
    "new": "action IS NULL",
    "top": "score >= 85 AND eligible_from_korea IN ('yes', 'likely')",
    "worldwide": "remote_scope = 'worldwide' AND async_level IN ('explicit', 'strong') AND eligible_from_korea = 'yes'",
    "apac": "remote_scope = 'apac' AND eligible_from_korea IN ('yes', 'likely')",
    "graphics": " OR ".join(f"contains(lower(skills_text), '{s}')" for s in ("three.js", "webgl", "webgpu", "glsl", "visualization")),
    "changed": "version_count > 1",
    "saved": "action = 'saved'",
    "applied": "action = 'applied'",
}


@query(
    "saved_view_counts",
    with_ctes(
        _LISTED,
        " UNION ALL ".join(
            f"SELECT '{n}' AS view, count(*) AS postings FROM listed WHERE status = 'open' AND ({w})" for n, w in _VIEW_SQL.items()
        ),
    ),
)
def saved_view_counts(spark, sf):
    listed = _listed(spark, sf)
    counts = []
    for name, chosen in filters.VIEWS.items():
        tests = filters.conditions(chosen)
        hit = tests[0]
        for test in tests[1:]:
            hit = hit & test
        counts.append(F.count_if(hit).alias(name))
    names = list(filters.VIEWS)
    stacked = ", ".join(f"'{n}', `{n}`" for n in names)
    return listed.agg(*counts).selectExpr(f"stack({len(names)}, {stacked}) AS (view, postings)")


_CURSOR = paging.Cursor(90, 900_000_000, "job_5")
_AFTER = "(score < 90 OR (score = 90 AND first_seen_at < 900000000) OR (score = 90 AND first_seen_at = 900000000 AND id < 'job_5'))"


@query("keyset_after_cursor", with_ctes(_LISTED, _ROWS + _AFTER))
def keyset_after_cursor(spark, sf):
    return paging.after_cursor(_listed(spark, sf), paging.encode_cursor(_CURSOR)).select(*_KEYS)


@query("posting_page", with_ctes(_LISTED, _ROWS + f"status = 'open' AND score >= 50 AND {_AFTER}{_ORDER} LIMIT 51"))
def posting_page(spark, sf):
    chosen = JobFilter(min_score=50)
    return paging.page_frame(_listed(spark, sf), chosen, cursor=_CURSOR).select(*_KEYS)


_PAGE_OUT = ("id", "title", "score", "first_seen_at", "action", "version_count")


def _list_page(name: str, chosen: JobFilter, where: str) -> None:
    @query(name, with_ctes(_LISTED, f"SELECT {', '.join(_PAGE_OUT)} FROM listed WHERE {where}{_ORDER} LIMIT 31"))
    def run(spark, sf):
        versions = history.build_versions(st.observations(spark, sf))
        return views.list_page(st.jobs(spark, sf), st.actions(spark, sf), versions, chosen, 30).select(*_PAGE_OUT)


_list_page("posting_list_page", JobFilter(min_score=20), "status = 'open' AND score >= 20")
_list_page("posting_list_page_saved", JobFilter(action="saved", changed=True), "status = 'open' AND action = 'saved' AND version_count > 1")


@query(
    "posting_page_orders",
    """SELECT o_orderkey AS id, o_totalprice AS score, o_orderdate AS first_seen_at, count(l_orderkey) AS version_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
ORDER BY score DESC, first_seen_at DESC, id DESC LIMIT 51""",
)
def posting_page_orders(spark, sf):
    """The flagship: a page of the best orders with their line counts."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("first_seen_at")
    )
    best = paging.ordered(orders).limit(paging.DEFAULT_LIMIT + 1)
    counts = table(spark, sf, "lineitem").join(best.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
    counts = counts.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("version_count"))
    rows = best.join(counts, "id", "left").withColumn("version_count", F.coalesce("version_count", F.lit(0).cast("bigint")))
    return paging.ordered(rows)


_FOLD = "' ' || trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9ßœæø]+', ' ', 'g')) || ' '"


@query(
    "fulltext_documents",
    "WITH f AS (SELECT doc_id, " + _FOLD.format(c="text") + " AS folded FROM documents) "
    "SELECT doc_id FROM f WHERE contains(folded, ' de ') AND contains(folded, ' la ')",
)
def fulltext_documents(spark, sf):
    return filters.search(table(spark, sf, "documents"), "\"de la\"", ["text"]).select("doc_id")


@query(
    "fulltext_phrase",
    "WITH f AS (SELECT doc_id, " + _FOLD.format(c="text") + " AS folded FROM documents) "
    "SELECT doc_id FROM f WHERE contains(folded, ' of the ')",
)
def fulltext_phrase(spark, sf):
    """A token with punctuation is a phrase of consecutive words."""
    return filters.search(table(spark, sf, "documents"), "of-the", ["text"]).select("doc_id")


@query(
    "fulltext_postings",
    with_ctes(
        ctes("jobs"),
        "SELECT id FROM jobs WHERE status = 'open' AND "
        "(contains(' ' || lower(title) || ' ', ' machinery ') OR contains(' ' || regexp_replace(lower(search_text), '[^a-z0-9]+', ' ', 'g') || ' ', ' machinery ')"
        " OR contains(' ' || lower(skills_text) || ' ', ' machinery ')) AND contains(' ' || replace(lower(company_name), '_', ' ') || ' ', ' nation ')",
    ),
)
def fulltext_postings(spark, sf):
    jobs = st.jobs(spark, sf).withColumn("skills_text", F.array_join("skills", " "))
    return filters.filter_jobs(jobs, JobFilter(q="Machinery NATION")).select("id")


@query(
    "posting_detail",
    with_ctes(
        {**_LISTED, **ctes("companies", "sources")},
        """SELECT l.id, l.description_text, l.action, l.version_count, c.careers_url, c.remote_policy_url,
  s.kind AS source_kind, s.url AS source_url, s.status AS source_status
FROM listed l JOIN companies c ON c.id = l.company_id JOIN sources s ON s.id = l.source_id""",
    ),
)
def posting_detail(spark, sf):
    versions = history.build_versions(st.observations(spark, sf))
    rows = views.job_detail(st.jobs(spark, sf), st.actions(spark, sf), versions, st.companies(spark, sf), st.sources(spark, sf))
    return rows.select(
        "id", "description_text", "action", "version_count", "careers_url", "remote_policy_url", "source_kind",
        "source_url", "source_status",
    )


@query(
    "newest_versions_of_one",
    with_ctes(
        ctes("observations", "versions"),
        "SELECT content_hash, snapshot_json, observed_at FROM versions WHERE job_id = 'job_77' ORDER BY observed_at DESC LIMIT 20",
    ),
)
def newest_versions_of_one(spark, sf):
    return views.job_versions(history.build_versions(st.observations(spark, sf)), "job_77", newest=20)


@query(
    "company_rollup",
    with_ctes(
        ctes("companies", "sources", "jobs"),
        """SELECT c.id, c.name, c.priority, count(DISTINCT s.id) AS source_count,
  (SELECT count(*) FROM jobs j WHERE j.company_id = c.id AND j.status = 'open') AS open_job_count
FROM companies c LEFT JOIN sources s ON s.company_id = c.id GROUP BY c.id, c.name, c.priority""",
    ),
)
def company_rollup(spark, sf):
    rows = views.company_list(st.companies(spark, sf), st.sources(spark, sf), st.jobs(spark, sf))
    return rows.select("id", "name", "priority", "source_count", "open_job_count")


_LATEST = """
SELECT source_id, arg_max(http_status, (started_at, id)) AS last_http_status,
  max(struct_pack(s := started_at, i := id, e := error_code)).e AS last_error_code,
  max(struct_pack(s := started_at, i := id, e := error_message)).e AS last_error_message
FROM source_runs GROUP BY source_id"""


@query("latest_source_runs", with_ctes(ctes("source_runs"), _LATEST))
def latest_source_runs(spark, sf):
    return views.latest_runs(st.source_runs(spark, sf))


@query(
    "source_overview",
    with_ctes(
        {**ctes("companies", "sources", "source_runs"), "latest": _LATEST},
        """SELECT s.id, s.kind, s.status, c.name AS company_name, c.active AS company_active, l.last_http_status,
  l.last_error_code, l.last_error_message
FROM sources s JOIN companies c ON c.id = s.company_id LEFT JOIN latest l ON l.source_id = s.id""",
    ),
)
def source_overview(spark, sf):
    rows = views.source_list(st.sources(spark, sf), st.companies(spark, sf), st.source_runs(spark, sf))
    return rows.select(
        "id", "kind", "status", "company_name", "company_active", "last_http_status", "last_error_code", "last_error_message"
    )


@query(
    "dashboard_postings",
    with_ctes(
        ctes("jobs", "actions"),
        """SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open,
  count(*) FILTER (status = 'open' AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.job_id = jobs.id)) AS new,
  count(*) FILTER (status = 'open' AND score >= 85) AS top_matches,
  count(*) FILTER (status = 'open' AND eligible_from_korea IN ('yes', 'likely')) AS korea_eligible,
  count(*) FILTER (status = 'open' AND async_level IN ('explicit', 'strong')) AS async_friendly
FROM jobs""",
    ),
)
def dashboard_postings(spark, sf):
    return reports.dashboard_jobs(st.jobs(spark, sf), st.actions(spark, sf))


@query(
    "dashboard_actions",
    with_ctes(
        ctes("actions"),
        "SELECT count(*) FILTER (action = 'saved') AS saved, count(*) FILTER (action = 'dismissed') AS dismissed, "
        "count(*) FILTER (action = 'applied') AS applied FROM actions",
    ),
)
def dashboard_actions(spark, sf):
    return reports.dashboard_actions(st.actions(spark, sf))


@query(
    "dashboard_sources",
    with_ctes(
        ctes("companies", "sources"),
        f"""SELECT count(*) AS total, count(*) FILTER (s.status = 'active' AND c.active) AS active,
  count(*) FILTER (s.status = 'quarantined') AS quarantined,
  count(*) FILTER (s.status = 'active' AND c.active AND s.next_due_at < {NOW}) AS overdue
FROM sources s JOIN companies c ON c.id = s.company_id""",
    ),
)
def dashboard_sources(spark, sf):
    return reports.dashboard_sources(st.sources(spark, sf), st.companies(spark, sf), F.lit(NOW))


@query(
    "company_totals",
    with_ctes(
        ctes("companies", "sources", "jobs"),
        """SELECT (SELECT count(*) FROM companies) AS total, (SELECT count(*) FROM companies WHERE active) AS active,
  (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM jobs WHERE status = 'open') AS jobs""",
    ),
)
def company_totals(spark, sf):
    return reports.company_totals(views.company_rollup(st.companies(spark, sf), st.sources(spark, sf), st.jobs(spark, sf)))


@query(
    "source_totals",
    with_ctes(
        ctes("companies", "sources"),
        """SELECT count(*) AS total, count(*) FILTER (s.status = 'active' AND c.active) AS active,
  count(*) FILTER (s.browser_required) AS browser, count(*) FILTER (s.status = 'quarantined') AS quarantined
FROM sources s JOIN companies c ON c.id = s.company_id""",
    ),
)
def source_totals(spark, sf):
    return reports.source_totals(views.source_list(st.sources(spark, sf), st.companies(spark, sf), st.source_runs(spark, sf)))


@query(
    "recent_runs",
    with_ctes(
        ctes("source_runs", "crawl_runs"),
        """SELECT id, runner_type, status, planned_source_count, completed_source_count, failed_source_count, started_at, completed_at
FROM crawl_runs ORDER BY started_at DESC, id DESC LIMIT 5""",
    ),
)
def recent_runs(spark, sf):
    return views.recent_runs(st.crawl_runs(spark, sf))


def _due_sql(browser: str) -> str:
    return with_ctes(
        {
            **ctes("companies", "sources"),
            "due": f"""SELECT * FROM sources WHERE status = 'active' AND next_due_at <= {NOW} AND (lease_until IS NULL OR lease_until < {NOW})
  AND browser_required = {browser} AND company_id IN (SELECT id FROM companies WHERE active) ORDER BY next_due_at, id LIMIT 150""",
        },
        """SELECT d.id, c.name AS company_name, c.priority, d.kind, d.next_due_at,
  CASE WHEN d.snapshot_run_id IS NOT NULL AND d.content_fingerprint IS NOT NULL THEN d.etag END AS etag, d.content_fingerprint
FROM due d JOIN companies c ON c.id = d.company_id""",
    )


def _due(spark, sf, runner):
    rows = source_state.due_sources(st.sources(spark, sf), st.companies(spark, sf), F.lit(NOW), runner, 150)
    return rows.select("id", "company_name", "priority", "kind", "next_due_at", "etag", "content_fingerprint")


@query("due_sources_fast", _due_sql("false"))
def due_sources_fast(spark, sf):
    return _due(spark, sf, "fast")


@query("due_sources_browser", _due_sql("true"))
def due_sources_browser(spark, sf):
    return _due(spark, sf, "browser")


@query(
    "duplicate_postings",
    with_ctes(
        ctes("jobs"),
        "SELECT dedupe_key, count(*) AS postings, min(id) AS first_id, max(score) AS top_score FROM jobs GROUP BY dedupe_key HAVING count(*) > 1",
    ),
)
def duplicate_postings(spark, sf):
    return state.duplicate_groups(st.jobs(spark, sf))


@query(
    "export_actions",
    with_ctes(
        ctes("jobs", "actions"),
        "SELECT a.*, j.title, j.company_name, j.canonical_url FROM actions a JOIN jobs j ON j.id = a.job_id",
    ),
)
def export_actions(spark, sf):
    parts = reports.export_user_data(st.companies(spark, sf), st.sources(spark, sf), st.actions(spark, sf), st.jobs(spark, sf))
    return parts["job_actions"]


@query("export_companies", with_ctes(ctes("companies"), "SELECT * FROM companies"))
def export_companies(spark, sf):
    return reports.export_user_data(st.companies(spark, sf), st.sources(spark, sf), st.actions(spark, sf), st.jobs(spark, sf))["companies"]


@query("export_sources", with_ctes(ctes("sources"), "SELECT id, company_id, kind, url, status, previous_job_count FROM sources"))
def export_sources(spark, sf):
    parts = reports.export_user_data(st.companies(spark, sf), st.sources(spark, sf), st.actions(spark, sf), st.jobs(spark, sf))
    return parts["sources"].select("id", "company_id", "kind", "url", "status", "previous_job_count")


@query(
    "run_summaries",
    """WITH o AS (SELECT 'run_' || strftime(ts, '%Y%m%d') AS run_id, event_type <> 'error' AS ok FROM events)
SELECT run_id, count(*) AS planned, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed,
  CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'completed' WHEN count(*) FILTER (ok) = 0 THEN 'failed' ELSE 'partial' END AS status
FROM o GROUP BY run_id""",
)
def run_summaries(spark, sf):
    events = table(spark, sf, "events").select(
        F.date_format("ts", "'run_'yyyyMMdd").alias("run_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("healthy").alias("status"),
    )
    return reports.run_summary(events)


@query(
    "display_values",
    with_ctes(
        ctes("jobs"),
        """SELECT id, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'mixed' ELSE 'low' END AS band,
  'USD ' || format('{:,}', CAST(round(salary_min) AS BIGINT)) AS salary,
  CASE eligible_from_korea WHEN 'yes' THEN '한국 지원 가능' WHEN 'likely' THEN '한국 지원 유력' WHEN 'unknown' THEN '지원 지역 불명' ELSE '한국 지원 어려움' END AS eligibility,
  CASE async_level WHEN 'explicit' THEN 'Async 명시' WHEN 'strong' THEN 'Async 강함' WHEN 'weak' THEN 'Async 신호' WHEN 'synchronous' THEN '동기식 위험' ELSE 'Async 불명' END AS async,
  CASE remote_scope WHEN 'worldwide' THEN 'Worldwide' WHEN 'apac' THEN 'APAC' WHEN 'country-list' THEN '국가 목록' WHEN 'region-limited' THEN '지역 제한' ELSE '범위 불명' END AS scope
FROM jobs""",
    ),
)
def display_values(spark, sf):
    c = F.col
    return st.jobs(spark, sf).select(
        "id",
        values.score_band(c("score")).alias("band"),
        values.salary_text(c("salary_currency"), c("salary_min"), c("salary_max"), c("salary_interval")).alias("salary"),
        values.eligibility_label(c("eligible_from_korea")).alias("eligibility"),
        values.async_label(c("async_level")).alias("async"),
        values.scope_label(c("remote_scope")).alias("scope"),
    )


@query(
    "relative_times",
    f"""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(floor(epoch(ts)) AS BIGINT) - 1705276800 AS d FROM events)
SELECT event_id, CASE WHEN abs(d) < 60 THEN 'second' WHEN abs(d) < 3600 THEN 'minute' WHEN abs(d) < 86400 THEN 'hour' WHEN abs(d) < 2592000 THEN 'day' ELSE 'date' END AS unit,
  CAST(CASE WHEN abs(d) < 60 THEN d WHEN abs(d) < 3600 THEN floor(d / 60.0 + 0.5) WHEN abs(d) < 86400 THEN floor(d / 3600.0 + 0.5)
    WHEN abs(d) < 2592000 THEN floor(d / 86400.0 + 0.5) END AS BIGINT) AS value
FROM e""",
)
def relative_times(spark, sf):
    rows = table(spark, sf, "events").withColumn("r", values.relative_time(epoch("ts"), F.lit(1_705_276_800)))
    return rows.select("event_id", F.col("r")["unit"].alias("unit"), F.col("r")["value"].alias("value"))


@query(
    "source_health",
    with_ctes(
        ctes("sources"),
        f"""SELECT id, CASE WHEN status = 'active' AND consecutive_failures <> 0 THEN '경고' ELSE
    CASE status WHEN 'active' THEN '정상' WHEN 'paused' THEN '일시정지' WHEN 'quarantined' THEN '격리' ELSE '비활성' END END AS label,
  CASE WHEN status = 'active' AND consecutive_failures <> 0 THEN 'source-warning' ELSE 'source-' || status END AS css,
  {NOW} - next_due_at > 43200 AS stale, {NOW} + crawl_interval_minutes * 60 AS due, {NOW} + greatest(crawl_interval_minutes, 720) * 60 AS retry
FROM sources""",
    ),
)
def source_health(spark, sf):
    c, now = F.col, F.lit(NOW).cast("bigint")
    return st.sources(spark, sf).select(
        "id",
        values.health_label(c("status"), c("consecutive_failures")).alias("label"),
        values.health_class(c("status"), c("consecutive_failures")).alias("css"),
        values.is_stale(c("next_due_at"), now).alias("stale"),
        values.next_due(now, c("crawl_interval_minutes")).alias("due"),
        values.retry_at(now, c("crawl_interval_minutes")).alias("retry"),
    )
