"""State transitions, decisions, paging and retention on small frames."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from postlens import schemas as S
from postlens.operators import filters, health, history, paging, retention, sources as source_state, state, validate
from postlens.operators.filters import JobFilter

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
HASH = "a" * 64


def now():
    return F.lit(1_000_000).cast("bigint")


def source(**changes):
    base = dict(
        id="s1", company_id="c1", kind="greenhouse", url="https://x", adapter_key="k", config_json="{}", browser_required=False,
        crawl_interval_minutes=360, etag="e", last_modified="m", content_fingerprint=HASH, snapshot_run_id="r0", previous_job_count=20,
        consecutive_failures=1, next_due_at=5, lease_owner="r1", lease_until=9, status="active", created_at=0, updated_at=0,
    )
    return base | changes


def observation(**changes):
    base = dict(
        run_id="r1", source_id="s1", status="healthy", http_status=200, fetched_job_count=20, previous_job_count=20,
        received_batch_count=1, expected_batch_count=1, etag=None, signals=[],
    )
    return base | changes


def judge(make, obs, stored=1, sources=None):
    counts = make("run_id string, source_id string, stored_batches bigint", dict(run_id="r1", source_id="s1", stored_batches=stored))
    rows = health.classify_completion(make(S.SOURCE_OBS, obs), counts)
    return health.check_snapshots(rows, make(S.SOURCES, sources or source()))


DECISIONS = [
    (dict(), 1, "complete", None),
    (dict(status="failed", http_status=429), 0, "retry", "http-429"),
    (dict(status="failed", http_status=503), 0, "retry", "http-503"),
    (dict(status="failed", http_status=None, error_code="crawler-error", error_message="The operation was aborted"), 0, "retry", "crawler-error"),
    (dict(status="failed", http_status=None, error_message="getaddrinfo ENOTFOUND"), 0, "retry", "crawler-reported-failure"),
    (dict(signals=["ok", "captcha-page"]), 1, "quarantine", "captcha-page"),
    (dict(signals=["required-selector-not-found"]), 1, "quarantine", "required-selector-not-found"),
    (dict(status="failed", http_status=None, error_message="Greenhouse response omitted jobs[]"), 0, "quarantine", "schema-invalid"),
    (dict(status="failed", http_status=None, error_message="Blocked private IP: 10.0.0.1"), 0, "quarantine", "unsafe-source-url"),
    (dict(status="failed", http_status=None, error_message="Too many redirects"), 0, "quarantine", "source-configuration-invalid"),
    (dict(fetched_job_count=0), 1, "quarantine", "unexpected-zero-jobs"),
    (dict(fetched_job_count=4), 1, "quarantine", "job-count-dropped-80-percent"),
    (dict(fetched_job_count=5), 1, "complete", None),
    (dict(status="failed", http_status=403), 0, "quarantine", "http-403"),
    (dict(received_batch_count=0), 0, "retry", "batch-count-mismatch"),
    (dict(status="not_modified", received_batch_count=1), 0, "retry", "not-modified-batch-count-mismatch"),
    (dict(status="quarantined", signals=["odd"]), 0, "quarantine", "odd"),
    (dict(status="quarantined"), 0, "quarantine", "crawler-reported-quarantine"),
]


@pytest.mark.parametrize("changes, stored, kind, reason", DECISIONS)
def test_completion_decisions(make, changes, stored, kind, reason):
    assert tuple(judge(make, observation(**changes), stored).first()["disposition"]) == (kind, reason)


def test_unchanged_report_must_match_the_stored_snapshot(make):
    unchanged = dict(status="not_modified", received_batch_count=0, expected_batch_count=0, content_fingerprint=HASH)
    assert tuple(judge(make, observation(**unchanged), 0).first()["disposition"]) == ("complete", None)
    other = judge(make, observation(**unchanged | {"content_fingerprint": "b" * 64}), 0)
    assert tuple(other.first()["disposition"]) == ("retry", "not-modified-snapshot-mismatch")
    moved = source_state.advance_sources(make(S.SOURCES, source()), other, now()).first()
    assert (moved.content_fingerprint, moved.snapshot_run_id, moved.etag, moved.status) == (None, None, None, "active")


def test_source_transitions(make):
    healthy = judge(make, observation(etag="e2", content_fingerprint="b" * 64))
    row = source_state.advance_sources(make(S.SOURCES, source()), healthy, now()).first()
    assert (row.snapshot_run_id, row.content_fingerprint, row.etag, row.consecutive_failures) == ("r1", "b" * 64, "e2", 0)
    assert (row.next_due_at, row.lease_owner) == (1_000_000 + 360 * 60, None)
    failed = judge(make, observation(status="failed", http_status=503), 0)
    row = source_state.advance_sources(make(S.SOURCES, source()), failed, now()).first()
    assert (row.status, row.next_due_at, row.content_fingerprint, row.consecutive_failures) == ("active", 1_000_000 + 720 * 60, HASH, 2)
    partial = judge(make, observation(status="failed", http_status=503, expected_batch_count=2), 1)
    row = source_state.advance_sources(make(S.SOURCES, source()), partial, now()).first()
    assert (row.content_fingerprint, row.snapshot_run_id, row.etag) == (None, None, None)
    runs = source_state.record_source_runs(make(S.SOURCE_RUNS), partial, now()).first()
    assert (runs.id, runs.status, runs.error_code) == ("r1:s1", "failed", "http-503")


def job(key, **changes):
    base = dict(
        id=f"job_{key}", source_id="s1", company_id="c1", external_id=key, dedupe_key="d", canonical_url="https://j", title="T", company_name="C",
        description_text="D", search_text="T C D", skills=["WebGL"], workplace_type="remote", remote_scope="worldwide", eligible_from_korea="yes",
        async_level="strong", first_seen_at=10, last_seen_at=10, last_seen_run_id="r0", missing_count=0, status="open", score=50, confidence=0.5,
        evidence=[], content_hash=HASH, created_at=1, updated_at=1,
    )
    return base | changes


def test_second_absence_closes(make):
    jobs = make(S.JOBS, job("present"), job("missing", last_seen_run_id="old", missing_count=1), job("first", last_seen_run_id=None))
    unchanged = observation(status="not_modified", received_batch_count=0, expected_batch_count=0, content_fingerprint=HASH)
    aged = state.age_missing(jobs, judge(make, unchanged, 0), now())
    rows = {r.external_id: (r.status, r.missing_count, r.closed_at) for r in aged.collect()}
    assert rows == {"present": ("open", 0, None), "missing": ("closed", 2, 1_000_000), "first": ("open", 1, None)}
    kept = source_state.advance_sources(make(S.SOURCES, source()), judge(make, unchanged, 0), now()).first()
    assert (kept.content_fingerprint, kept.snapshot_run_id) == (HASH, "r0")
    failed = judge(make, observation(status="failed", http_status=503), 0)
    assert state.age_missing(jobs, failed, now()).filter("missing_count > 1").count() == 0


def test_upsert_keeps_identity_and_is_idempotent(make):
    jobs = make(S.JOBS, job("a", status="closed", closed_at=9, missing_count=2), job("b"))
    delta = make(S.JOBS, job("a", title="New", company_id="c2"), job("z")).withColumns({"run_id": F.lit("r2"), "fetched_at": F.lit(77)})
    incoming = state.incoming_jobs(delta, now())
    once = state.upsert_jobs(jobs, incoming)
    a = once.filter("external_id = 'a'").first()
    assert (a.id, a.title, a.company_id, a.status, a.missing_count, a.closed_at) == ("job_a", "New", "c2", "open", 0, None)
    assert (a.first_seen_at, a.created_at, a.last_seen_at, a.last_seen_run_id) == (10, 1, 77, "r2")
    assert once.count() == 3
    assert sorted(map(str, state.upsert_jobs(once, incoming).collect())) == sorted(map(str, once.collect()))


def test_returning_content_adds_no_version(make):
    seen = make(S.JOB_VERSIONS, *[dict(job_id="j", content_hash=h, snapshot_json=h, observed_at=t) for t, h in enumerate("ABA")])
    stored = state.append_versions(make(S.JOB_VERSIONS), seen)
    assert sorted((r.content_hash, r.observed_at) for r in stored.collect()) == [("A", 0), ("B", 1)]
    assert state.append_versions(stored, seen).count() == 2


def test_actions(make):
    jobs = make(S.JOBS, job("a"), job("b"))
    changes = make(
        S.JOB_ACTIONS, dict(job_id="job_a", action="applied"), dict(job_id="job_b", action="saved", applied_at=3), dict(job_id="gone", action="saved")
    )
    rows = {r.job_id: (r.action, r.applied_at) for r in state.set_actions(make(S.JOB_ACTIONS, dict(job_id="job_a", action="saved")), changes, jobs, now()).collect()}
    assert rows == {"job_a": ("applied", 1_000_000), "job_b": ("saved", None)}


def test_batches_are_admitted_once(make):
    ledger = make(S.INGEST_BATCHES, dict(batch_id="old", run_id="r1", source_id="s1", job_count=1, received_at=0))
    ddl = "batch_id string, run_id string, source_id string, at int"
    rows = [("old", "r1", "s1"), ("old", "r2", "s1"), ("new", "r1", "s1"), ("new", "r1", "s1"), ("new", "r1", "s2")]
    incoming = make(ddl, *[dict(batch_id=b, run_id=r, source_id=s, at=i) for i, (b, r, s) in enumerate(rows)])
    labels = [r.admission for r in state.admit_batches(ledger, incoming, "at").orderBy("at").collect()]
    assert labels == ["duplicate", "collision", "new", "duplicate", "collision"]


def test_run_finalization(make):
    runs = make(S.CRAWL_RUNS, dict(id="r1", runner_type="fast", trigger_type="m", planned_source_count=2, completed_source_count=1, failed_source_count=0, started_at=0, status="running"))
    source_runs = make(S.SOURCE_RUNS, dict(id="r1:s1", run_id="r1", source_id="s1", status="running", started_at=0), dict(id="r1:s2", run_id="r1", source_id="s2", status="healthy", started_at=0, completed_at=1))
    ddl = "run_id string, status string, completed_source_count bigint, failed_source_count bigint"
    report = make(ddl, dict(run_id="r1", status="partial", completed_source_count=1, failed_source_count=1))
    new_runs, new_source_runs, new_sources, judged = source_state.finalize_runs(runs, source_runs, make(S.SOURCES, source()), report, now())
    assert (judged.first().verdict, judged.first().dangling) == ("applied", 1)
    assert new_runs.first().status == "partial"
    assert new_source_runs.filter("id = 'r1:s1'").first().error_code == "run-finalized-without-source-complete"
    reset = new_sources.first()
    assert (reset.etag, reset.content_fingerprint, reset.lease_owner, reset.next_due_at) == (None, None, None, 1_000_000 + 720 * 60)
    again = source_state.judge_reports(new_runs, new_source_runs, report).first()
    assert (again.verdict, again.dangling) == ("already-completed", 0)
    other = make(ddl, dict(run_id="r1", status="failed", completed_source_count=0, failed_source_count=2), dict(run_id="no", status="failed", completed_source_count=0, failed_source_count=0))
    assert {r.run_id: r.verdict for r in source_state.judge_reports(new_runs, new_source_runs, other).collect()} == {"r1": "RUN_ALREADY_FINALIZED", "no": "RUN_NOT_FOUND"}


EDITS = "id string, provided array<string>, company_id string, kind string, url string, adapter_key string, config_json string, crawl_interval_minutes int, active boolean"


def test_source_edits(make):
    def edit(**values):
        row = dict(id="s1", provided=list(values)) | values
        return source_state.apply_source_edits(make(S.SOURCES, source(config_json='{"listSelector":"a","headers":{"b":"1","a":"2"}}')), make(EDITS, row), now()).first()

    moved = edit(url="https://new")
    assert (moved.url, moved.etag, moved.snapshot_run_id, moved.previous_job_count, moved.next_due_at, moved.lease_owner) == ("https://new", None, None, 0, 1_000_000, None)
    slower = edit(crawl_interval_minutes=1440)
    assert (slower.crawl_interval_minutes, slower.etag, slower.next_due_at, slower.lease_owner) == (1440, "e", 5, "r1")
    paused = edit(active=False)
    assert (paused.status, paused.etag, paused.lease_owner, paused.next_due_at) == ("paused", "e", None, 5)
    same = edit(config_json='{"headers":{"a":"2","b":"1"},"listSelector":"a"}')
    assert (same.etag, same.lease_owner) == ("e", "r1")
    browser = edit(kind="playwright")
    assert (browser.browser_required, browser.etag) == (True, None)


def test_stale_claims_and_backfill(make):
    rows = make(S.SOURCES, source(id="late", lease_until=1), source(id="fresh", lease_until=2_000_000), source(id="open", lease_owner=None, lease_until=None))
    etags = {r.id: r.etag for r in source_state.invalidate_stale(rows, now()).collect()}
    assert etags == {"late": None, "fresh": "e", "open": "e"}
    old = make(S.SOURCES, source(id="a"), source(id="b", crawl_interval_minutes=180, kind="playwright"))
    done = {r.id: (r.crawl_interval_minutes, r.browser_required) for r in source_state.migrate_sources(old).collect()}
    assert done == {"a": (720, False), "b": (180, True)}


def test_company_edits(make):
    company = dict(id="c1", slug="one", name="One", careers_url="https://c", priority=50, active=True, created_at=0, updated_at=0)
    ddl = "id string, provided array<string>, slug string, name string, careers_url string, remote_policy_url string, priority int, active boolean"
    edited = source_state.apply_company_edits(make(S.COMPANIES, company), make(ddl, dict(id="c1", provided=["careers_url", "active"], active=False)), now()).first()
    assert (edited.careers_url, edited.active, edited.name, edited.priority) == (None, False, "One", 50)
    inputs = make("id string, slug string, name string", dict(id="c2", slug="one", name="X"), dict(id="c3", slug="two", name="Y"), dict(id="c4", slug="two", name="Z"))
    table, refused = source_state.create_companies(make(S.COMPANIES, company), inputs, now())
    assert sorted(r.id for r in table.collect()) == ["c1", "c3"] and sorted(r.id for r in refused.collect()) == ["c2", "c4"]


def test_retention_is_idempotent_and_cascades(make):
    at = 1_000_000_000
    day = 86_400
    tables = {
        "jobs": make(S.JOBS, job("old", status="closed", closed_at=at - 181 * day), job("acted", status="closed", closed_at=at - 181 * day), job("young", status="closed", closed_at=at - 179 * day)),
        "job_actions": make(S.JOB_ACTIONS, dict(job_id="job_acted", action="saved")),
        "job_versions": make(S.JOB_VERSIONS, *[dict(job_id=j, content_hash=str(i), snapshot_json="", observed_at=i) for j in ("job_old", "job_young") for i in range(5)]),
        "source_runs": make(S.SOURCE_RUNS, dict(id="a", run_id="r", source_id="s", started_at=at), dict(id="b", run_id="r", source_id="s2", started_at=at - 31 * day)),
        "crawl_runs": make(S.CRAWL_RUNS, dict(id="r", started_at=at), dict(id="q", started_at=at - 91 * day)),
        "ingest_batches": make(S.INGEST_BATCHES, dict(batch_id="x", received_at=at - 31 * day), dict(batch_id="y", received_at=at)),
    }
    moment = F.lit(at).cast("bigint")
    report = {r["table"]: r["removed"] for r in retention.retention_report(tables, moment).collect()}
    assert report == {"ingest_batches": 1, "source_runs": 1, "crawl_runs": 1, "job_versions": 4, "jobs": 1}
    once = retention.apply_retention(tables, moment)
    assert sorted(r.external_id for r in once["jobs"].collect()) == ["acted", "young"]
    assert sorted((r.job_id, r.content_hash) for r in once["job_versions"].collect()) == [("job_young", h) for h in "234"]
    twice = retention.apply_retention(once, moment)
    assert all(twice[n].count() == once[n].count() for n in once)


# Fingerprints, presence and pages.


@QUIET
@given(hs.lists(hs.tuples(hs.sampled_from("abcdef"), hs.sampled_from("123")), min_size=1, max_size=12), hs.randoms(use_true_random=False))
def test_fingerprint_ignores_order_and_layout(make, pairs, rnd):
    ddl = "source_id string, external_id string, content_hash string"
    rows = [dict(source_id="s", external_id=a, content_hash=b) for a, b in pairs]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    first = history.fingerprint(make(ddl, *rows), ["source_id"]).first().content_fingerprint
    assert history.fingerprint(make(ddl, *shuffled).repartition(5), ["source_id"]).first().content_fingerprint == first
    changed = rows[:-1] + [dict(rows[-1], content_hash="other")]
    assert history.fingerprint(make(ddl, *changed), ["source_id"]).first().content_fingerprint != first


def test_reuse_needs_snapshot_match_and_no_anomaly(column):
    rows = [("f", "r", "f", None), ("f", None, "f", None), (None, "r", "f", None), ("g", "r", "f", None), ("f", "r", "f", "captcha-page")]
    reuse = health.can_reuse(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert column(rows, "a string, b string, c string, d string", reuse) == [True, False, False, False, False]


@QUIET
@given(hs.lists(hs.tuples(hs.sampled_from("ab"), hs.integers(0, 7)), min_size=1, max_size=14))
def test_presence_history_against_brute_force(make, sightings):
    ddl = "source_id string, external_id string, run_at int"
    runs = make("source_id string, run_at int", *[dict(source_id="s", run_at=i) for i in range(8)])
    seen = make(ddl, *[dict(source_id="s", external_id=k, run_at=t) for k, t in sightings])
    expected = set()
    for key in {k for k, _ in sightings}:
        times = sorted({t for k, t in sightings if k == key})
        start = times[0]
        for i, t in enumerate(times):
            following = times[i + 1] if i + 1 < len(times) else 8
            absent = following - t - 1
            if absent >= 2 or i + 1 == len(times):
                expected.add((key, start, t, absent, t + 2 if absent >= 2 else None))
                start = following
    found = history.presence_history(seen, runs).collect()
    assert {(r.external_id, r.first_seen, r.last_seen, r.runs_absent, r.closed_at) for r in found} == expected


def test_dedupe_last_wins(make):
    rows = make("k string, n int, v string", dict(k="a", n=0, v="x"), dict(k="b", n=1, v="y"), dict(k="a", n=2, v="z"))
    assert sorted((r.k, r.v, r.first_ordinal) for r in history.dedupe_last(rows, ["k"], "n").collect()) == [("a", "z", 0), ("b", "y", 1)]


def test_pages_cover_the_sorted_set_exactly(make):
    rnd = random.Random(3)
    jobs = make(S.JOBS, *[job(f"{i:02}", score=rnd.randint(0, 3), first_seen_at=rnd.randint(0, 3)) for i in range(37)])
    listed = jobs.withColumns({"action": F.lit(None).cast("string"), "version_count": F.lit(1)})
    got, cursor = [], None
    while True:
        items, cursor = paging.page(listed, JobFilter(), 10, cursor)
        got += [i["id"] for i in items]
        if cursor is None:
            break
    assert got == [r["id"] for r in paging.ordered(jobs).collect()] and len(got) == 37


@pytest.mark.parametrize("bad", ["", "%%%", "e30", "bnVsbA", paging.encode_cursor(paging.Cursor("x", 1, "a"))])
def test_bad_cursors_are_refused(bad):
    with pytest.raises(paging.BadCursor):
        paging.decode_cursor(bad)


def test_cursor_round_trip():
    cursor = paging.Cursor(85, 1_700_000_000, "job_é")
    assert paging.decode_cursor(paging.encode_cursor(cursor)) == cursor


@pytest.mark.parametrize("value, expected", [(None, 50), ("7.9", 7), ("abc", 50), ("-3", 1), ("1e9", 100), ("", 1), ("inf", 50)])
def test_clamp(value, expected):
    assert filters.clamp_int(value, 50, 1, 100) == expected


def test_search(make):
    ddl = "id int, title string, company_name string, location_text string, skills_text string, search_text string"
    rows = make(
        ddl, dict(id=1, title="Three.js Développeur", company_name="Acme", search_text="old words"), dict(id=2, title="Three", company_name="js", search_text="x"),
        dict(id=3, title="threejs", search_text="three js 100%"),
    )

    def hits(q):
        return sorted(r.id for r in filters.search(rows, q).collect())

    assert hits("three.js") == [1, 3] and hits("developpeur ACME") == [1] and hits('"three" js') == [1, 2, 3]
    assert hits("") == [1, 2, 3] and hits("...") == [] and hits("thre") == []
    updated = rows.withColumn("search_text", F.when(F.col("id") == 1, "new words").otherwise(F.col("search_text")))
    assert filters.search(updated, "old").count() == 0 and filters.search(updated, "new").count() == 1


def test_contracts(make):
    good = job("a")
    bad = job("b", title="", score=101, content_hash="x", skills=["s"] * 41, workplace_type="moon")
    valid, rejects = validate.validate(make(S.JOBS, good, bad), validate.posting_contract())
    assert [r.external_id for r in valid.collect()] == ["a"]
    assert set(rejects.first().errors) == {"title:length", "skills:size", "workplace_type:enum", "score:range", "content_hash:pattern"}
    valid, rejects = validate.validate(make(S.SOURCE_OBS, observation(content_fingerprint=HASH), observation(content_fingerprint="short"), observation(signals=["x"] * 21)), validate.observation_contract())
    assert valid.count() == 1 and sorted(r.errors[0] for r in rejects.collect()) == ["content_fingerprint:pattern", "signals:size"]


def test_source_contract(make):
    ddl = f"company_id string, kind string, url string, adapter_key string, crawl_interval_minutes int, browser_required boolean, config {S.CONFIG}"
    none = tuple([None] * 7)
    base = dict(company_id="c", kind="greenhouse", url="https://x", adapter_key="k", crawl_interval_minutes=720, browser_required=False, config=(*none, None))
    rows = make(
        ddl, base, base | dict(adapter_key=" "), base | dict(kind="static-html"), base | dict(browser_required=True), base | dict(crawl_interval_minutes=29),
        base | dict(url="ftp://x"), base | dict(config=(*none, {"Cookie": "x"})), base | dict(config=(*none, {"ok": "a\nb"})),
    )
    found = [r.errors for r in validate.with_errors(rows, validate.source_contract()).collect()]
    assert found == [
        [], ["ADAPTER_KEY_REQUIRED"], ["SELECTORS_REQUIRED"], ["BROWSER_KIND_REQUIRED"], ["crawl_interval_minutes:range"], ["url:pattern"],
        ["config.headers:forbidden"], ["config.headers:value"],
    ]


def test_reports_handed_in_twice_or_contradicting_change_state_once(make):
    """Of several reports of one source the last counts, whatever their order; rows are never multiplied."""
    first = judge(make, observation(status="failed", http_status=503), 0).withColumn("reported_at", F.lit(1))
    last = judge(make, observation(etag="e2", content_fingerprint="b" * 64)).withColumn("reported_at", F.lit(2))
    many = last.unionByName(first).unionByName(last).unionByName(first)
    sources, runs, jobs = make(S.SOURCES, source()), make(S.SOURCE_RUNS), make(S.JOBS, job("a"), job("b", last_seen_run_id="old"))
    for change, old in ((source_state.advance_sources, sources), (source_state.record_source_runs, runs), (state.age_missing, jobs)):
        assert sorted(map(str, change(old, many, now()).collect())) == sorted(map(str, change(old, last, now()).collect()))
    assert state.age_missing(jobs, many, now()).count() == 2
    assert [tuple(r)[1:] for r in source_state.run_counters(many).collect()] == [(1, 0)]
