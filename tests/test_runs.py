"""Whole collection runs, batch and streamed, and plan checks for large inputs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from postlens import schemas as S
from postlens.operators import history, sources as sources_ops, state
from postlens.plans import reports, views
from postlens.plans.collect import collect_run
from postlens.sources.registry import parse_board_c
from postlens.sources.tables import Delta, Tables, replace_partitions
from postlens.streaming import ingest


def source(key, kind, **changes):
    base = dict(
        id=key, company_id="c1", kind=kind, url="https://base.com/", config_json="{}", browser_required=False, crawl_interval_minutes=720,
        previous_job_count=0, consecutive_failures=0, next_due_at=0, lease_owner="r1", status="active", created_at=0, updated_at=0,
    )
    return base | changes


def state_tables(make, run="r1", sources=()):
    tables = {name: make(ddl) for name, ddl in S.TABLES.items()}
    tables["companies"] = make(S.COMPANIES, dict(id="c1", slug="c", name="Co", priority=1, active=True, created_at=0, updated_at=0))
    tables["sources"] = make(S.SOURCES, *sources)
    tables["crawl_runs"] = make(S.CRAWL_RUNS, dict(id=run, runner_type="fast", trigger_type="m", planned_source_count=len(sources), completed_source_count=0, failed_source_count=0, started_at=0, status="running"))
    tables["source_runs"] = make(S.SOURCE_RUNS, *[dict(id=f"{run}:{s['id']}", run_id=run, source_id=s["id"], status="running", started_at=0) for s in sources])
    return tables


def board(*titles):
    return json.dumps({"jobs": [{"id": i, "title": t, "absolute_url": f"https://x/{i}", "content": "word " * 40} for i, t in enumerate(titles)]})


def response(key, body, run="r1", **changes):
    return dict(source_id=key, run_id=run, role="list", status=200, url="https://u", body=body, content_type="application/json", fetched_at=50) | changes


def test_first_run(make):
    sources = [source("ok", "greenhouse"), source("empty", "greenhouse"), source("broken", "lever"), source("down", "ashby"), source("other", "greenhouse", lease_owner="r9")]
    responses = make(
        S.RESPONSE, response("ok", board("Product Engineer", " ", "Designer")), response("empty", json.dumps({"jobs": [], "note": "x" * 120})), response("broken", "{}"),
        response("down", "", status=503), response("other", board("A")),
    )
    result = collect_run(responses, state_tables(make, sources=sources), F.lit(1000))
    seen = {r.source_id: (r.status, r.fetched_job_count, r.error_message) for r in result.observations.collect()}
    assert seen == {
        "ok": ("healthy", 2, None), "empty": ("healthy", 0, None), "broken": ("failed", 0, "Lever response must be an array"), "down": ("failed", 0, "HTTP 503 for https://u"),
    }
    signals = result.observations.filter("source_id = 'ok'").first().signals
    assert signals == ["normalize-error:Job title is empty"]
    decided = {r.source_id: tuple(r.disposition) for r in result.dispositions.collect()}
    assert decided == {"ok": ("complete", None), "empty": ("complete", None), "broken": ("quarantine", "schema-invalid"), "down": ("retry", "http-503")}
    assert [(r.source_id, r.reject_reason) for r in result.rejected.collect()] == [("other", "LEASE_MISMATCH")]
    jobs = result.tables["jobs"].collect()
    assert sorted(j.title for j in jobs) == ["Designer", "Product Engineer"] and {j.last_seen_run_id for j in jobs} == {"r1"}
    assert result.tables["job_versions"].count() == 2 and result.tables["ingest_batches"].count() == 1
    run = result.tables["crawl_runs"].first()
    assert (run.completed_source_count, run.failed_source_count) == (2, 2)


def test_repeated_and_paged_landings_count_once(make):
    sources = [source("s", "greenhouse")]
    one, two = response("s", board("A", "B")), response("s", board("A", "B", "C"), url="https://u?page=2", fetched_at=60)
    once = collect_run(make(S.RESPONSE, one), state_tables(make, sources=sources), F.lit(1000))
    twice = collect_run(make(S.RESPONSE, one, one), state_tables(make, sources=sources), F.lit(1000))
    for name in once.tables:
        assert sorted(map(str, once.tables[name].collect())) == sorted(map(str, twice.tables[name].collect())), name
    assert sorted(map(str, once.observations.collect())) == sorted(map(str, twice.observations.collect()))
    paged = collect_run(make(S.RESPONSE, one, two, two), state_tables(make, sources=sources), F.lit(1000))
    assert sorted(j.title for j in paged.tables["jobs"].collect()) == ["A", "B", "C"]
    assert [o.fetched_job_count for o in paged.observations.collect()] == [3]
    assert (paged.tables["sources"].count(), paged.tables["source_runs"].count()) == (1, 1)
    assert paged.tables["crawl_runs"].first().completed_source_count == 1


def test_a_finished_run_takes_nothing(make):
    tables = state_tables(make, sources=[source("s", "greenhouse")])
    tables["crawl_runs"] = tables["crawl_runs"].withColumn("status", F.lit("partial"))
    result = collect_run(make(S.RESPONSE, response("s", board("A"))), tables, F.lit(1000))
    assert [(r.source_id, r.reject_reason) for r in result.rejected.collect()] == [("s", "RUN_NOT_ACTIVE")]
    assert result.tables["jobs"].isEmpty()


def test_a_run_is_opened_over_fresh_state(make):
    fresh = source("s", "greenhouse", lease_owner=None)
    held = source("h", "greenhouse", lease_owner="r0", lease_until=5_000)
    tables = {name: make(ddl) for name, ddl in S.TABLES.items()}
    tables["companies"] = make(S.COMPANIES, dict(id="c1", slug="c", name="Co", priority=1, active=True, created_at=0, updated_at=0))
    tables["sources"] = make(S.SOURCES, fresh, held)
    opened = sources_ops.open_run(tables["sources"], tables["source_runs"], tables["crawl_runs"], tables["sources"], "r1", F.lit(1000).cast("bigint"))
    again = sources_ops.open_run(opened["sources"], opened["source_runs"], opened["crawl_runs"], opened["sources"], "r1", F.lit(1000).cast("bigint"))
    for name in opened:
        assert sorted(map(str, opened[name].collect())) == sorted(map(str, again[name].collect()))
    run = opened["crawl_runs"].first()
    assert (run.id, run.planned_source_count, run.status) == ("r1", 1, "running")
    assert {s.id: s.lease_owner for s in opened["sources"].collect()} == {"s": "r1", "h": "r0"}
    result = collect_run(make(S.RESPONSE, response("s", board("A"))), {**tables, **opened}, F.lit(1000))
    assert result.tables["jobs"].count() == 1 and result.rejected.isEmpty()


def test_unchanged_feed_is_not_ingested_and_ages_the_absent(make):
    sources = [source("s", "greenhouse")]
    tables = state_tables(make, sources=sources)
    first = collect_run(make(S.RESPONSE, response("s", board("A", "B"))), tables, F.lit(1000))
    after = {**tables, **first.tables}
    leased = after["sources"].withColumn("lease_owner", F.lit("r2"))
    later = state_tables(make, "r2", sources)
    again = {**after, "sources": leased, "crawl_runs": later["crawl_runs"], "source_runs": later["source_runs"]}
    result = collect_run(make(S.RESPONSE, response("s", board("A", "B"), "r2")), again, F.lit(2000))
    obs = result.observations.first()
    assert (obs.status, obs.expected_batch_count) == ("not_modified", 0)
    assert {(j.title, j.missing_count, j.last_seen_run_id) for j in result.tables["jobs"].collect()} == {("A", 0, "r1"), ("B", 0, "r1")}
    assert result.tables["sources"].first().snapshot_run_id == "r1"
    changed = collect_run(make(S.RESPONSE, response("s", board("A"), "r2")), again, F.lit(2000))
    assert {(j.title, j.missing_count) for j in changed.tables["jobs"].collect()} == {("A", 0), ("B", 1)}
    cached = collect_run(make(S.RESPONSE, response("s", None, "r2", status=304, not_modified=True)), again, F.lit(2000))
    assert tuple(cached.dispositions.first().disposition) == ("complete", None)


def test_details_and_custom_parsers_in_a_run(make, spark):
    config = '{"listSelector":"li","titleSelector":"a","detailDescriptionSelector":".d"}'
    sources = [source("cards", "static-html", config_json=config), source("board", "greenhouse"), source("own", "jsonld")]
    page = "<ul>" + "".join(f"<li data-id={i}><a href=/j/{i}>Job {i}</a></li>" for i in range(2)) + "</ul>" + " " * 100 + "<p>end of the list</p>"
    short = json.dumps({"jobs": [{"id": 1, "title": "B", "content": "short", "absolute_url": "https://x/1"}], "pad": "x" * 120})
    responses = make(S.RESPONSE, response("cards", page, content_type="text/html"), response("board", short), response("own", "y" * 200, content_type="text/plain"))
    details = spark.createDataFrame(
        [("cards", "r1", "https://base.com/j/0", "<div class=d>Full text</div>", ".d", None)],
        "source_id string, run_id string, url string, body string, selector string, error string",
    )

    def parser(rows):
        return parse_board_c(rows.withColumn("body", F.lit('{"jobs":[{"id":"z","title":"Own","jobUrl":"https://own/z"}]}')))

    result = collect_run(responses, state_tables(make, sources=sources), F.lit(1000), custom={"jsonld": parser}, detail_pages=details)
    seen = {r.source_id: (r.status, r.fetched_job_count, r.signals) for r in result.observations.collect()}
    assert seen == {
        "cards": ("healthy", 2, ["detail-fetch-failed:https://base.com/j/1:not landed"]), "board": ("healthy", 1, []), "own": ("healthy", 1, []),
    }
    texts = {(j.source_id, j.external_id): j.description_text for j in result.tables["jobs"].collect()}
    assert texts == {("cards", "0"): "Full text", ("cards", "1"): "", ("board", "1"): "short", ("own", "z"): ""}


def test_streamed_run_is_replay_safe(make, spark, tmp_path):
    sources = [source("s", "greenhouse")]
    tables = Tables(spark, str(tmp_path / "tables"))
    tables.commit(state_tables(make, sources=sources))
    landed = str(tmp_path / "landed")
    make(S.RESPONSE, response("s", board("A", "B"))).write.parquet(landed)
    sink = ingest.ingest_sink(tables, lambda: F.lit(1000))
    ingest.run_available(ingest.read_landed(spark, landed), sink, str(tmp_path / "cp")).awaitTermination()
    assert tables.read("jobs").count() == 2
    sink(spark.read.schema(S.RESPONSE).parquet(landed), 0)
    assert tables.read("jobs").count() == 2 and tables.read("ingest_batches").count() == 1
    assert tables.read("crawl_runs").first().completed_source_count == 1


def test_export_and_run_outputs(make, spark, tmp_path):
    company = make(S.COMPANIES, dict(id="c1", slug="b", name="B", priority=1), dict(id="c2", slug="a", name="A", priority=9))
    jobs = make(S.JOBS, dict(id="j1", title="T", company_name="A", canonical_url="https://j"), dict(id="j2", title="U"))
    actions = make(S.JOB_ACTIONS, dict(job_id="j1", action="saved", updated_at=1), dict(job_id="j2", action="applied", updated_at=2))
    parts = reports.export_user_data(company, make(S.SOURCES, source("s", "lever")), actions, jobs)
    assert [r.name for r in parts["companies"].collect()] == ["A", "B"]
    assert [r.title for r in parts["job_actions"].collect()] == ["U", "T"]
    reports.write_export(parts, str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export" / "job_actions")).count() == 2
    observed = make(
        S.SOURCE_OBS, dict(run_id="r", source_id="a", status="healthy", fetched_job_count=3), dict(run_id="r", source_id="b", status="failed", error_code="x"),
        dict(run_id="q", source_id="a", status="failed"), dict(run_id="p", source_id="a", status="not_modified"),
    )
    assert {r.run_id: (r.completed, r.failed, r.status) for r in reports.run_summary(observed).collect()} == {
        "r": (1, 1, "partial"), "q": (0, 1, "failed"), "p": (1, 0, "completed"),
    }
    path = str(tmp_path / "facts")
    outcomes = reports.source_outcomes(observed)
    replace_partitions(outcomes, path, ["run_id"])
    replace_partitions(outcomes.filter("run_id = 'r' AND source_id = 'a'"), path, ["run_id"])
    assert {(r.run_id, r.source_id) for r in spark.read.parquet(path).collect()} == {("r", "a"), ("q", "a"), ("p", "a")}


def test_late_runs_are_set_aside(make):
    batch = make("source_id string, run_no int", dict(source_id="a", run_no=2), dict(source_id="a", run_no=3), dict(source_id="b", run_no=1))
    applied = make("source_id string, last_run_no int", dict(source_id="a", last_run_no=2))
    on_time, late = ingest.split_late(batch, applied)
    assert sorted(map(tuple, on_time.collect())) == [("a", 3), ("b", 1)] and [tuple(r) for r in late.collect()] == [("a", 2)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The adaptive plan after the query ran."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


def test_list_view_reads_no_bodies(make, spark, tmp_path):
    path = str(tmp_path / "jobs")
    make(S.JOBS).write.parquet(path)
    jobs = spark.read.schema(S.JOBS).parquet(path)
    listed = views.list_view(views.listing(jobs, make(S.JOB_ACTIONS), make(S.JOB_VERSIONS)))
    schema = plan(listed.filter("status = 'open' AND score >= 85"))
    assert "description_text" not in schema and "search_text" not in schema
    assert "GreaterThanOrEqual(score,85)" in schema and "EqualTo(status,open)" in schema


def test_rank_limits_run_before_the_shuffle(make):
    newest = history.keep_latest(make(S.JOB_VERSIONS), ["job_id"], [F.col("observed_at").desc()], 3)
    assert plan(newest).count("WindowGroupLimit") == 2


def test_one_source_holding_most_rows(spark):
    """Aggregations combine before the shuffle, so a hot source reaches it as a few rows."""
    rows = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 1000).cast("string"))).alias("source_id"),
        F.col("id").cast("string").alias("external_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"),
    )
    prints = history.fingerprint(rows, ["source_id"])
    text = plan(prints)
    assert "partial_sum" in text and "collect_list" not in text
    hot = prints.filter("source_id = 'hot'").first()
    assert hot.posting_count == rows.filter("source_id = 'hot'").count()


def test_hot_source_is_spread_over_partitions(spark):
    """Beyond any broadcast, postings of one huge source still reach many tasks of the aging join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs = spark.range(300_000, numPartitions=8).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source_id"),
            F.lit("open").alias("status"), F.lit("r0").alias("last_seen_run_id"), F.lit(0).alias("missing_count"),
            F.lit(None).cast("bigint").alias("closed_at"), F.lit(0).cast("bigint").alias("updated_at"),
        )
        done = F.struct(F.lit("complete").alias("kind"), F.lit(None).cast("string").alias("reason"))
        dispositions = jobs.select("source_id").distinct().select(
            "source_id", F.lit("healthy").alias("status"), F.lit("r1").alias("run_id"), F.lit(None).cast("string").alias("stored_snapshot_run_id"), done.alias("disposition")
        )
        aged = state.age_missing(jobs, dispositions, F.lit(5))
        assert aged.filter("missing_count = 1").count() == 300_000
        assert re.search(r"hashpartitioning\(source_id#\d+, _salt#\d+", final_plan(aged))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_lost_before_its_manifest_is_applied_once(make, spark, tmp_path):
    """The ledger, what is made of admitted rows and the batch's number are published in one step."""
    tables = Tables(spark, str(tmp_path / "t"), {"ingest_batches": S.INGEST_BATCHES, "effects": "batch_id string, n int"}, {"ingest_batches": ("batch_id",), "effects": ("batch_id",)}, buckets=2)
    rows = make("batch_id string, run_id string, source_id string, job_count bigint, at int", *[dict(batch_id=f"b{i % 3}", run_id="r", source_id="s", job_count=1, at=i) for i in range(6)])
    calls = []

    def admitted(new, number, at):
        calls.append((number, at.version))
        return {"effects": Delta(new.selectExpr("batch_id", "1 AS n"), append=True)}

    sink, create = ingest.ledger_sink(tables, "at", lambda: F.lit(5), admitted), tables.files.create

    def lose(*_):
        raise OSError("lost")

    tables.files.create = lose
    with pytest.raises(OSError, match="lost"):
        sink(rows, 0)
    assert tables.version() == 0 and tables.read("effects").isEmpty()
    tables.files.create = create
    for _ in range(2):
        sink(rows, 0)
    assert (tables.version(), tables.read("effects").count(), tables.read("ingest_batches").count()) == (1, 3, 3)
    sink(rows, 1)
    assert tables.read("effects").count() == 3 and calls == [(0, 0), (0, 0), (1, 1)]


def test_listed_signals_are_limited_and_all_are_kept_as_rows(make):
    titles = [" "] * 30 + ["Real"]
    result = collect_run(make(S.RESPONSE, response("s", board(*titles))), state_tables(make, sources=[source("s", "greenhouse")]), F.lit(1000), signals_listed=1)
    assert result.observations.first().signals == ["normalize-error:Job title is empty"]
    assert result.signals.count() == 30


def test_details_landed_in_the_same_run(make):
    config = '{"listSelector":"li","titleSelector":"a","detailDescriptionSelector":".d"}'
    page = "<ul>" + "".join(f"<li data-id={i}><a href=/j/{i}>Job {i}</a>{'<p class=d>' + 'long ' * 50 + '</p>' if i == 3 else ''}</li>" for i in range(4)) + "</ul>" + " " * 100
    detail = lambda i, body, **more: response("cards", body, role="detail", url=f"https://base.com/j/{i}", content_type="text/html", **more)
    responses = make(
        S.RESPONSE, response("cards", page, content_type="text/html"), detail(0, "<div class=d>Full text</div>"), detail(1, "", status=404), detail(3, "<div class=d>not asked for</div>"),
        detail(2, "<div class=d>other run</div>", run="r0"),
    )
    result = collect_run(responses, state_tables(make, sources=[source("cards", "static-html", config_json=config)]), F.lit(1000))
    texts = {j.external_id: j.description_text for j in result.tables["jobs"].collect()}
    assert texts == {"0": "Full text", "1": "", "2": "", "3": ("long " * 50).strip()}
    assert result.observations.first().signals == ["detail-fetch-failed:https://base.com/j/1:HTTP 404 for https://base.com/j/1", "detail-fetch-failed:https://base.com/j/2:not landed"]


def test_custom_kinds_parse_the_landing_that_counts(make):
    """A page landed twice is parsed once, and pages are numbered one behind the other."""
    def parser(rows):
        return parse_board_c(rows)

    def page(*ids):
        return json.dumps({"jobs": [{"id": i, "title": f"T{i}", "jobUrl": f"https://own/{i}"} for i in ids], "pad": "x" * 100})

    landed = make(
        S.RESPONSE, response("own", page("a", "gone")), response("own", page("a", "b"), fetched_at=60), response("own", page("c"), url="https://u?2"), response("own", page("c"), url="https://u?2"),
    )
    result = collect_run(landed, state_tables(make, sources=[source("own", "jsonld")]), F.lit(1000), custom={"jsonld": parser})
    assert sorted(j.external_id for j in result.tables["jobs"].collect()) == ["a", "b", "c"]
    assert result.observations.first().fetched_job_count == 3


def test_per_source_rows_are_not_broadcast(spark):
    """A side with a row for each source and salt compresses well, so its file or shuffle tells little of its size in the driver."""
    from postlens.operators.joins import join_salted, join_shuffled

    many = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c"), (None, "d")], "source_id string, n string")
    few = spark.createDataFrame([("s1", 1), (None, 2)], "source_id string, v int")
    for joined in (join_salted(many, few, ["source_id"], ["n"], "left"), join_shuffled(many, few, "source_id", "left")):
        rows = sorted((r.source_id or "", r.n, r.v or 0) for r in joined.collect())
        assert rows == [("", "d", 0), ("s1", "a", 1), ("s1", "b", 1), ("s2", "c", 0)]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_wide_rows_of_a_run_are_sent_once_before_the_state(make):
    """A run's postings used to be dealt by key for the last of each, for their prints again, and by source for its facts."""
    sources = [source("s", "greenhouse"), source("t", "greenhouse")]
    one, two = response("s", board("A", "B")), response("s", board("A", "C"), url="https://u?page=2", fetched_at=60)
    result = collect_run(make(S.RESPONSE, one, two, response("t", board("A"))), state_tables(make, sources=sources), F.lit(1000))
    versions = result.changes["job_versions"].rows
    text = versions._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((j.source_id, j.external_id, j.title) for j in result.tables["jobs"].collect()) == [("s", "0", "A"), ("s", "1", "C"), ("t", "0", "A")]
    joins = [line for line in text.splitlines() if "Join" in line and "_row#" in line]
    assert joins and not [line for line in joins if "content_hash#" in line]
