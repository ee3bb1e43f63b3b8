"""Posting state: each change is a pure function from old state and delta to new state.

Only keys and the few preserved columns of the old state are joined with a delta;
untouched wide rows pass through an anti join. For a delta within Catalyst's
broadcast threshold neither join shuffles the state table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import dedupe_key, job_id, snapshot_json
from ..schemas import JOB_ACTIONS, JOBS, struct
from .history import build_versions, one_each
from .joins import join_salted

CLOSE_AFTER = 2


def not_stored(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Delta rows whose key is not stored yet; of equal delta keys one (the first by order) stays."""
    if order is None:
        fresh = one_each(delta, keys)
    else:
        rest = [c for c in delta.columns if c not in keys]
        firsts = delta.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
        fresh = firsts.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    return fresh.join(base.select(*keys), list(keys), "left_anti").select(*base.columns)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """The stored rows and the delta rows whose key is not stored yet."""
    return base.unionByName(not_stored(base, delta, keys, order))


def last_dispositions(dispositions: DataFrame, key: Sequence[str] = ("source_id",)) -> DataFrame:
    """One disposition per key, the last of several: by ``reported_at`` where they have it, then by run.

    Reports may be handed in twice or contradict each other; changes of state follow one of them."""
    rest = [c for c in ("reported_at", "run_id") if c in dispositions.columns and c not in key]
    return one_each(dispositions, list(key), rest)


def incoming_jobs(postings: DataFrame, now: Column) -> DataFrame:
    """Job rows of normalized postings (with source_id, company_id, run_id, fetched_at)."""
    null = F.lit(None).cast("bigint")
    columns = {
        "id": job_id(F.col("source_id"), F.col("external_id")),
        "dedupe_key": dedupe_key(F.col("company_name"), F.col("title"), F.col("location_text")),
        "first_seen_at": now,
        "last_seen_at": F.col("fetched_at"),
        "last_seen_run_id": F.col("run_id"),
        "missing_count": F.lit(0),
        "status": F.lit("open"),
        "closed_at": null,
        "created_at": now,
        "updated_at": now,
    }
    rows = postings.withColumns(columns)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct(JOBS)])


def upsert_jobs(jobs: DataFrame, incoming: DataFrame, mark: str | None = None) -> DataFrame:
    """Refresh or add postings by (source_id, external_id).

    Identity and first sighting of a known posting stay; absence is reset and it reopens. Of
    several sightings of one posting the last counts, so a delta may be handed in twice.
    ``mark`` names a column that tells the refreshed and added rows from the rest.
    """
    key = ["source_id", "external_id"]
    untouched = jobs.join(incoming.select(*key), key, "left_anti")
    incoming = one_each(incoming, key, ["last_seen_at", "content_hash"])
    kept = jobs.select(
        *key, F.col("id").alias("_id"), F.col("first_seen_at").alias("_first"), F.col("created_at").alias("_created")
    )
    touched = incoming.join(kept, key, "left").withColumns(
        {
            "id": F.coalesce("_id", "id"),
            "first_seen_at": F.coalesce("_first", "first_seen_at"),
            "created_at": F.coalesce("_created", "created_at"),
        }
    )
    marks = [[F.lit(hit).alias(mark)] if mark else [] for hit in (False, True)]
    return untouched.select(*jobs.columns, *marks[0]).unionByName(touched.select(*jobs.columns, *marks[1]))


def version_rows(postings: DataFrame) -> DataFrame:
    return postings.select(
        job_id(F.col("source_id"), F.col("external_id")).alias("job_id"),
        "content_hash",
        snapshot_json().alias("snapshot_json"),
        F.col("fetched_at").alias("observed_at"),
    )


def append_versions(versions: DataFrame, observations: DataFrame) -> DataFrame:
    """Add contents not stored yet; returning to an old content adds nothing."""
    return versions.unionByName(fresh_versions(versions, observations))


def fresh_versions(versions: DataFrame, observations: DataFrame) -> DataFrame:
    """The first observation of each content that is not stored."""
    return build_versions(observations).join(versions.select("job_id", "content_hash"), ["job_id", "content_hash"], "left_anti").select(*versions.columns)


def set_actions(actions: DataFrame, changes: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Upsert user actions of existing postings. Only ``applied`` keeps a time, now by default.

    Of several changes of one posting the last stays, by ``changed_at`` where the changes have it."""
    changes = one_each(changes, ["job_id"], [c for c in ("changed_at", "applied_at") if c in changes.columns])
    applied = F.when(F.col("action") == "applied", F.coalesce("applied_at", now))
    known = changes.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    rows = known.withColumns({"applied_at": applied, "updated_at": now})
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct(JOB_ACTIONS)])
    rest = actions.join(rows.select("job_id"), "job_id", "left_anti")
    return rest.select(*rows.columns).unionByName(rows)


def clear_actions(actions: DataFrame, job_ids: DataFrame) -> DataFrame:
    return actions.join(job_ids.select("job_id"), "job_id", "left_anti").select(*actions.columns)


def presence_baseline(dispositions: DataFrame) -> DataFrame:
    """Per completed source the run whose postings count as present; no other source ages postings.

    Of several dispositions of one source the last counts."""
    dispositions = last_dispositions(dispositions)
    complete = F.col("disposition")["kind"] == "complete"
    baseline = F.when(F.col("status") == "healthy", F.col("run_id")).when(
        F.col("status") == "not_modified", F.col("stored_snapshot_run_id")
    )
    return dispositions.filter(complete).select("source_id", baseline.alias("_baseline")).filter(F.col("_baseline").isNotNull())


def missing_postings(jobs: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Open postings absent from their source's reference run."""
    aged = join_salted(jobs, presence_baseline(dispositions), ["source_id"], ["id"])
    return aged.filter(_absent()).select(*jobs.columns)


def _absent() -> Column:
    return (
        (F.col("status") == "open")
        & F.col("_baseline").isNotNull()
        & ~F.col("last_seen_run_id").eqNullSafe(F.col("_baseline"))
    )


def age_missing(jobs: DataFrame, dispositions: DataFrame, now: Column, mark: str | None = None) -> DataFrame:
    """Count one more absence for postings not in the reference run; the second one closes them.

    ``mark`` names a column of the postings that becomes true for those that were aged."""
    rows = join_salted(jobs, presence_baseline(dispositions), ["source_id"], ["id"], "left").withColumn("_aged", _absent())
    closes = F.col("_aged") & (F.col("missing_count") + 1 >= CLOSE_AFTER)
    changed = {
        "missing_count": F.when(F.col("_aged"), F.col("missing_count") + 1).otherwise(F.col("missing_count")),
        "status": F.when(closes, "closed").otherwise(F.col("status")),
        "closed_at": F.when(closes, now).otherwise(F.col("closed_at")),
        "updated_at": F.when(F.col("_aged"), now).otherwise(F.col("updated_at")),
    }
    if mark:
        changed[mark] = F.col(mark) | F.col("_aged")
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in jobs.columns])


def cascade(
    parents_deleted: DataFrame, child: DataFrame, foreign_key: str, parent_key: str = "id", spread_by: Sequence[str] = ()
) -> DataFrame:
    """Child rows that remain after their parents were deleted.

    ``spread_by`` names columns that tell the children of one huge parent apart.
    """
    gone = parents_deleted.select(F.col(parent_key).alias(foreign_key))
    if spread_by:
        return join_salted(child, gone, [foreign_key], spread_by, "left_anti").select(*child.columns)
    return child.join(gone, foreign_key, "left_anti").select(*child.columns)


def admit_batches(ledger: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    """Label every incoming batch ``new``, ``duplicate`` or ``collision``.

    The first arrival of an id is compared with the ledger, later ones with that first arrival.
    """
    firsts = incoming.groupBy("batch_id").agg(
        F.min_by(F.struct("run_id", "source_id"), arrival).alias("_first"), F.min(arrival).alias("_arrival")
    )
    stored = ledger.select("batch_id", F.struct("run_id", "source_id").alias("_stored"))
    owners = firsts.join(stored, "batch_id", "left")
    # One id may be replayed any number of times, so its copies are spread.
    rows = join_salted(incoming, owners, ["batch_id"], [arrival])
    owner = F.coalesce("_stored", "_first")
    same = (F.col("run_id") == owner["run_id"]) & (F.col("source_id") == owner["source_id"])
    fresh = F.col("_stored").isNull() & (F.col(arrival) == F.col("_arrival"))
    label = F.when(fresh, "new").when(same, "duplicate").otherwise("collision")
    return rows.withColumn("admission", label).select(*incoming.columns, "admission")


def ledger_counts(ingest_batches: DataFrame) -> DataFrame:
    return ingest_batches.groupBy("run_id", "source_id").agg(F.count(F.lit(1)).alias("stored_batches"))


def run_context(
    df: DataFrame, sources: DataFrame, source_runs: DataFrame, crawl_runs: DataFrame, spread_by: Sequence[str] = ()
) -> DataFrame:
    """Add the state a run's report is judged by; absent rows give NULLs.

    All rows may be of one run, and a source may have most of them: ``spread_by`` names columns that tell its rows apart."""
    s = sources.select(
        F.col("id").alias("source_id"), F.col("company_id").alias("source_company_id"), "lease_owner",
        F.lit(True).alias("source_exists"),
    )
    sr = source_runs.select(
        "run_id", "source_id", F.col("status").alias("source_run_status"),
        F.col("completed_at").alias("source_run_completed_at"),
    )
    cr = crawl_runs.select(F.col("id").alias("run_id"), F.col("status").alias("crawl_run_status"))
    rows = join_salted(df, s, ["source_id"], spread_by or ["run_id"], "left")
    rows = join_salted(rows, sr, ["run_id", "source_id"], spread_by or ["source_id"], "left")
    return join_salted(rows, cr, ["run_id"], spread_by or ["source_id"], "left")


def admit_writes(context: DataFrame) -> DataFrame:
    """Why a posting batch must not be written (``reject_reason``, NULL when it may)."""
    active = (F.col("source_run_status") == "running") & (F.col("crawl_run_status") == "running")
    reason = (
        F.when(F.col("source_exists").isNull(), "SOURCE_NOT_FOUND")
        .when(~F.col("lease_owner").eqNullSafe(F.col("run_id")), "LEASE_MISMATCH")
        .when(~F.coalesce(active, F.lit(False)), "RUN_NOT_ACTIVE")
    )
    return context.withColumn("reject_reason", reason)


def admit_completions(context: DataFrame) -> DataFrame:
    """Why a source completion is not applied (``reject_reason``, NULL when it is)."""
    reason = (
        F.when(F.col("source_exists").isNull(), "SOURCE_NOT_FOUND")
        .when(F.col("source_run_completed_at").isNotNull(), "ALREADY_COMPLETED")
        .when(F.col("source_run_status").isNull(), "SOURCE_RUN_NOT_FOUND")
        .when(~F.col("lease_owner").eqNullSafe(F.col("run_id")), "LEASE_MISMATCH")
    )
    return context.withColumn("reject_reason", reason)


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    """Postings that share company, title and place."""
    return (
        jobs.groupBy("dedupe_key")
        .agg(F.count(F.lit(1)).alias("postings"), F.min("id").alias("first_id"), F.max("score").alias("top_score"))
        .filter(F.col("postings") > 1)
    )


