"""Versions, fingerprints and presence over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import quote_json
from .joins import join_salted, join_shuffled

_LIMB = 6


def dedupe_last(df: DataFrame, keys: Sequence[str], ordinal: str, tie: Sequence[str] = ()) -> DataFrame:
    """Last record per key by ordinal, with the position of its first sighting as ``first_ordinal``.

    Only keys and ordinals are aggregated (map-side first); the wide rows are then
    kept or dropped by a join that never gathers the copies of a key. Where ordinals may
    repeat within a key, ``tie`` names columns that make the order total.
    """
    return join_shuffled(df, last_places(df, keys, ordinal, tie), [*keys, ordinal, *tie])


def last_places(df: DataFrame, keys: Sequence[str], ordinal: str, tie: Sequence[str] = ()) -> DataFrame:
    """Per key the ordinal and tie columns of its last record and ``first_ordinal``."""
    place = [ordinal, *tie]
    ends = df.groupBy(*keys).agg(F.max(F.struct(*place)).alias("_last"), F.min(ordinal).alias("first_ordinal"))
    return ends.select(*keys, "first_ordinal", *[F.col("_last")[c].alias(c) for c in place])


def one_each(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, then by a hash of the whole row, so repeats and ties are settled alike.

    Rows are ranked before the shuffle as well, so copies of one key are few when they meet."""
    rest = [c for c in df.columns if c not in keys]
    place = [*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*[F.col(c) for c in rest]).desc()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*place))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def keep_latest(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key. The rank limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest_per(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attributes of the newest row per key, from one aggregation."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("_newest")
    return df.groupBy(*key).agg(newest).select(*key, *[F.col("_newest")[v].alias(v) for v in values])


def build_versions(observations: DataFrame) -> DataFrame:
    """First observation of every distinct content of a posting."""
    return observations.groupBy("job_id", "content_hash").agg(
        F.min_by("snapshot_json", "observed_at").alias("snapshot_json"), F.min("observed_at").alias("observed_at")
    )


def fingerprint(df: DataFrame, group: Sequence[str], external_id: str = "external_id", content: str = "content_hash") -> DataFrame:
    """Order-independent 64-hex fingerprint of each group's (id, content) pairs.

    Every pair is hashed and the hashes are added up in limbs, an additive multiset
    hash: partial sums combine map-side, so a group of any size never meets in one task.
    """
    pair = F.concat(F.lit("["), quote_json(F.col(external_id)), F.lit(","), quote_json(F.col(content)), F.lit("]"))
    hashed = df.select(*group, F.sha2(pair, 256).alias("_h"))
    limbs = [
        F.sum(F.conv(F.substring("_h", start, _LIMB), 16, 10).cast("bigint")).alias(f"_s{start}")
        for start in range(1, 65, _LIMB)
    ]
    sums = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("posting_count"), *limbs)
    names = [f"_s{start}" for start in range(1, 65, _LIMB)]
    text = F.concat_ws(",", F.col("posting_count").cast("string"), *[F.col(n).cast("string") for n in names])
    return sums.select(*group, "posting_count", F.sha2(text, 256).alias("content_fingerprint"))


EMPTY_FINGERPRINT_INPUT = ",".join(["0"] * (1 + len(range(1, 65, _LIMB))))


def empty_fingerprint() -> Column:
    """Fingerprint of a source without any posting."""
    return F.sha2(F.lit(EMPTY_FINGERPRINT_INPUT), 256)


def presence_history(seen: DataFrame, runs: DataFrame, absences: int = 2) -> DataFrame:
    """Close and reopen history of every posting over the successful runs of its source.

    ``seen`` has ``source_id, external_id, run_at`` and ``runs`` has ``source_id, run_at``.
    One row per presence island: when it was first and last seen, how many runs it was
    then absent, and when the ``absences``-th absence closed it (NULL while still open).
    No key x run spine is built: runs are numbered per source and gaps are differences.
    """
    by_source = Window.partitionBy("source_id").orderBy("run_at")
    numbered = runs.select("source_id", "run_at").distinct().withColumn("run_no", F.row_number().over(by_source))
    closes_at = numbered.select("source_id", F.col("run_no").alias("_close_no"), F.col("run_at").alias("closed_at"))
    numbered = numbered.withColumn("_last_no", F.max("run_no").over(Window.partitionBy("source_id")))

    sightings = join_salted(
        seen.select("source_id", "external_id", "run_at").distinct(), numbered, ["source_id", "run_at"], ["external_id"]
    )
    key = ["source_id", "external_id"]
    timeline = Window.partitionBy(*key).orderBy("run_no")
    gaps = sightings.withColumn("_next", F.lead("run_no").over(timeline))
    gaps = gaps.withColumn("_absent", F.coalesce(F.col("_next") - 1, F.col("_last_no")) - F.col("run_no"))
    ends = gaps.withColumn("_ends", (F.col("_absent") >= absences) | F.col("_next").isNull())
    island = F.coalesce(F.sum(F.col("_ends").cast("int")).over(timeline.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = ends.withColumn("island", island).groupBy(*key, "island").agg(
        F.min("run_at").alias("first_seen"),
        F.max("run_at").alias("last_seen"),
        F.count(F.lit(1)).alias("runs_seen"),
        F.max("run_no").alias("_last_seen_no"),
        F.max(F.when(F.col("_ends"), F.col("_absent"))).alias("runs_absent"),
    )
    closing = F.when(F.col("runs_absent") >= absences, F.col("_last_seen_no") + absences)
    closed = join_salted(
        grouped.withColumn("_close_no", closing), closes_at, ["source_id", "_close_no"], ["external_id"], "left"
    )
    return (
        closed.select(*key, "island", "first_seen", "last_seen", "runs_seen", "runs_absent", "closed_at")
    )
