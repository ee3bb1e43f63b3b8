"""Counts of postings kept by company and source from the changes of the postings, without reading the rest again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import Delta

ROLLUP = "company_id string, source_id string, postings bigint, open bigint, closed bigint, good bigint, score_sum bigint, groups binary"
ROLLUP_KEY = ("company_id", "source_id")
#: Sketches of 2^12 registers: their standard error is about 1.04 / 64 = 1.6 %.
REGISTERS = 12
# Fixed value: from this score on a posting is a good one.
GOOD = 70


def _measures() -> dict[str, Column]:
    open_ = F.col("status") == "open"
    return {
        "postings": F.lit(1),
        "open": open_.cast("int"),
        "closed": (~open_).cast("int"),
        "good": (open_ & (F.col("score") >= GOOD)).cast("int"),
        "score_sum": F.col("score"),
    }


def rollup(jobs: DataFrame) -> DataFrame:
    """The counts of all postings, by company and source; ``groups`` is a sketch of the distinct duplicate keys."""
    sums = [F.sum(c.cast("bigint")).alias(n) for n, c in _measures().items()]
    return jobs.groupBy(*ROLLUP_KEY).agg(*sums, F.hll_sketch_agg("dedupe_key", REGISTERS).alias("groups"))


def rollup_delta(stored: DataFrame, before: DataFrame, after: DataFrame) -> Delta:
    """What a change of postings changes in the stored counts.

    ``before`` are the stored rows of the postings that change or go, ``after`` the rows that take their place. Counts are
    taken off and added; a company and source without postings goes. Sketches can only grow: keys of postings that
    went stay in them until `rollup` builds the counts anew."""
    names = list(_measures())
    added, taken = rollup(after), rollup(before).withColumn("groups", F.lit(None).cast("binary"))
    taken = taken.select(*ROLLUP_KEY, *[(-F.col(n)).alias(n) for n in names], "groups")
    moved = added.unionByName(taken)
    kept = stored.join(moved.select(*ROLLUP_KEY).distinct(), list(ROLLUP_KEY), "left_semi")
    merged = kept.unionByName(moved).groupBy(*ROLLUP_KEY).agg(*[F.sum(n).alias(n) for n in names], F.hll_union_agg("groups").alias("groups"))
    return Delta(merged.filter("postings > 0"), gone=merged.filter("postings <= 0"))


def with_groups(counts: DataFrame) -> DataFrame:
    """The estimated number of distinct duplicate keys in place of their sketch."""
    return counts.withColumn("groups", F.hll_sketch_estimate("groups"))


def changed_postings(stored: DataFrame, change: Delta) -> DataFrame:
    """The stored rows of the postings that a change replaces or removes."""
    key = ["source_id", "external_id"]
    keys = change.rows.select(*key)
    if change.gone is not None:
        keys = keys.unionByName(change.gone.select(*key))
    return stored.join(keys, key, "left_semi")
