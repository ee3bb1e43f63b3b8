"""Presence of postings kept as state of a stream: what a run changes costs its own postings and the open ones, not the history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import Delta, Snapshot

PRESENCE = "source_id string, external_id string, island bigint, first_seen string, last_seen string, runs_seen bigint, closed_at string"
PRESENCE_KEY = ("source_id", "external_id", "island")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups over which the postings of one source are dealt.
SALTS = 32
_ENTRY = "island bigint, first_seen string, last_seen string, runs_seen bigint, absent bigint, open boolean"


def presence_input(sightings: DataFrame, runs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Sightings (``source_id, external_id, run_at``) and, once for each salt, the runs (``source_id, run_at``) of a stream."""
    salt = F.pmod(F.xxhash64("external_id"), F.lit(salts)).cast("int")
    seen = sightings.select("source_id", salt.alias("salt"), "run_at", "external_id")
    ticks = runs.select("source_id", F.explode(F.lit(list(range(salts)))).alias("salt"), "run_at", F.lit(None).cast("string").alias("external_id"))
    return seen.unionByName(ticks)


class Presence(StatefulProcessor):
    """Open and closed islands of the postings of one (source, salt).

    The state has an entry for each posting: its present island, how many runs it has been absent, and whether it is
    open. The runs of a micro-batch are taken in order: a posting seen is opened or goes on, one not seen is absent once
    more, and the absence that makes ``absences`` closes it. A run that is not newer than the last one taken is late and
    left alone. Every island that changes is emitted as it is after the batch."""

    def __init__(self, absences: int = 2):
        self.absences = absences

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "external_id string", _ENTRY)
        self.last_run = handle.getValueState("last_run", "run_at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        last = self.last_run.get()[0] if self.last_run.exists() else ""
        fresh = found[found["run_at"] > last]
        if fresh.empty:
            return
        held = {k[0]: list(v) for k, v in self.entries.iterator()}
        open_ = {k for k, v in held.items() if v[5]}
        changed, out = set(), {}
        for run, own in fresh.groupby("run_at", sort=True):
            seen = set(own["external_id"].dropna())
            for posting in seen:
                entry = held.get(posting)
                if entry is None or not entry[5]:
                    held[posting] = [entry[0] + 1 if entry else 0, run, run, 1, 0, True]
                    open_.add(posting)
                else:
                    entry[2], entry[3], entry[4] = run, entry[3] + 1, 0
                out[posting, held[posting][0]] = (*held[posting][:4], None)
            for posting in open_ - seen:
                entry = held[posting]
                entry[4] += 1
                if entry[4] >= self.absences:
                    entry[5] = False
                    open_.discard(posting)
                    out[posting, entry[0]] = (*entry[:4], run)
                changed.add(posting)
            changed |= seen
            last = run
        for posting in changed:
            self.entries.updateValue((posting,), tuple(held[posting]))
        self.last_run.update((last,))
        yield pd.DataFrame([(key[0], posting, *row) for (posting, _), row in out.items()], columns=[c.split()[0] for c in PRESENCE.split(", ")])

    def close(self) -> None:
        pass


def presence_changes(stream: DataFrame, absences: int = 2) -> DataFrame:
    """Islands that each micro-batch of `presence_input` rows opens, prolongs or closes."""
    return stream.groupBy("source_id", "salt").transformWithStateInPandas(Presence(absences), outputStructType=PRESENCE, outputMode="Update", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB provider; a running query keeps the one that it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def keep_presence(name: str = "presence"):
    """For `ingest.once`: a micro-batch's islands take the place of the stored ones."""

    def change(batch: DataFrame, _: int, at: Snapshot) -> dict[str, Delta]:
        return {name: Delta(batch)}

    return change
