"""Packing of documents into sequences whose sources keep their target token proportions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.shared import Scratch, by_value, partitions, running_start
from postlens.llm.tokenfiles import crc, id_type, read_ids, shard_writer

by_value(__name__)

BUCKETS = 1024
ROUNDS_PER_BLOCK = 1024
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def queues(tokens: DataFrame, window: int, weights: dict[str, float] | None) -> DataFrame:
    """(name, queue, quantum) of every source, a null one included.

    A quantum is what a queue may send in a round: its share of a window, as given by `weights` (by source, any
    scale; a source that is not named weighs its own share), else its share of all tokens. A weight that no source
    has or that is no finite number from zero on is an error."""
    sums = tokens.groupBy(F.col("source").alias("name")).agg(F.sum("n_tokens").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 1
    given = [(name, float(w)) for name, w in (weights or {}).items()]
    wanted = sums.withColumn("weight", F.lit(None).cast("double"))
    if given:
        table = tokens.sparkSession.createDataFrame(given, "given string, weight double")
        unknown = table.join(sums, F.col("given").eqNullSafe(F.col("name")), "left_anti").collect()
        wrong = [r.given for r in unknown] + [name for name, w in given if not 0 <= w < math.inf]
        if wrong:
            raise ValueError(f"weights that can't be applied: {wrong}")
        wanted = sums.join(table, F.col("given").eqNullSafe(F.col("name")), "left").drop("given")
    wanted = wanted.withColumn("share", F.coalesce("weight", F.col("n") / F.lit(total)))
    scale = wanted.agg(F.sum("share")).first()[0] or 1
    quantum = F.greatest(F.lit(window) * F.col("share") / F.lit(scale), F.when(F.col("weight").isNull(), 1e-9).otherwise(1e-3))
    return wanted.select("name", F.coalesce(F.concat(F.lit("="), "name"), F.lit("")).alias("queue"), quantum.alias("quantum"))


def schedule(tokens: DataFrame, window: int, weights: dict[str, float] | None, segment: int) -> DataFrame:
    """Add to each segment of a document its position in the stream that the queues send.

    Deficit round-robin: in each round a queue's credit grows by its quantum, and it sends the segments that its
    credit covers; the rest is carried on. A backlogged queue has sent, after r rounds, exactly the segments that
    end within r quanta of its start, so a segment's round follows from the queue's running total and all
    queues can be scheduled at once, over any number of partitions. When a queue is empty the others go on in
    their proportions. Segments are at most `segment` tokens long, so no document holds a window alone."""
    placed = tokens.join(queues(tokens, window, weights), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    placed = placed.withColumn("mix", F.xxhash64("file", "place"))
    placed = placed.withColumn("bucket", F.shiftrightunsigned("mix", 64 - BUCKETS.bit_length() + 1))
    placed = placed.withColumn("mix", F.shiftrightunsigned("mix", 1))
    lined = running_start(placed, ["queue"], "bucket", ["mix", "file", "place"], "n_tokens", "queued")
    cut = lined.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(segment).cast("long"))))
    cut = cut.withColumn("size", F.least(F.lit(segment).cast("long"), F.col("n_tokens") - F.col("at")))
    due = F.col("queued") + F.col("at") + F.col("size")
    cut = cut.withColumn("round", F.greatest(F.ceil(due / F.col("quantum")) - 1, F.lit(0)).cast("long"))
    cut = cut.withColumns({"span": F.floor(F.col("round") / ROUNDS_PER_BLOCK), "sent": F.col("queued") + F.col("at")})
    return running_start(cut, [], "span", ["round", "queue", "sent"], "size", "position").select("doc_id", "source", "n_tokens", "file", "place", "at", "size", "position")


def tail_cuts(total: int, window: int) -> list[int]:
    """Where the sequences after the last full window begin: their lengths are falling powers of two, unpadded."""
    cuts, at = [], total - total % window
    for bit in reversed(range(window.bit_length())):
        if (total % window) >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    return cuts


def cut_points(start: int, end: int, window: int, tail: list[int], full: int) -> list[tuple[int, int, int, int]]:
    """(from, to, sequence, begin of the sequence) of the parts of a stream range."""
    out = []
    while start < end:
        if start < full:
            sequence, begin = start // window, start // window * window
            stop = min(begin + window, end)
        else:
            k = max(i for i, x in enumerate(tail) if x <= start)
            sequence, begin = full // window + k, tail[k]
            stop = min(tail[k + 1], end) if k + 1 < len(tail) else end
        out.append((start, stop, sequence, begin))
        start = stop
    return out


def pack(docs: DataFrame, path: str, window: int = 4096, weights: dict[str, float] | None = None, segment: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """One row for each piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document (the end id included) lies in one piece; a sequence's pieces lie in it without
    gaps from offset 0. All sequences but the last few are full; those have lengths of falling powers of two, so
    nothing is padded. Null texts are empty and give their end id alone; null doc_ids and sources are kept, a
    null source being a source of its own; repeated rows are documents of their own."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    folder, dtype = scratch.path("ids"), id_type(path)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    made = columns.mapInArrow(shard_writer(folder, path, ["doc_id", "source"]), "doc_id long, source string, n_tokens long, file string, place long")
    tokens = scratch.keep(made, "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    full, tail = total - total % window, tail_cuts(total, window)
    sent = schedule(tokens, window, weights, segment)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, ids = r["file"], read_ids(folder, r["file"], dtype)
                for a, b, sequence, begin in cut_points(r["position"], r["position"] + r["size"], window, tail, full):
                    start = r["at"] + a - r["position"]
                    own = ids[r["place"] + start : r["place"] + start + b - a]
                    rows.append((r["doc_id"], r["source"], start, b - a, crc(own), r["n_tokens"], sequence, a - begin))
            types = [pa.int64(), pa.string(), *[pa.int64()] * 6]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PIECES.split(", ")])

    # Rows of a file meet again, so a task maps few files; a file's rows may be split, for each only reads its ids.
    return sent.repartition(partitions(spark), "file").sortWithinPartitions("file", "place", "at").mapInArrow(cut, PIECES)
