"""Best-fit packing: few sequences, documents cut only where one sequence can't hold them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.shared import Scratch, by_value, partitions
from postlens.llm.tokenfiles import id_type, read_ids, shard_writer

by_value(__name__)

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


class Bins:
    """Runs of equal sequences by the room that is left in them, and the slots that pieces have been given.

    A slot (length, first rank, sequence, per sequence, offset) takes consecutive ranks of one length: so many
    to each sequence, side by side from the offset."""

    def __init__(self):
        self.made, self.gaps, self.runs, self.slots = 0, [], {}, []

    def keep(self, first: int, n: int, gap: int) -> None:
        if n and gap:
            if gap not in self.runs:
                insort(self.gaps, gap)
            self.runs.setdefault(gap, []).append((first, n))

    def open(self, n: int) -> int:
        self.made += n
        return self.made - n

    def least(self, size: int) -> int | None:
        """The smallest gap that holds `size`."""
        at = bisect_left(self.gaps, size)
        return self.gaps[at] if at < len(self.gaps) else None

    def take(self, gap: int) -> tuple[int, int]:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.gaps.remove(gap)
        return run


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The slots of counts[length] pieces of each length, sorted by length and first rank, and the number of sequences.

    Lengths above a third of the capacity are matched first, longest first: each goes with the longest other one that
    still fits, two to a sequence at most as three can't fit. Shorter ones follow, longest first, each into the
    smallest gap that holds it; a sequence is opened only where no gap does. Equal lengths are dealt out together, so
    work and result depend on the capacity alone: a slot uses up a run of equal gaps or a length, and a gap that took
    all it can of a length has less than half of its room left, so there are O(capacity x log capacity) slots
    however many documents there are."""
    left, bins = counts.astype(np.int64).tolist(), Bins()
    rank = [0] * (capacity + 1)

    def deal(size: int, n: int, first: int, each: int, offset: int) -> None:
        bins.slots.append((size, rank[size], first, each, offset))
        rank[size] += n
        left[size] -= n

    large = [s for s in range(capacity // 3 + 1, capacity + 1) if left[s]]
    while large:
        size = large[-1]
        fits = bisect_right(large, capacity - size)
        mate = large[fits - 1] if fits else None
        if mate == size and left[size] == 1:
            mate = large[-2] if len(large) > 1 else None
        if mate is None:
            n = left[size]
            first = bins.open(n)
            deal(size, n, first, 1, 0)
        elif mate == size:
            n = left[size] // 2
            first = bins.open(n)
            deal(size, 2 * n, first, 2, 0)
        else:
            n = min(left[size], left[mate])
            first = bins.open(n)
            deal(size, n, first, 1, 0)
            deal(mate, n, first, 1, size)
        bins.keep(first, n, capacity - size - (mate or 0))
        for s in {size, mate or size}:
            if not left[s]:
                large.remove(s)
    for size in range(capacity // 3, 0, -1):
        while left[size]:
            gap = bins.least(size)
            if gap is None:
                n = -(-left[size] // (capacity // size))
                bins.keep(bins.open(n), n, gap := capacity)
            first, n = bins.take(gap)
            each = min(gap // size, left[size])
            used = min(n, left[size] // each)
            deal(size, used * each, first, each, capacity - gap)
            bins.keep(first, used, gap - each * size)
            bins.keep(first + used, n - used, gap)
    slots = np.array(sorted(bins.slots), np.int64).reshape(-1, 5)
    return slots, bins.made


def cut_writer(folder: str, path: str, capacity: int, end_id: int):
    """Per piece: doc_id, piece, start, length, where its ids lie, and its number among the file's pieces of that length."""
    write = shard_writer(folder, path, ["doc_id"], end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in write(batches):
            tokens, place = batch.column("n_tokens").to_numpy(), batch.column("place").to_numpy()
            pieces = -(-tokens // capacity)
            row = np.repeat(np.arange(len(tokens)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(tokens[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            own = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - (np.cumsum(own) - own)[length[order]]
            nth += seen[length]
            seen += own
            made = [piece.astype(np.int32), start, length, place[row] + start, nth]
            names = ["doc_id", "file", "piece", "start", "length", "place", "nth"]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("file").take(at), *map(pa.array, made)], names=names)

    return cut


def pack_best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Every document in sequences of at most `capacity` tokens, as few as `plan` needs.

    One row for each piece: doc_id, piece (from 0), start (its document's ids before it), length, sequence_id, offset
    (its place there; the pieces of a sequence lie in it without gaps from 0) and ids (unsigned 32-bit little-endian).
    Documents are encoded by the tokenizer file `path`, the end id is appended, and only what is longer than the
    capacity is cut, into full pieces and a rest. Null texts are empty and give their end id alone; null doc_ids are
    kept; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.

    Only the number of pieces of each length, at most `capacity` numbers, goes through the driver. A piece finds its
    slot by its rank among the pieces of its length: its number within its file plus those of the files before it."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "bestfit")
    folder, dtype = scratch.path("ids"), id_type(path)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = "doc_id long, file string, piece int, start long, length long, place long, nth long"
    pieces = scratch.keep(columns.mapInArrow(cut_writer(folder, path, capacity, end_id), made), "pieces")
    shares = scratch.keep(pieces.groupBy("file", "length").agg(F.count("*").alias("n")), "shares")
    counts = np.zeros(capacity + 1, np.int64)
    for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    slots, _ = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("file", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["file", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, name, ids = sent.value, None, None
        # Lengths come before ranks in one key; a rank stays below 2^48.
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = table[np.searchsorted(keys, (size << 48) + rank, "right") - 1]
            nth, each = rank - slot[:, 1], slot[:, 3]
            own = []
            for file, at, n in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), size.tolist()):
                if file != name:
                    name, ids = file, read_ids(folder, file, dtype)
                own.append(ids[at : at + n].astype("<u4").tobytes())
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slot[:, 2] + nth // each), pa.array(slot[:, 4] + nth % each * size), pa.array(own, pa.binary())], names=[c.split()[0] for c in PIECES.split(", ")])

    # Rows of a file meet again, so a task maps few files.
    return ranked.repartition(partitions(spark), "file").sortWithinPartitions("file", "place").mapInArrow(place, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the packed pieces: the ids of each sequence's pieces one behind the other.

    A group holds one sequence, at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda all_, p: F.concat(all_, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
