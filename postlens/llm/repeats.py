"""Removal of byte strings that occur more than once in a corpus, by suffix arrays over shards of shared text."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postlens.llm.shared import Scratch, by_value, filesystem, partitions
from postlens.llm.suffixarray import repeated_starts

by_value(__name__)

GRAM = 32
CHUNK = 1 << 20
SHARD = 1 << 20
#: Groups with more distinct texts than this are compared by window digests instead of in one suffix array.
HOT = 20_000
MERS = "file string, row int, start int, n int, m long, h long, multi boolean"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM consecutive bytes, by doubling."""
    table = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
    h, span, factor = table[data], 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor, span = (factor * factor + 2) % (1 << 64), span * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs_of(data: bytes, bounds: np.ndarray, length: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(text, start, n, m, h, multi): the runs of consecutive `length`-byte windows with the same smallest gram.

    `bounds` are the begins of the texts in `data` and its end. m is that gram's hash, h the hash of the run's
    bytes; multi tells that the gram occurs in the run more than once, as it must where a run repeats itself.
    Equal windows have equal m wherever they stand."""
    import xxhash

    raw = np.frombuffer(data, np.uint8)
    if len(raw) < length:
        return []
    h = gram_hashes(raw)
    width = length - GRAM + 1
    least, span = h, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(h) - width + 1], least[width - span :])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[: len(least)] == text[length - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    begin = at[first]
    m = least[begin]
    spans = n + width - 1
    edge = np.cumsum(spans) - spans
    grams = np.repeat(begin - edge, spans) + np.arange(spans.sum())
    multi = np.add.reduceat((h[grams] == np.repeat(m, spans)).astype(np.int32), edge) > 1
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(data[a:b]) for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist())]
    starts = begin - bounds[text[begin]]
    return list(zip(text[begin].tolist(), starts.tolist(), n.tolist(), m.view(np.int64).tolist(), np.array(hashes, np.uint64).view(np.int64).tolist(), multi.tolist()))


def all_runs(texts: list[bytes], length: int) -> list[tuple[int, int, int, int, int, bool]]:
    """Runs of several texts, hashed CHUNK bytes at a time; a run that a chunk cuts becomes two, which is as good."""
    out, group, size = [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            bounds = np.concatenate([[0], np.cumsum([len(b) for _, _, b in group])])
            for i, start, *rest in runs_of(b"".join(b for _, _, b in group), bounds, length):
                out.append((group[i][0], group[i][1] + start, *rest))
        group, size = [], 0

    for i, data in enumerate(texts):
        for a in range(0, max(1, len(data) - length + 1), CHUNK):
            part = data[a : a + CHUNK + length - 1]
            if len(part) >= length:
                group.append((i, a, part))
                size += len(part)
            if size >= CHUNK:
                flush()
    flush()
    return out


class Shelf:
    """A file of texts in the shared folder, read forwards."""

    def __init__(self, folder: str, name: str):
        import pyarrow.parquet as pq

        files, at = filesystem(folder)
        self.rows = (r for b in pq.ParquetFile(files.open_input_file(f"{at}/{name}")).iter_batches(256) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        self.at, self.now = -1, (None, b"")

    def text(self, row: int) -> bytes:
        while self.at < row:
            self.now, self.at = next(self.rows), self.at + 1
        return self.now[1]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def windows_found(members: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, list[dict]]]:
    """For the texts of some groups: the ranges of windows that also start elsewhere among them."""
    symbols = np.concatenate([x for _, _, data in members for x in (np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0])])
    found = repeated_starts(symbols, length)
    out, at = [], 0
    for m, h, data in members:
        own = found[at : at + len(data) - length + 1]
        at += len(data) + 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        out.append((m, h, [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2])]))
    return out


def cut_repeats(docs: DataFrame, length: int = 200, hot: int = HOT, scratch: Scratch | None = None, keep_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `text` if asked for).

    A byte goes if a string of `length` bytes over it also starts anywhere else; matches never cross documents
    and are judged on the input. Null texts are empty, shorter texts lose nothing, repeated rows lose all that
    is long enough.

    1. Texts are cut into runs of windows with the same smallest gram; equal windows get the same gram, so
       only runs of one gram need comparing. A gram that occurs once is done with.
    2. Runs of equal bytes are one text with a count. Where all runs of a gram are equal, all are removed.
    3. Of the other grams one text for each distinct run is fetched, dealt out by gram, and sorted: suffix arrays
       by induced sorting over SHARD bytes at a time, whose permuted common prefixes tell the repeated windows.
       A gram with over `hot` distinct runs is not brought together: digests of its windows are counted instead.
    Texts wait in files of the shared folder, written by the tasks that read them, so they are never shuffled."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    folder = scratch.path("texts")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        task = TaskContext.get()
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        name, row = f"{task.partitionId():07d}-{task.taskAttemptId()}.parquet", 0
        kept = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
        made = pa.schema([("file", pa.string()), ("row", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("m", pa.int64()), ("h", pa.int64()), ("multi", pa.bool_())])
        with files.open_output_stream(f"{at}/{name}") as out, pq.ParquetWriter(out, kept, compression="zstd") as writer:
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    batch = whole.slice(a, 1024)
                    texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
                    writer.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], schema=kept))
                    found = [(name, row + i, *rest) for i, *rest in all_runs(texts, length)]
                    row += len(texts)
                    yield batch_of(found, made)
        # Stands for the file itself, so that files without repeats are read in the end as well.
        yield batch_of([(name, -1, 0, 0, 0, 0, False)], made)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mers = scratch.keep(narrow.mapInArrow(first, MERS), "mers")
    real = mers.where("row >= 0")
    groups = real.groupBy("m").agg(F.count("*").alias("times"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.max("multi").alias("self"))
    groups = groups.where("times > 1 or self").select("m", (F.col("self") | (F.col("h0") != F.col("h1"))).alias("mixed"))
    shared = scratch.keep(real.drop("multi").join(groups, "m"), "shared")
    texts = shared.where("mixed").groupBy("m", "h").agg(F.count("*").alias("times"), F.min(F.struct("file", "row", "start", "n")).alias("at"))
    sizes = texts.groupBy("m").agg(F.count("*").alias("kinds"))
    texts = texts.join(sizes, "m").select("m", "h", "times", (F.col("kinds") > hot).alias("hot"), "at.*")
    n = partitions(spark)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("times", pa.int64()), ("hot", pa.bool_()), ("data", pa.binary())])
        for name, rows in itertools.groupby(rows_of(batches), key=lambda r: r[4]):
            shelf, out, size = Shelf(folder, name), [], 0
            for m, h, times, is_hot, _, row, start, k in rows:
                out.append((m, h, times, is_hot, shelf.text(row)[start : start + k + length - 1]))
                size += len(out[-1][4])
                if size >= SHARD:
                    yield batch_of(out, made)
                    out, size = [], 0
            yield batch_of(out, made)

    placed = texts.repartition(n, "file").sortWithinPartitions("file", "row", "start")
    fetched = scratch.keep(placed.mapInArrow(fetch, "m long, h long, times long, hot boolean, data binary"), "fetched")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("spans", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])
        held, size, last = [], 0, None
        for m, h, data in rows_of(batches):
            if size >= SHARD and m != last:
                yield batch_of(windows_found(held, length), made)
                held, size = [], 0
            held.append((m, h, data))
            size, last = size + len(data), m
        if held:
            yield batch_of(windows_found(held, length), made)

    spans = "m long, h long, spans array<struct<low:int,high:int>>"
    cold = fetched.where("not hot").select("m", "h", "data").repartition(n, "m").sortWithinPartitions("m", "h")
    sorted_spans = cold.mapInArrow(sort, spans)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("low", pa.int32()), ("digest", pa.binary())])
        for m, h, data in rows_of(batches):
            yield batch_of([(m, h, i, hashlib.sha256(data[i : i + length]).digest()) for i in range(len(data) - length + 1)], made)

    counted = fetched.where("hot").select("m", "h", "data").mapInArrow(digests, "m long, h long, low int, digest binary")
    often = counted.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    single = F.struct("low", (F.col("low") + 1).alias("high"))
    hot_spans = counted.join(often, "digest").groupBy("m", "h").agg(F.collect_list(single).alias("spans"))
    partial = sorted_spans.unionByName(hot_spans)
    # A run that occurs as a whole elsewhere goes as a whole; else the windows found in its text go.
    decided = fetched.select("m", "h", (F.col("times") > 1).alias("whole")).join(partial, ["m", "h"], "left")
    decided = scratch.keep(decided, "decided")
    every = F.array(F.struct(F.lit(0).alias("low"), F.col("n").alias("high")))
    plain = shared.where("not mixed").select("file", "row", "start", every.alias("spans"))
    mixed = shared.where("mixed").join(decided, ["m", "h"]).select("file", "row", "start", F.when(F.col("whole"), every).otherwise(F.col("spans")).alias("spans"))
    marks = plain.unionByName(mixed).select("file", "row", "start", F.inline("spans"))
    marks = marks.select("file", "row", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + length - 1).alias("high"))
    marks = marks.union(mers.where("row < 0").select("file", "row", "start", "n"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if keep_text else [])])
        for name, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            shelf, out = Shelf(folder, name), []
            marked = itertools.groupby((r for r in rows if r[1] >= 0), key=lambda r: r[1])
            row, ranges = next(marked, (None, ()))
            for at in itertools.count():
                try:
                    data = shelf.text(at)
                except StopIteration:
                    break
                kept, end, removed, n_spans = [], 0, 0, 0
                if at == row:
                    low = high = None
                    for _, _, a, b in itertools.chain(ranges, [(0, 0, len(data) + 1, 0)]):
                        if low is not None and a <= high:
                            high = max(high, b)
                            continue
                        if low is not None:
                            kept.append(data[end:low])
                            end, removed, n_spans = high, removed + high - low, n_spans + 1
                        low, high = a, b
                    row, ranges = next(marked, (None, ()))
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((shelf.now[0], len(data), removed, n_spans, hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "replace")] if keep_text else [])))
                if len(out) >= 1024:
                    yield batch_of(out, made)
                    out = []
            yield batch_of(out, made)

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if keep_text else "")
    return marks.repartition(n, "file").sortWithinPartitions("file", "row", "low", "high").mapInArrow(finish, result)
