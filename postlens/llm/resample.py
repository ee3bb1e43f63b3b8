"""Importance resampling towards a target: documents drawn by how much their hashed n-grams look like the target's."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.shared import Scratch, by_value, partitions
from postlens.llm.tokenfiles import row_groups, text_bytes

by_value(__name__)

#: Stands before each text of a batch; no byte of UTF-8 text is like it.
SENTINEL = b"\xff"
#: A word (ASCII letters, once lowered, digits, and all that is not ASCII) or a sentinel.
TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
WORD = re.compile(rb"[0-9a-z\x80-\xfe]+")
BUCKETS, ORDER = 10_000, 3
#: Bytes of text that one regular expression passes over at a time.
BATCH = 1 << 20


def segments(column: pa.Array, context: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Joined texts of about BATCH bytes: (bytes, row of each text, words of context before the first).

    A text longer than a batch comes in parts that end between words; each part after the first begins with the last
    words of the part before it, as context."""
    at = 0
    for group in row_groups(column, BATCH):
        data, offsets = text_bytes(group)
        raw = data.tobytes().lower()
        if len(group) > 1 or len(raw) <= BATCH:
            cuts = offsets.tolist()
            yield SENTINEL + SENTINEL.join([raw[a:b] for a, b in zip(cuts, cuts[1:])]), at + np.arange(len(group)), 0
        else:
            start, carried = 0, []
            while start < len(raw):
                stop = start + BATCH
                while stop < len(raw) and WORD.match(raw, stop):
                    stop += 1
                part = b"\n".join([*carried, raw[start:stop]])
                yield SENTINEL + part, np.array([at]), len(carried)
                carried, start = last_words(part, context), stop
        at += len(group)


def last_words(text: bytes, n: int) -> list[bytes]:
    """The last n words of a text."""
    stop, out = len(text), []
    while stop and len(out) < n:
        if not WORD.match(text, stop - 1):
            stop -= 1
            continue
        start = stop
        while start and WORD.match(text, start - 1):
            start -= 1
        out.insert(0, text[start:stop])
        stop = start
    return out


def features(column: pa.Array, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word that is no context, row of each n-gram, bucket of each n-gram) for each batch of joined texts.

    One pass of a regular expression finds the words of all texts and the sentinels between them, whose places are the texts'
    offsets: a search among them tells which word is whose and the how manieth, and an n-gram that would begin before its
    text is masked. A bucket is the CRC-32 of the n-gram's bytes, one blank between words, modulo the number of buckets;
    that of n words is continued from that of the n - 1 before."""
    for text, rows, context in segments(column, order - 1):
        tokens = TOKEN.findall(text)
        begins, at = np.empty(len(rows), np.int64), -1
        for i in range(len(rows)):
            begins[i] = at = tokens.index(SENTINEL, at + 1)
        place = np.arange(len(tokens))
        owner = np.searchsorted(begins, place, "right") - 1
        place -= begins[owner] + 1
        # Those that end within the context were counted before.
        least = np.where(owner == 0, context, 0)
        of = rows[owner]
        following = [b"\x20" + w for w in tokens]
        crcs = list(map(zlib.crc32, tokens))
        kept = place >= least
        words, own, codes = of[kept], [of[kept]], [np.array(crcs, np.int64)[kept]]
        for n in range(1, min(order, len(tokens))):
            crcs = list(map(zlib.crc32, following[n:], crcs))
            kept = place[n:] >= np.maximum(n, least[n:])
            own.append(of[n:][kept])
            codes.append(np.array(crcs, np.int64)[kept])
        yield words, np.concatenate(own), np.concatenate(codes) % buckets


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. A task sends one row, which are summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, codes in features(batch.column(0), order, buckets):
                total += np.bincount(codes, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares of each bucket in the target and the source), in doubles."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of all features, for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n = batch.num_rows
            words, counts, weights = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for own, rows, codes in features(batch.column("text"), order, len(gain)):
                words += np.bincount(own, minlength=n)
                counts += np.bincount(rows, minlength=n)
                # Whole numbers far below 2^53 are exact as doubles.
                weights += np.bincount(rows, gain[codes], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(counts), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, per_cent: int, least_words: int, scratch: Scratch) -> DataFrame:
    """Add the rank of the documents that are drawn: the highest scores among those with enough words.

    Rows are dealt by ranges of their place in the order and numbered within a range; the sizes of the ranges, one number
    for each partition, give the rest, so nothing is ordered in one task and every rank is exact."""
    spark = scored.sparkSession
    keys = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    ordered = scored.withColumn("eligible", F.col("n_words") >= least_words).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    table = scratch.keep(ordered.withColumn("at", at), "ordered").withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = table.groupBy("part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("fit"))
    budget = F.floor(F.lit(per_cent) * F.sum("fit").over(Window.partitionBy()) / 100)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"), budget.alias("budget"))
    place = F.col("base") + F.col("nth") + 1
    rank = F.when(F.col("eligible") & (place <= F.col("budget")), place)
    return table.join(bases, "part").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 5, least_words: int = 20, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """Draw `per_cent` of the documents with at least `least_words` words, without replacement, by importance weights.

    Returns for every document: doc_id, n_features, weight, score and rank (1, 2, 3 in the order of the draw; null if not
    drawn). A document's weight sums the gains of its n-grams' buckets; Gumbel noise from a digest of seed and doc_id
    makes the highest scores a draw. Null and empty texts have no words and weight 0; a null doc_id counts as the text
    `null` in the digest and comes last among equal scores; rows with one doc_id have the same noise and are ranked one after another; an
    empty target or table gives gains by the smoothing alone or no rows. Only counts by bucket pass the driver."""
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # Dealing rows by ranges looks at them twice: once for the ranges, once for the rows.
    scored = scratch.keep(weighted(docs, gains).withColumn("score", F.col("weight") + noise), "scored")
    return drawn(scored, per_cent, least_words, scratch)
