"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.graph import components, forest
from postlens.llm.shared import Scratch, by_value

by_value(__name__)

BITS = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
BLOCK = 1 << 18


def fingerprint(text: str | None, words: int = 4) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles; no words give 0."""
    import xxhash

    found = WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    span = min(words, len(found))
    starts, stops = (ends - lengths)[: len(found) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        part = zip(starts[at : at + BLOCK], stops[at : at + BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprint_column(text: Column, words: int = 4) -> Column:
    """The fingerprint as a signed long."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            bits = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
            yield pd.Series(bits.view(np.int64))

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "long")(text)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of distance + 1 segments, so that the budget of a single segment is below one bit."""
    n = distance + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of different fingerprints in `prints.fp` with at most `distance` differing bits.

    Pigeonring: put the m = distance + 1 segments on a ring. If all differences sum to at most d, some segment
    starts a chain in which the first l segments differ in at most l * d / m bits together, for every l. The
    budgets of chains of one and two segments are below 1 and 2 bits: the first segment is equal and the second
    differs in at most one bit. So each fingerprint is filed once for each start under both segments, and looks
    up the same key and its one-bit neighbours; longer chains are checked on the pair before the full distance.
    """
    if not 1 <= distance <= 7:
        raise ValueError("distance must be from 1 to 7")
    ring = segments(distance)
    m = len(ring)
    fp = F.col("fp")

    def part(c: Column, at: tuple[int, int]) -> Column:
        return F.shiftrightunsigned(c, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1).cast("long"))

    filed, asked = [], []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % m]
        key = F.shiftleft(part(fp, first), second[1]).bitwiseOR(part(fp, second))
        filed.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
        asked += [F.struct(F.lit(i).alias("start"), key.bitwiseXOR(F.lit(x).cast("long")).alias("key")) for x in (0, *(1 << b for b in range(second[1])))]
    shelf = prints.select(fp.alias("b"), F.inline(F.array(*filed)))
    probe = prints.select(fp.alias("a"), F.inline(F.array(*asked)))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    # A pair may have chains from several starts; the first of them stands for it, so each pair comes out once.
    first = F.lit(None)
    for i in reversed(range(m)):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            total = total + F.bit_count(part(differing, ring[(i + length - 1) % m]))
            ok = ok & (total * m <= length * distance)
        first = F.when(ok, i).otherwise(first)
    pairs = probe.join(shelf, ["start", "key"]).where((F.col("a") < F.col("b")) & (F.col("start") == first) & (F.bit_count(differing) <= distance))
    return pairs.select("a", "b")


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document: doc_id, fp (signed long), fingerprint (hex), component_id.

    Documents with equal fingerprints form one class before anything is joined, so copies never make pairs.
    Null or empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated rows.
    A null doc_id never is a component_id; a component of only such rows has a null component_id."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(docs.select("doc_id", fingerprint_column(F.col("text"), words).alias("fp")), "prints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    members = components(forest(links(classes, distance)), scratch)
    labelled = classes.join(members.select(F.col("node").alias("fp"), "component"), "fp", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """The documents with one row of each near-duplicate group: that of the smallest doc_id.

    Columns stay as they are. Of repeated doc_ids in a group one row stays, the one with the smallest text.
    Groups of rows without a doc_id keep one row as well."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash-keep")
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    staged = docs.select(F.col("doc_id").alias("doc_id"), fingerprint_column(F.col("text"), words).alias("fp"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"), held.alias("row"))
    staged = scratch.keep(staged.withColumn("place", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "place")).alias("first")
    classes = scratch.keep(staged.groupBy("fp").agg(first), "classes")
    members = components(forest(links(classes.select("fp"), distance)), scratch)
    labelled = classes.join(members.select(F.col("node").alias("fp"), "component"), "fp", "left")
    kept = labelled.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    return staged.join(kept.select(F.col("first.place").alias("place")), "place", "left_semi").select("row.*")
