"""Near-duplicates by exact Jaccard similarity of word shingles: prefix filtering, then every candidate is computed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.graph import components, forest
from postlens.llm.shared import Scratch, by_value
from postlens.llm.simhash import LOWER, SEED, WORD

by_value(__name__)

#: Documents that are looked at for common shingles, which only order the prefixes; any order gives the same links.
LOOKED_AT, COMMON = 4_000, 1 << 16
#: Bits of a set's parities, which tell most pairs apart before their texts are fetched.
PARITIES = 2048
#: A round of leaders that joins fewer than one in so many of the open documents is the last one.
WORTH = 50
GROUP = 256


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of `words` words, or of the whole text if it has fewer."""
    import xxhash

    found = WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not found:
        return np.zeros(0, np.int64)
    digest, span = xxhash.xxh64_intdigest, min(words, len(found))
    each = np.fromiter((digest(w, SEED) for w in found), np.uint64, len(found))
    n = len(found) - span + 1
    mixed = np.full(n, span, np.uint64)
    for k in range(span):
        # Each position is mixed before the next is added, so the order of the words counts.
        mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in an order that has those of `common`, sorted, last. Two sets of at least the similarity share one."""
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    late = np.zeros(len(found), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate([found[~late], found[late]])[:n]


def parities(found: np.ndarray) -> np.ndarray:
    """Bit b tells whether an odd number of the shingles fall on b."""
    odd = np.bincount((found & (PARITIES - 1)), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The shingles that several of a sample of documents share, sorted."""
    share = min(1.0, LOOKED_AT / max(1, texts.count()))
    spread = texts.sample(share, SEED).select(F.explode(shingle_column(F.col("text"), words)).alias("shingle"))
    rows = spread.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON)
    return np.sort(np.array([r.shingle for r in rows.collect()], np.int64))


def in_groups(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A few hundred texts at a time, as their shingles take more room than they do."""
    return (texts.iloc[at : at + GROUP] for texts in batches for at in range(0, len(texts), GROUP))


def shingle_column(text: Column, words: int) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in in_groups(batches):
            yield pd.Series([shingles(t, words) for t in texts], dtype=object)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "array<long>")(text)


def sketch_column(text: Column, words: int, common: np.ndarray, similarity: float) -> Column:
    """The number of shingles, a digest of all of them, the prefix, and the parities."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in in_groups(batches):
            sets = [shingles(t, words) for t in texts]
            yield pd.DataFrame({
                "size": np.array([len(s) for s in sets], np.int32),
                "whole": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets],
                "prefix": pd.Series([prefix(s, common, similarity) for s in sets], dtype=object),
                "bits": pd.Series([parities(s) for s in sets], dtype=object),
            })

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, "size int, whole string, prefix array<long>, bits array<long>")(text)


def similar_links(filed: DataFrame, bits: DataFrame, texts: DataFrame, similarity: float, words: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes that chains of links join; a link is a similarity that was computed.

    `filed` has (shingle, node, size) for every shingle of a prefix, `bits` has (node, size,
    bits) and `texts` (node, text). In each round a shingle's
    nodes are compared with one of them, drawn anew, unless a chain joins the two already, so a group of many near
    copies costs its size a round. When rounds join little more, all pairs left of a shingle that no chain joins are compared."""
    several = filed.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    filed = scratch.keep(filed.join(several, "shingle"), "filed")
    t = F.lit(similarity)
    near = F.least("a_size", "b_size") >= t * F.greatest("a_size", "b_size") - 1e-9

    def computed(pairs: DataFrame, name: str) -> DataFrame:
        sides = [bits.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")) for c in ("a", "b")]
        both = pairs.distinct().join(sides[1], "b").join(sides[0], "a")
        # Both sets' parities differ in at most as many bits as the sets do in shingles.
        differing = sum((F.bit_count(F.get("a_bits", F.lit(i)).bitwiseXOR(F.get("b_bits", F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
        both = scratch.keep(both.where(differing <= (1 - t) / (1 + t) * (F.col("a_size") + F.col("b_size")) + 1e-6).select("a", "b"), f"likely-{name}")
        nodes = scratch.keep(both.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"nodes-{name}")
        sets = texts.join(nodes, "node", "left_semi").select("node", shingle_column(F.col("text"), words).alias("found"))
        sets = scratch.keep(sets, f"sets-{name}")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("found").alias("b_found")), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("found").alias("a_found")), "a")
        shared = F.size(F.array_intersect("a_found", "b_found"))
        out = scratch.keep(both.where(shared * (1 + t) >= t * (F.size("a_found") + F.size("b_found")) - 1e-9).select("a", "b"), f"links-{name}")
        scratch.drop(f"sets-{name}")
        return out

    links, named, turn = [], None, 0
    while True:
        turn += 1
        state = filed.withColumn("component", F.col("node")) if named is None else filed.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = state.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("drawn"), "node", "size", "component")).alias("leader"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        state = state.join(mixed.select("shingle", F.col("leader.node").alias("a"), F.col("leader.size").alias("a_size"), F.col("leader.component").alias("own")), "shingle")
        open_nodes = state.where("component != own")
        pairs = open_nodes.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), "a_size", F.col("size").alias("b_size")).where(near).select("a", "b")
        new = computed(pairs, str(turn))
        links.append(new)
        joined, before = new.count(), named
        if joined:
            named = scratch.keep(components(forest(union(links)), Scratch(scratch.spark, "similar-groups")), f"groups-{turn}")
        gained = joined and named.count() - (before.count() if before is not None else 0)
        if gained * WORTH <= (named.count() if named is not None else 0):
            break
    left = filed if named is None else filed.join(named, "node", "left")
    left = left.withColumn("component", F.coalesce("component", "node") if named is not None else F.col("node"))
    mixed = left.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    left = scratch.keep(left.join(mixed, "shingle"), "left")
    one = left.select("shingle", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("a_component"))
    two = left.select("shingle", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("component").alias("b_component"))
    rest = one.join(two, "shingle").where((F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")) & near).select("a", "b")
    links.append(computed(rest, "rest"))
    return components(forest(union(links)), Scratch(scratch.spark, "similar-groups"))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out


def keep_distinct(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The documents with one row of each group that chains of at least `similarity` join: that of the smallest doc_id.

    The similarity is the Jaccard similarity of the sets of shingles; every pair that reaches it is linked and no
    other is. Columns stay as they are. Texts without words are equal. Of repeated doc_ids in a group one row
    stays, the one with the smallest text. Groups of rows without a doc_id keep one row as well."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    common = common_shingles(docs.select("text"), words)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    staged = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), held.alias("row"), sketch_column(F.col("text"), words, common, similarity).alias("sketch"))
    staged = staged.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "row", "sketch", F.monotonically_increasing_id().alias("place"))
    staged = scratch.keep(staged, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "place")).alias("first")
    classes = scratch.keep(staged.groupBy(F.col("sketch.whole").alias("whole")).agg(first), "classes")
    chosen = staged.join(classes.select(F.col("first.place").alias("place")), "place", "left_semi")
    filed = chosen.select(F.explode("sketch.prefix").alias("shingle"), F.col("place").alias("node"), F.col("sketch.size").alias("size"))
    bits = staged.select(F.col("place").alias("node"), F.col("sketch.size").alias("size"), F.col("sketch.bits").alias("bits"))
    members = similar_links(filed, bits, staged.select(F.col("place").alias("node"), F.col("row.text").alias("text")), similarity, words, scratch)
    labelled = classes.withColumn("node", F.col("first.place")).join(members, "node", "left")
    kept = labelled.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    return staged.join(kept.select(F.col("first.place").alias("place")), "place", "left_semi").select("row.*")
