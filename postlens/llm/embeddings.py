"""Near-duplicate embeddings: rotated binary codes decide which pairs need their cosine computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.graph import components, roots
from postlens.llm.shared import Scratch, by_value, partitions

by_value(__name__)

TILE = 1024
MEMBERS = "row long, vec_id long, data binary, copies long"


class Codes:
    """Codes of one bit for each dimension of randomly rotated unit vectors, with their correction factors.

    A code stands for the unit vector c of the signs of the rotated vector v by the root of d. For any unit q,
    <c, q> / <c, v> is an unbiased estimate of <v, q> over the rotations, and misses it by more than
    `sigmas` * sqrt((1 - <c, v>^2) / (d - 1)) / <c, v> with a probability that falls as a Gaussian's tail in
    `sigmas`. <c, v> is the correction factor stored with each code."""

    def __init__(self, dimension: int, sigmas: float, seed: int = 17):
        self.dimension, self.sigmas = dimension, sigmas
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))[0]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed signs, correction factors)."""
        rotated = unit @ self.rotation
        return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(1) / np.sqrt(self.dimension)

    def candidates(self, queries: np.ndarray, bits: np.ndarray, factors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, coded vector) whose inner product may reach `least` within the bound."""
        signs = np.unpackbits(bits, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        inner = (queries @ self.rotation).astype(np.float32) @ signs.T / np.float32(np.sqrt(self.dimension))
        spread = self.sigmas * np.sqrt(np.maximum(0, 1 - factors**2) / max(1, self.dimension - 1))
        return np.nonzero(inner >= (least * factors - spread).astype(np.float32)[None, :])


def unit_vectors(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.permutation(len(sample))[:n]]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def near_vectors(table: DataFrame, least: float = 0.95, sample: int = 16_384, per_cell: int = 128, probes: int = 6, sigmas: float = 4.0, scratch: Scratch | None = None) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of `least` or more (double precision) are linked. Null, zero and empty vectors, and
    those with a null or a non-finite component, link with nothing; vectors of different lengths don't either.

    Equal vectors are one class with a count. Centres are fitted on the `sample` classes that are first by hash,
    `per_cell` classes of the whole table for each, and at most a quarter of the sample; every class is filed in
    its nearest cell and asks its `probes` nearest. A cell is worked on in tiles of TILE queries by TILE members,
    so a crowded cell is many tasks' work. In a tile, estimates from the members' codes drop pairs that can't
    reach the threshold, and the cosine of all others is computed. A tile returns, for each class, the number of
    vectors linked and a spanning forest of the links, never the links. A pair that is found from both sides is
    counted from both sides, one that is found from one side only is counted for both."""
    spark = table.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    usable = F.size("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0)))), "rows")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("row").alias("row"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, ends = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), "<f8"), np.cumsum([0, *lists.value_lengths().to_pylist()])
            data = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(data, pa.binary()), batch.column("copies")], names=["row", "vec_id", "data", "copies"])

    classes = scratch.keep(classes.mapInArrow(pack, MEMBERS), "classes")
    parts = []
    for size, n in sorted(tuple(r) for r in classes.groupBy(F.length("data").alias("size")).count().collect()):
        own = classes.where(F.length("data") == size)
        parts.append(_links_of(own, n, size // 8, least, sample, per_cell, probes, sigmas, scratch, f"tiles-{size}"))
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "row long, linked long, root long")
    found = scratch.keep(found, "found")
    counts = found.groupBy("row").agg(F.sum("linked").alias("linked"))
    member = components(found.where("root != row").select("row", "root"), scratch)
    named = classes.select("row", "vec_id", "copies").join(counts, "row", "left").join(member.withColumnRenamed("node", "row"), "row", "left")
    named = named.withColumn("component", F.coalesce("component", "row"))
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least_id, "component").select(F.col("row").alias("class"), "copies", F.coalesce("linked", F.lit(0)).alias("linked"), "component_id")
    # Each vector finds its class by the vector itself.
    keyed = rows.where("v is not null").select("vec_id", "v").join(rows.select(F.col("v"), "row").where("v is not null").groupBy("v").agg(F.min("row").alias("class")), "v")
    linked = keyed.join(named, "class").select("vec_id", (F.col("linked") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of(classes: DataFrame, n: int, dimension: int, least: float, sample: int, per_cell: int, probes: int, sigmas: float, scratch: Scratch, name: str) -> DataFrame:
    """(row, linked, root) for classes of one dimension: parts of the number of vectors linked, and forest links."""
    chosen = classes.orderBy(F.xxhash64("row"), "row").limit(sample).select("data").toArrow()
    units = unit_vectors(chosen.column("data").to_pylist())
    centres = centres_of(units, int(min(max(1, n // per_cell), max(1, len(units) // 4)))).astype(np.float32)
    probes = min(probes, len(centres))
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    codes = Codes(dimension, sigmas)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, TILE):
                batch = whole.slice(a, TILE)
                near = unit_vectors(batch.column("data").to_pylist()).astype(np.float32) @ shared.value.T
                cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                order = np.take_along_axis(near, cells, 1).argmax(1)
                home = cells[np.arange(len(cells)), order]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["row", "vec_id", "data", "copies", "home", "cells"])

    placed = scratch.keep(classes.mapInArrow(place, MEMBERS + ", home int, cells array<int>"), f"{name}-placed")
    # Tiles of a cell: members and queries are dealt out by hash, a number of tiles each as the cell's sizes ask.
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    asking = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("queries"))
    tiles = members.join(asking, "cell").select("cell", F.ceil(F.col("members") / TILE).cast("int").alias("mt"), F.ceil(F.col("queries") / TILE).cast("int").alias("qt"))
    own = lambda t: F.pmod(F.xxhash64("row"), F.col(t)).cast("int")
    base = ["row", "data", "copies", "home", "cells"]
    filed = placed.withColumn("cell", F.col("home")).join(tiles, "cell").select(*base, "cell", own("mt").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qt") - 1)).alias("q"), F.lit(True).alias("member"))
    asked = placed.withColumn("cell", F.explode("cells")).join(tiles, "cell").select(*base, "cell", F.explode(F.sequence(F.lit(0), F.col("mt") - 1)).alias("m"), own("qt").alias("q"), F.lit(False).alias("member"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        shelf, probe = group[group["member"]], group[~group["member"]]
        if not len(shelf) or not len(probe):
            return pd.DataFrame({"row": [], "linked": [], "root": []}).astype("int64")
        v, w = unit_vectors(list(shelf["data"])), unit_vectors(list(probe["data"]))
        a, b = codes.candidates(w, *codes.encode(v), least)
        rows_q, rows_m = probe["row"].to_numpy(), shelf["row"].to_numpy()
        other = rows_q[a] != rows_m[b]
        a, b = a[other], b[other]
        cosine = np.concatenate([np.einsum("ij,ij->i", w[a[i : i + 65536]], v[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        a, b = a[cosine >= least], b[cosine >= least]
        copies_q, copies_m = probe["copies"].to_numpy(np.int64), shelf["copies"].to_numpy(np.int64)
        linked_q = np.bincount(a, copies_m[b], len(probe))
        # The member finds this query itself if it asks the query's home cell.
        home, asks = probe["home"].to_numpy(), np.array(shelf["cells"].tolist())
        unseen = ~(asks[b] == home[a][:, None]).any(1)
        linked_m = np.bincount(b[unseen], copies_q[a[unseen]], len(shelf))
        rows = np.concatenate([rows_q, rows_m])
        distinct, at = np.unique(rows, return_inverse=True)
        root = distinct[roots(len(distinct), at[a], at[len(rows_q) + b])]
        linked = np.bincount(at, np.concatenate([linked_q, linked_m]), len(distinct)).astype(np.int64)
        keep = (linked > 0) | (root != distinct)
        return pd.DataFrame({"row": distinct[keep], "linked": linked[keep], "root": root[keep]})

    return filed.unionByName(asked).groupBy("cell", "m", "q").applyInPandas(compare, "row long, linked long, root long")
