"""Helpers of the operators: tables in the shared folder, worker caches, running totals."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def by_value(module: str) -> None:
    """Let the functions of a module travel to executors by value, so they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; its users bound its size."""
    holder = sys.modules.setdefault("_postlens_worker", types.ModuleType("_postlens_worker"))
    return holder.__dict__.setdefault(name, {})


class Scratch:
    """Tables of one run in the folder that driver and executors share.

    A written table cuts the lineage and survives lost executors. `drop` removes a table as soon as nothing
    reads it any more; what a result still reads stays until the folder is cleared."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """The pyarrow file system and plain path of a folder given as a URI or a local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(df: DataFrame, parts: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add the total of `value` over all earlier rows of the same `parts`.

    `block` must rise with `order`. Rows meet only within their block; blocks are chained by their totals, so
    no task holds more than one block, or one row for each block."""
    inside = Window.partitionBy(*parts, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*parts).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*parts, block).agg(F.sum(value).alias("_total"))
    bases = totals.select(*parts, block, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return inner.join(bases, [*parts, block]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def bound(df: DataFrame, **columns) -> DataFrame:
    """Add columns whose values are computed once a row. The optimizer would else copy an expression to where it
    is used, and one used inside a lambda would run for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lower_ascii(c):
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


by_value(__name__)
