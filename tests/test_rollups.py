"""Counts kept by deltas against counts built anew."""

from pyspark.sql import functions as F

from postlens import schemas as S
from postlens.operators import rollups
from postlens.sources.tables import Delta, Tables


def postings(spark, low, high, **changes):
    rows = spark.range(low, high).select(
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source_id"), F.col("id").cast("string").alias("external_id"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("company_id"), F.concat(F.lit("d"), (F.col("id") % 400).cast("string")).alias("dedupe_key"),
        F.when(F.col("id") % 4 == 0, "closed").otherwise("open").alias("status"), (F.col("id") % 100).cast("int").alias("score"),
    ).withColumns(changes)
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.struct(S.JOBS)])


def counts(frame):
    return sorted(tuple(r) for r in frame.drop("groups").collect())


def test_three_deltas_give_what_a_rebuild_gives(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), {"jobs": S.JOBS, "rollup": rollups.ROLLUP}, {"jobs": S.KEYS["jobs"], "rollup": rollups.ROLLUP_KEY}, buckets=2, spread=2)
    first = postings(spark, 0, 600)
    tables.commit({"jobs": first, "rollup": rollups.rollup(first)})
    closed = postings(spark, 0, 100, status=F.lit("closed"))
    moved = postings(spark, 500, 900, company_id=F.lit("other"), score=F.lit(99))
    gone = postings(spark, 0, 900).filter("source_id = 's3'")
    for change in (Delta(closed), Delta(moved), Delta(first.limit(0), gone=gone)):
        at = tables.snapshot()
        stored = at.read("jobs")
        tables.commit({"jobs": change, "rollup": rollups.rollup_delta(at.read("rollup"), rollups.changed_postings(stored, change), change.rows)}, base=at.version)
    kept, anew = tables.read("rollup"), rollups.rollup(tables.read("jobs"))
    assert counts(kept) == counts(anew) and counts(kept)
    assert kept.filter("source_id = 's3'").isEmpty()


def test_the_sketch_is_within_five_per_cent(spark):
    rows = postings(spark, 0, 30_000, source_id=F.lit("s"), company_id=F.lit("c"), dedupe_key=F.col("external_id"))
    found = rollups.with_groups(rollups.rollup(rows)).first()
    assert abs(found.groups - 30_000) < 1_500 and found.postings == 30_000
