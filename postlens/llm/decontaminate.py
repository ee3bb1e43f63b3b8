"""Benchmark decontamination by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.shared import Scratch, bound, lower_ascii

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: 64-bit words of the filter made of the benchmark's fingerprints: its size never grows with the benchmark.
FILTER_WORDS = 1 << 14
#: The low bits of a packed fingerprint hold its place, the others the head of its hash.
PLACE = (1 << 31) - 1
FOUND = "array<struct<need:int,place:int,hash:bigint>>"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def winnow(frame: DataFrame, need: int, window: int, k: int, out: str) -> DataFrame:
    """Add the fingerprints (need, place, hash) of `words`: the smallest k-gram hash of each `need` words.

    Of equal hashes the first counts. Two texts that share `need` consecutive words select the same k-gram in
    them. Whole short items (need < window) are hashed as one gram."""
    size = k if need == window else need
    width = need - size + 1
    many = F.size("words") >= need
    none = F.array().cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.size("words") - size + 1)
    gram = F.when(many, F.transform(steps, lambda i: F.xxhash64(F.slice("hashes", i, size)))).otherwise(none)
    frame = bound(frame, gram=gram)
    packed = F.transform("gram", lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    frame = bound(frame, packed=packed)
    starts = F.sequence(F.lit(1), F.size("gram") - width + 1)
    least = F.when(many, F.transform(starts, lambda i: F.array_min(F.slice("packed", i, width)))).otherwise(none)
    frame = frame.withColumn("least", F.array_distinct(least))

    def pick(c: Column) -> Column:
        place = c.bitwiseAND(F.lit(PLACE)).cast("int")
        return F.struct(F.lit(need).alias("need"), place.alias("place"), F.get("gram", place).alias("hash"))

    return frame.withColumn(out, F.transform("least", pick)).drop("gram", "packed", "least")


def bench_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, need, words, window_id): each distinct window of each item; an item of fewer words is one window."""
    split = bound(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), w=words_of(F.col("text")))
    split = split.where(F.size("w") > 0).withColumn("need", F.least(F.size("w"), F.lit(window)))
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("need") + 1), lambda i: F.slice("w", i, F.col("need")))
    out = split.select("item", "need", F.explode(F.array_distinct(spans)).alias("words"))
    return out.withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256))


def fingerprint_filter(shelf: DataFrame) -> DataFrame:
    """One row with an array of FILTER_WORDS longs, in which each fingerprint of the benchmark sets a bit."""
    slot = F.pmod("hash", F.lit(FILTER_WORDS * 64))
    bits = shelf.groupBy(F.shiftrightunsigned(slot, 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, 64) as int))")).alias("bits"))
    dense = shelf.sparkSession.range(FILTER_WORDS).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("filter"))


def matches(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, owners): row, doc_id and n_words of each document; (row, at, need, window_id) of each
    occurrence of a benchmark window in it; (window_id, item).

    Both sides are winnowed. A document's fingerprints that pass the fixed-size filter of the benchmark's meet
    equal ones in a join, with the words around them; each meeting is extended to the window and its words are
    compared. `docs` has a column `row`: the digest of its text, so equal texts share what is found."""
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    owners = scratch.keep(bench_windows(items, window), "owners")
    lengths = sorted(r.need for r in owners.select("need").distinct().collect())
    shelf = None
    for need in lengths:
        own = owners.where(F.col("need") == need).select("words", "window_id").distinct()
        own = winnow(bound(own, hashes=F.transform("words", lambda w: F.xxhash64(w))), need, window, k, "found")
        own = own.select("window_id", F.col("words").alias("wanted"), F.inline("found"))
        shelf = own if shelf is None else shelf.unionByName(own)
    schema = "window_id string, wanted array<string>, need int, place int, hash bigint"
    shelf = scratch.keep(shelf if shelf is not None else docs.sparkSession.createDataFrame([], schema), "shelf")
    frame = bound(docs.select("row", "doc_id", "text"), words=words_of(F.col("text")))
    frame = bound(frame.drop("text"), hashes=F.transform("words", lambda w: F.xxhash64(w)))
    for need in lengths:
        frame = winnow(frame, need, window, k, f"found_{need}")
    # The first entry of each document stands for the document itself, so one pass gives all rows.
    self_entry = F.array(F.struct(F.lit(0).alias("need"), F.lit(-1).alias("place"), F.lit(None).cast("long").alias("hash"))).cast(FOUND)
    frame = frame.withColumn("entries", F.concat(self_entry, *[F.col(f"found_{n}").cast(FOUND) for n in lengths]))
    entries = frame.select("row", "doc_id", "words", F.inline("entries"))
    slot = F.pmod("hash", F.lit(FILTER_WORDS * 64))
    held = F.get(fingerprint_filter(shelf).scalar(), F.shiftrightunsigned(slot, 6).cast("int"))
    passes = F.getbit(held, F.pmod("hash", F.lit(64)).cast("int")) == 1
    entries = entries.where((F.col("place") < 0) | passes)
    low = F.greatest(F.col("place") - (F.col("need") - F.least(F.lit(k), "need")), F.lit(0))
    near = F.when(F.col("place") >= 0, F.slice("words", low + 1, 2 * F.col("need")))
    entries = entries.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "need", "place", "hash", low.alias("low"), near.alias("near"))
    entries = scratch.keep(entries, "entries")
    rows = entries.where("place < 0").select("row", "doc_id", "n_words")
    asked = entries.where("place >= 0").select("row", "need", "hash", "near", "low", F.col("place").alias("at"))
    met = asked.join(shelf.withColumnRenamed("place", "inner"), ["need", "hash"])
    met = met.where((F.col("at") - F.col("inner") >= F.col("low")) & (F.slice("near", F.col("at") - F.col("inner") - F.col("low") + 1, F.col("need")) == F.col("wanted")))
    found = met.select("row", (F.col("at") - F.col("inner")).alias("at"), "need", "window_id").distinct()
    return rows, scratch.keep(found, "found"), owners.select("window_id", "item")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of `window` consecutive words of an item (of a whole item, if it
    has fewer). Null and empty texts have no words, items of no words never occur, an item_id of null counts as
    empty text; of repeated item_ids one counts. Repeated documents give repeated rows."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    rows, found, owners = matches(docs.select(digest(F.col("text")).alias("row"), "doc_id", "text"), items, scratch, window, k)
    covered = found.select("row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("need") - 1)).alias("word")).distinct()
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    owned = found.select("row", "window_id").join(owners, "window_id").select("row", "item").distinct()
    listed = owned.groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    zero = F.lit(0).cast("long")
    joined = rows.join(n_hit, "row", "left").join(listed, "row", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def keep_unseen(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 4) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns as they are."""
    scratch = Scratch(docs.sparkSession, "decontaminate-keep")
    row = digest(F.col("text")).alias("row")
    _, found, _ = matches(docs.select(row, "doc_id", "text"), items, scratch, window, k)
    held = docs.select(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    # What is found grows with the corpus, so it is never broadcast.
    return held.join(found.select("row").distinct().hint("merge"), "row", "left_anti").select("held.*")
