"""Phrase collocations: contiguous words that stand together far more often than their parts would by chance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.shared import Scratch, by_value
from postlens.llm.tokenfiles import row_groups, text_bytes
from postlens.llm.trie import Trie

by_value(__name__)

#: Candidates of one trie, which is broadcast; more of them go into further tries and passes.
SHARD = 1 << 19
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK = 4 << 20
#: Bits of the filter of frequent phrases, a whole number of Spark's bitmaps.
FILTER = 1 << 23
MIX = 1_000_003
#: Phrases that a task holds before it sends them.
GATHERED = 1 << 21
#: Counters of one slice, in which they are sent.
SLICE = 1 << 13
#: Buckets of hashes at most, about; a task holds a counter for each.
BUCKETS = 1 << 25
#: Bits of the hash by which packed phrases meet.
PARTS = 8
#: A byte of a word, a blank between words, the end of a piece.
WORD, BLANK, END = 0, 1, 2
KINDS = bytes(END if b in b".,;:!?\n\x0b\x0c\r" else BLANK if b in b" \t" else WORD for b in range(256))


def word_numbers(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(numbers of all words in order, distinct words): 1 is the first distinct word, 0 lies between two pieces."""
    data, offsets = text_bytes(column)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    raw = data.tobytes().lower()
    kind = np.frombuffer(raw.translate(KINDS), np.uint8)
    word = kind == WORD
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[firsts] = word[firsts]
    ends[:-1] &= ~word[1:]
    ends[firsts[1:] - 1] = word[firsts[1:] - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    stops = kind == END
    piece = np.cumsum(stops, dtype=np.int32)[begins] + np.searchsorted(firsts, begins, "right")
    edges = pa.py_buffer(np.append(0, np.cumsum(ends - begins)).astype(np.int32))
    words = pa.Array.from_buffers(pa.string(), len(begins), [None, edges, pa.py_buffer(np.frombuffer(raw, np.uint8)[word])]).dictionary_encode()
    numbers = words.indices.to_numpy().astype(np.int32) + 1
    return np.insert(numbers, np.flatnonzero(np.diff(piece)) + 1, 0), words.dictionary


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of one language: block, lang, distinct words, how often each stands there, numbers of all words."""
    made, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lang in table.column("lang").unique().to_pylist():
            texts = table.filter(pc.equal(table.column("lang"), lang)).column("text").combine_chunks()
            for group in row_groups(texts, BLOCK):
                numbers, words = word_numbers(group)
                counts = np.bincount(numbers, minlength=len(words) + 1)[1:]
                whole = pa.array([0, len(words)], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, x) for x in (words, pa.array(counts))]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), pa.array([lang]), *lists, pa.array([numbers.tobytes()])], names=["block", "lang", "words", "counts", "numbers"])
                made += 1


#: Rows of two kinds: a frequent word with its number among its task's, or where such words stand in a block.
NUMBERED = "part long, lang string, word string, f long, local long, block long, at array<int>, locals array<long>"


def number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the words of a task, whose rows come word by word, from 0.

    Each batch gives a row for each word that begins in it, and one for each of its blocks, so that what goes to the blocks
    is gathered before it is sent."""
    part, local, last = TaskContext.get().partitionId(), -1, None
    schema = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("local", pa.int64()), ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("locals", pa.list_(pa.int64()))])
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        lang, word = (table.column(c).combine_chunks() for c in ("lang", "word"))
        first = np.ones(len(word), bool)
        same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(word[1:], word[:-1]))
        first[1:] = ~same.to_numpy(zero_copy_only=False)
        first[0] = (lang[0].as_py(), word[0].as_py()) != last
        last = (lang[-1].as_py(), word[-1].as_py())
        numbers = local + np.cumsum(first)
        local = int(numbers[-1])
        new, n = pa.array(first), int(first.sum())
        words = [pa.array(np.full(n, part)), lang.filter(new), word.filter(new), batch.column("f").filter(new), pa.array(numbers[first])]
        yield pa.RecordBatch.from_arrays([*words, *(pa.nulls(n, schema.field(c).type) for c in ("block", "at", "locals"))], schema=schema)
        blocks = batch.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        own, begins = np.unique(blocks[order], return_index=True)
        edges = pa.array(np.append(begins, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (batch.column("at").to_numpy(), numbers)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), *(pa.nulls(len(own), schema.field(c).type) for c in ("lang", "word", "f", "local")), pa.array(own), *lists], schema=schema)


def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' words by the numbers of frequent words. Others become 0, as they end every candidate; a frequent word
    between two of those is left out, and of several 0 one stays."""
    for batch in batches:
        out = []
        for numbers, size, at, ids in zip(*(batch.column(c) for c in ("numbers", "size", "at", "ids"))):
            own = np.zeros(size.as_py() + 1, np.int32)
            own[at.values.to_numpy() + 1] = ids.values.to_numpy()
            found = own[np.frombuffer(numbers.as_buffer(), np.int32)]
            known = np.concatenate([[False], found > 0, [False]])
            beside = known[1:-1] & (known[:-2] | known[2:])
            # A 0 stays behind each run of words that stay.
            stays = beside.copy()
            stays[1:] |= beside[:-1]
            out.append(np.where(beside, found, 0)[stays].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of each block, not copied."""
    return (np.frombuffer(x.as_buffer(), np.int32) for b in batches for x in b.column(0))


def phrase_rows(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n, length = rows.shape
    edges = pa.array(np.arange(n + 1, dtype=np.int32) * length)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, pa.array(rows.ravel().astype(np.int32))), pa.array(counts.astype(np.int64))], names=["ids", "f"])


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring frequent words, both in one number, with their counts in each block."""
    for block in blocks_of(batches):
        ids = block.astype(np.int64)
        keys = (ids[:-1] << 32 | ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)]
        found, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["pair", "f"])


def phrase_filter(phrases: DataFrame) -> np.ndarray:
    """FILTER bits, those of the given phrases set; its size is fixed, so it is broadcast with each trie."""
    # Spark's bitmaps begin at 1.
    at = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: (a * MIX + x) % FILTER) + 1
    rows = phrases.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(FILTER // 8, np.uint8)
    for r in rows:
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def hashes(words: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of 64 bits of phrases, whose first, second ... words are given."""
    mixed = np.uint64(0)
    for ids in words:
        mixed = (mixed + ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def top_bits(hashed: np.ndarray, bits: int) -> np.ndarray:
    return (hashed >> np.uint64(64 - bits)).astype(np.int64)


def extended(trie: Trie, known: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row and next word in one number, hash) at each place of a phrase of a trie with a frequent word behind it, where
    the words without the first are a frequent phrase by the filter."""
    ids = np.append(block, np.zeros(trie.length, np.int32))
    at, row = trie.find(ids)
    at, row = at[ids[at + trie.length] > 0], row[ids[at + trie.length] > 0]
    mixed = np.zeros(len(at), np.int64)
    for j in range(1, trie.length + 1):
        mixed = (mixed * MIX + ids[at + j]) % FILTER
    safe = known[mixed]
    at, row = at[safe], row[safe]
    return row.astype(np.int64) << 32 | ids[at + trie.length], hashes(ids[at + j] for j in range(trie.length + 1))


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, bitorder="little").view(bool)


def slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices of a task's counters in which anything was counted, with their numbers."""
    for begin in range(0, len(counts), 256 * SLICE):
        own = [counts[i : i + SLICE] for i in range(begin, min(begin + 256 * SLICE, len(counts)), SLICE)]
        filled = [i for i, x in enumerate(own) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([begin // SLICE + i for i in filled], pa.int64()), pa.array([own[i].tobytes() for i in filled], pa.binary())], names=["part", "counts"])


def summed(batches: Iterator[pa.RecordBatch], dtype, most: int | None = None) -> dict[int, np.ndarray]:
    """The counters of all tasks, slice by slice, up to `most`."""
    out = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
            total = out.get(part, np.int64(0)) + np.frombuffer(counts.as_buffer(), dtype).astype(np.int64)
            out[part] = (total if most is None else np.minimum(total, most)).astype(dtype)
    return out


def counter(least: int):
    """The smallest type that holds counts up to `least`."""
    return np.min_scalar_type(least)


def tally(sent, bits: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many places of longer phrases fall into each of 2^`bits` buckets, up to `least`, at which a bucket is hot anyway."""
    trie, known = sent.value
    known, counts = unpacked(known), np.zeros(1 << bits, counter(least))
    for block in blocks_of(batches):
        _, hashed = extended(trie, known, block)
        bucket, n = np.unique(top_bits(hashed, bits), return_counts=True)
        counts[bucket] = np.minimum(counts[bucket].astype(np.int64) + n, least)
    yield from slices(counts)


def hot(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each bucket of a slice: whether all tasks together counted `least` there."""
    own = summed(batches, counter(least), least)
    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in own.values()], pa.binary())], names=["part", "bits"])


def hot_buckets(corpus: DataFrame, sent, bits: int, least: int) -> np.ndarray:
    """A bit for each bucket in which at least `least` places of longer phrases fall: no other holds a frequent phrase."""
    counts = corpus.mapInArrow(lambda batches: tally(sent, bits, least, batches), "part long, counts binary").repartition("part")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in counts.mapInArrow(lambda batches: hot(least, batches), "part long, bits binary").collect():
        out[r.part * SLICE // 8 : (r.part + 1) * SLICE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def longer(sent, filled, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of a trie with the next word that fall into hot buckets, packed by parts of the hashes. The blocks of a
    task are put together, so a phrase is sent once, or once for each GATHERED of them."""
    trie, known = sent.value
    known, filled = unpacked(known), unpacked(filled.value)

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(found))
        rows = np.column_stack([trie.rows[keys >> 32], keys & 0xFFFFFFFF]).astype(np.int32)
        part = top_bits(hashes(rows.T), PARTS)
        order = np.argsort(part, kind="stable")
        parts, begins = np.unique(part[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(parts), pa.array([x.tobytes() for x in np.split(rows[order], begins[1:])][: len(parts)], pa.binary())], names=["part", "phrases"])

    found, size = [], 0
    for block in blocks_of(batches):
        keys, hashed = extended(trie, known, block)
        found.append(np.unique(keys[filled[top_bits(hashed, bits)]]))
        size += len(found[-1])
        if size > GATHERED:
            yield packed(found)
            found, size = [], 0
    if found:
        yield packed(found)


def distinct_phrases(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct ones of packed phrases, which meet by part."""
    waiting, size = [np.zeros((0, length), np.int32)], 0

    def together() -> np.ndarray:
        return np.unique(np.concatenate(waiting), axis=0)

    for batch in batches:
        for phrases in batch.column("phrases"):
            waiting.append(np.frombuffer(phrases.as_buffer(), np.int32).reshape(-1, length))
            size += len(waiting[-1])
        if size > max(GATHERED, len(waiting[0])):
            waiting, size = [together()], 0
    own = together()
    edges = pa.array(np.arange(len(own) + 1, dtype=np.int32) * length)
    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, pa.array(own.ravel()))], names=["ids"])


def count_accepted(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each phrase of a trie stands in the task's blocks, by the number of its accepting state."""
    trie = sent.value
    total = np.zeros(-(-len(trie.rows) // SLICE) * SLICE, np.int64)
    for block in blocks_of(batches):
        _, row = trie.find(block)
        total += np.bincount(row, minlength=len(total))
    yield from slices(total)


def accepted(sent, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of a trie that stand `least` times in all blocks."""
    trie = sent.value
    for part, counts in summed(batches, np.int64).items():
        at = np.flatnonzero(counts >= least)
        yield phrase_rows(trie.rows[part * SLICE + at], counts[at])


def tries(phrases: DataFrame, n: int, digits: int, length: int) -> Iterator[Trie]:
    """Tries of all `phrases`, about SHARD of them at most in each. The driver holds the phrases of one trie at a time."""
    shards = -(-n // SHARD)
    for shard in range(shards):
        own = phrases.where(F.pmod(F.hash("ids"), F.lit(shards)) == shard) if shards > 1 else phrases
        found = own.select("ids").toArrow().column(0).combine_chunks()
        yield Trie(found.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, length), digits)


def candidates_of(corpus: DataFrame, shorter: DataFrame, n: int, digits: int, length: int, least: int, places: int) -> DataFrame:
    """The phrases of `length` words that may be frequent: `n` phrases `shorter` by one, which have `places`, with the word behind them.

    Places are first counted in buckets of hashes; phrases of buckets that hold fewer than `least` are left out. These are most, as
    frequent pairs meet in many ways that occur a few times each. The phrases of a trie have their own buckets; all together have
    eight for each phrase that could be frequent, but about BUCKETS at most. Fuller buckets let more phrases pass and hold none back."""
    spark, known, out = corpus.sparkSession, phrase_filter(shorter), []
    bits = (max(SLICE, min(BUCKETS, 8 * places // least) // -(-n // SHARD)) - 1).bit_length()
    for trie in tries(shorter, n, digits, length - 1):
        sent = spark.sparkContext.broadcast((trie, known))
        filled = spark.sparkContext.broadcast(hot_buckets(corpus, sent, bits, least))
        out.append(corpus.mapInArrow(lambda batches, sent=sent, filled=filled: longer(sent, filled, bits, batches), "part long, phrases binary"))
    return reduce(DataFrame.unionAll, out).repartition("part").mapInArrow(lambda batches: distinct_phrases(length, batches), "ids array<int>")


def counted_by_tries(corpus: DataFrame, candidates: DataFrame, n: int, digits: int, length: int, least: int) -> DataFrame:
    """(ids, f) of the `n` candidates that stand `least` times in the corpus."""
    spark, out = corpus.sparkSession, []
    for trie in tries(candidates, n, digits, length):
        sent = spark.sparkContext.broadcast(trie)
        counts = corpus.mapInArrow(lambda batches, sent=sent: count_accepted(sent, batches), "part long, counts binary").repartition("part")
        out.append(counts.mapInArrow(lambda batches, sent=sent: accepted(sent, least, batches), "ids array<int>, f long"))
    return reduce(DataFrame.unionAll, out)


def frequent_phrases(docs: DataFrame, least: int, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n of all words), (id, lang, word) of frequent words, and (ids, f) of the frequent phrases of 1 to `longest` words.

    Words and pairs are counted block by block and summed: no set of pairs that Apriori rules allow is smaller than all
    pairs of frequent words. From three words on, candidates are the phrases that occur and whose first and last words
    but one are frequent phrases themselves (the last ones by a filter, which may let others pass but holds none of
    them back) and whose bucket of hashes holds enough places; tries of them are broadcast and count all texts."""
    # Phrases that occur stand at least once.
    spark, least = docs.sparkSession, max(1, least)
    columns = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = scratch.keep(columns.mapInArrow(to_blocks, "block long, lang string, words array<string>, counts array<long>, numbers binary"), "blocks", compression="zstd")
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    seen = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "of"))
    word = F.col("of.words").alias("word")
    # A word's rows are at most one for each block.
    counted = seen.select("block", "lang", "at", word, F.sum("of.counts").over(Window.partitionBy("lang", "of.words")).alias("f"))
    numbered = scratch.keep(counted.where(F.col("f") >= least).mapInArrow(number_words, NUMBERED), "numbered")
    sizes = dict(tuple(r) for r in numbered.groupBy("part").agg(F.max("local") + 1).where("part IS NOT NULL").collect())
    bases, n_words = [], 0
    for part in range(max(sizes, default=0) + 1):
        bases.append(n_words)
        n_words += sizes.get(part, 0)
    base = F.element_at(F.lit(bases), (F.col("part") + 1).cast("int")) + 1
    words = numbered.where("block IS NULL").select("lang", "word", "f", (base + F.col("local")).cast("int").alias("id"))
    digits = max(1, -(-n_words.bit_length() // 8))
    placed = numbered.where("block IS NOT NULL").select("block", "at", base.alias("base"), "locals")
    placed = placed.select("block", "at", F.transform("locals", lambda x: (x + F.col("base")).cast("int")).alias("ids"))
    known = placed.groupBy("block").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("ids")).alias("ids"))
    corpus = blocks.select("block", "numbers", F.size("words").alias("size")).join(known, "block")
    corpus = scratch.keep(corpus.mapInArrow(renumber, "ids binary"), "corpus", compression="zstd")
    totals = scratch.keep(totals, "totals")
    scratch.drop("blocks")
    tables = [words.select(F.array("id").alias("ids"), "f")]
    frequent = F.col("f") >= least
    for length in range(2, longest + 1):
        if length == 2:
            found = corpus.mapInArrow(pairs, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f")).where(frequent)
            halves = F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int"))
            found = found.select(halves.alias("ids"), "f")
        else:
            shorter = tables[-1]
            n, places = shorter.agg(F.count("ids"), F.sum("f")).first()
            if not n:
                break
            candidates = candidates_of(corpus, shorter, n, digits, length, least, places)
            candidates = scratch.keep(candidates, f"candidates{length}")
            n = candidates.count()
            if not n:
                break
            found = counted_by_tries(corpus, candidates, n, digits, length, least)
        tables.append(scratch.keep(found, f"phrases{length}"))
    return totals, words, scratch.keep(reduce(DataFrame.unionAll, tables), "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, held_per_cent: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lowered (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at blanks and tabs.
    Candidates are phrases of 2 to `longest` words that stand at least `least` times (a) within pieces, overlaps
    included. A cut into two phrases that stand l and r times scores floor(1000 a n / (l r)), n being all words of the
    language; the lowest cut counts, the earliest of equal ones. A candidate is dropped if one longer candidate
    around it has `held_per_cent` of its count: as counts fall with length it is enough to look one word further.
    Order: score, a (both falling), phrase in byte order. Products are exact, as decimals of 38 digits.

    Null texts are empty, a null lang is `und` and joins texts so marked; repeated rows count each; a table without
    words gives no rows; columns other than lang and text are not read."""
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    totals, words, phrases = frequent_phrases(docs, least, longest, scratch)
    size = F.size("ids")
    candidates = phrases.where(size > 1)
    # f(part) of each part of each cut, looked up by the part.
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(phrases.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    lang = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    cut = cut.withColumn("first", F.element_at("ids", 1)).join(lang, "first")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"above": whole("f") * whole("n") * F.lit(1000).cast("decimal(4,0)"), "below": whole("l") * whole("r")}).withColumn("score", F.expr("above div below"))
    best = cut.groupBy("ids", "f", "lang", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    around = candidates.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    around = around.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = best.join(around, "ids", "left").where(F.coalesce(100 * F.col("longer") < held_per_cent * F.col("f"), F.lit(True)))
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    named = kept.join(spelled, "ids").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
