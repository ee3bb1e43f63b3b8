"""Token ids as flat unsigned integer files with 64-bit document offsets, read back through memory maps."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.llm.shared import Scratch, by_value, filesystem, partitions, worker_cache

by_value(__name__)

END_ID = 2
REMEMBERED = 400_000
LONGEST = 64
GROUP = 256
#: Bytes of text that are encoded together; one longer text is a chunk of its own.
CHUNK = 8 << 20
#: The two ways of cutting a text into pre-tokens that `unit_starts` knows: byte level with a leading blank, and words
#: without blanks in lower case.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = {"type": "Split", "pattern": {"Regex": CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


#: Classes of bytes: ASCII letters and digits; signs; the blank; the line end; first bytes of characters that are no white
#: space (C2 and E1 to E3 begin some that are); first bytes of the letters U+00C0 to U+027F.
ALNUM, SIGN, BLANK, LINE, SOLID, LATIN = (1 << i for i in range(6))


def class_of(b: int) -> int:
    printed = 0x21 <= b <= 0x7E
    own = ALNUM * (printed and chr(b).isalnum()) | SIGN * (printed and not chr(b).isalnum()) | BLANK * (b == 0x20) | LINE * (b == 0x0A)
    return own | SOLID * (printed or 0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xF4) | LATIN * (0xC3 <= b <= 0xC9)


CLASSES = bytes(class_of(b) for b in range(256))


def unit_starts(data: np.ndarray, firsts: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Where the units of concatenated UTF-8 texts begin; a text's ids are those of its units in order.

    A unit begins at each text (`firsts`), and where both known kinds of tokenizers always begin a pre-token and no
    normalizer acts across: before a blank that a solid character follows, before a sign or line end that follows an
    ASCII or Latin letter or a digit, and around a lone line end between solid characters. The multiplication and
    division signs are no letters, and a capital I with a dot becomes a letter and a mark, which joins the sign
    behind it: nothing is cut behind these three. Texts in `whole` stay one unit."""
    kind = np.frombuffer(data.tobytes().translate(CLASSES), np.uint8)
    cut = np.zeros(len(data), bool)
    solid = kind & SOLID != 0
    solid[firsts] = False
    letter = kind & ALNUM != 0
    second = np.flatnonzero(kind[:-1] & LATIN) + 1
    after, lead = data[second], data[second - 1]
    letter[second] = ~((lead == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((lead == 0xC4) & (after == 0xB0))
    line, printed = kind & LINE != 0, kind & (ALNUM | SIGN) != 0
    ended = letter | printed
    cut[:-1] = (kind[:-1] & BLANK != 0) & solid[1:]
    cut[1:] |= letter[:-1] & (kind[1:] & SIGN != 0)
    around = np.flatnonzero(ended[:-1] & line[1:]) + 1
    cut[around] = True
    around = around[around + 1 < len(data)] + 1
    cut[around[printed[around]]] = True
    for a, b in whole:
        cut[a:b] = False
    cut[firsts] = True
    return np.flatnonzero(cut)


class Memory:
    """Values of the last keys asked for: two dicts of at most `size` entries, the older of which goes first."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: list[bytes]) -> list[bytes]:
        """Keys without a value; all others are in `young` now."""
        out = []
        for k in keys:
            if k not in self.young:
                if k in self.old:
                    self.young[k] = self.old[k]
                else:
                    out.append(k)
        return out

    def trim(self, long: list[bytes]) -> None:
        for k in long:
            self.young.pop(k, None)
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


def row_groups(column: pa.Array, limit: int = CHUNK) -> Iterator[pa.Array]:
    """Slices of a text column with at most `limit` bytes each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield column.slice(at, stop - at)
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the n + 1 offsets of the texts; a null text is empty."""
    flat = pa.concat_arrays([column.fill_null("").cast(pa.string())])
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Encoder:
    """Ids of texts by a tokenizer file, encoding each distinct unit of a chunk of texts once.

    `unit_starts` says where texts are cut; a text that holds a special token's string, and every text where the
    tokenizer is of no known kind, is one unit. Memory is bounded: a worker remembers twice REMEMBERED units, and
    none over LONGEST bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache("encoders")
        if path not in cache:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            kind = json.loads(tokenizer.to_str())
            level, chain = kind["pre_tokenizer"] or {}, [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])]
            by_bytes = kind["normalizer"] is None and level.get("type") == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"]
            steps = level.get("pretokenizers", [{}])
            by_words = chain == ["NFC", "Replace", "Lowercase"] and steps[0] == WORDS and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1]["use_regex"]
            special = [x["content"].encode() for x in kind["added_tokens"]]
            # What each id adds to a text: a byte-level token has a character for each byte; else the end of a word or not.
            adds = np.zeros(tokenizer.get_vocab_size(), np.int64)
            for token, i in tokenizer.get_vocab().items():
                adds[i] = len(token) if by_bytes else token.endswith(tokenizer.model.end_of_word_suffix or "\0")
            cache[path] = (tokenizer, by_bytes, by_words, special, adds, Memory(REMEMBERED))
        self.tokenizer, self.by_bytes, self.by_words, self.special, self.adds, self.memory = cache[path]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of the texts that must not be cut."""
        if not (self.by_bytes or self.by_words):
            return list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        raw, rows = data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        return [(int(offsets[r]), int(offsets[r + 1])) for r in rows]

    def _encode(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of units, many in one call where they can be told apart: byte-level ones that begin with a blank by
        their bytes, single words by their ends. Words of ASCII letters are asked for in lower case, once."""
        texts = [u.decode() for u in units]
        if self.by_words:
            texts = [t[1:] if t[:1] == "\x20" and t[1:].isalpha() else t for t in texts]
            texts = [t.lower() if t.isascii() else t for t in texts]
        distinct = list(dict.fromkeys(texts))
        joint = [t for t in distinct if t[:1] == "\x20"] if self.by_bytes else [t for t in distinct if t.isalpha()] if self.by_words else []
        gap, ids_of = "" if self.by_bytes else "\x20", {}
        groups = [joint[i : i + GROUP] for i in range(0, len(joint), GROUP)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([gap.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            sizes = [len(t.encode()) for t in group] if self.by_bytes else [1] * len(group)
            cuts = np.searchsorted(np.cumsum(self.adds[ids]), np.cumsum(sizes)) + 1
            if self.adds[ids].sum() == sum(sizes) and cuts[-1] == len(ids):
                flat, edges = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
                ids_of.update(zip(group, [flat[a:b] for a, b in zip(edges, edges[1:])]))
        rest = [t for t in distinct if t not in ids_of]
        ids_of.update((t, np.array(f.ids, self.dtype).tobytes()) for t, f in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return dict(zip(units, map(ids_of.__getitem__, texts)))

    def flat(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in the file's type, each text's end id included, and how many each text has."""
        data, offsets = text_bytes(column)
        sizes = np.diff(offsets)
        starts = unit_starts(data, offsets[:-1][sizes > 0], self._whole(data, offsets)) if len(data) else np.zeros(0, np.int64)
        edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        keys, which = units.dictionary.to_pylist(), units.indices.to_numpy()
        missing = self.memory.missing(keys)
        if missing:
            self.memory.young.update(self._encode(missing))
        values = [*map(self.memory.young.__getitem__, keys), np.array([end_id], self.dtype).tobytes()]
        self.memory.trim([k for k in missing if len(k) > LONGEST])
        known = np.frombuffer(b"".join(values), self.dtype)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // known.itemsize
        # Every text ends with the last value, the end id.
        last = np.searchsorted(starts, offsets[1:], "left")
        which = np.insert(which, last, len(keys))
        own = lengths[which]
        stops = np.cumsum(own)
        places = np.repeat((np.cumsum(lengths) - lengths)[which] - (stops - own), own) + np.arange(stops[-1] if len(stops) else 0)
        ends = stops[last + np.arange(len(last))]
        return known[places], np.diff(ends, prepend=0)

    def __call__(self, texts: list[str | None], end_id: int = END_ID) -> list[bytes]:
        """The ids of each text as bytes in the file's type, the end id included; a null text is empty."""
        ids, counts = self.flat(pa.array(texts, pa.string()), end_id)
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def shard_writer(folder: str, path: str, columns: list[str], end_id: int = END_ID):
    """Per document: the given columns, n_tokens, and where its ids lie (file, place).

    A task writes one file under its own attempt's name; only rows of finished attempts name a file, so what a
    lost task left behind is never read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = Encoder(path), TaskContext.get()
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        name, place = f"{task.partitionId():07d}-{task.taskAttemptId()}.ids", 0
        with files.open_output_stream(f"{at}/{name}") as out:
            for batch in batches:
                counts = []
                for group in row_groups(batch.column("text")):
                    ids, sizes = encode.flat(group, end_id)
                    out.write(ids)
                    counts.append(sizes)
                counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                places = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                own = [batch.column(c) for c in columns]
                made = [pa.array(counts, pa.int64()), pa.array([name] * batch.num_rows, pa.string()), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*columns, "n_tokens", "file", "place"])

    return write


def read_ids(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file's ids, memory-mapped where the folder is a mounted one, else read as a whole."""
    files, at = filesystem(folder)
    if files.type_name == "local":
        empty = not files.get_file_info(f"{at}/{name}").size
        return np.zeros(0, dtype) if empty else np.memmap(f"{at}/{name}", dtype=dtype, mode="r")
    with files.open_input_file(f"{at}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def id_type(path: str) -> str:
    return Encoder(path).dtype


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Encode documents in ascending doc_id order into `folder`.

    ids/*.ids hold the ids of consecutive documents, flat; index/*.idx hold as 64-bit integers the number of
    documents, the number of those without doc_id (they come first), the doc_ids, and n + 1 offsets within the
    file. manifest/ names the files in order with the base of each: the prefix sum of the ids before it.
    Null texts are empty; equal doc_ids are ordered by text; an empty table gives an empty manifest."""
    spark = docs.sparkSession
    write = shard_writer(f"{folder}/ids", path, ["doc_id"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, name = [], [], None
        for batch in write(batches):
            ids.append(batch.column("doc_id"))
            counts.append(batch.column("n_tokens").to_numpy())
            name = batch.column("file")[0].as_py() if batch.num_rows else name
        if name is None:
            return
        keys, sizes = pa.chunked_array(ids), np.concatenate(counts)
        head = np.array([len(sizes), keys.null_count], "<i8")
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        files, at = filesystem(f"{folder}/index")
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{name[:-4]}.idx") as out:
            for part in (head, keys.fill_null(0).to_numpy().astype("<i8"), offsets):
                out.write(part.tobytes())
        row = [[TaskContext.get().partitionId()], [name], [len(sizes)], [int(sizes.sum())]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1]), *(pa.array(x, pa.int64()) for x in row[2:])], names=["shard", "file", "n_docs", "n_tokens"])

    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sorted_docs = narrow.repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    shards = sorted_docs.mapInArrow(task, "shard long, file string, n_docs long, n_tokens long")
    shards.write.mode("overwrite").parquet(f"{folder}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    table = spark.read.schema(shards.schema).parquet(f"{folder}/shards")
    table = table.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("dtype", F.lit(id_type(path)))
    table.write.mode("overwrite").parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            index = read_ids(f"{folder}/index", f"{row['file'][:-4]}.idx", "<i8")
            n, unnamed = int(index[0]), int(index[1])
            ids, keys, offsets = read_ids(f"{folder}/ids", row["file"], row["dtype"]), index[2 : 2 + n], index[2 + n :].view("<u8").astype(np.int64)
            for a in range(0, n, 8192):
                cuts = offsets[a : a + 8193]
                crcs = [crc(ids[i:j]) for i, j in zip(cuts, cuts[1:])]
                own = np.array(keys[a : a + 8192], np.int64)
                made = [pa.array(own, mask=np.arange(a, a + len(own)) < unnamed), pa.array(cuts[:-1] + row["base"]), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.schema("shard long, file string, n_docs long, n_tokens long, base long, dtype string").parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, scratch.root)
    return read_tokens(docs.sparkSession, scratch.root)
