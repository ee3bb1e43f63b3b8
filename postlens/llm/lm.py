"""Token log-probabilities of a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.shared import Scratch, by_value

by_value(__name__)

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: No word holds a line end, so it can stand for the end of a text.
END = "\n"


def tokens_of(text: str | None) -> list[str]:
    """The words of the text with A-Z lower-cased, then the end."""
    return [*WORD.findall((text or "").translate(LOWER)), END]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the doc_id's text leaves 2 by 7; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all texts; each batch is counted before anything is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(tokens_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["token", "c"])

    return texts.select("text").mapInArrow(task, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, head: list[str]) -> DataFrame:
    """(pair, c) of neighbouring tokens over all texts, as classes: the head's places, len(head) for any other
    token. The class before a text's first token is that of the end. There are at most (len(head) + 1)^2 pairs."""
    known, other = {t: i for i, t in enumerate(head)}, len(head)
    size = other + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            codes = [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                at = np.array([known.get(t, other) for t in tokens_of(text)], np.int64)
                codes.append(np.concatenate([at[-1:], at[:-1]]) * size + at)
            total += np.bincount(np.concatenate(codes), minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "c"])

    return texts.select("text").mapInArrow(task, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


class LogBilinear:
    """log P(class | class before) = q . C r + bias, normalised over all classes by matrix products."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def train(cls, pairs: np.ndarray, rank: int = 32, noise: float = 8.0, epochs: int = 60, rate: float = 0.05, seed: int = 5) -> LogBilinear:
        """Noise-contrastive estimation over pair counts, the noise being the classes' own shares.

        The counts are all that a model of one context class sees of a corpus, so the expectations over data and
        noise are exact and each step covers every token; parameters start at the shares and move by Adam."""
        n = len(pairs)
        total = pairs.sum() or 1
        share = (pairs.sum(0) + 0.5) / (total + 0.5 * n)
        before = pairs.sum(1) / total
        data = (pairs / total).astype(np.float32)
        base = np.log(share).astype(np.float32)
        draw = np.random.default_rng(seed)
        r, c, q = (draw.normal(0, 0.1, (n, rank)).astype(np.float32) for _ in range(3))
        c = np.eye(rank, dtype=np.float32)
        bias = np.zeros(n, np.float32)
        expected = (before[:, None] * share[None, :] * noise).astype(np.float32)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (r, c, q, bias)]
        for step in range(1, epochs + 1):
            rc = r @ c.T
            # The log-odds of data against noise: the bias starts from the noise's own log share.
            odds = rc @ q.T + bias - np.float32(np.log(noise))
            real = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            grad = expected * real - data * (1 - real)
            weight = np.sqrt(np.maximum(before, 1e-7)).astype(np.float32)[:, None]
            grad_rc = grad @ q
            grads = (grad_rc @ c / weight, grad_rc.T @ r, grad.T @ rc / np.sqrt(np.maximum(share, 1e-7)).astype(np.float32)[:, None], grad.sum(0) / np.sqrt(share).astype(np.float32))
            for p, g, (m, v) in zip((r, c, q, bias), grads, state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        scores = (r @ c.T) @ q.T + bias + base
        top = scores.max(1, keepdims=True)
        return cls(((scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))) / np.log(10)).astype(np.float32))


def head_of(counts: DataFrame, size: int) -> list[tuple[str, int]]:
    """The `size` most frequent tokens with their counts, ties by text."""
    found = counts.orderBy(F.desc("c"), "token").limit(size).select("token", "c").toArrow()
    return list(zip(found.column("token").to_pylist(), found.column("c").to_pylist()))


def language_model(docs: DataFrame, classes: int = 1023, lexicon: int = 1 << 17, scratch: Scratch | None = None, **settings) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts cover all tokens of all documents that are not held out. The `classes` most frequent tokens are
    classes of the model, any other token belongs to one more class and is drawn from it by its count; so the
    score is a normalised log10 probability over all tokens, unseen ones included. Counts of the `lexicon` most
    frequent tokens go to the tasks, a table of fixed size; all other tokens get theirs in a join.
    Null and empty texts have the end as their only token; with no text to learn from all tokens are unseen."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    learned = texts.where("not held_out")
    counts = scratch.keep(count_tokens(learned), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = head_of(counts, max(classes, lexicon))
    head = [t for t, _ in known[:classes]]
    size = len(head) + 1
    pairs = count_pairs(learned, head).toArrow()
    matrix = np.zeros(size * size)
    matrix[pairs.column("pair").to_numpy()] = pairs.column("c").to_numpy()
    model = LogBilinear.train(matrix.reshape(size, size), **settings)
    rest, kinds = n - sum(c for _, c in known[: size - 1]), v - (size - 1)
    shared = spark.sparkContext.broadcast((model.table, [t for t, _ in known], np.log10(np.array([c for _, c in known], float) + 1)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, listed, logs = shared.value
        place = {t: i for i, t in enumerate(listed)}
        other = table.shape[0] - 1
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = tokens_of(text)
                at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                group = np.where((at >= 0) & (at < other), at, other)
                score = table[np.concatenate([group[-1:], group[:-1]]), group].sum(dtype=np.float64)
                log = logs[at[at >= 0]].sum()
                tail = Counter(w for w, i in zip(words, at.tolist()) if i < 0)
                rows.append((len(words), int((at >= 0).sum()), float(log), float(logs[at[at >= other]].sum()), int((group == other).sum()), float(score), [{"token": t, "tf": k} for t, k in tail.items()]))
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64())]))]
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "held_out", "n_tokens", "n_listed", "log", "log_other", "n_other", "part", "tail"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_listed long, log double, log_other double, n_other long, part double, tail array<struct<token:string,tf:bigint>>"
    scored = texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(task, schema).withColumn("row", F.monotonically_increasing_id())
    scored = scratch.keep(scored, "scored")
    tail = scored.select("row", F.inline("tail")).join(counts, "token", "left")
    seen = F.coalesce("c", F.lit(0))
    tail = tail.groupBy("row").agg(F.sum(F.col("tf") * F.log10(seen + 1)).alias("tail_log"), F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    joined = scored.drop("tail").join(tail, "row", "left").na.fill(0, ["tail_log", "tail_known"])
    base = F.col("log") + F.col("tail_log") - F.col("n_tokens") * float(np.log10(n + v + 1))
    score = F.col("part") + F.col("log_other") + F.col("tail_log") - F.col("n_other") * float(np.log10(rest + kinds + 1))
    known_now = (F.col("n_listed") + F.col("tail_known")).cast("long")
    return joined.select("doc_id", "held_out", "n_tokens", known_now.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
