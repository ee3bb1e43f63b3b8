"""Toxicity scores of a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.shared import Scratch, by_value, worker_cache

by_value(__name__)

TERM = re.compile(r"[^\W\d_]+")
SPACE = 1 << 30
STEMS = (4, 5)
FREQUENT = 200
#: Terms of a model; their places fit into two bytes.
SIZE = 2048
REMEMBERED = 200_000
GROUP = 256
THRESHOLD = 0.3


def hashes_of(word: str) -> list[int]:
    """Hashes of a word's terms: the word, and its first letters where it is longer, for inflected forms."""
    terms = [word, *(f"{n} {word[:n]}" for n in STEMS if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "replace")) % SPACE for t in terms]


def term_ids(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the terms of a text's lower-cased words."""
    words = set(TERM.findall((text or "").lower()))
    return np.unique(np.array([h for w in words for h in hashes_of(w)], np.uint32))


class FactorizationMachine:
    """logit = bias + sum of weights + pairwise products of latent vectors, over the terms a text holds.

    Only `terms`, the hashes chosen in training, count, so the model's size does not grow with the vocabulary."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    def logits(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """rows and places: the document and the term's place of each term found."""
        linear = np.bincount(rows, self.weights[places], n)
        v = self.factors[places]
        total = np.stack([np.bincount(rows, v[:, k], n) for k in range(v.shape[1])], 1)
        squares = np.bincount(rows, (v * v).sum(1), n)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def choose_terms(ids: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """The `size` terms whose presence tells most about the label (G statistic).

    A term counts only if chance would not give so strong a tie to the best of all terms (the likelihood ratio
    must exceed the number of terms, with some room), or if FREQUENT texts hold it, as it may tell something in a
    pair that it does not tell alone."""
    terms, where = np.unique(np.concatenate(ids), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    seen = np.bincount(where, minlength=len(terms)).astype(float)
    toxic = np.bincount(where, labels[owner], len(terms))
    n, p = len(ids), labels.sum()

    def cell(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9))

    gain = cell(toxic, seen * p / n) + cell(seen - toxic, seen * (n - p) / n)
    gain += cell(p - toxic, (n - seen) * p / n) + cell(n - seen - p + toxic, (n - seen) * (n - p) / n)
    sure = (gain > np.log(len(terms)) + 2) | (seen >= FREQUENT)
    best = np.argsort(-np.where(sure, gain, -1), kind="stable")[: min(size, int(sure.sum()))]
    return np.sort(terms[best])


def find_places(terms: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index within ids, place within terms) of the ids that the model knows."""
    place = np.minimum(np.searchsorted(terms, ids), max(0, len(terms) - 1))
    known = terms[place] == ids if len(terms) else np.zeros(len(ids), bool)
    return np.flatnonzero(known), place[known]


def train(ids: list[np.ndarray], labels: np.ndarray, size: int = SIZE, **settings) -> FactorizationMachine:
    """Choose terms from the term hashes of each text and fit a machine on them."""
    labels = np.asarray(labels, float)
    if not len(ids) or not sum(map(len, ids)):
        return learn(np.zeros(0, np.uint32), [], labels, **settings)
    terms = choose_terms(ids, labels, size)
    return learn(terms, [find_places(terms, x)[1] for x in ids], labels, **settings)


def learn(terms: np.ndarray, places: list[np.ndarray], labels: np.ndarray, rank: int = 8, epochs: int = 20, batch: int = 512, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
    """Fit by AdaGrad on the logistic loss, in batches whose order is fixed by the seed. `places`: where the terms of each
    text stand among `terms`."""
    labels = np.asarray(labels, float)
    prior = (labels.sum() + 0.5) / (len(labels) + 10)
    if not len(terms):
        return FactorizationMachine(terms, float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, rank)))
    draw = np.random.default_rng(seed)
    fm = FactorizationMachine(terms, float(np.log(prior / (1 - prior))), np.zeros(len(terms)), draw.normal(0, 0.02, (len(terms), rank)))
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-6), np.full((len(terms), rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = draw.permutation(len(places))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            rows, at = np.repeat(np.arange(len(own)), [len(places[i]) for i in own]), np.concatenate([places[i] for i in own])
            error = sigmoid(fm.logits(rows, at, len(own))) - labels[own]
            v = fm.factors[at]
            total = np.zeros((len(own), rank))
            np.add.at(total, rows, v)
            touched, back = np.unique(at, return_inverse=True)
            grad_w = np.bincount(back, error[rows], len(touched)) / len(own) + decay * fm.weights[touched]
            grad_v = np.zeros((len(touched), rank))
            np.add.at(grad_v, back, error[rows, None] * (total[rows] - v))
            grad_v = grad_v / len(own) + decay * fm.factors[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            fm.weights[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            fm.factors[touched] -= rate * grad_v / np.sqrt(seen_v[touched])
            step = error.mean()
            seen_b += step**2
            fm.bias -= rate * step / np.sqrt(seen_b)
    return fm


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the doc_id's text leaves 2 by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chosen_terms(texts: DataFrame, size: int) -> np.ndarray:
    """`choose_terms` as an aggregation: terms are counted by label in Spark and only the chosen ones reach the driver.

    `texts` has toxic and ids, the sorted term hashes of a text."""
    n, p = texts.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return np.zeros(0, np.uint32)
    counts = texts.select("toxic", F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("seen"), F.sum("toxic").cast("double").alias("hit"))
    seen, hit, n, p = F.col("seen"), F.col("hit"), float(n), float(p)

    def cell(observed: Column, expected: Column) -> Column:
        return observed * F.log(F.greatest(observed, F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9)))

    gain = cell(hit, seen * p / n) + cell(seen - hit, seen * (n - p) / n) + cell(p - hit, (n - seen) * p / n) + cell(n - seen - p + hit, (n - seen) * (n - p) / n)
    terms = counts.count()
    sure = (F.col("gain") > float(np.log(max(terms, 1)) + 2)) | (seen >= FREQUENT)
    best = counts.withColumn("gain", gain).where(sure).orderBy(F.desc("gain"), "term").limit(size).select("term").toArrow()
    return np.sort(best.column(0).to_numpy().astype(np.uint32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, size: int = SIZE, **settings) -> FactorizationMachine:
    """Learn `labels.toxic` from labelled documents that are not held out.

    At most `sample` labelled doc_ids, the first by hash, are learned from: that bounds what is broadcast. Their terms are
    counted and chosen in Spark; the driver gets for each text the places of the chosen terms, two bytes each, so a long text
    costs it no more than `size` of them. Rows without a doc_id or label teach nothing; a doc_id labelled twice counts as
    toxic if either label is; of several texts with one doc_id one is learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # A few hundred texts at a time: their hashes take more room than the texts.
        for texts in batches:
            for at in range(0, len(texts), GROUP):
                yield texts.iloc[at : at + GROUP].map(term_ids)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    hashed = F.pandas_udf(each, "array<long>")
    scratch = Scratch(docs.sparkSession, "toxicity")
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", hashed("text").alias("ids"))
    texts = scratch.keep(own.groupBy("doc_id", "toxic").agg(F.min("ids").alias("ids")), "texts")
    terms = chosen_terms(texts, size)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            for at in range(0, len(ids), GROUP):
                yield ids.iloc[at : at + GROUP].map(lambda x: find_places(terms, np.asarray(x, np.uint32))[1].astype(np.uint16).tobytes())

    place.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    placed = F.pandas_udf(place, "binary")
    rows = texts.select("doc_id", "toxic", placed("ids").alias("places")).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    places, toxic = rows.column("places"), rows.column("toxic").to_numpy()
    # As numbers of eight bytes they would take four times the room; `learn` widens those of a batch.
    return learn(terms, [np.frombuffer(places[int(i)].as_py(), np.uint16) for i in order], toxic[order], **settings)


def score_column(fm: FactorizationMachine, text: Column) -> Column:
    """The probability of label 1; null and empty texts score as a text without known terms."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chosen = {int(t): i for i, t in enumerate(fm.terms)}
        cache = worker_cache("toxicity terms")
        if cache.get("of") != (key := hash(fm.terms.tobytes())):
            cache.clear()
            cache["of"], cache["words"] = key, {}
        for texts in batches:
            words: dict = cache["words"]
            rows, places = [], []
            for i, text in enumerate(texts):
                found = set(TERM.findall((text or "").lower()))
                if fresh := [w for w in found if w not in words]:
                    if len(words) + len(fresh) > REMEMBERED:
                        words = cache["words"] = {w: words[w] for w in found if w in words}
                    words.update((w, tuple(chosen[h] for h in hashes_of(w) if h in chosen)) for w in fresh)
                own = set().union(*map(words.__getitem__, found))
                places += sorted(own)
                rows += [i] * len(own)
            logits = fm.logits(np.array(rows, np.int64), np.array(places, np.int64), len(texts))
            yield pd.Series(sigmoid(logits))

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "double")(text)


def toxicity(docs: DataFrame, fm: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted. Repeated rows give repeated rows."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(fm, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, fm: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), score_column(fm, F.col("text")).alias("score")).where(F.col("score") < threshold).select("row.*")
