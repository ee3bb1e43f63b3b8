"""Importance resampling against a plain reading of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from postlens.llm import resample

DOCS = "doc_id long, text string, score string, rank int, n_words string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def buckets(texts):
    return Counter(zlib.crc32(g.encode()) % 10_000 for t in texts for g in grams(t)[1])


def brute(rows, target, per_cent=5, least=20):
    s, t = buckets(r[1] for r in rows), buckets(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for doc_id, text, *_ in rows:
        words, own = grams(text)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(g.encode()) % 10_000) for g in own)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit):
        r[4] = i + 1 if i < per_cent * len(fit) // 100 else None
    return sorted(map(repr, [(*r[:4], None if r[4] is False else r[4]) for r in out]))


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    vocabulary = ["alpha", "Beta", "γάμμα", "d1", "É", "x", "foo-bar", "ÀÉ", "the", "of"]
    text = lambda n: "".join(pick.choice(vocabulary) + pick.choice([" ", ", ", "\n", "  "]) for _ in range(n))
    out = [(i, text(pick.randint(0, 60)), "clash", 1, "clash") for i in range(400)]
    return out + [(500, None, "", 1, ""), (501, "", "", 1, ""), (502, "...", "", 1, ""), (None, text(30), "", 1, ""), (7, text(40), "", 1, ""), (503, text(3000), "", 1, "")]


@pytest.mark.parametrize("batch", [64, 1 << 20])
def test_draw_equals_brute_force(spark, rows, monkeypatch, batch):
    """With a small batch many texts come in parts."""
    target = ["alpha beta the of " * 9, None, "", "γάμμα d1"]
    monkeypatch.setattr(resample, "BATCH", batch)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = resample.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), per_cent=20)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, found.collect()))) == brute(rows, target, 20)


def test_parts_of_a_long_text_count_each_feature_once(monkeypatch):
    monkeypatch.setattr(resample, "BATCH", 16)
    text = "one two three " * 5 + "x" * 50 + " é" * 20 + " ... " * 9 + "end"
    found = Counter(int(c) for _, _, codes in resample.features(pa.array(["a b", text, None, "c"])) for c in codes)
    assert found == buckets(["a b", text, "c"])


def test_no_documents_and_no_target(spark, rows):
    none = spark.createDataFrame([], DOCS)
    assert resample.resample(none, none).isEmpty()
    found = resample.resample(spark.createDataFrame(rows[:40], DOCS), none)
    assert sorted(map(repr, map(tuple, found.collect()))) == brute(rows[:40], [])
