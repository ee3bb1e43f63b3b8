"""Collocations against a plain count of all phrases; tries against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import phrases
from postlens.llm.shared import Scratch
from postlens.llm.trie import Trie

DOCS = "lang string, text string, word string, ids int, n long"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, longest=5, top=2000, held=100):
    f, n, out = Counter(), Counter(), []
    for lang, text, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, a in found.items():
        words = p[1:]
        dropped |= {(p[0], *words[i : i + k]) for k in range(2, len(words)) for i in range(len(words) - k + 1) if 100 * a >= held * f[(p[0], *words[i : i + k])]}
    for p, a in found.items():
        if p in dropped:
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
        score, k = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, f[p[:k]], f[(p[0], *p[k:])], n[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, ranked = Counter(), []
    for r in out:
        rank[r[0]] += 1
        ranked += [(r[0], rank[r[0]], *r[1:])] if rank[r[0]] <= top else []
    return ranked


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(2)
    words = ["the", "The", "new", "york", "times", "É", "é", "a\x00b", "x-y", "ü"]
    text = lambda n: "".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ", ", "\r\n", ". "]) for _ in range(n))
    out = [(pick.choice(["en", "en", "fr", None, "und", ""]), text(pick.randint(0, 50)), "clash", 1, 2) for _ in range(120)]
    return out + [("en", "new york times new york times " * 9, "", 1, 2), ("en", None, "", 1, 2), (None, "", "", 1, 2), ("en", " \t.;", "", 1, 2), ("fr", "la la la la la la la", "", 1, 2)] + out[:5]


@pytest.mark.parametrize(("least", "shard", "top", "held"), [(4, 1 << 19, 2000, 100), (3, 7, 15, 60)])
def test_collocations_equal_brute_force(spark, rows, monkeypatch, least, shard, top, held):
    """With small shards there are many tries for each length."""
    monkeypatch.setattr(phrases, "SHARD", shard)
    found = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(4), least, 5 if shard > 7 else 3, top, held).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute(rows, least, 5 if shard > 7 else 3, top, held))


def test_only_phrases_of_full_buckets_become_candidates(spark):
    """All pairs of the words are frequent, their triples are not: they are counted in buckets and not sent one by one."""
    pick = random.Random(4)
    texts = [" ".join(f"w{pick.randrange(40)}" for _ in range(500)) + ". red green blue" for _ in range(200)]
    scratch = Scratch(spark, "phrases")
    docs = spark.createDataFrame([("en", x) for x in texts], "lang string, text string").repartition(4)
    found = phrases.frequent_phrases(docs, 30, 3, scratch)[2].where("size(ids) = 3").collect()
    assert [r.f for r in found] == [200]
    triples = {tuple(x[i : i + 3]) for x in (t.split(".")[0].split() for t in texts) for i in range(498)}
    assert len(triples) > 40_000
    assert spark.read.parquet(scratch.path("candidates3")).count() < 1000


@pytest.mark.parametrize(("least", "slice_", "buckets"), [(4, 8, 8), (300, 16, 64)])
def test_full_buckets_hold_no_phrase_back(spark, rows, monkeypatch, least, slice_, buckets):
    """A few buckets, which all phrases share, and counters beyond one byte; several tries and slices of each."""
    monkeypatch.setattr(phrases, "SLICE", slice_)
    monkeypatch.setattr(phrases, "BUCKETS", buckets)
    monkeypatch.setattr(phrases, "SHARD", 50)
    rows = rows * (1 if least < 300 else 20)
    found = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least, 4).collect()
    expected = brute(rows, least, 4)
    assert expected and sorted(tuple(r) for r in found) == sorted(expected)


def test_counters_of_tasks_add_up():
    """Slices without counts are not sent; sums stop at `most`, and no counter runs over."""
    counts = np.zeros(3 * phrases.SLICE, np.uint8)
    counts[[0, 5, -1]] = 1, 200, 255
    sent = [b for _ in range(3) for b in phrases.slices(counts)]
    assert [p for b in sent[:1] for p in b.column("part").to_pylist()] == [0, 2]
    own = phrases.summed(iter(sent), np.uint8, 255)
    assert {p: x[x > 0].tolist() for p, x in own.items()} == {0: [3, 255], 2: [255]}


def test_no_frequent_phrase_and_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([("en", "a b c", "", 1, 2)], DOCS)).isEmpty()
    assert phrases.collocations(spark.createDataFrame([], DOCS)).isEmpty()


def test_scores_are_exact_beyond_64_bits(spark):
    above, below = 3 * 10**12 * 7 * 10**13 * 1000, 10**12 * (10**12 + 1)
    row = spark.sql("SELECT CAST(3000000000000 AS decimal(19,0)) * CAST(70000000000000 AS decimal(19,0)) * CAST(1000 AS decimal(4,0)) AS above, CAST(1000000000000 AS decimal(19,0)) * CAST(1000000000001 AS decimal(19,0)) AS below")
    assert row.selectExpr("above div below").first()[0] == above // below


def test_word_numbers():
    numbers, words = phrases.word_numbers(pa.array(["A b.b", "", None, "b", ". a..\tB\x0bc ", "É;"]))
    own = ["|", *words.to_pylist()]
    assert [own[i] for i in numbers] == ["a", "b", "|", "b", "|", "b", "|", "a", "|", "b", "|", "c", "|", "É"]


def test_renumber_keeps_every_run_of_two(spark):
    words = np.array([1, 0, 2, 3, 0, 4, 1, 2, 5, 3, 3, 0, 2], np.int32)
    batch = pa.RecordBatch.from_pydict({"numbers": [words.tobytes()], "size": [5], "at": [[0, 1, 2]], "ids": [[11, 12, 13]]})
    (out,) = list(phrases.renumber(iter([batch])))
    assert np.frombuffer(out.column(0)[0].as_py(), np.int32).tolist() == [12, 13, 0, 11, 12, 0, 13, 13, 0]


@pytest.mark.parametrize(("vocabulary", "n", "length", "digits"), [(5, 40, 2, 1), (300, 400, 3, 2), (70_000, 3000, 3, 3), (3, 1, 1, 1), (3, 0, 2, 1)])
def test_trie_finds_what_a_dictionary_finds(vocabulary, n, length, digits):
    rng = np.random.default_rng(length)
    rows = np.unique((rng.zipf(1.3, (n, length)) % vocabulary + 1).astype(np.int32), axis=0)
    rng.shuffle(rows)
    ids = (rng.zipf(1.3, 5000) % (vocabulary + 1)).astype(np.int32)
    at, row = Trie(rows, digits).find(ids)
    known, all_ids = {tuple(r): i for i, r in enumerate(rows.tolist())}, ids.tolist()
    windows = [(i, tuple(all_ids[i : i + length])) for i in range(len(all_ids) - length + 1)]
    assert list(zip(at.tolist(), row.tolist())) == [(i, known[w]) for i, w in windows if w in known]
