"""Best-fit packing against one-by-one packing, every id kept, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import bestfit

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length string, rank string, ids int"


def spread(slots, counts, capacity):
    """The sequences that slots describe, as lists of (offset, length)."""
    out = {}
    for size, n in enumerate(counts):
        own = slots[slots[:, 0] == size]
        for rank in range(n):
            _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1].tolist()
            k, j = divmod(rank - first, each)
            out.setdefault(sequence + k, []).append((offset + j * size, size))
    return out


def best_fit(sizes, capacity):
    """Sequences that best-fit decreasing needs, one piece at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan_fills_sequences_without_gaps_and_is_as_good_as_best_fit(seed):
    pick = random.Random(seed)
    capacity = pick.choice([7, 30, 64])
    top = pick.choice([capacity, capacity // 2, max(1, capacity // 3)])
    sizes = [pick.randint(1, top) for _ in range(pick.choice([0, 1, 5, 200]))] + [pick.randint(1, capacity)] * pick.choice([0, 50])
    counts = np.bincount(sizes, minlength=capacity + 1)
    slots, n = bestfit.plan(counts, capacity)
    found = spread(slots, counts.tolist(), capacity)
    assert sorted(found) == list(range(n))
    for own in found.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[s for _, s in own][:-1]]).tolist()
        assert sum(s for _, s in own) <= capacity and sum(3 * s > capacity for _, s in own) <= 2
    assert sum(map(len, found.values())) == len(sizes)
    assert n <= best_fit(sizes, capacity) or n == -(-sum(sizes) // capacity)


def test_large_lengths_are_matched_as_well_as_possible():
    """All above a third: no matching joins more pairs than the greedy one."""
    for seed in range(200):
        pick = random.Random(seed)
        sizes = [pick.randint(11, 30) for _ in range(8)]

        def pairs(rest):
            if not rest:
                return 0
            a, others = rest[0], rest[1:]
            return max([pairs(others), *[1 + pairs(others[:i] + others[i + 1 :]) for i, b in enumerate(others) if a + b <= 30]])

        _, n = bestfit.plan(np.bincount(sizes, minlength=31), 30)
        assert n == len(sizes) - pairs(sizes)


def test_slots_do_not_grow_with_the_documents():
    counts = np.random.default_rng(1).integers(0, 1000, 2049)
    counts[0] = 0
    few, many = len(bestfit.plan(counts)[0]), len(bestfit.plan(counts * 1_000_003)[0])
    assert many < 2 * few < 20_000


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    texts = [None, "", " \n", "a", "a", "Ünï word. " * 3, "x" * 500, "few words of text, " * 300] + ["tok " * pick.randint(0, 90) for _ in range(150)]
    return [(i, t, "clash", "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "", "", 1), (3, "a", "", "", 1)]


@pytest.mark.parametrize("capacity", [32, 2048])
def test_every_id_lies_in_one_piece(spark, rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    found = bestfit.pack_best_fit(spark.createDataFrame(rows, DOCS).repartition(4), PATH, capacity).cache()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            own = np.array(ids[k : k + capacity], "<u4")
            want[doc_id, k // capacity, k, len(own), zlib.crc32(own.tobytes())] += 1
    got = found.select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset").collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own][:-1]]).tolist() and sum(n for _, n in own) <= capacity
    assert len(by) <= best_fit([r.length for r in got], capacity)
    whole = {r.sequence_id: r for r in bestfit.sequences(found).collect()}
    assert all(whole[s].n_tokens == sum(n for _, n in own) == len(whole[s].ids) // 4 for s, own in by.items())
    found.unpersist()


def test_no_documents(spark):
    assert bestfit.pack_best_fit(spark.createDataFrame([], DOCS), PATH).isEmpty()
