"""The pipeline's near-duplicates against brute force over pairs near the threshold."""

import random

from corpus_pipeline import distinct
from postlens.llm import similar


def shingle_set(text):
    found = (text or "").lower().split()
    span = min(5, len(found))
    return {tuple(found[i : i + span]) for i in range(len(found) - span + 1)} if found else set()


def brute_kept(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or 10 * len(sets[i] & sets[j]) >= 8 * either:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def variants():
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", "one two", "One  two", "two one", line, line + " more"]
    for n in (20, 45, 100, 300):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base) + " " + line)
            for changes in range(1, 2 + n // 25):
                for _ in range(2):
                    copy = list(base)
                    for at in pick.sample(range(n), changes):
                        copy[at] = word()
                    texts.append(" ".join(copy) + " " + line)
    pick.shuffle(texts)
    return list(enumerate(texts))


def test_pairs_at_the_similarity_are_linked_and_no_others(spark, tmp_path):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in distinct(spark, docs, str(tmp_path)).collect()) == brute_kept(rows)


def test_repeats_and_nulls(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, similar.keep_distinct(docs).collect()))) == ["(2, 'a b c d e f')", "(None, 'x y')"]
    assert similar.keep_distinct(docs.limit(0)).isEmpty()


def test_the_pipeline_goes_by_fingerprints():
    import inspect

    import corpus_pipeline

    assert "simhash.keep_one" in inspect.getsource(dict(corpus_pipeline.STAGES)["simhash"])
