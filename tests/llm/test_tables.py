"""Operators over embeddings and pages, the registered queries and the pipeline."""

import math
import os
import random
import sys
import zlib

import compare
import numpy as np
import pytest

from postlens.llm import embeddings, queries, urlrules

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row long, v string"


def brute_links(rows, least):
    unit = []
    for _, v, *_ in rows:
        bad = not v or any(x is None or not math.isfinite(x) for x in v) or not any(v)
        x = None if bad else np.array(v, np.float32).astype(float)
        unit.append(None if bad else x / np.linalg.norm(x))
    group, n = list(range(len(rows))), [0] * len(rows)
    pairs = [(i, j) for i, a in enumerate(unit) for j, b in enumerate(unit) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= least]
    for i, _ in pairs:
        n[i] += 1
    for _ in rows:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    least_id = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return [(r[0], n[i], least_id[group[i]], r[0] is not None and r[0] == least_id[group[i]]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("tile", [embeddings.TILE, 8])
def test_vectors(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    draw = np.random.default_rng(2)
    rows = []
    for i in range(40):
        base = draw.normal(size=16)
        for _ in range(draw.integers(1, 6)):
            rows.append((len(rows), [float(x) for x in np.float32(base + draw.normal(size=16) * 0.1)], 0, 9, "x"))
    special = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [-0.0, 1.0, 0.0]]
    rows += [(1000 + i, v, None, 9, "x") for i, v in enumerate(special)] + [(rows[0][0], rows[0][1], 1, 9, "x"), (None, rows[3][1], 1, 9, "x"), (2000, rows[5][1], 1, 9, "x")]
    found = embeddings.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), per_cell=16)
    expected = brute_links(rows, 0.95)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).isEmpty()


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(1)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in draw.normal(size=(2, 300, 64)))
    total, missed = np.zeros((300,)), 0
    for seed in range(60):
        codes = embeddings.Codes(64, 4.0, seed)
        bits, factors = codes.encode(x)
        signs = (np.unpackbits(bits, axis=1, count=64) * 2.0 - 1) / 8
        estimate = (signs * (y @ codes.rotation)).sum(1) / factors
        total += estimate
        missed += int((np.abs(estimate - (x * y).sum(1)) > 4 * np.sqrt((1 - factors**2) / 63) / factors).sum())
    assert np.abs(total / 60 - (x * y).sum(1)).mean() < 0.02 and missed <= 5


URLS = [
    "http://A.Example.net/en/x?q=1", "https://example.net/de/", "http://www.example.com/de/1#f", "http://example.com/DE/", "x://sub.org/fr/9", "http://net/", "http://net",
    "http://other.net?x=/a", None, "", "no scheme", "http://internet/", "http://a.com/cgi-bin/run", "http://casino.example.org/en", "http://a.b/pay-xxx?", "http://Üb.net/en/", "a://b://c.net/x",
]


def test_url_rules(spark):
    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(-len(h + p), h + p, a) for a, h, p in urlrules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        import re

        other = [(a != "block", a) for a, _, e in urlrules.PATTERN_RULES if re.search(e, host + path)]
        return host, path, min(fits)[1] if fits else None, min(fits)[2] if fits else min(other)[1] if other else "allow"

    rows = [(i, u, "h", "t") for i, u in enumerate([*URLS, *URLS[:4]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, target string, token string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages).collect()}
    assert found == {i: judge(u) for i, u, *_ in rows}
    assert urlrules.judge_urls(pages.where("false")).isEmpty()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    assert compare.spark_rows(queries.QUERIES[name](spark, SF)) == compare.duck_rows(duck, queries.ORACLE[name])


@pytest.mark.parametrize("name", ["op7_decontamination", "op8_surrogates", "op10_url_rules"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, tmp_path):
    sys.path.insert(0, ROOT)
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 8)))
    base = [" ".join(word() for _ in range(80)) for _ in range(120)]
    exam = " ".join(word() for _ in range(30))
    texts, gone = dict(enumerate(base)), set()
    for i in range(0, 60):
        texts[i] += " scumbag" * (i % 3 == 0)
        gone |= {i} if i % 3 == 0 else set()
    texts[200], texts[201] = texts[61], texts[62] + " end"
    texts[202] = texts[63][:200] + " " + " ".join(exam.split()[4:20])
    texts[70] += " mail ann.lee@corp.com"
    gone |= {200, 202}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in gone)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - gone - {201} <= set(kept) <= set(texts) - gone
    assert all(r.text == texts[i] for i, r in kept.items() if i != 70) and "ann.lee" not in kept[70].text and kept[70].n_chars == len(kept[70].text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for i, r in kept.items()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(kept) and sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
