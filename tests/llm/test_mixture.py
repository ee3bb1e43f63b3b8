"""Packing with more sources than a driver's list used to hold."""

import public_tokenizers
import pytest

from postlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_small_source_among_many_follows_its_weight(spark):
    """Three hundred sources; the smallest weighs as much as all others, so half of the first windows are its own."""
    rows = [(i, "some words of a text " * 40, f"s{i % 300}") for i in range(600)] + [(1000 + i, "few words " * 30, "tiny") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, PATH, window=1024, segment=16, weights={"tiny": 1.0}).collect()
    tokens = sum(p.doc_tokens for p in pieces if p.source == "tiny" and p.start == 0)
    early = sum(p.length for p in pieces if p.source == "tiny" and p.sequence_id == 0)
    assert 0 < tokens < 1024 and early >= 0.6 * min(tokens, 512)
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


@pytest.mark.parametrize("weights", [{"absent": 1.0}, {"s1": -1.0}, {"s1": float("nan")}])
def test_a_weight_that_cannot_be_applied_is_an_error(spark, weights):
    docs = spark.createDataFrame([(1, "a text", "s1")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="weights"):
        packing.pack(docs, PATH, weights=weights).count()
