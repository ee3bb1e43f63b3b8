"""Personal data in other cases of its key words, and formats with more units than surrogates."""

import re

from postlens.llm import pii


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.replace_entities(docs, "key").collect(), key=lambda r: r.doc_id)]


def test_key_words_and_titles_in_any_case(spark):
    texts = ['TOKEN = "9233A8EC11223344AABB"', "PASSWORD=hunter22", "Api_Key: abcdef123", "Token:zyxwvu987", "MRS. ANNA SMITH left", "mr. John left", "ГОСПОДИН Иванов", "I miss Boston"]
    found = replaced(spark, texts)
    kept = ['TOKEN = "', "PASSWORD=", "Api_Key: ", "Token:", "MRS. ", "mr. ", "ГОСПОДИН "]
    for before, after, prefix in zip(texts, found, kept):
        assert after.startswith(prefix) and after != before
    assert found[-1] == texts[-1]
    assert found[4].split()[1].lower().endswith("a")
    assert re.fullmatch('TOKEN = "[0-9][0-9A-Z]{19}"', found[0])


def test_a_full_space_grows(spark):
    """Twenty-six surrogates of the same form for two hundred one-letter mailboxes, all of ten for one-digit words."""
    found = replaced(spark, [f"to {chr(97 + i % 26)}@firm{i}.com now" for i in range(200)])
    addresses = [re.fullmatch(r"to ([a-z]@(?:[a-z]+\.)?example\.com) now", t)[1] for t in found]
    assert len(set(addresses)) == 200
