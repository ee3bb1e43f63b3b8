import pytest
from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from postlens.functions import classify as cl, html, text, url, values
from postlens.functions.register import register_functions

QUIET = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def test_whitespace_and_matching(column):
    rows = [(" a \t b\r\nc\n\n\n\nd ﻿",), ("Co‑Op – X",)]
    assert column(rows, "s string", text.normalize_whitespace(F.col("s"))) == ["a b \nc\n\nd", "Co‑Op – X"]
    assert column(rows, "s string", text.normalize_for_match(F.col("s")))[1] == "co-op - x"


def test_unique_ci_keeps_first_spelling(column):
    rows = [(["WebGL", " webgl ", "", "SVG", "svg"],)]
    assert column(rows, "a array<string>", text.unique_ci(F.col("a"))) == [["WebGL", "SVG"]]


def test_truncate_and_snippet(column):
    assert column([("abc  def",)], "s string", text.truncate(F.col("s"), 6)) == ["abc…"]
    long = "x" * 300 + " Needle " + "y" * 300
    assert column([(long,)], "s string", text.find_snippet(F.col("s"), "needle"))[0].count("Needle") == 1
    assert len(column([(long,)], "s string", text.find_snippet(F.col("s"), "absent"))[0]) == 240


@pytest.mark.parametrize(
    "given_text, slug",
    [("Café Münster", "cafe-mu-nster"), ("--Hello, World--", "hello-world"), ("½ ﬁn", "1-2-fin"), ("", "")],
)
def test_slug(column, given_text, slug):
    assert column([(given_text,)], "s string", text.slugify(F.col("s"))) == [slug]


def test_json_numbers_and_objects(column):
    rows = [(120000.0,), (0.57,), (None,)]
    assert column(rows, "n double", text.json_number(F.col("n"))) == ["120000", "0.57", "null"]
    built = text.json_object({"b": text.json_number(F.col("n")), "a": text.json_string(F.lit('q"\n'))})
    assert column([(1.0,)], "n double", built) == ['{"a":"q\\"\\n","b":1}']


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<p>a &amp; b &eacute; &#233; &#xE9; &copy 2 &bogus; &notit; &#150;</p>", "a & b é é é © 2 &bogus; ¬it; –"),
        ("<script>if (a<b) x</script>t<style>p{}</style><noscript>n</noscript><svg><path d='>'/></svg>", "t"),
        ("<!-- <p>no</p> -->yes<br>no gap <b title=\"a>b\">z</b>", "yesno gap z"),
        ("cut <p", "cut"),
        ("5 < 6 & 7", "5 < 6 & 7"),
        ("&lt;b&gt; &amp;lt;", "<b> &lt;"),
    ],
)
def test_html_to_text(column, source, expected):
    assert column([(source,)], "h string", html.html_to_text(F.col("h"))) == [expected]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("HTTPS://Ex.com:443/a/../b?z=1&utm_source=x&a=2%20c&ref=1&refx=3&b#f", "https://ex.com/b?a=2+c&b=&refx=3&z=1"),
        ("http://a.com", "http://a.com/"),
        ("https://a.com/?UTM_medium=1&GCLID=2&source=x", "https://a.com/"),
        ("ftp://a.com/x", None),
        ("not a url", None),
        ("https://a.com/?b=1&a=2&a=1", "https://a.com/?a=2&a=1&b=1"),
    ],
)
def test_canonical_url(column, source, expected):
    once = column([(source,)], "u string", url.canonical_url(F.col("u")))
    assert once == [expected]
    if expected:
        assert column([(expected,)], "u string", url.canonical_url(F.col("u"))) == [expected]


@QUIET
@given(hs.lists(hs.tuples(hs.sampled_from(["a", "b", "utm_x", "ref", "ü"]), hs.text("xyz &=%+é/", max_size=5)), max_size=5))
def test_canonical_url_is_idempotent(column, pairs):
    query = "&".join(f"{k}={v}" for k, v in pairs).replace("#", "")
    first = column([("https://e.com/p?" + query,)], "u string", url.canonical_url(F.col("u")))
    assert column([(first[0],)], "u string", url.canonical_url(F.col("u"))) == first


@pytest.mark.parametrize(
    "href, expected",
    [
        ("../x", "https://ex.com/p/x"), ("/y?q=1", "https://ex.com/y?q=1"), ("?z=2", "https://ex.com/p/q/r.html?z=2"),
        ("#t", "https://ex.com/p/q/r.html?o=1#t"), ("//H.com/a", "https://h.com/a"), ("b/./c", "https://ex.com/p/q/b/c"),
        ("http://A.com", "http://a.com/"), (None, "https://ex.com/p/q/r.html?o=1"),
    ],
)
def test_resolve_url(column, href, expected):
    made = url.resolve_url(F.col("h"), F.lit("https://ex.com/p/q/r.html?o=1"))
    assert column([(href,)], "h string", made) == [expected]


@pytest.mark.parametrize(
    "source, verdict",
    [
        ("http://10.1.2.3/", "private-ip"), ("http://100.64.0.1/", "private-ip"), ("http://172.32.0.1/", "ok"),
        ("http://169.254.169.254/latest", "private-ip"), ("http://8.8.8.8/", "ok"), ("http://2130706433/", "private-ip"),
        ("http://[::1]/", "private-ip"), ("http://[fd00::1]/", "private-ip"), ("http://[2606:4700::1]/", "ok"),
        ("http://localhost:80/", "local-hostname"), ("http://a.localhost./", "local-hostname"), ("https://u:p@h.com/", "embedded-credentials"),
        ("file:///etc", "blocked-protocol"), ("nonsense", "invalid-url"), ("https://ok.example.com/x", "ok"),
    ],
)
def test_url_safety(column, source, verdict):
    assert column([(source,)], "u string", url.url_safety(F.col("u"))) == [verdict]


@pytest.mark.parametrize(
    "number, words, expected",
    [
        (1_786_000_000_000.0, None, 1_786_000_000), (1_786_000_000.7, None, 1_786_000_000), (None, "2026-08-13", 1_786_579_200),
        (None, "2026-08-13T10:00:00.5+09:00", 1_786_582_800), (None, "Thu, 13 Aug 2026 10:00:00 GMT", 1_786_615_200),
        (None, "Aug 13, 2026", 1_786_579_200), (None, "soon", None), (None, " ", None),
    ],
)
def test_posted_at(column, number, words, expected):
    assert column([(number, words)], "n double, t string", values.posted_at(F.col("n"), F.col("t"))) == [expected]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("Pay USD 120,000 - 150,000 per year", ("USD", 120000.0, 150000.0, "year")),
        ("€60.5–€80 / Hour", ("EUR", 60.5, 80.0, "hour")),
        ("₩1,000 to 2,000", ("KRW", 1000.0, 2000.0, None)),
        ("1,000 - 2,000", None),
    ],
)
def test_salary_from_text(column, source, expected):
    found = column([(source,)], "t string", values.salary_from_text(F.col("t")))[0]
    assert (tuple(found) if found else None) == expected


def test_salary_text(column):
    rows = [("USD", 1000.5, 2000.0, "year"), (None, None, 5.0, None), ("USD", None, None, None)]
    ddl = "c string, a double, b double, i string"
    shown = column(rows, ddl, values.salary_text(F.col("c"), F.col("a"), F.col("b"), F.col("i")))
    assert shown == ["USD 1,001–2,000 / year", "5", "미공개"]


def _classified(spark, title, place, description, profile=cl.DEFAULT_PROFILE):
    df = spark.createDataFrame([(title, place, description)], "title string, location_text string, description_text string")
    return cl.classify(df, profile).first()


def test_ideal_posting(spark):
    row = _classified(
        spark, "Senior Graphics Engineer", "Remote worldwide",
        "We are async-first with no core hours. Three.js and WebGL. You own the product end to end. Salary $150,000.",
    )
    assert row["eligible_from_korea"] == "yes" and row["async_level"] == "explicit"
    assert "Three.js" in row["skills"] and row["score"] >= 90


def test_restricted_posting(spark):
    row = _classified(
        spark, "Frontend Engineer", "US only", "Must be located in the United States. Daily stand-up and 5 hours overlap with PST."
    )
    assert row["eligible_from_korea"] == "no" and row["score"] < 40


def test_restriction_beats_global_wording(spark):
    row = _classified(spark, "Product Engineer", "Remote", "A global remote team. Remote within the United States.")
    assert (row["remote_scope"], row["eligible_from_korea"]) == ("region-limited", "no")


def test_named_country_counts_even_beside_a_restriction(spark):
    row = _classified(spark, "Engineer", "Remote", "US only, or South Korea.")
    assert (row["remote_scope"], row["eligible_from_korea"]) == ("region-limited", "yes")


def test_confidence_rounds_the_binary_sum(column):
    rows = [(4, 3), (2, 3), (6, 10), (0, 0), (1, 1)]
    found = column(rows, "k int, e int", cl.confidence(F.col("k"), F.col("e")))
    assert found == [0.79, 0.59, 0.98, 0.32, 0.45]


def test_evidence_order(spark):
    df = spark.createDataFrame(
        [("Back-end Developer", "Berlin, hybrid", "Daily stand-up. Frequent client meetings.")],
        "title string, location_text string, description_text string",
    )
    row = cl.classify(df).select("evidence", values.sort_evidence(F.col("evidence")).alias("ranked")).first()
    assert [(e["field"], e["effect"]) for e in row["evidence"]] == [
        ("eligibleFromKorea", -40), ("asyncLevel", -8), ("role", -10), ("syncRisk", -8), ("syncRisk", -8),
    ]
    assert [e["field"] for e in row["ranked"]] == ["asyncLevel", "syncRisk", "syncRisk", "role", "eligibleFromKorea"]
    assert "stand-up" in row["ranked"][1]["text"]


def test_word_boundaries_are_ascii(column):
    rows = [("é et",), ("éet",), ("étet",), ("xet",)]
    assert column(rows, "t string", cl.timezone(F.col("t"))) == ["ET", "ET", None, None]


def test_prefilter_literals_are_required():
    import re

    for group in (cl.WORLDWIDE, cl.APAC, cl.REGION_LIMITED, cl.REMOTE, cl.HYBRID, cl.ONSITE, cl.OWNERSHIP, cl.COMPENSATION):
        for pattern in group:
            literals = cl.needed_literals(pattern)
            for sample in ("must be located in the us", "3 days per week in the office", "salary", "ship products", "hires globally"):
                if literals and re.search(pattern, sample):
                    assert any(x in sample for x in literals)


def test_named_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT posting_normalize_whitespace(' a\\u00a0\\t b ') a, posting_score_band(85) b, posting_canonical_url('http://a.com?b=1&utm_x=2#f') c").first()
    assert tuple(row) == ("a b", "excellent", "http://a.com/?b=1")
    cards = spark.sql("SELECT title, url FROM posting_html_cards('<ul><li class=j><a href=/x>T</a></li></ul>', 'li.j', 'a')").collect()
    assert [tuple(c) for c in cards] == [("T", "/x")]


SAME_IN_SQL = [
    "http://a.com/x/../y", "http://U@a.com/", " http://a.com/b ", "http://a.com\\b\\..\\c?x=1&utm_source=q&b=2#f", "HTTPS://User:Pw@Ex.COM:443/%7e/./a/../", "http://a.com:80",
    "ftp://x/y", None, "", "http:///a", "https://x.com/a/b/../../..", "http://a.com/?b=2&a=%20x&ref=1&=v&c", "http://a.com/.hidden/a.", "http://x.com/a\tb\nc", "https://a.b:8443/p?x",
]


def test_the_sql_function_gives_what_the_column_gives(spark):
    register_functions(spark)
    rows = spark.createDataFrame([(u,) for u in SAME_IN_SQL], "u string")
    for row in rows.select("u", url.canonical_url(F.col("u")).alias("column"), F.expr("posting_canonical_url(u)").alias("named")).collect():
        assert row.column == row.named, row.u


def test_url_safety_reads_a_numeric_host_once(spark):
    from postlens.functions.url import url_safety

    rows = spark.createDataFrame([("http://10.1.2.3/x",), ("http://0x7f.1/",), ("http://8.8.8.8/",), (None,)], "u string").select(url_safety(F.col("u")).alias("s"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r.s for r in rows.collect()] == ["private-ip", "private-ip", "ok", "invalid-url"]


def test_zones_take_one_test_a_place_and_are_found_as_before(column):
    from postlens.functions.classify import TIMEZONE, timezone
    from postlens.functions.text import ascii_regex

    pattern = ascii_regex(TIMEZONE)
    # Both kinds of zones stand behind one look back, and no class of letters is written out in it.
    assert pattern.startswith(r"(?i)(?<!\w)(?:(?:UTC|GMT)") and "[A-Za-z0-9_]" not in pattern
    texts = ["utc +9", "xutc+9 or kst", "pst", "_pst est", "\u00e9pst", "gmt", "at 9 et.", "pstx", "gmt\u00a0- 03:30", "utc+123", "cest9 aest"]
    expected = ["UTC+9", "KST", "PST", "EST", "PST", None, "ET", None, "GMT\u00a0-03:30", "UTC+12", "AEST"]
    assert column([(t,) for t in texts], "t string", timezone(F.col("t"))) == expected
