import json

import pytest
from pyspark.sql import functions as F

from postlens.schemas import CONFIG, RESPONSE
from postlens.sources import cards, landed, registry
from postlens.sources.details import enrich_details
from postlens.sources.tables import Tables

FEED = f"source_id string, run_id string, kind string, source_url string, company_name string, body string, config {CONFIG}"


def feed(make, kind, body, config=None, source="s1"):
    row = dict(source_id=source, run_id="r1", kind=kind, source_url="https://base.com/careers", company_name="Co", body=body)
    return make(FEED, {**row, "config": tuple((config or {}).get(n) for n in (
        "listSelector", "titleSelector", "locationSelector", "linkSelector", "departmentSelector", "detailDescriptionSelector",
        "waitForSelector", "headers",
    ))})


def test_board_a(make):
    body = {"jobs": [{"id": 7, "title": " Engineer ", "absolute_url": "https://x/7", "location": {"name": "Remote"}, "content": "<p>Hi &amp; bye</p>",
                      "departments": [{"name": "A"}, {}, {"name": "B"}], "metadata": [{"name": "Employment Type", "value": 3}]}]}
    row = registry.parse_all(feed(make, "greenhouse", json.dumps(body))).first()
    assert (row.external_id, row.title, row.department, row.employment_type, row.description_text) == ("7", "Engineer", "A · B", None, "Hi & bye")


def test_board_b_and_c(make):
    b = [{"id": "p", "text": "T", "applyUrl": "https://a", "createdAt": 1786000000000, "lists": [{"text": "L", "content": "<li>x</li>"}], "categories": {"team": "Core"}}]
    row = registry.parse_all(feed(make, "lever", json.dumps(b))).first()
    assert (row.canonical_url, row.department, row.description_text, row.posted.num) == ("https://a", "Core", "Lx", 1786000000000.0)
    c = {"jobs": [{"title": "T", "jobUrl": "https://j", "isRemote": True}]}
    row = registry.parse_all(feed(make, "ashby", json.dumps(c))).first()
    assert (row.external_id, row.location_text, row.description_text) == ("https://j", "Remote", "")


@pytest.mark.parametrize("kind, body", [("greenhouse", "{}"), ("greenhouse", "<html>"), ("lever", '{"jobs":[]}'), ("ashby", "[]")])
def test_missing_list_is_an_error_not_an_empty_feed(make, kind, body):
    df = feed(make, kind, body)
    assert registry.with_items(df).first()["parse_error"] is not None
    assert registry.parse_all(df).count() == 0


def test_jsonld_finds_nested_postings_and_skips_broken_scripts(make):
    inner = {"@type": "jobposting", "title": ["x", ["y"]], "url": "/p/2"}
    outer = {"@type": ["Thing", "JobPosting"], "title": "A", "related": inner, "identifier": "own", "baseSalary": {"currency": "EUR", "value": {"value": 5}},
             "jobLocation": [{"name": "HQ", "address": {"addressLocality": "Seoul", "addressCountry": {"name": "KR"}}}, "Remote", "Remote"]}
    page = f'<script type="application/ld+json">oops</script><script type="application/ld+json">{json.dumps({"@graph": [outer]})}</script>'
    rows = registry.parse_jsonld(feed(make, "jsonld", page)).orderBy("ordinal").collect()
    assert [(r.external_id, r.title) for r in rows] == [("own", "A"), ("https://base.com/p/2", "x · y")]
    assert rows[0].location_text == "HQ · Seoul, KR · Remote"
    assert tuple(rows[0].salary) == ("EUR", 5.0, 5.0, None)
    none = registry.with_items(feed(make, "jsonld", "<p>nothing</p>")).select(registry.empty_signal().alias("s")).first()["s"]
    assert none == "jsonld-jobposting-not-found"


#: A text with brackets, a quote and a backslash.
DEEP = 'deep [[{ " ' + chr(92) + " text"


def nested(value, n):
    for i in range(n):
        value = {"k": value} if i % 2 else [value]
    return value


def test_jsonld_at_any_depth(make):
    """Postings, and strings within arrays, fifty levels down; brackets in strings and escapes are no levels."""
    deep = {"@type": "JobPosting", "title": DEEP, "identifier": "d", "industry": [[[[["one"]], " "], ["two", [[[[["three"]]]]]]]]}
    first = {"@type": "JobPosting", "title": "first", "identifier": "f", "industry": ["x"]}
    page = "".join(f'<script type="application/ld+json">{t}</script>' for t in (json.dumps([first, nested(deep, 50)]), '{"@type": "JobPosting", "title": ', json.dumps(nested(["@type", "jobposting"], 30))))
    df = feed(make, "jsonld", page)
    rows = registry.parse_jsonld(df).orderBy("ordinal").collect()
    assert [(r.external_id, r.title, r.department) for r in rows] == [("f", "first", "x"), ("d", DEEP, "one · two · three")]
    assert registry.with_items(df).select(registry.unreadable_signal().alias("s")).first()["s"] == "jsonld-script-unreadable:1"
    plan = registry.parse_jsonld(df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "EvalPython" not in plan and "InArrow" not in plan


def test_jsonld_keeps_the_order_of_the_page(make):
    posting = lambda i, **more: {"@type": "JobPosting", "title": f"T{i}", "identifier": str(i), **more}
    tree = [posting(0, related=[posting(1), [posting(2, a=posting(3))]]), {"@graph": [posting(4)]}, "text", None, 5]
    page = f'<script type="application/ld+json">{json.dumps(tree)}</script><script type="application/ld+json">{json.dumps(posting(5))}</script>'
    rows = registry.parse_jsonld(feed(make, "jsonld", page)).orderBy("ordinal").collect()
    assert [r.external_id for r in rows] == ["0", "1", "2", "3", "4", "5"]


def card_page(n):
    return "<main>" + "".join(
        f'<article class="job" data-job-id="{i}"><a href="/j/{i}"><h2 class="title">T{i}</h2></a><time datetime="2026-01-01"></time></article>' for i in range(n)
    ) + "</main>"


CARDS = {"listSelector": "article.job", "titleSelector": ".title", "detailDescriptionSelector": ".description"}


def test_cards_of_a_long_page(make):
    rows = registry.parse_html_cards(feed(make, "static-html", card_page(301), CARDS))
    assert rows.count() == 301
    first = rows.orderBy("ordinal").first()
    assert (first.external_id, first.canonical_url, first.title, first.posted.text) == ("0", "https://base.com/j/0", "T0", "2026-01-01")


def test_card_without_hits_signals(make):
    rows = registry.with_items(feed(make, "static-html", "<p>", CARDS))
    assert rows.select(registry.empty_signal().alias("s")).first()["s"] == "required-selector-not-found"
    missing = registry.with_items(feed(make, "static-html", "<p>", {"listSelector": "li"})).first()["parse_error"]
    assert missing == "static-html source requires config.titleSelector"


def test_detail_cap(make, spark):
    postings = registry.parse_html_cards(feed(make, "static-html", card_page(61), CARDS))
    pages = spark.createDataFrame(
        [("s1", "r1", f"https://base.com/j/{i}", f"<div class='description'>Detail {i}</div>", ".description", None) for i in range(61)],
        "source_id string, run_id string, url string, body string, selector string, error string",
    )
    enriched, signals = enrich_details(postings, pages, cap=60)
    texts = [r.description_text for r in enriched.orderBy("ordinal").collect()]
    assert texts == [f"Detail {i}" for i in range(60)] + [""]
    assert [r.signal for r in signals.collect()] == ["detail-fetch-capped:1"]
    every, none = enrich_details(postings, pages.union(pages))
    assert [r.description_text for r in every.orderBy("ordinal").collect()] == [f"Detail {i}" for i in range(61)]
    assert none.isEmpty()


@pytest.mark.parametrize("selector", ["li:first-child", "a + b", ">", "a[href", "::before"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        cards.compile_selector(selector)


def test_selector_subset():
    html = '<ul id=u><li class="a b"><a href="/x" data-k="v1">t</a></li><li><p><a>n</a></p></li></ul>'
    found = lambda s: [n.text() for n in cards._tree(html).walk() if cards._matches(n, s)]
    assert found("li.a.b > a") == ["t"] and found("li > a") == ["t"] and found("#u a") == ["t", "n"]
    assert found('a[data-k^="v"]') == ["t"] and found("a[href], p") == ["t", "n"] and found("li p > a") == ["n"]


def test_custom_parser_takes_over_its_kind(make, spark):
    def parser(df):
        raw = registry.parse_kind(df.withColumn("body", F.lit('{"jobs":[{"id":"z","title":"Own"}]}')), "ashby")
        return raw

    rows = registry.parse_all(feed(make, "jsonld", "ignored"), {"jsonld": parser}).collect()
    assert [(r.external_id, r.title) for r in rows] == [("z", "Own")]


def test_acceptance(make):
    base = dict(source_id="s", run_id="r", url="https://u", body="x", content_type="application/json")
    rows = make(
        RESPONSE, {**base, "status": 200}, {**base, "status": 304, "content_type": None}, {**base, "status": 500},
        {**base, "status": 200, "content_type": "application/pdf"}, {**base, "status": 200, "body": "x" * (5 * 1024 * 1024 + 1)},
    )
    split = landed.accept_responses(rows)
    assert (split.ok.count(), split.not_modified.count()) == (2, 1)
    reasons = sorted(r.rejected_reason for r in split.rejected.collect())
    assert reasons == ["HTTP 500 for https://u", "Unsupported Content-Type: application/pdf"]
    assert rows.filter(landed.rejection(max_bytes=10).startswith("Response exceeded")).count() == 1


def test_tables_publish_only_finished_commits(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), {"a": "id int", "b": "id int"})
    assert tables.version() == 0 and tables.read("a").count() == 0
    tables.commit({"a": spark.range(3).selectExpr("cast(id as int) id"), "b": spark.range(1).selectExpr("cast(id as int) id")})
    tables.replace("a", tables.read("a").filter("id > 0"))
    assert (tables.version(), tables.read("a").count(), tables.read("b").count()) == (2, 2, 1)
    (tmp_path / "t" / "_commits" / "000000000003.json.lost.draft").write_text("{")
    assert tables.version() == 2
    assert tables.replace("a", tables.read("a").filter("id > 1")) == 3
    assert tables.read("a").count() == 1


def test_unreadable_scripts_are_counted_without_a_search_for_postings(spark):
    from postlens.sources import registry

    body = '<script type="application/ld+json">{broken JobPosting</script><script type="application/ld+json">{"a":[{"@type":"JobPosting","title":"T"}]}</script>'
    rows = spark.createDataFrame([("jsonld", body), ("jsonld", "none"), ("jsonld", None)], "kind string, body string")
    parsed = registry.with_items(rows, ("jsonld",))
    alone = parsed.select("unreadable")
    assert "@type" not in alone._jdf.queryExecution().optimizedPlan().toString()
    assert [r.unreadable for r in alone.collect()] == [1, 0, 0]
    assert [r.n for r in parsed.select(F.size("items").alias("n")).collect()] == [1, 0, None]


def ld_page(*scripts):
    return "".join(f'<script type="application/ld+json">{s if isinstance(s, str) else json.dumps(s)}</script>' for s in scripts)


def test_jsonld_is_searched_in_its_text(make):
    """Braces and names in strings, what follows a value, names with escapes, and types after other objects."""
    posting = lambda i, **more: {"@type": "JobPosting", "identifier": i, **more}
    late = {"@graph": [posting("b1")], "@context": {"a": {"b": [{}]}}, "identifier": "b0", "@type": ["x]", "jobPosting"]}
    page = ld_page(
        {"z": posting("a2", title='} {"@type":"JobPosting"} "'), "m": [{"n": posting("a1")}], "@id": posting("a0", similar=posting("a01"))}, late,
        '{"\\u0040type": "JobPosting", "identifier": "c", "title": ["t", 1e999, {"k": "no"}, [["{"]]]} "{', json.dumps(json.dumps(posting("none"))), {"@type": {"@type": "JobPosting"}, "identifier": "none"},
    )
    df = feed(make, "jsonld", page)
    rows = registry.parse_jsonld(df).orderBy("ordinal").collect()
    # {"@type": {"@type": ...}} holds a posting without a name or a link of its own.
    assert [r.external_id for r in rows] == ["a0", "a01", "a1", "a2", "b0", "b1", "c", "https://base.com/careers"]
    assert [r.title for r in rows if r.external_id in ("a2", "c")] == ['} {"@type":"JobPosting"} "', "t · {"]


def test_jsonld_levels_are_not_copied_one_by_one(make):
    """Each level of a script used to be taken apart into values of its own, which copied all below it."""
    items = registry.with_items(feed(make, "jsonld", ld_page(nested({"@type": "JobPosting", "identifier": "d"}, 300))), ("jsonld",)).select("items")
    assert "MapType(StringType,VariantType" not in items._jdf.queryExecution().optimizedPlan().toString()
    assert len(items.first()["items"]) == 1


def test_looked_up_details_are_kept_once(make, spark):
    """Postings and signals both derive from what the caller has kept."""
    postings = registry.parse_html_cards(feed(make, "static-html", card_page(2), CARDS))
    pages = spark.createDataFrame(
        [("s1", "r1", "https://base.com/j/0", "<div class='description'>Detail 0</div>", ".description", None)],
        "source_id string, run_id string, url string, body string, selector string, error string",
    )
    kept = []
    enriched, signals = enrich_details(postings, pages, keep=lambda found: kept.append(found.localCheckpoint()) or kept[0])
    assert len(kept) == 1
    assert "body#" not in signals._jdf.queryExecution().optimizedPlan().toString()
    assert [r.description_text for r in enriched.orderBy("ordinal").collect()] == ["Detail 0", ""]
    assert [r.signal for r in signals.collect()] == ["detail-fetch-failed:https://base.com/j/1:not landed"]
