"""Landed responses, board bodies, JSON-LD, cards, contracts and source health."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import health, sources as source_state, validate
from postlens.schemas import CONFIG, EVIDENCE, RAW_POSTING, struct
from postlens.session import spread
from postlens.sources import jsonld, landed, registry

from . import standins as st
from .base import epoch, query, table, with_ctes
from .standins import ctes


def _orders(spark, sf):
    return spread(table(spark, sf, "orders"))


def _landed(rows):
    """One landed response per order with the columns parsing expects."""
    key = F.col("o_orderkey").cast("string")
    return rows.withColumns(
        {
            "source_id": F.concat(F.lit("source_"), key),
            "run_id": F.lit("run_1"),
            "source_url": F.lit("https://feeds.example.com/list"),
            "company_name": F.concat(F.lit("Company "), F.col("o_custkey").cast("string")),
        }
    )


def _iso():
    return F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")


_RESPONSES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 304 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS status,
  CASE page_id % 6 WHEN 3 THEN 'image/png' WHEN 4 THEN '' ELSE 'Text/HTML; charset=utf-8' END AS content_type, url, html AS body FROM pages"""


@query(
    "accepted_responses",
    with_ctes(
        {"r": _RESPONSES},
        """SELECT page_id, status = 304 AS unchanged, CASE WHEN status = 304 THEN NULL WHEN status <> 200 THEN 'HTTP ' || status || ' for ' || url
  WHEN content_type = '' THEN 'Unsupported Content-Type: missing' WHEN content_type = 'image/png' THEN 'Unsupported Content-Type: image/png' END AS rejected_reason FROM r""",
    ),
)
def accepted_responses(spark, sf):
    kind = F.col("page_id") % 6
    rows = table(spark, sf, "pages").select(
        "page_id",
        F.when(kind == 0, 304).when(kind == 1, 404).when(kind == 2, 503).otherwise(200).alias("status"),
        F.when(kind == 3, "image/png").when(kind == 4, "").otherwise("Text/HTML; charset=utf-8").alias("content_type"),
        "url",
        F.col("html").alias("body"),
        F.lit(False).alias("not_modified"),
    )
    return landed.label_responses(rows).select("page_id", "unchanged", "rejected_reason")


_OUT = (
    "source_id", "ordinal", "external_id", "canonical_url", "title", "company_name", "department", "location_text",
    "employment_type", "description_text",
)


def _raw(df, *more):
    return df.select(*_OUT, *more)


_PAIR = "FROM orders CROSS JOIN (VALUES (0), (1)) AS v(i)"


@query(
    "board_a_postings",
    f"""SELECT 'source_' || o_orderkey AS source_id, i AS ordinal, CAST(o_orderkey + i AS VARCHAR) AS external_id,
  CASE WHEN i = 0 THEN 'https://a.example.com/' || o_orderkey ELSE 'https://feeds.example.com/list' END AS canonical_url, o_orderpriority AS title,
  'Company ' || o_custkey AS company_name, CASE WHEN i = 0 THEN 'Dept ' || o_orderstatus || ' · Core' END AS department,
  CASE WHEN i = 0 THEN 'Seoul' END AS location_text, CASE WHEN i = 0 THEN 'Full-time' END AS employment_type,
  CASE WHEN i = 0 THEN 'Pay & ' || o_custkey ELSE '' END AS description_text, CASE WHEN i = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS posted_text {_PAIR}""",
)
def board_a_postings(spark, sf):
    name = F.col("o_orderpriority")
    body = F.concat(
        F.lit('{"jobs":[{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"title":" '), name,
        F.lit(' ","absolute_url":"https://a.example.com/'), F.col("o_orderkey").cast("string"),
        F.lit('","location":{"name":" Seoul "},"departments":[{"name":"Dept '), F.col("o_orderstatus"),
        F.lit('"},{"name":""},{"name":"Core"}],"content":"<p>Pay &amp; '), F.col("o_custkey").cast("string"),
        F.lit('</p>","updated_at":"'), _iso(),
        F.lit('","metadata":[{"name":"Level","value":"x"},{"name":"Employment Type","value":"Full-time"}]},{"id":"'),
        (F.col("o_orderkey") + 1).cast("string"), F.lit('","title":"'), name,
        F.lit('","metadata":[{"name":"commitment","value":5}]}]}'),
    )
    rows = registry.parse_board_a(_landed(_orders(spark, sf)).withColumn("body", body))
    return _raw(rows, F.col("posted")["text"].alias("posted_text"))


@query(
    "board_b_postings",
    f"""SELECT 'source_' || o_orderkey AS source_id, i AS ordinal, CASE WHEN i = 0 THEN 'b' || o_orderkey END AS external_id,
  CASE WHEN i = 0 THEN 'https://b.example.com/' || o_orderkey ELSE 'https://apply.example.com/' || o_orderkey END AS canonical_url, o_orderpriority AS title,
  'Company ' || o_custkey AS company_name, CASE WHEN i = 0 THEN 'Dept ' || o_orderstatus ELSE 'Team' END AS department,
  CASE WHEN i = 0 THEN 'Remote' END AS location_text, CASE WHEN i = 0 THEN 'Full-time' END AS employment_type,
  CASE WHEN i = 0 THEN 'Plain ' || o_custkey ELSE 'Intro' || chr(10) || 'Needs' || o_custkey || chr(10) || 'End' END AS description_text,
  CASE WHEN i = 0 THEN CAST(epoch_ms(o_orderdate) AS DOUBLE) END AS posted_ms {_PAIR}""",
)
def board_b_postings(spark, sf):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    body = F.concat(
        F.lit('[{"id":"b'), key, F.lit('","text":" '), F.col("o_orderpriority"), F.lit(' ","hostedUrl":"https://b.example.com/'), key,
        F.lit('","applyUrl":"https://x","createdAt":'), (epoch("o_orderdate") * 1_000).cast("string"),
        F.lit(',"descriptionPlain":" Plain '), customer, F.lit('","description":"<b>no</b>","categories":{"location":"Remote","team":"T","department":"Dept '),
        F.col("o_orderstatus"), F.lit('","commitment":"Full-time"}},{"text":"'), F.col("o_orderpriority"),
        F.lit('","applyUrl":"https://apply.example.com/'), key,
        F.lit('","description":"<b>Intro</b>","lists":[{"text":"Needs","content":"<li>'), customer,
        F.lit('</li>"}],"additional":"<i>End</i>","categories":{"team":"Team"}}]'),
    )
    rows = registry.parse_board_b(_landed(_orders(spark, sf)).withColumn("body", body))
    return _raw(rows, F.col("posted")["num"].alias("posted_ms"))


@query(
    "board_c_postings",
    f"""SELECT 'source_' || o_orderkey AS source_id, i AS ordinal, CASE WHEN i = 0 THEN 'c' || o_orderkey ELSE 'https://c.example.com/' || o_orderkey END AS external_id,
  'https://c.example.com/' || o_orderkey AS canonical_url, o_orderpriority AS title, 'Company ' || o_custkey AS company_name,
  CASE WHEN i = 0 THEN 'Dept ' || o_orderstatus ELSE 'Team' END AS department, CASE WHEN i = 0 THEN 'Paris · Remote' ELSE 'Remote' END AS location_text,
  CASE WHEN i = 0 THEN 'FullTime' END AS employment_type, CASE WHEN i = 0 THEN 'Html ' || o_custkey ELSE 'Plain' END AS description_text,
  CASE WHEN i = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS posted_text {_PAIR}""",
)
def board_c_postings(spark, sf):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    body = F.concat(
        F.lit('{"jobs":[{"id":"c'), key, F.lit('","title":"'), F.col("o_orderpriority"), F.lit('","location":"Paris","isRemote":true,"department":"Dept '),
        F.col("o_orderstatus"), F.lit('","employmentType":"FullTime","descriptionHtml":"<div>Html '), customer,
        F.lit('</div>","descriptionPlain":" ","jobUrl":"https://c.example.com/'), key, F.lit('","publishedAt":"'), _iso(),
        F.lit('"},{"title":" '), F.col("o_orderpriority"), F.lit('","isRemote":true,"team":"Team","descriptionPlain":"Plain","jobUrl":"https://c.example.com/'), key,
        F.lit('"}]}'),
    )
    rows = registry.parse_board_c(_landed(_orders(spark, sf)).withColumn("body", body))
    return _raw(rows, F.col("posted")["text"].alias("posted_text"))


_LD_SQL = f"""SELECT 'source_' || o_orderkey AS source_id, i AS ordinal,
  CASE WHEN i = 0 THEN 'id' || o_orderkey ELSE 'https://feeds.example.com/p/' || o_orderkey END AS external_id,
  CASE WHEN i = 0 THEN 'https://feeds.example.com/list' ELSE 'https://feeds.example.com/p/' || o_orderkey END AS canonical_url,
  CASE WHEN i = 0 THEN o_orderpriority ELSE 'A · B' END AS title, CASE WHEN i = 0 THEN 'Org ' || o_custkey ELSE 'Company ' || o_custkey END AS company_name,
  CASE WHEN i = 0 THEN 'Software' END AS department, CASE WHEN i = 0 THEN 'TELECOMMUTE · Korea · Seoul, KR' ELSE 'Berlin' END AS location_text,
  CASE WHEN i = 0 THEN 'FULL_TIME · PART_TIME' END AS employment_type, CASE WHEN i = 0 THEN 'Text ' || o_custkey ELSE '' END AS description_text,
  CASE WHEN i = 0 THEN 'USD' END AS currency, CASE WHEN i = 0 THEN floor(o_totalprice) END AS low, CASE WHEN i = 0 THEN floor(o_totalprice) + 5 END AS high,
  CASE WHEN i = 0 THEN 'YEAR' END AS unit {_PAIR}"""


@query("jsonld_postings", _LD_SQL)
def jsonld_postings(spark, sf):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    low = F.floor("o_totalprice").cast("string")
    high = (F.floor("o_totalprice") + 5).cast("string")
    body = F.concat(
        F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":[{"@type":["Thing","jobPosting"],"title":" '),
        F.col("o_orderpriority"), F.lit('","identifier":{"value":"id'), key, F.lit('"},"hiringOrganization":{"name":"Org '), customer,
        F.lit('"},"industry":"Software","jobLocationType":"TELECOMMUTE","applicantLocationRequirements":{"name":"Korea"},'
              '"jobLocation":[{"address":{"addressLocality":"Seoul","addressCountry":{"name":"KR"}}},{"address":{"addressLocality":"Seoul","addressCountry":"KR"}}],'
              '"employmentType":["FULL_TIME","PART_TIME"],"description":"<p>Text '), customer,
        F.lit('</p>","baseSalary":{"currency":"USD","value":{"minValue":'), low, F.lit(',"maxValue":"'), high,
        F.lit('","unitText":"YEAR"}},"similar":{"@type":"JobPosting","title":["A","B"],"url":"/p/'), key,
        F.lit('","jobLocation":"Berlin"}}]}</script></html>'),
    )
    rows = registry.parse_jsonld(_landed(_orders(spark, sf)).withColumn("body", body))
    pay = F.col("salary")
    return _raw(rows, pay["currency"].alias("currency"), pay["min"].alias("low"), pay["max"].alias("high"), pay["interval"].alias("unit"))


def _page_rows(spark, sf, selectors):
    pages = spread(table(spark, sf, "pages"))
    return pages.select(
        F.concat(F.lit("source_"), F.col("page_id").cast("string")).alias("source_id"),
        F.lit("run_1").alias("run_id"),
        F.lit("https://feeds.example.com/list").alias("source_url"),
        F.lit("Company").alias("company_name"),
        F.col("html").alias("body"),
        F.from_json(F.lit(selectors), CONFIG).alias("config"),
    )


_CARD_SQL = """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS names FROM pages),
c AS (SELECT page_id, unnest(hrefs) AS href, unnest(names) AS name, generate_subscripts(hrefs, 1) - 1 AS ordinal FROM l)
SELECT 'source_' || page_id AS source_id, CAST(ordinal AS INTEGER) AS ordinal, {key} AS external_id, 'https://feeds.example.com' || href AS canonical_url,
  trim(regexp_replace(name, '&amp;?', '&', 'g')) AS title FROM c"""


@query("page_cards", _CARD_SQL.replace("{key}", "href"))
def page_cards(spark, sf):
    rows = registry.parse_html_cards(_page_rows(spark, sf, '{"listSelector":"nav ul > li","titleSelector":"a"}'))
    return rows.select("source_id", "ordinal", "external_id", "canonical_url", "title")


@query("rendered_page_cards", _CARD_SQL.replace("{key}", "'https://feeds.example.com' || href"))
def rendered_page_cards(spark, sf):
    rows = registry.parse_html_cards(_page_rows(spark, sf, '{"listSelector":"li","titleSelector":"a[href]"}'), rendered=True)
    return rows.select("source_id", "ordinal", "external_id", "canonical_url", "title")


@query(
    "postings_by_kind",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'greenhouse' WHEN '2-HIGH' THEN 'lever' ELSE 'ashby' END AS kind, count(*) AS postings,
  sum(o_orderkey) AS key_sum FROM orders GROUP BY 1""",
)
def postings_by_kind(spark, sf):
    """Mixed kinds in one pass, chosen by row."""
    key = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "greenhouse").when(F.col("o_orderpriority") == "2-HIGH", "lever").otherwise("ashby")
    field = F.when(kind == "lever", "text").otherwise("title")
    one = F.concat(F.lit('{"id":"'), key, F.lit('","'), field, F.lit('":"x"}'))
    body = F.when(kind == "lever", F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"jobs":['), one, F.lit("]}")))
    rows = _landed(_orders(spark, sf)).withColumns({"kind": kind, "body": body})
    kinds = ("greenhouse", "lever", "ashby")
    parsed = registry.explode_items(registry.with_items(rows, kinds), kinds)
    chosen = parsed.join(rows.select("source_id", "kind"), "source_id")
    return chosen.groupBy("kind").agg(
        F.count(F.lit(1)).alias("postings"), F.sum(F.col("external_id").cast("bigint")).alias("key_sum")
    )


@query(
    "broken_bodies",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Greenhouse response omitted jobs[]' WHEN 'O' THEN 'Lever response must be an array'
  ELSE 'Ashby response omitted jobs[]' END AS parse_error FROM orders""",
)
def broken_bodies(spark, sf):
    kind = st.pick(F.col("o_orderstatus"), {"F": "greenhouse", "O": "lever", "P": "ashby"})
    body = st.pick(F.col("o_orderstatus"), {"F": '{"postings":[]}', "O": '{"jobs":[]}', "P": "<html>"})
    rows = _landed(_orders(spark, sf)).withColumns({"kind": kind, "body": body})
    return registry.with_items(rows, ("greenhouse", "lever", "ashby")).select("o_orderkey", "parse_error")


@query(
    "response_signals",
    """SELECT page_id, array_to_string(list_filter([CASE WHEN length(trim(b)) < 100 THEN 'response-too-short' END, CASE WHEN regexp_matches(lower(b), 'captcha') THEN 'captcha-page' END,
  CASE WHEN regexp_matches(lower(b), 'log in to continue') THEN 'login-page' END, CASE WHEN regexp_matches(b, '(?i)<title>\\s*(?:login|sign in)') THEN 'login-title' END], lambda x: x IS NOT NULL), ',') AS signals
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN md5(html) WHEN 1 THEN html || ' CAPTCHA' WHEN 2 THEN '<title> Sign in</title>Log in to continue' || html ELSE html END AS b FROM pages)""".replace("\\\\", "\\"),
)
def response_signals(spark, sf):
    kind = F.col("page_id") % 5
    body = F.when(kind == 0, F.md5("html")).when(kind == 1, F.concat("html", F.lit(" CAPTCHA")))
    body = body.when(kind == 2, F.concat(F.lit("<title> Sign in</title>Log in to continue"), "html")).otherwise(F.col("html"))
    rows = table(spark, sf, "pages").withColumn("b", body)
    return rows.select("page_id", F.array_join(health.response_signals(F.col("b"), F.lit(1)), ",").alias("signals"))


# Observations made of orders, one per order, covering every branch of the decision.
_OBS = """SELECT o_orderkey, o_orderkey % 12 AS k, CASE o_orderkey % 12 WHEN 0 THEN 'not_modified' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'not_modified' WHEN 3 THEN 'quarantined' WHEN 4 THEN 'failed'
    WHEN 5 THEN 'failed' WHEN 6 THEN 'failed' ELSE 'healthy' END AS status,
  CASE WHEN o_orderkey % 12 = 1 THEN 503 WHEN o_orderkey % 12 = 5 THEN 403 WHEN o_orderkey % 12 = 6 THEN 429 WHEN o_orderkey % 12 = 11 AND o_orderstatus = 'F' THEN 404 ELSE 200 END AS http_status,
  CASE WHEN o_orderkey % 12 = 7 THEN 0 WHEN o_orderkey % 12 = 8 THEN 4 ELSE 20 END AS fetched, CASE WHEN o_orderkey % 12 = 9 THEN 4 ELSE 20 END AS previous,
  CASE WHEN o_orderkey % 12 < 3 THEN 0 WHEN o_orderkey % 12 = 10 THEN 2 ELSE 1 END AS expected, CASE WHEN o_orderkey % 12 < 3 THEN 0 ELSE 1 END AS stored,
  CASE WHEN o_orderkey % 12 = 3 AND o_orderstatus <> 'F' THEN 'reported-code' WHEN o_orderkey % 12 = 4 THEN 'crawler-error' END AS error_code,
  CASE WHEN o_orderkey % 12 = 4 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'Unexpected token <' WHEN '2-HIGH' THEN 'Blocked private IP: 10.0.0.1' WHEN '3-MEDIUM' THEN 'Too many redirects'
    WHEN '4-NOT SPECIFIED' THEN 'aborted' ELSE 'selector missing' END END AS error_message,
  CASE WHEN o_orderkey % 12 = 11 AND o_orderpriority = '1-URGENT' THEN 'Captcha-page' WHEN o_orderkey % 12 = 3 THEN 'detail-fetch-capped:1' END AS signal FROM orders"""


def _observations(spark, sf):
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 12
    message = st.pick(
        F.col("o_orderpriority"),
        {"1-URGENT": "Unexpected token <", "2-HIGH": "Blocked private IP: 10.0.0.1", "3-MEDIUM": "Too many redirects",
         "4-NOT SPECIFIED": "aborted", "5-LOW": "selector missing"},
    )
    signal = F.when((k == 11) & (F.col("o_orderpriority") == "1-URGENT"), "Captcha-page").when(k == 3, "detail-fetch-capped:1")
    batches = F.when(k < 3, 0)
    return _orders(spark, sf).select(
        "o_orderkey",
        F.lit("run_1998").alias("run_id"),
        F.concat(F.lit("source_"), key.cast("string")).alias("source_id"),
        F.when(k < 3, "not_modified").when(k == 3, "quarantined").when(k < 7, "failed").otherwise("healthy").alias("status"),
        F.when(k == 1, 503).when(k == 5, 403).when(k == 6, 429).when((k == 11) & (F.col("o_orderstatus") == "F"), 404).otherwise(200).alias("http_status"),
        F.when(k == 7, 0).when(k == 8, 4).otherwise(20).cast("bigint").alias("fetched_job_count"),
        F.when(k == 9, 4).otherwise(20).cast("bigint").alias("previous_job_count"),
        batches.when(k == 10, 2).otherwise(1).cast("bigint").alias("expected_batch_count"),
        batches.otherwise(1).cast("bigint").alias("received_batch_count"),
        F.lit(None).cast("string").alias("response_hash"),
        F.lit(None).cast("string").alias("content_fingerprint"),
        F.lit("e2").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when((k == 3) & (F.col("o_orderstatus") != "F"), "reported-code").when(k == 4, "crawler-error").alias("error_code"),
        F.when(k == 4, message).alias("error_message"),
        F.array_compact(F.array(signal)).alias("signals"),
        batches.otherwise(1).cast("bigint").alias("stored_batches"),
    )


_DECISION = """SELECT o_orderkey, CASE WHEN regexp_matches(signal, '(?i)captcha') THEN 'quarantine' WHEN k = 1 THEN 'retry' WHEN k IN (0, 2) THEN 'complete' WHEN k = 3 THEN 'quarantine'
    WHEN k = 4 THEN CASE WHEN error_message = 'aborted' THEN 'retry' ELSE 'quarantine' END WHEN k = 5 THEN 'quarantine' WHEN k = 6 THEN 'retry' WHEN k IN (7, 8) THEN 'quarantine'
    WHEN http_status = 404 THEN 'quarantine' WHEN k = 10 THEN 'retry' ELSE 'complete' END AS kind,
  CASE WHEN regexp_matches(signal, '(?i)captcha') THEN signal WHEN k = 1 THEN 'http-503' WHEN k IN (0, 2) THEN NULL WHEN k = 3 THEN coalesce(error_code, signal)
    WHEN k = 4 THEN CASE error_message WHEN 'Unexpected token <' THEN 'schema-invalid' WHEN 'Blocked private IP: 10.0.0.1' THEN 'unsafe-source-url'
      WHEN 'Too many redirects' THEN 'source-configuration-invalid' WHEN 'selector missing' THEN 'required-selector-not-found' ELSE 'crawler-error' END
    WHEN k = 5 THEN 'http-403' WHEN k = 6 THEN 'http-429' WHEN k = 7 THEN 'unexpected-zero-jobs' WHEN k = 8 THEN 'job-count-dropped-80-percent'
    WHEN http_status = 404 THEN 'http-404' WHEN k = 10 THEN 'batch-count-mismatch' END AS reason FROM obs"""


@query("source_completions", with_ctes({"obs": _OBS}, _DECISION))
def source_completions(spark, sf):
    rows = _observations(spark, sf)
    counts = rows.select("run_id", "source_id", "stored_batches")
    judged = health.classify_completion(rows.drop("stored_batches"), counts)
    return judged.select("o_orderkey", F.col("disposition")["kind"].alias("kind"), F.col("disposition")["reason"].alias("reason"))


@query(
    "count_anomalies",
    """SELECT c_custkey, CASE WHEN p >= 5 AND c = 0 THEN 'unexpected-zero-jobs' WHEN p >= 5 AND c <= floor(p * CAST(0.2 AS DOUBLE)) THEN 'job-count-dropped-80-percent' END AS anomaly
FROM (SELECT c_custkey, c_nationkey AS p, c_custkey % 6 AS c FROM customer)""",
)
def count_anomalies(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.select("c_custkey", health.count_anomaly(F.col("c_nationkey"), F.col("c_custkey") % 6).alias("anomaly"))


@query(
    "severe_signals",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'login-page' WHEN 'error' THEN 'captcha-page' WHEN 'view' THEN 'schema-invalid' WHEN 'signup' THEN 'response-too-short' END AS severe,
  CASE event_type WHEN 'error' THEN 'a b' ELSE event_type END AS first_limited FROM events""",
)
def severe_signals(spark, sf):
    none = F.lit(None).cast("string")
    signals = F.array_compact(
        F.array(
            F.when(F.col("event_type") == "error", " a\r\nb ").otherwise(F.col("event_type")),
            F.when(F.col("event_type") == "click", "detail:LOGIN").when(F.col("event_type") == "error", "captcha-page")
            .when(F.col("event_type") == "view", "empty-title").when(F.col("event_type") == "signup", "response-too-short").otherwise(none),
            F.when(F.col("event_type") != "purchase", "captcha").otherwise(none),
        )
    )
    rows = table(spark, sf, "events").withColumn("s", signals)
    return rows.select(
        "event_id", health.severe_signal(F.col("s")).alias("severe"), F.get(health.limit_signals(F.col("s")), F.lit(0)).alias("first_limited")
    )


@query(
    "http_reasons",
    """SELECT o_orderkey, s IN (408, 425, 429) OR s >= 500 AS retryable, CASE WHEN s >= 400 THEN 'http-' || s END AS reason
FROM (SELECT o_orderkey, CAST(200 + o_custkey % 400 AS INTEGER) AS s FROM orders)""",
)
def http_reasons(spark, sf):
    status = (F.lit(200) + F.col("o_custkey") % 400).cast("int")
    return _orders(spark, sf).select("o_orderkey", health.is_retryable(status).alias("retryable"), health.http_reason(status).alias("reason"))


@query(
    "reusable_snapshots",
    """SELECT c_custkey, c_acctbal > 2000 AND c_nationkey <> 3 AND c_mktsegment <> 'BUILDING' AS reuse FROM customer""",
)
def reusable_snapshots(spark, sf):
    trusted = F.col("c_acctbal") > 2_000
    stored = F.when(trusted, F.sha2("c_name", 256))
    current = F.when(F.col("c_nationkey") == 3, F.lit("other")).otherwise(F.sha2("c_name", 256))
    anomaly = F.when(F.col("c_mktsegment") == "BUILDING", "captcha-page")
    return table(spark, sf, "customer").select("c_custkey", health.can_reuse(stored, F.when(trusted, "run"), current, anomaly).alias("reuse"))


@query(
    "invalid_sources",
    with_ctes(
        ctes("sources"),
        """SELECT id, array_to_string(list_filter([CASE WHEN length(u) > 2000 THEN 'url:length' END, CASE WHEN NOT regexp_matches(u, '^https?://[^/]') THEN 'url:pattern' END,
  CASE WHEN m < 30 OR m > 43200 THEN 'crawl_interval_minutes:range' END, CASE WHEN kind IN ('greenhouse', 'lever', 'ashby') AND coalesce(trim(k), '') = '' THEN 'ADAPTER_KEY_REQUIRED' END,
  CASE WHEN kind = 'playwright' AND p = 0 THEN 'SELECTORS_REQUIRED' END, CASE WHEN b AND kind <> 'playwright' THEN 'BROWSER_KIND_REQUIRED' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT id, kind, CASE WHEN previous_job_count = 1 THEN 'ftp://x' ELSE url END AS u, CASE WHEN previous_job_count = 2 THEN 5 ELSE crawl_interval_minutes END AS m,
  CASE WHEN previous_job_count = 3 THEN ' ' ELSE adapter_key END AS k, previous_job_count AS p, browser_required OR previous_job_count = 4 AS b FROM sources)""",
    ),
)
def invalid_sources(spark, sf):
    p = F.col("previous_job_count")
    config = F.when((F.col("kind") == "playwright") & (p == 0), "{}").otherwise(F.col("config_json"))
    rows = st.sources(spark, sf).withColumns(
        {
            "url": F.when(p == 1, "ftp://x").otherwise(F.col("url")),
            "crawl_interval_minutes": F.when(p == 2, 5).otherwise(F.col("crawl_interval_minutes")),
            "adapter_key": F.when(p == 3, " ").otherwise(F.col("adapter_key")),
            "browser_required": F.col("browser_required") | (p == 4),
            "config": F.from_json(config, CONFIG),
        }
    )
    checked = validate.with_errors(rows, validate.source_contract())
    return checked.select("id", F.array_join("errors", ",").alias("errors"))


@query(
    "invalid_companies",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(p_name, '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN 'slug:pattern' END,
  CASE WHEN p_size > 40 THEN 'careers_url:pattern' END, CASE WHEN p_size * 3 > 100 THEN 'priority:range' END], lambda x: x IS NOT NULL), ',') AS errors FROM part""",
)
def invalid_companies(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_brand").alias("name"),
        F.col("p_name").alias("slug"),
        F.when(F.col("p_size") > 40, "mailto:x").otherwise("https://x.example.com").alias("careers_url"),
        F.lit(None).cast("string").alias("remote_policy_url"),
        (F.col("p_size") * 3).alias("priority"),
    )
    checked = validate.with_errors(rows, validate.company_contract())
    return checked.select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query(
    "dangling_runs",
    with_ctes(ctes("source_runs"), "SELECT run_id, count(*) AS dangling FROM source_runs WHERE status = 'running' GROUP BY run_id"),
)
def dangling_runs(spark, sf):
    return source_state.dangling(st.source_runs(spark, sf))


@query(
    "invalid_postings",
    with_ctes(
        ctes("jobs"),
        """SELECT id, array_to_string(list_filter([CASE WHEN length(e) NOT BETWEEN 1 AND 300 THEN 'external_id:length' END, CASE WHEN NOT regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*:[^[:space:]]+$') THEN 'canonical_url:pattern' END,
  CASE WHEN length(t) > 500 THEN 'title:length' END, CASE WHEN w NOT IN ('remote', 'hybrid', 'onsite', 'unknown') THEN 'workplace_type:enum' END, CASE WHEN sc > 100 THEN 'score:range' END,
  CASE WHEN NOT regexp_matches(h, '^[a-f0-9]{64}$') THEN 'content_hash:pattern' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT id, CASE WHEN score % 7 = 0 THEN '' ELSE external_id END AS e, CASE WHEN score % 7 = 1 THEN 'no url' ELSE 'https://x.example.com/' || external_id END AS u,
  CASE WHEN score % 7 = 2 THEN repeat('long ', 101) ELSE 'T' END AS t, CASE WHEN score % 7 = 3 THEN 'boat' ELSE 'remote' END AS w, CASE WHEN score % 7 = 4 THEN score + 101 ELSE score END AS sc,
  CASE WHEN score % 7 = 5 THEN upper(sha256(id)) ELSE sha256(id) END AS h FROM jobs)""",
    ),
)
def invalid_postings(spark, sf):
    odd, text = F.col("score") % 7, F.lit("text")
    none = F.lit(None)
    rows = st.jobs(spark, sf).withColumns(
        {
            "canonical_url": F.when(odd == 1, "no url").otherwise(F.concat(F.lit("https://x.example.com/"), "external_id")),
            "external_id": F.when(odd == 0, "").otherwise(F.col("external_id")),
            "title": F.when(odd == 2, F.repeat(F.lit("long "), 101)).otherwise("T"),
            "workplace_type": F.when(odd == 3, "boat").otherwise("remote"),
            "content_hash": F.when(odd == 5, F.upper(F.sha2("id", 256))).otherwise(F.sha2("id", 256)),
            "company_name": text, "description_text": text, "search_text": text, "remote_scope": F.lit("worldwide"), "eligible_from_korea": F.lit("yes"),
            "async_level": F.lit("strong"), "skills": F.array(text), "confidence": F.lit(0.5), "evidence": F.array().cast(EVIDENCE),
            **{n: none.cast("string") for n in ("department", "location_text", "employment_type", "required_timezone", "salary_currency", "salary_interval")},
            **{n: none.cast("double") for n in ("required_overlap_hours", "salary_min", "salary_max")}, "posted_at": none.cast("bigint"),
            "score": F.when(odd == 4, F.col("score") + 101).otherwise(F.col("score")),
        }
    )
    checked = validate.with_errors(rows, validate.posting_contract())
    return checked.select("id", F.array_join("errors", ",").alias("errors"))


@query(
    "invalid_observations",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('view', 'click') THEN 'status:enum' END, CASE WHEN floor(value) > 599 THEN 'http_status:range' END,
  CASE WHEN user_id % 5 = 0 THEN 'expected_batch_count:missing' END, CASE WHEN user_id % 5 = 1 THEN 'signals:size' END, CASE WHEN user_id % 5 = 2 THEN 'signals:length' END], lambda x: x IS NOT NULL), ',') AS errors
FROM events""",
)
def invalid_observations(spark, sf):
    odd, none = F.col("user_id") % 5, F.lit(None).cast("string")
    long = F.when(odd == 2, F.repeat(F.lit("s"), 301)).otherwise("s")
    rows = table(spark, sf, "events").select(
        "event_id", F.lit("run").alias("run_id"), F.lit("source").alias("source_id"),
        F.when(F.col("event_type") == "view", "healthy").when(F.col("event_type") == "click", "failed").otherwise(F.col("event_type")).alias("status"),
        F.floor("value").cast("int").alias("http_status"), *[F.lit(1).alias(n) for n in ("fetched_job_count", "previous_job_count", "received_batch_count")],
        F.when(odd != 0, 1).alias("expected_batch_count"), *[none.alias(n) for n in ("response_hash", "content_fingerprint", "etag", "last_modified", "error_code", "error_message")],
        F.when(odd == 1, F.array_repeat(long, 21)).otherwise(F.array(long)).alias("signals"),
    )
    return validate.with_errors(rows, validate.observation_contract()).select("event_id", F.array_join("errors", ",").alias("errors"))


@query(
    "invalid_actions",
    with_ctes(
        ctes("actions"),
        """SELECT job_id, array_to_string(list_filter([CASE WHEN action = 'dismissed' THEN 'action:enum' END, CASE WHEN action = 'saved' THEN 'notes:length' END,
  CASE WHEN applied_at IS NOT NULL THEN 'applied_at:range' END], lambda x: x IS NOT NULL), ',') AS errors FROM actions""",
    ),
)
def invalid_actions(spark, sf):
    rows = st.actions(spark, sf).withColumns(
        {"notes": F.when(F.col("action") == "saved", F.repeat(F.lit("n"), 5001)), "action": F.regexp_replace("action", "^dismissed$", "gone"), "applied_at": -F.col("applied_at")}
    )
    return validate.with_errors(rows, validate.action_contract()).select("job_id", F.array_join("errors", ",").alias("errors"))


@query(
    "checked_snapshots",
    with_ctes(
        ctes("sources"),
        """SELECT id AS source_id, CASE WHEN bad AND k = 'complete' THEN 'retry' ELSE k END AS kind, CASE WHEN bad AND k = 'complete' THEN 'not-modified-snapshot-mismatch' END AS reason,
  bad AS bad_snapshot, snapshot_run_id AS stored_snapshot_run_id
FROM (SELECT *, status_ = 'not_modified' AND (k <> 'complete' OR snapshot_run_id IS NULL OR content_fingerprint IS NULL OR f IS DISTINCT FROM content_fingerprint) AS bad
  FROM (SELECT *, CASE previous_job_count % 3 WHEN 0 THEN 'healthy' ELSE 'not_modified' END AS status_, CASE WHEN previous_job_count % 5 = 0 THEN 'quarantine' ELSE 'complete' END AS k,
    CASE WHEN previous_job_count % 2 = 0 THEN 'other' ELSE content_fingerprint END AS f FROM sources))""",
    ),
)
def checked_snapshots(spark, sf):
    n, sources = F.col("previous_job_count"), st.sources(spark, sf)
    kind = F.when(n % 5 == 0, "quarantine").otherwise("complete")
    reports = sources.select(
        F.col("id").alias("source_id"), F.when(n % 3 == 0, "healthy").otherwise("not_modified").alias("status"),
        F.when(n % 2 == 0, "other").otherwise(F.col("content_fingerprint")).alias("content_fingerprint"),
        F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("reason")).alias("disposition"),
    )
    return health.check_snapshots(reports, sources).select("source_id", "disposition.kind", "disposition.reason", "bad_snapshot", "stored_snapshot_run_id")


@query(
    "parsed_salaries",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'USD' END AS currency,
  CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN floor(o_totalprice) END AS low,
  CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) + 7 WHEN 1 THEN floor(o_totalprice) + 7 WHEN 2 THEN floor(o_totalprice) END AS high,
  CASE o_orderkey % 4 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'MONTH' END AS unit FROM orders""",
)
def parsed_salaries(spark, sf):
    """min and max, minValue and maxValue, one value, and a list, which is no salary."""
    low = F.floor("o_totalprice").cast("bigint")
    low, high = low.cast("string"), (low + 7).cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, c('{"currency":"USD","min":', low, ',"max":', high, ',"interval":"YEAR"}'))
        .when(kind == 1, c('{"currencyCode":"USD","minValue":', low, ',"maxValue":', high, ',"unitText":"MONTH"}'))
        .when(kind == 2, c('{"currency":"USD","value":', low, "}"))
        .otherwise(c("[", low, "]"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", jsonld.parse_salary(F.try_parse_json(text)).alias("s"))
    return rows.select("o_orderkey", F.col("s.currency").alias("currency"), F.col("s.min").alias("low"), F.col("s.max").alias("high"), F.col("s.interval").alias("unit"))


@query(
    "deep_jsonld",
    """SELECT 'source_' || o_orderkey AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority || ' · ' || o_orderstatus AS title, 'Deep ' || o_custkey AS department, 1 AS unreadable FROM orders""",
)
def deep_jsonld(spark, sf):
    """A posting fifty levels down with a text twelve arrays down, beside a script that is no JSON."""
    key = F.col("o_orderkey").cast("string")
    posting = F.concat(
        F.lit('{"@type":["Thing","jobPosting"],"identifier":"'), key, F.lit('","industry":' + "[" * 12 + '"Deep '), F.col("o_custkey").cast("string"), F.lit('"' + "]" * 12),
        F.lit(',"title":[["'), "o_orderpriority", F.lit('"],[[" "],[[["'), "o_orderstatus", F.lit('"]]]]]}'),
    )
    body = F.concat(
        F.lit('<script type="application/ld+json">{"@type": "JobPosting", </script><script type="application/ld+json">' + '{"k":[' * 25), posting, F.lit("]}" * 25 + "</script>")
    )
    rows = _landed(_orders(spark, sf)).withColumn("body", body)
    parsed = registry.with_items(rows.withColumn("kind", F.lit("jsonld")), ("jsonld",))
    return registry.explode_items(parsed, ("jsonld",)).select("source_id", "external_id", "title", "department").join(parsed.select("source_id", "unreadable"), "source_id")


@query(
    "custom_kind_postings",
    """SELECT 'source_' || o_orderkey AS source_id, i AS ordinal, 'x' || o_orderkey || '-' || i AS external_id, 'Row ' || i || ' of ' || o_orderpriority AS title, 'Company ' || o_custkey AS company_name
FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'source_' || o_orderkey, 0, CAST(o_orderkey AS VARCHAR), o_orderpriority, 'Company ' || o_custkey FROM orders WHERE o_orderkey % 2 = 1""",
)
def custom_kind_postings(spark, sf):
    """A kind of its own, lines of fields, parsed beside the built-in ones."""

    def lines(rows):
        line = rows.select("source_id", "run_id", "company_name", "source_url", F.posexplode(F.split("body", "\n")).alias("ordinal", "line"))
        fields = F.split("line", "[|]")
        given = {"external_id": F.get(fields, F.lit(0)), "title": F.get(fields, F.lit(1)), "canonical_url": F.col("source_url"), "description_text": F.lit("")}
        return line.select(*[given.get(f.name, F.col(f.name) if f.name in line.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(RAW_POSTING)])

    key = F.col("o_orderkey").cast("string")
    own = F.concat(F.lit("x"), key, F.lit("-0|Row 0 of "), "o_orderpriority", F.lit("\nx"), key, F.lit("-1|Row 1 of "), "o_orderpriority")
    board = F.concat(F.lit('{"jobs":[{"id":"'), key, F.lit('","title":"'), "o_orderpriority", F.lit('","jobUrl":"https://c.example.com/1"}]}'))
    even = F.col("o_orderkey") % 2 == 0
    rows = _landed(_orders(spark, sf)).withColumns({"kind": F.when(even, "lines").otherwise("ashby"), "body": F.when(even, own).otherwise(board)})
    return registry.parse_all(rows, {"lines": lines}).select("source_id", "ordinal", "external_id", "title", "company_name")
