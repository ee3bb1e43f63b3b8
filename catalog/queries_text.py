"""Text, URL, key, classification and normalization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import classify as cl, html, keys, text, url, values
from postlens.functions.register import register_functions
from postlens.operators import health
from postlens.plans.normalize import normalize_postings
from postlens.schemas import POSTED, SALARY
from postlens.session import spread

from . import sqltext as sq, standins as st
from .base import epoch, query, table, with_ctes


def _documents(spark, sf):
    return spread(table(spark, sf, "documents"))


@query(
    "normalized_text",
    f"SELECT doc_id, sha256({sq.clean('text')}) AS clean, sha256({sq.fold('text')}) AS folded, {sq.cut('text', 200)} AS head FROM documents",
)
def normalized_text(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).select(
        "doc_id",
        F.sha2(text.normalize_whitespace(t), 256).alias("clean"),
        F.sha2(text.normalize_for_match(t), 256).alias("folded"),
        text.truncate(t, 200).alias("head"),
    )


@query("normalized_text_by_name", f"SELECT doc_id, sha256({sq.clean('text')}) AS clean, sha256({sq.fold('text')}) AS folded FROM documents")
def normalized_text_by_name(spark, sf):
    register_functions(spark)
    rows = _documents(spark, sf)
    return rows.select(
        "doc_id",
        F.sha2(F.call_function("posting_normalize_whitespace", F.col("text")), 256).alias("clean"),
        F.sha2(F.call_function("posting_normalize_for_match", F.col("text")), 256).alias("folded"),
    )


@query(
    "unique_words",
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
n AS (SELECT doc_id, i, trim(regexp_replace(raw, '[\t\r ]+', ' ', 'g'), ' ' || chr(10)) AS word FROM w),
f AS (SELECT doc_id, lower(word) AS k, arg_min(word, i) AS word, min(i) AS i FROM n WHERE word <> '' GROUP BY ALL)
SELECT doc_id, count(*) AS words, sha256(string_agg(word, ' ' ORDER BY i)) AS spelled FROM f GROUP BY doc_id""",
)
def unique_words(spark, sf):
    """First spelling of every word. Whole texts are exploded, so no long array is compared with itself.

    Texts meet by document before they are taken apart, so no word is shuffled, and equal spellings are one row before they are sorted."""
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    raw, i = F.col("raw"), F.col("i")
    # The outer explode keeps Spark from deriving a filter, which would split every text twice more.
    words = docs.select("doc_id", F.posexplode_outer(F.split("text", " ")).alias("i", "raw"))
    spelled = words.groupBy("doc_id", "raw").agg(F.min("i").alias("i"))
    # A word without any of these characters is tidy.
    spelled = spelled.withColumn("word", F.when(raw.rlike(f"[{text.TRIM_CHARS}]"), text.normalize_whitespace(raw)).otherwise(raw)).filter(F.col("word") != "")
    firsts = spelled.groupBy("doc_id", F.lower("word").alias("k")).agg(F.min(F.struct(i, "word")).alias("f"))
    listed = F.transform(F.array_sort(F.collect_list("f")), lambda x: x["word"])
    return firsts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sha2(F.array_join(listed, " "), 256).alias("spelled"))


@query(
    "text_snippets",
    f"SELECT doc_id, {sq.snippet('text', 'lower(text)', chr(39) + 'tion' + chr(39))} AS tion, {sq.snippet('text', 'lower(text)', chr(39) + 'zzz' + chr(39))} AS missing FROM documents",
)
def text_snippets(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).select("doc_id", text.find_snippet(t, "tion").alias("tion"), text.find_snippet(t, "zzz").alias("missing"))


_SEARCH = sq.clean("concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), text)")


@query(
    "search_text_limits",
    f"SELECT doc_id, sha256({_SEARCH}) AS search_text, sha256({sq.clean('text')}) AS description FROM documents",
)
def search_text_limits(spark, sf):
    c = F.col
    return _documents(spark, sf).select(
        "doc_id",
        F.sha2(text.make_search_text([c("source"), c("lang"), F.lit(""), c("text")]), 256).alias("search_text"),
        F.sha2(text.limit_text(c("text")), 256).alias("description"),
    )


_ACCENTS = {"é": "e", "ó": "o", "è": "e", "ñ": "n", "ü": "u", "ç": "c", "ä": "a", "ö": "o", "ê": "e", "í": "i"}
_SLUG = "lower(text)"
for _accented, _base in _ACCENTS.items():
    _SLUG = f"replace({_SLUG}, '{_accented}', '{_base}-')"


@query("text_slugs", f"SELECT doc_id, trim(regexp_replace({_SLUG}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def text_slugs(spark, sf):
    return _documents(spark, sf).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("part_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def part_slugs(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", text.slugify(F.concat("p_name", F.lit(" "), "p_brand")).alias("slug"))


@query(
    "canonical_json_maps",
    """SELECT c_custkey, '{"Name":' || CAST(to_json(c_name) AS VARCHAR) || ',"segment":' || CAST(to_json(c_mktsegment) AS VARCHAR) || ',"zone":null}' AS json FROM customer""",
)
def canonical_json_maps(spark, sf):
    pairs = F.create_map(
        F.lit("zone"), F.lit(None).cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("Name"), F.col("c_name")
    )
    return table(spark, sf, "customer").select("c_custkey", text.canonical_json(pairs).alias("json"))


@query(
    "decoded_props",
    "SELECT event_id, coalesce(CAST(props->>'k' AS BIGINT), -1) AS k, CAST(-1 AS BIGINT) AS broken FROM events",
)
def decoded_props(spark, sf):
    default = F.struct(F.lit(-1).cast("bigint").alias("k"))
    good = text.json_or(F.col("props"), "struct<k:bigint>", default)
    broken = text.json_or(F.concat(F.lit("["), "props"), "array<struct<k:bigint>>", F.array(default))
    return table(spark, sf, "events").select("event_id", good["k"].alias("k"), F.get(broken, F.lit(0))["k"].alias("broken"))


_PAGE = r"regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g')"
for _name in ("script", "style", "noscript", "svg"):
    _PAGE = rf"regexp_replace({_PAGE}, '(?is)<{_name}[\s/>].*?(</{_name}\s*>|\z)', '', 'g')"
_PAGE = rf"regexp_replace(regexp_replace({_PAGE}, '<[!?][^>]*>', '', 'g'), '</?[a-zA-Z][^>]*(>|\z)', '', 'g')"
_PAGE = f"replace(replace(replace({_PAGE}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"')"
_PAGE = f"regexp_replace({_PAGE}, '&amp;?', '&', 'g')"


@query("page_text", f"SELECT page_id, {sq.clean(_PAGE)} AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


_CANON = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
a AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|ref(=|$)|source(=|$))'))) AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM a"""


@query("canonical_urls", _CANON)
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@query("canonical_urls_by_name", _CANON)
def canonical_urls_by_name(spark, sf):
    register_functions(spark)
    return table(spark, sf, "pages").select("page_id", F.call_function("posting_canonical_url", F.col("url")).alias("canonical"))


@query(
    "resolved_links",
    r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
b AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^([^?#]*)', 1) AS bare FROM l)
SELECT page_id, href, root || href AS absolute, regexp_replace(bare, '[^/]*$', '') || 'x' || href AS relative, bare || '?q=1' AS query,
  regexp_extract(url, '^([^#]*)', 1) || '#f' AS fragment, url AS self FROM b""",
)
def resolved_links(spark, sf):
    pages = table(spark, sf, "pages")
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    base, href = F.col("url"), F.col("href")
    return links.select(
        "page_id",
        "href",
        url.resolve_url(href, base).alias("absolute"),
        url.resolve_url(F.concat(F.lit("x"), href), base).alias("relative"),
        url.resolve_url(F.lit("?q=1"), base).alias("query"),
        url.resolve_url(F.lit("#f"), base).alias("fragment"),
        url.resolve_url(F.lit(""), base).alias("self"),
    )


@query(
    "url_safety",
    r"""WITH h AS (SELECT c_custkey, c_custkey % 256 AS a, c_nationkey AS b, c_mktsegment AS m FROM customer),
u AS (SELECT *, CASE m WHEN 'AUTOMOBILE' THEN 'http://' || a || '.' || b || '.0.1/x' WHEN 'BUILDING' THEN 'ftp://h' || a || '.example.com'
  WHEN 'FURNITURE' THEN 'https://u:p@h.example.com/' || a WHEN 'HOUSEHOLD' THEN 'http://192.168.' || b || '.' || a ELSE 'https://h' || a || '.example.com/' END AS url FROM h)
SELECT c_custkey, CASE m WHEN 'BUILDING' THEN 'blocked-protocol' WHEN 'FURNITURE' THEN 'embedded-credentials' WHEN 'HOUSEHOLD' THEN 'private-ip' WHEN 'MACHINERY' THEN 'ok'
  ELSE CASE WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 198 AND b BETWEEN 18 AND 19) OR (a = 192 AND b = 0) THEN 'private-ip' ELSE 'ok' END END AS safety FROM u""",
)
def url_safety(spark, sf):
    c = spread(table(spark, sf, "customer"))
    a, b = (F.col("c_custkey") % 256).cast("string"), F.col("c_nationkey").cast("string")
    made = {
        "AUTOMOBILE": F.concat(F.lit("http://"), a, F.lit("."), b, F.lit(".0.1/x")),
        "BUILDING": F.concat(F.lit("ftp://h"), a, F.lit(".example.com")),
        "FURNITURE": F.concat(F.lit("https://u:p@h.example.com/"), a),
        "HOUSEHOLD": F.concat(F.lit("http://192.168."), b, F.lit("."), a),
        "MACHINERY": F.concat(F.lit("https://h"), a, F.lit(".example.com/")),
    }
    return c.withColumn("url", st.pick(F.col("c_mktsegment"), made)).select("c_custkey", url.url_safety(F.col("url")).alias("safety"))


@query("page_url_safety", "SELECT page_id, 'ok' AS safety FROM pages")
def page_url_safety(spark, sf):
    return table(spark, sf, "pages").select("page_id", url.url_safety(F.col("url")).alias("safety"))


@query(
    "posting_keys",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) ELSE sha256('https://p.example.com/' || p_partkey) END AS external_id,
  'job_' || substr(sha256(p_brand || chr(10) || p_partkey), 1, 32) AS job_id,
  sha256(lower(p_brand) || chr(10) || lower(p_name) || chr(10) || CASE WHEN p_size > 10 THEN p_type ELSE '' END) AS dedupe_key, sha256(p_name) AS response_hash FROM part""",
)
def posting_keys(spark, sf):
    c = F.col
    key = c("p_partkey").cast("string")
    link = F.concat(F.lit("https://p.example.com/"), key)
    return table(spark, sf, "part").select(
        "p_partkey",
        keys.external_id(F.when(c("p_size") > 25, key).otherwise(F.lit(" ")), link).alias("external_id"),
        keys.job_id(c("p_brand"), key).alias("job_id"),
        keys.dedupe_key(c("p_brand"), c("p_name"), F.when(c("p_size") > 10, c("p_type"))).alias("dedupe_key"),
        keys.response_hash(c("p_name")).alias("response_hash"),
    )


@query(
    "posted_times",
    """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS from_ms, CAST(epoch(o_orderdate) AS BIGINT) AS from_seconds, CAST(epoch(o_orderdate) AS BIGINT) AS from_date,
  CAST(epoch(o_orderdate) AS BIGINT) - 32400 AS from_zone, CAST(epoch(o_orderdate) AS BIGINT) AS from_words, CAST(NULL AS BIGINT) AS from_junk FROM orders""",
)
def posted_times(spark, sf):
    at, none = epoch("o_orderdate"), F.lit(None)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        values.posted_at((at * 1_000).cast("double") + 0.5, none.cast("string")).alias("from_ms"),
        values.posted_at(at.cast("double"), none.cast("string")).alias("from_seconds"),
        values.posted_at(none.cast("double"), day).alias("from_date"),
        values.posted_at(none.cast("double"), F.concat(day, F.lit("T00:00:00+09:00"))).alias("from_zone"),
        values.posted_at(none.cast("double"), F.date_format("o_orderdate", "MMM d, yyyy")).alias("from_words"),
        values.posted_at(none.cast("double"), F.col("o_orderpriority")).alias("from_junk"),
    )


_SALARY_CODE = r"(?i)\b(USD|EUR|GBP|KRW|JPY|CAD|AUD)\s*[$€£₩¥]?\s*([\d,.]+)\s*(?:-|–|—|to)\s*[$€£₩¥]?\s*([\d,.]+)(?:\s*(?:per|/)\s*(year|month|hour))?"
_SALARY_SIGN = r"(?i)([$€£₩¥])\s*([\d,.]+)\s*(?:-|–|—|to)\s*[$€£₩¥]?\s*([\d,.]+)(?:\s*(?:per|/)\s*(year|month|hour))?"


def _salary_sql(c: str) -> dict[str, str]:
    by_code, by_sign = f"regexp_matches({c}, '{_SALARY_CODE}')", f"regexp_matches({c}, '{_SALARY_SIGN}')"

    def group(n: int) -> str:
        return f"CASE WHEN {by_code} THEN regexp_extract({c}, '{_SALARY_CODE}', {n}) WHEN {by_sign} THEN regexp_extract({c}, '{_SALARY_SIGN}', {n}) END"

    signs = "CASE regexp_extract({c}, '{p}', 1) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '₩' THEN 'KRW' WHEN '¥' THEN 'JPY' END"
    signs = signs.replace("{c}", c).replace("{p}", _SALARY_SIGN)
    return {
        "salary_currency": f"CASE WHEN {by_code} THEN upper(regexp_extract({c}, '{_SALARY_CODE}', 1)) WHEN {by_sign} THEN {signs} END",
        "salary_min": f"TRY_CAST(replace({group(2)}, ',', '') AS DOUBLE)",
        "salary_max": f"TRY_CAST(replace({group(3)}, ',', '') AS DOUBLE)",
        "salary_interval": f"lower(nullif({group(4)}, ''))",
    }


_PAY = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Pay: USD ' || CAST(floor(o_totalprice) AS BIGINT) || ' - 900,000.5 per year'
  WHEN '2-HIGH' THEN '€' || CAST(floor(o_totalprice) AS BIGINT) || ' to €1,234 / Hour' WHEN '3-MEDIUM' THEN '₩ 1,000–' || o_custkey ELSE o_orderpriority END AS pay FROM orders"""


@query(
    "salaries_in_text",
    with_ctes({"o": _PAY}, "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _salary_sql("pay").items()) + " FROM o"),
)
def salaries_in_text(spark, sf):
    whole = F.floor("o_totalprice").cast("bigint").cast("string")
    made = {
        "1-URGENT": F.concat(F.lit("Pay: USD "), whole, F.lit(" - 900,000.5 per year")),
        "2-HIGH": F.concat(F.lit("€"), whole, F.lit(" to €1,234 / Hour")),
        "3-MEDIUM": F.concat(F.lit("₩ 1,000–"), F.col("o_custkey").cast("string")),
    }
    rows = table(spark, sf, "orders").withColumn("pay", F.coalesce(st.pick(F.col("o_orderpriority"), made), "o_orderpriority"))
    found = rows.withColumn("s", values.salary_from_text(F.col("pay")))
    return found.select(
        "o_orderkey",
        *[F.col("s")[n].alias(f"salary_{n}") for n in ("currency", "min", "max", "interval")],
    )


@query(
    "error_statuses",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN 400 + CAST(l_quantity AS INTEGER) END AS status FROM lineitem""",
)
def error_statuses(spark, sf):
    code = (F.lit(400) + F.col("l_quantity").cast("int")).cast("string")
    message = F.when(F.col("l_quantity") > 25, F.concat(F.lit("HTTP "), code, F.lit(" for https://x"))).otherwise("HTTP failed")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.http_status_from_error(message).alias("status")
    )


# Postings made of documents: rule wording is chosen by the document's source and language.
_TITLES = {
    "src0": "Senior Frontend Engineer", "src1": "Product Engineer", "src2": "Back-end Developer", "src3": "WebGL Engineer",
    "src4": "Product Manager", "src5": "Backend and Front-end Lead", "src6": "Data Analyst", "src7": "Creative Developer",
    "src8": "Front End Engineer", "src9": "Graphics Engineer", "src10": "Visualization Engineer, Backend", "src11": "Head of Product",
}
_PLACES = {"en": "Remote, Worldwide", "de": "Berlin", "fr": "Remote in Asia", "es": "Madrid"}
_WORDING = {
    "src0": "Async-first with no core hours. We use Three.js and WebGL. You own the roadmap. Base pay $120,000 - $150,000 per year.",
    "src1": "Remote within the EU. Daily stand-up. 5 hours of daily overlap with PST. Written communication matters.",
    "src2": "Candidates must be located in the United States. Onsite in our office. Frequent customer video calls.",
    "src3": "Remote role open to South Korea. GLSL, canvas and SVG. Zero-to-one work. UTC+9 preferred.",
    "src4": "Hybrid, 3 days per week in the office. Salary EUR 60,000 to 80,000 / month.",
    "src5": "APAC only. Documentation-first with a flexible schedule. From 0 → 1. Asynchronous by default.",
    "src6": "Work from home. Must overlap with the team. Daily standup at 9 EST.",
    "src7": "We are hiring globally for a distributed team. Compensation is fair. Ship products.",
    "src8": "US only. 2.5 hrs of overlap with PDT. PixiJS and pixi.js.",
    "src9": "Global remote. Core collaboration hours apply. End-to-end ownership.",
    "src10": "Work from the office. Visualization of data.",
    "src11": "Remote from anywhere, asynchronous communication. 6 hours overlap required, PT. Frequent client meetings.",
}
_SQL_LABEL = (
    f"SELECT doc_id, coalesce({st.pick_sql('source', _TITLES)}, 'Engineer') AS title, {st.pick_sql('lang', _PLACES)} AS location_text, "
    f"text || chr(10) || chr(10) || coalesce({st.pick_sql('source', _WORDING)}, '') AS description_text, source, lang FROM documents"
)
# The wording, points and sentences of the labels, as the rules state them.
_PATTERNS = {
    "hybrid": (r"\bhybrid\b", r"\b\d+ days? (?:a|per) week (?:in|at) (?:the )?office\b", r"\boffice attendance\b"),
    "onsite": (r"\bonsite\b", r"\bon-site\b", r"\bin[- ]office\b", r"\bwork from (?:our|the) office\b"),
    "remote": (r"\bremote\b", r"\bdistributed team\b", r"\bwork from home\b", r"\bhome[- ]based\b"),
    "region": (
        r"\b(?:us|u\.s\.|united states) only\b",
        r"\bmust (?:be )?(?:located|based|reside) in (?:the )?(?:us|u\.s\.|united states)\b",
        r"\bcanada only\b", r"\beu only\b", r"\buk only\b", r"\beurope only\b", r"\bemea only\b",
        r"\bremote within (?:the )?(?:us|united states|canada|eu|uk|europe)\b",
    ),
    "korea": (r"\b(?:south korea|republic of korea|korea)\b",),
    "apac": (r"\bapac\b", r"\basia[- ]pacific\b", r"\bremote[^.\n]{0,80}\basia\b", r"\basia time zones?\b"),
    "world": (
        r"\bworldwide\b", r"\bwork from anywhere\b", r"\bremote from anywhere\b", r"\banywhere in the world\b",
        r"\bworldwide remote\b", r"\bglobal remote\b", r"\bopen to candidates globally\b", r"\bhire(?:s|ing)? globally\b",
    ),
}
_OWN = (
    r"\b0\s*(?:→|->|to)\s*1\b", r"\bzero[- ]to[- ]one\b", r"\bend[- ]to[- ]end ownership\b",
    r"\bown (?:the )?(?:product|feature|roadmap|outcome)\b", r"\bship products?\b",
)
_COMP = (r"\b(?:salary|compensation|pay range|base pay)\b", r"[$€£]\s?\d{2,3}(?:[,\s]\d{3})")
_ZONE = (
    r"(?i)\b(?:UTC|GMT)\s?[+-]\s?\d{1,2}(?::\d{2})?|\b(?:PST|PDT|PT|MST|MDT|MT|CST|CDT|CT|EST|EDT|ET|CET|CEST|EET|JST|KST|AEST|AEDT)\b"
)
_OVERLAP = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)\s+(?:of\s+)?(?:daily\s+)?(?:overlap|crossover)\b"
_POSITIVE = (
    "async-first", "asynchronous communication", "asynchronous written communication", "no core hours",
    "documentation-first", "written communication", "flexible schedule", "work whenever",
)
_NEGATIVE = (
    "daily stand-up", "daily standup", "core collaboration hours", "must overlap", "frequent zoom calls", "frequent video calls",
)
_ROLES = (
    "frontend engineer", "front-end engineer", "product engineer", "graphics engineer", "creative developer",
    "visualization engineer", "webgl engineer", "webgpu engineer",
)
_SKILLS = (
    ("three.js", "Three.js"), ("threejs", "Three.js"), ("webgl", "WebGL"), ("webgpu", "WebGPU"), ("glsl", "GLSL"),
    ("canvas", "Canvas"), ("svg", "SVG"), ("pixijs", "PixiJS"), ("pixi.js", "PixiJS"), ("babylon.js", "Babylon.js"),
    ("visualization", "Visualization"),
)
_FRONT = (r"\bfront[- ]?end\b", r"\bproduct engineer\b", r"\bgraphics engineer\b", r"\bcreative developer\b", r"\bvisualization engineer\b")
_LEVEL_POINTS = "CASE async_level WHEN 'explicit' THEN 25 WHEN 'strong' THEN 20 WHEN 'weak' THEN 8 WHEN 'synchronous' THEN -8 ELSE 0 END"
_ELIGIBLE_POINTS = "CASE eligible WHEN 'yes' THEN 30 WHEN 'likely' THEN 22 WHEN 'no' THEN -40 ELSE 5 END"


def _snip(needle: str) -> str:
    return sq.snippet("original", "lowered", needle)


_EVIDENCE = [
    (
        "eligible <> 'unknown'", "eligibleFromKorea", _ELIGIBLE_POINTS,
        "CASE WHEN eligible = 'yes' AND scope = 'worldwide' THEN 'Worldwide 또는 어디서나 지원 가능한 Remote 범위가 명시되었습니다.' "
        f"WHEN eligible = 'yes' THEN {_snip(chr(39) + 'korea' + chr(39))} WHEN eligible = 'likely' THEN 'APAC 또는 Asia 범위의 Remote 신호가 있습니다.' "
        "ELSE '거주 지역 제한 또는 출근 요구가 감지되었습니다.' END",
        "CASE WHEN eligible = 'yes' AND scope = 'worldwide' THEN 'metadata' ELSE 'location' END",
    ),
    ("async_level <> 'unknown'", "asyncLevel", _LEVEL_POINTS, _snip("coalesce(positives[1], negatives[1], 'async')"), "'job-description'"),
    ("role", "role", "15", "title", "'title'"),
    ("backend", "role", "-10", "'Backend 중심 역할로 보입니다.'", "'title'"),
    ("len(skills) >= 2", "skills", "15", "array_to_string(skills, ' · ')", "'job-description'"),
    ("len(skills) = 1", "skills", "10", "skills[1]", "'job-description'"),
    ("own IS NOT NULL", "ownership", "10", _snip("own"), "'job-description'"),
    ("comp IS NOT NULL", "compensation", "5", _snip("comp"), "'job-description'"),
    (
        "late", "timezoneOverlap", "-15",
        "coalesce(zone, 'PT') || ' 기준 ' || regexp_replace(CAST(overlap AS VARCHAR), '\\.0$', '') || '시간 이상 중첩 요구'", "'job-description'",
    ),
    ("standup", "syncRisk", "-8", _snip("'daily stand'"), "'job-description'"),
    ("calls", "syncRisk", "-8", "'빈번한 고객 화상회의 신호가 있습니다.'", "'job-description'"),
]
_PACKED = ", ".join(
    f"CASE WHEN {when} THEN struct_pack(field := '{name}', effect := CAST({effect} AS INTEGER), text := {sq.clean(body)}, source := {source}) END"
    for when, name, effect, body, source in _EVIDENCE
)
_EXCEPTIONS = "(0, 7), (0, 11), (2, 3), (2, 9), (4, 1), (4, 3), (4, 5), (4, 9)"


def label_ctes(post: str) -> dict[str, str]:
    """CTEs that label the postings of ``post`` (doc_id, title, location_text, description_text and more)."""
    flags = ", ".join(f"{sq.any_of('placed', ps)} AS is_{n}" for n, ps in _PATTERNS.items())
    joined = "title || chr(10) || coalesce(location_text, '') || chr(10) || description_text"
    return {
        "post": post,
        "base": f"SELECT *, {sq.clean(joined)} AS original FROM post",
        "folded": f"SELECT *, lower(original) AS lowered, {sq.fold('original')} AS t, {sq.fold('title')} AS head, {sq.fold('coalesce(location_text, chr(39))').replace('chr(39)', chr(39) * 2)} || chr(10) || {sq.fold('original')} AS placed FROM base",
        "flagged": f"""SELECT *, {flags}, {sq.contained('t', [(x, x) for x in _POSITIVE])} AS positives, {sq.contained('t', [(x, x) for x in _NEGATIVE])} AS negatives,
  list_distinct_ordered AS skills, upper(regexp_replace(nullif(regexp_extract(t, '{_ZONE}'), ''), '\\s+', '', 'g')) AS zone,
  TRY_CAST(nullif(regexp_extract(t, '{_OVERLAP}', 1), '') AS DOUBLE) AS overlap,
  {' OR '.join(f"contains(head, '{r}')" for r in _ROLES)} OR {sq.any_of('head', _FRONT)} AS role,
  regexp_matches(head, '\\bproduct\\b') AS product, regexp_matches(head, '\\bback[- ]?end\\b') AND NOT regexp_matches(head, '\\bfront[- ]?end\\b') AS backend,
  {sq.first_of('t', _OWN)} AS own, {sq.first_of('t', _COMP)} AS comp, regexp_matches(t, '\\bdaily stand[- ]?up\\b') AS standup,
  regexp_matches(t, '\\bfrequent (?:customer|client) (?:video )?(?:calls|meetings)\\b') AS calls,
  contains(t, 'async-first') OR contains(t, 'no core hours') OR contains(t, 'asynchronous by default') OR contains(t, 'default to asynchronous') AS explicit
FROM (SELECT *, list_filter({sq.contained('t', _SKILLS)}, lambda x, i: list_position({sq.contained('t', _SKILLS)}, x) = i) AS list_distinct_ordered FROM folded)""",
        "scoped": """SELECT *, CASE WHEN is_hybrid THEN 'hybrid' WHEN is_onsite AND NOT is_remote THEN 'onsite' WHEN is_remote THEN 'remote' ELSE 'unknown' END AS workplace,
  CASE WHEN is_region THEN 'region-limited' WHEN is_korea THEN 'country-list' WHEN is_apac THEN 'apac' WHEN is_world THEN 'worldwide' ELSE 'unknown' END AS scope,
  CASE WHEN explicit THEN 'explicit' WHEN len(negatives) > 0 AND len(positives) = 0 THEN 'synchronous' WHEN len(positives) >= 2 THEN 'strong'
    WHEN len(positives) = 1 THEN 'weak' ELSE 'unknown' END AS async_level,
  coalesce(overlap, 0) >= 4 AND regexp_matches(t, '\\b(?:pst|pdt|pt)\\b') AS late FROM flagged""".replace("\\\\", "\\"),
        "eligibled": """SELECT *, CASE WHEN workplace IN ('onsite', 'hybrid') THEN 'no' WHEN is_korea THEN 'yes' WHEN scope = 'worldwide' THEN 'yes'
  WHEN scope = 'apac' THEN 'likely' WHEN scope = 'region-limited' THEN 'no' ELSE 'unknown' END AS eligible FROM scoped""",
        "evident": f"SELECT *, list_filter([{_PACKED}], lambda x: x IS NOT NULL) AS evidence FROM eligibled",
        "counted": """SELECT *, CAST(workplace <> 'unknown' AS INTEGER) + CAST(scope <> 'unknown' AS INTEGER) + CAST(eligible <> 'unknown' AS INTEGER)
  + CAST(async_level <> 'unknown' AS INTEGER) + CAST(len(skills) > 0 AS INTEGER) + CAST(role AS INTEGER) AS known,
  coalesce(list_sum(list_transform(evidence, lambda e: e.effect)), 0) + CASE WHEN eligible = 'unknown' THEN 5 ELSE 0 END
  + CASE WHEN product AND NOT role THEN 8 ELSE 0 END AS total FROM evident""",
        "labelled": f"""SELECT *, CAST(greatest(0, least(100, total)) AS INTEGER) AS score,
  (least(980, 320 + 100 * known + 25 * len(evidence)) + 5) // 10 / 100.0 - CASE WHEN (known, len(evidence)) IN ({_EXCEPTIONS}) THEN 0.01 ELSE 0 END AS confidence FROM counted""",
    }


def _posting_docs(spark, sf):
    docs = _documents(spark, sf)
    wording = F.coalesce(st.pick(F.col("source"), _WORDING), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(st.pick(F.col("source"), _TITLES), F.lit("Engineer")).alias("title"),
        st.pick(F.col("lang"), _PLACES).alias("location_text"),
        F.concat("text", F.lit("\n\n"), wording).alias("description_text"),
        "source",
        "lang",
    )


def _classified(spark, sf):
    return cl.classify(_posting_docs(spark, sf))


_LABELS = label_ctes(_SQL_LABEL)


@query(
    "posting_labels",
    with_ctes(_LABELS, "SELECT doc_id, workplace AS workplace_type, scope AS remote_scope, eligible AS eligible_from_korea, async_level FROM labelled"),
)
def posting_labels(spark, sf):
    return _classified(spark, sf).select("doc_id", "workplace_type", "remote_scope", "eligible_from_korea", "async_level")


@query(
    "posting_requirements",
    with_ctes(_LABELS, "SELECT doc_id, zone AS required_timezone, overlap AS required_overlap_hours, array_to_string(skills, ',') AS skills FROM labelled"),
)
def posting_requirements(spark, sf):
    return _classified(spark, sf).select(
        "doc_id", "required_timezone", "required_overlap_hours", F.array_join("skills", ",").alias("skills")
    )


@query("posting_scores", with_ctes(_LABELS, "SELECT doc_id, score, round(confidence, 2) AS confidence FROM labelled"))
def posting_scores(spark, sf):
    return _classified(spark, sf).select("doc_id", "score", F.round("confidence", 2).alias("confidence"))


@query(
    "posting_evidence",
    with_ctes(
        _LABELS,
        "SELECT doc_id, i, e.field AS field, e.effect AS effect, e.text AS text, e.source AS source FROM "
        "(SELECT doc_id, unnest(evidence) AS e, CAST(generate_subscripts(evidence, 1) - 1 AS INTEGER) AS i FROM labelled)",
    ),
)
def posting_evidence(spark, sf):
    # The outer form keeps Spark from deriving a filter that would classify every text again.
    rows = _classified(spark, sf).select("doc_id", F.posexplode_outer("evidence").alias("i", "e")).filter("i IS NOT NULL")
    return rows.select("doc_id", "i", "e.field", "e.effect", "e.text", "e.source")


@query(
    "evidence_by_effect",
    with_ctes(
        _LABELS,
        "SELECT doc_id, coalesce(string_agg(field, ',' ORDER BY effect DESC, i), '') AS fields FROM documents LEFT JOIN "
        "(SELECT doc_id, e.field AS field, e.effect AS effect, i FROM (SELECT doc_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS i FROM labelled)) "
        "USING (doc_id) GROUP BY doc_id",
    ),
)
def evidence_by_effect(spark, sf):
    ranked = F.transform(values.sort_evidence(F.col("evidence")), lambda e: e["field"])
    return _classified(spark, sf).select("doc_id", F.array_join(ranked, ",").alias("fields"))


_OWN_PROFILE = cl.Profile(
    roles=("lead",), skills=("tion", "und", "elle"), async_positive=("the", "que", "der"), async_negative=("and", "les"), skill_names={"und": "Und"}
)


@query(
    "custom_profile",
    f"""WITH f AS (SELECT doc_id, {sq.fold("'Engineer' || chr(10) || chr(10) || text")} AS t FROM documents),
h AS (SELECT doc_id, t, {sq.contained('t', [('the', 'the'), ('que', 'que'), ('der', 'der')])} AS p, {sq.contained('t', [('and', 'and'), ('les', 'les')])} AS n,
  {sq.contained('t', [('tion', 'tion'), ('und', 'Und'), ('elle', 'elle')])} AS s FROM f)
SELECT doc_id, CASE WHEN len(n) > 0 AND len(p) = 0 THEN 'synchronous' WHEN len(p) >= 2 THEN 'strong' WHEN len(p) = 1 THEN 'weak' ELSE 'unknown' END AS async_level,
  array_to_string(s, ',') AS skills FROM h""",
)
def custom_profile(spark, sf):
    rows = _documents(spark, sf).select("doc_id", F.lit("Engineer").alias("title"), F.lit("").alias("location_text"), F.col("text").alias("description_text"))
    return cl.classify(rows, _OWN_PROFILE).select("doc_id", "async_level", F.array_join("skills", ",").alias("skills"))


@query("document_timezones", f"SELECT doc_id, upper(nullif(regexp_extract({sq.fold('text')}, '{_ZONE}'), '')) AS zone FROM documents")
def document_timezones(spark, sf):
    return _documents(spark, sf).select("doc_id", cl.timezone(text.normalize_for_match(F.col("text"))).alias("zone"))


_RAW_SQL = (
    f"SELECT *, CASE WHEN lang <> 'de' THEN ' ' || doc_id || ' ' END AS raw_id, "
    f"'https://Jobs.Example.com/p/' || doc_id || '?utm_source=x&b=2&a=1#top' AS raw_url FROM ({_SQL_LABEL})"
)
_Q = "CAST(to_json({c}) AS VARCHAR)"
_NUM = "coalesce(regexp_replace(CAST({c} AS VARCHAR), '\\.0$', ''), 'null')"


def _q(c: str) -> str:
    return f"coalesce({_Q.format(c=c)}, 'null')"


_JSON = {
    "asyncLevel": _q("async_level"), "canonicalUrl": _q("canonical_url"), "companyName": _q("company_name"),
    "confidence": "regexp_replace(CAST(CAST(confidence AS DOUBLE) AS VARCHAR), '\\.0$', '')", "department": _q("lang"), "descriptionText": _q("descr"),
    "eligibleFromKorea": _q("eligible"), "employmentType": "'null'",
    "evidence": "'[' || array_to_string(list_transform(evidence, lambda e: '{\"effect\":' || e.effect || ',\"field\":\"' || e.field || '\",\"source\":\"' || e.source || '\",\"text\":' || CAST(to_json(e.text) AS VARCHAR) || '}'), ',') || ']'",
    "externalId": _q("external_id"), "locationText": _q("location_text"), "postedAt": _NUM.format(c="posted_at"),
    "remoteScope": _q("scope"), "requiredOverlapHours": _NUM.format(c="overlap"), "requiredTimezone": _q("zone"),
    "salaryCurrency": _q("salary_currency"), "salaryInterval": _q("salary_interval"), "salaryMax": _NUM.format(c="salary_max"),
    "salaryMin": _NUM.format(c="salary_min"), "score": "CAST(score AS VARCHAR)", "searchText": _q("search_text"),
    "skills": "'[' || array_to_string(list_transform(skills, lambda s: '\"' || s || '\"'), ',') || ']'",
    "title": _q("title"), "workplaceType": _q("workplace"),
}
_SNAPSHOT_KEYS = [k for k in _JSON if k not in ("canonicalUrl", "companyName", "externalId", "postedAt", "searchText")]


def _object(names) -> str:
    return " || ".join(("'{" if i == 0 else "',") + f"\"{k}\":' || {_JSON[k]}" for i, k in enumerate(names)) + " || '}'"


_NORMAL = {
    **label_ctes(_RAW_SQL),
    "sized": f"""SELECT *, {sq.clean('description_text')} AS clean_text, 'https://jobs.example.com/p/' || doc_id || '?a=1&b=2' AS canonical_url,
  coalesce(CAST(CASE WHEN lang <> 'de' THEN doc_id END AS VARCHAR), sha256('https://jobs.example.com/p/' || doc_id || '?a=1&b=2')) AS external_id,
  'Company ' || source AS company_name, CAST(1786579200 + doc_id AS BIGINT) AS posted_at FROM labelled""",
    "paid": f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _salary_sql('clean_text').items())} FROM sized",
    "record": f"""SELECT *, clean_text AS descr,
  {sq.clean("concat_ws(chr(10), title, company_name, nullif(lang, ''), location_text, nullif(array_to_string(skills, ' '), ''), nullif(clean_text, ''))")} AS search_text FROM paid""",
}


def _raw_postings(spark, sf):
    rows = _posting_docs(spark, sf)
    key = F.col("doc_id").cast("string")
    at = (F.lit(1_786_579_200) + F.col("doc_id")).cast("double")
    return rows.select(
        "doc_id",
        F.when(F.col("lang") != "de", F.concat(F.lit(" "), key, F.lit(" "))).alias("external_id"),
        F.concat(F.lit("https://Jobs.Example.com/p/"), key, F.lit("?utm_source=x&b=2&a=1#top")).alias("canonical_url"),
        F.concat(F.lit(" "), "title", F.lit("\t")).alias("title"),
        F.concat(F.lit("Company "), "source").alias("company_name"),
        F.col("lang").alias("department"),
        "location_text",
        F.lit(None).cast("string").alias("employment_type"),
        "description_text",
        F.struct(at.alias("num"), F.lit(None).cast("string").alias("text")).cast(POSTED).alias("posted"),
        F.lit(None).cast(SALARY).alias("salary"),
    )


_NORMAL_OUT = (
    "doc_id, external_id, canonical_url, title, company_name, salary_currency, salary_min, salary_max, salary_interval, posted_at, score, "
    "sha256(search_text) AS search_hash"
)


@query("normalized_postings", with_ctes(_NORMAL, f"SELECT {_NORMAL_OUT} FROM record"))
def normalized_postings(spark, sf):
    rows = normalize_postings(_raw_postings(spark, sf))
    return rows.select(
        "doc_id", "external_id", "canonical_url", "title", "company_name", "salary_currency", "salary_min", "salary_max",
        "salary_interval", "posted_at", "score", F.sha2("search_text", 256).alias("search_hash"),
    )


@query("content_hashes", with_ctes(_NORMAL, f"SELECT doc_id, sha256({_object(_JSON)}) AS content_hash FROM record"))
def content_hashes(spark, sf):
    return normalize_postings(_raw_postings(spark, sf)).select("doc_id", "content_hash")


@query("version_snapshots", with_ctes(_NORMAL, f"SELECT doc_id, {_object(_SNAPSHOT_KEYS)} AS snapshot FROM record"))
def version_snapshots(spark, sf):
    rows = normalize_postings(_raw_postings(spark, sf))
    return rows.select("doc_id", keys.snapshot_json().alias("snapshot"))


_SHORT = "CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n} - 1)) || '…' END"


@query(
    "limited_fields",
    f"""WITH p AS (SELECT p_partkey, p_type, p_type || ' ' || p_brand AS t FROM part)
SELECT p_partkey, {_SHORT.format(t="t", n=18)} AS short, array_to_string(list_slice([p_type, 'extra', t], 1, 2), ',') AS skills,
  {_SHORT.format(t="t", n=12)} || '|' || {_SHORT.format(t="p_type", n=12)} AS evidence, 's1,' || p_type AS signals FROM p""",
)
def limited_fields(spark, sf):
    """Every limit given: characters of a text, number of skills, of pieces of evidence and their characters, of signals."""
    whole = F.concat("p_type", F.lit(" "), "p_brand")
    piece = lambda c: F.struct(F.lit("title").alias("field"), F.lit(1).alias("effect"), c.alias("text"), F.lit("title").alias("source"))
    evidence = text.limit_evidence(F.array(piece(whole), piece(F.concat(F.lit("  "), "p_type", F.lit(" "))), piece(F.lit("third"))), 2, 12)
    skills = text.limit_skills(F.array(F.col("p_type"), F.lit("extra"), F.upper("p_type"), whole), 2)
    signals = health.limit_signals(F.array(F.lit(" s1 "), F.lit(" "), F.concat(F.lit("\n"), "p_type"), F.lit("s3")), 2)
    return table(spark, sf, "part").select(
        "p_partkey", text.limit_text(whole, 18).alias("short"), F.array_join(skills, ",").alias("skills"),
        F.array_join(F.transform(evidence, lambda e: e["text"]), "|").alias("evidence"), F.array_join(signals, ",").alias("signals"),
    )
