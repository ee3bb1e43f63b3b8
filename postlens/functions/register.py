"""The functions a SQL user calls by name: inlined SQL functions and one table function."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F, types as T

from ..sources.cards import page_cards
from .text import HYPHENS, TRIM_CHARS
from .url import _SPLIT, TRACKING_PARAM


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_CLEAN = (
    "btrim(regexp_replace(regexp_replace(x, '[\\\\t\\\\r \\\\u00a0]+', ' '), '\\\\n{3,}', '\\n\\n'), "
    + _quoted(TRIM_CHARS) + ")"
)
_SPLIT_SQL = _quoted(_SPLIT)


def _part(group: int) -> str:
    return f"regexp_extract(x, {_SPLIT_SQL}, {group})"


_NAME = "coalesce(try_url_decode(substring_index(p, '=', 1)), substring_index(p, '=', 1))"
_VALUE = "if(position('=', p) > 0, substring(p, position('=', p) + 1), '')"
_QUERY = (
    "array_join(transform(array_sort(filter(transform("
    f"filter(split(substring({_part(4)}, 2), '&'), p -> p <> ''), "
    f"(p, i) -> named_struct('name', {_NAME}, 'i', i, 'text', "
    f"concat(url_encode({_NAME}), '=', url_encode(coalesce(try_url_decode({_VALUE}), {_VALUE}))))), "
    f"f -> not rlike(f.name, {_quoted(TRACKING_PARAM)}))), f -> f.text), '&')"
)
_HOST = (
    f"regexp_replace(lower(regexp_replace({_part(2)}, '^.*@', '')), "
    f"if(lower({_part(1)}) = 'https', ':(?:443)?$', ':(?:80)?$'), '')"
)
# Dot segments of a path x: kept segments are gathered, one `..` takes the last of them away.
_SEGMENTS = "slice(split(x, '/'), 2, size(split(x, '/')))"
_KEPT = (
    f"aggregate({_SEGMENTS}, cast(array() as array<string>), (a, s) -> if(s = '..', slice(a, 1, greatest(size(a) - 1, 0)), "
    "if(s = '.', a, concat(a, array(s)))))"
)
_PATH = (
    "if(x = '', '/', if(contains(x, '/.'), "
    f"concat('/', array_join({_KEPT}, '/'), if(element_at({_SEGMENTS}, -1) in ('.', '..') and size({_KEPT}) > 0, '/', '')), x))"
)
# The helpers are functions of their own, so that each value is written once; they take `prefix` as their name's begin.
_URL = (
    f"if(rlike(x, '(?i)^https?:') and {_part(2)} <> '', "
    f"concat(lower({_part(1)}), '://', regexp_extract({_part(2)}, '^(.*@)', 1), {_HOST}, "
    "{prefix}settled_path(translate(" + _part(3) + ", '" + "\\\\" + "', '/')), "
    f"if({_QUERY} = '', '', concat('?', {_QUERY}))), null)"
)
_FUNCTIONS = {
    "normalize_whitespace": ("string", "string", _CLEAN),
    "normalize_for_match": ("string", "string", f"translate(lower({_CLEAN}), {_quoted(HYPHENS)}, '-----')"),
    "settled_path": ("string", "string", _PATH),
    "trimmed_url_parts": ("string", "string", _URL),
    "canonical_url": (
        "string", "string",
        f"{{prefix}}trimmed_url_parts(regexp_replace(btrim(x, {_quoted(TRIM_CHARS)}), '[\\\\t\\\\n\\\\r]', ''))",
    ),
    "score_band": (
        "int", "string",
        "case when x >= 85 then 'excellent' when x >= 70 then 'good' when x >= 50 then 'mixed' else 'low' end",
    ),
}
_CARD_FIELDS = ("external_id", "url", "title", "department", "location_text", "plain", "posted_text")
_CARD = T.StructType([T.StructField(n, T.StringType()) for n in _CARD_FIELDS])


class _HtmlCards:
    """SELECT * FROM posting_html_cards(html, list_selector, title_selector)"""

    def eval(self, html: str, list_selector: str, title_selector: str):
        config = {"listSelector": list_selector, "titleSelector": title_selector}
        for card in page_cards(html or "", config, False):
            yield tuple(card[n] for n in _CARD_FIELDS)


def register_functions(spark: SparkSession, prefix: str = "posting_") -> list[str]:
    """Create the temporary SQL functions; the scalar ones inline into plans."""
    names = []
    for name, (argument, result, body) in _FUNCTIONS.items():
        body = body.replace("{prefix}", prefix)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x {argument}) RETURNS {result} RETURN {body}")
        names.append(prefix + name)
    spark.udtf.register(prefix + "html_cards", F.udtf(_HtmlCards, returnType=_CARD))
    return [*names, prefix + "html_cards"]
