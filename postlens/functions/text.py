"""Text functions. Everything is a Column expression and stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters a browser-side trim removes.
_SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_SPACES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
TRIM_CHARS = "".join(chr(code) for code in _SPACES)
SPACE = "[" + "".join(f"\\u{code:04x}" for code in _SPACES) + "]"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014"

_WORD = "[A-Za-z0-9_]"
# The JVM's own class of the same characters is one table look-up; a written-out class is a chain of range tests.
_W = r"\w"
_BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
_TOKEN = re.compile(r"\\.|.", re.DOTALL)


def ascii_regex(pattern: str) -> str:
    """Give ``\\b`` and ``\\s`` of a pattern the same meaning in every engine.

    ``\\b`` becomes a boundary of ASCII word characters; beside a literal word character
    or before a group, which must then start with one, a single look-around is enough.
    ``\\s`` includes the Unicode spaces.
    """
    tokens = _TOKEN.findall(pattern)

    def wordy(at: int) -> bool:
        inside = 0 <= at < len(tokens)
        return inside and (tokens[at] == r"\d" or re.fullmatch(_WORD, tokens[at]) is not None)

    out = []
    for i, token in enumerate(tokens):
        if token == r"\s":
            out.append(SPACE)
        elif token != r"\b":
            out.append(token)
        elif wordy(i + 1) or tokens[i + 1 : i + 2] == ["("]:
            out.append(f"(?<!{_W})")
        elif wordy(i - 1):
            out.append(f"(?!{_W})")
        else:
            out.append(_BOUNDARY)
    return "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed value once inside an expression that uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(values: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``let`` for several named values at once."""
    packed = F.struct(*[c.alias(name) for name, c in values.items()])
    return let(packed, lambda s: body({name: s[name] for name in values}))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let_blank_to_null(c: Column) -> Column:
    """As ``blank_to_null``, for a costly argument that must not be written out twice."""
    return let(c, blank_to_null)


def normalize_whitespace(c: Column) -> Column:
    """Single blanks, at most one empty line, nothing at the ends. Tidy text is only scanned."""

    def blanks(t: Column) -> Column:
        untidy = t.contains("  ") | t.contains("\t") | t.contains("\r") | t.contains("\u00a0")
        return F.when(untidy, F.regexp_replace(t, "[\\t\\r \\u00a0]+", " ")).otherwise(t)

    def lines(t: Column) -> Column:
        return trim(F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\\n{3,}", "\n\n")).otherwise(t))

    return let(let(c, blanks), lines)


def fold(c: Column) -> Column:
    """Lower case with every hyphen alike, for text whose whitespace is normalized."""
    folded = F.lower(c)
    for hyphen in HYPHENS:
        folded = F.replace(folded, F.lit(hyphen), F.lit("-"))
    return folded


def normalize_for_match(c: Column) -> Column:
    return fold(normalize_whitespace(c))


def unique_ci(values: Column) -> Column:
    """Distinct non-empty strings ignoring case; the first spelling stays."""
    clean = F.filter(F.transform(values, normalize_whitespace), lambda v: v != "")
    folded = F.transform(clean, F.lower)
    return F.filter(clean, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)


def truncate(c: Column, limit: int | None) -> Column:
    """At most ``limit`` characters with a mark where something was cut off; no limit leaves the text as it is."""
    if limit is None:
        return c

    def cut(text: Column) -> Column:
        head = F.rtrim(F.substring(text, 1, max(0, limit - 1)), F.lit(TRIM_CHARS))
        return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))

    return let(c, cut)


def find_snippet(original: Column, needle: Column | str, radius: int = 120, lowered: Column | None = None) -> Column:
    """Text around the first case-insensitive hit, or the head of the text without one."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    lowered = F.lower(original) if lowered is None else lowered

    def around(hit: Column) -> Column:
        start = F.greatest(F.lit(1), hit - radius)
        piece = F.substring(original, start, hit + F.char_length(needle) + radius - start)
        return F.when(hit > 0, normalize_whitespace(piece)).otherwise(
            truncate(normalize_whitespace(original), radius * 2)
        )

    return let(F.position(F.lower(needle), lowered), around)


def make_search_text(parts: Sequence[Column], limit: int | None = None) -> Column:
    joined = F.concat_ws("\n", *[blank_to_null(p) for p in parts])
    return truncate(normalize_whitespace(joined), limit)


def limit_evidence(evidence: Column, items: int | None = None, limit: int | None = None) -> Column:
    kept = evidence if items is None else F.slice(evidence, 1, items)
    return F.transform(kept, lambda e: e.withField("text", truncate(normalize_whitespace(e["text"]), limit)))


def limit_skills(skills: Column, items: int | None = None) -> Column:
    return unique_ci(skills) if items is None else F.slice(unique_ci(skills), 1, items)


def limit_text(c: Column, limit: int | None = None) -> Column:
    return truncate(normalize_whitespace(c), limit)


@F.pandas_udf(T.StringType())
def _decompose(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKD")


def slugify(c: Column) -> Column:
    """Lower-case ASCII slug of the whole text. Only non-ASCII strings travel to the decomposition helper."""
    non_ascii = F.when(c.rlike("[^\\x00-\\x7F]"), c)
    plain = F.coalesce(_decompose(non_ascii), c)
    dashed = F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def quote_json(c: Column) -> Column:
    """A string as a JSON string literal."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.char_length(boxed) - 2)


def json_string(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(quote_json(c))


def json_number(c: Column) -> Column:
    """A number as JSON text; whole doubles carry no fraction."""
    value = c.cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    text = F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def json_array(values: Column, item) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, item), ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """JSON object text with its keys in sorted order."""
    parts: list[Column] = []
    for position, key in enumerate(sorted(fields)):
        parts.append(F.lit(("," if position else "") + f'"{key}":'))
        parts.append(fields[key])
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def canonical_json(map_col: Column) -> Column:
    """JSON text of a string map, keys sorted."""
    entries = F.array_sort(F.map_entries(map_col))
    pairs = F.transform(entries, lambda e: F.concat(quote_json(e["key"]), F.lit(":"), json_string(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """Decode JSON text, or give the default when it is missing or broken."""
    return F.coalesce(F.from_json(c, schema), default)
