"""HTML to plain text with built-in expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import let, normalize_whitespace

# Elements whose content is not text.
DROPPED_ELEMENTS = ("script", "style", "noscript", "svg")

_COMMENT = "(?s)<!--.*?(?:-->|\\z)"
_DECLARATION = "<[!?][^>]*>"
_TAG = "</?[a-zA-Z](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+(?:>|\\z)"
_FREQUENT = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;")
_WINDOWS_1252 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
_ENTITY = "^(?:#[xX][0-9a-fA-F]{1,6};?|#[0-9]{1,7};?|[A-Za-z][A-Za-z0-9]*;)"
_BARE_ENTITY = "^(?:" + "|".join(_BARE) + ")"


def _character(number: Column) -> Column:
    """The character a numeric reference stands for; 128-159 mean windows-1252."""
    bad = (number <= 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    legacy = F.get(F.array(*[F.lit(ch) for ch in _WINDOWS_1252]), (number - 128).cast("int"))
    return F.when(number.between(128, 159), legacy).otherwise(wide)


def _named() -> Column:
    # One literal, folded into a map once per query; frequent names come first.
    names = {name: html5[name] for name in _FREQUENT} | html5
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _decode_part(part: Column, named: Column) -> Column:
    """Text after one ``&`` with its leading reference replaced."""
    found = F.regexp_extract(part, _ENTITY, 0)
    bare = F.regexp_extract(part, _BARE_ENTITY, 0)
    digits = F.regexp_extract(part, "^#([0-9]{1,7})", 1).try_cast("bigint")
    hex_digits = F.conv(F.regexp_extract(part, "^#[xX]([0-9a-fA-F]{1,6})", 1), 16, 10).try_cast("bigint")
    number = let(F.when(part.startswith("#"), F.coalesce(digits, hex_digits)), _character)
    whole = F.concat(F.coalesce(number, named[found]), F.substring(part, F.char_length(found) + 1, F.char_length(part)))
    partial = F.concat(named[bare], F.substring(part, F.char_length(bare) + 1, F.char_length(part)))
    return F.coalesce(whole, partial, F.concat(F.lit("&"), part))


def decode_entities(c: Column) -> Column:
    """Replace character references. Text without ``&`` passes through untouched."""

    def decode(text: Column) -> Column:
        parts = F.split(text, "&")
        decoded = let(
            _named(),
            lambda named: F.array_join(
                F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_decode_part(p, named))), ""
            ),
        )
        return F.when(text.contains("&"), decoded).otherwise(text)

    return let(c, decode)


def html_to_text(c: Column) -> Column:
    """Text of a document or fragment, without the content of script-like elements."""
    body = F.regexp_replace(c, _COMMENT, "")
    for name in DROPPED_ELEMENTS:
        body = F.regexp_replace(body, f"(?is)<{name}(?=[\\s/>])[^>]*>.*?(?:</{name}\\s*>|\\z)", "")
    body = F.regexp_replace(body, _DECLARATION, "")
    body = F.regexp_replace(body, _TAG, "")
    return normalize_whitespace(decode_entities(body))
