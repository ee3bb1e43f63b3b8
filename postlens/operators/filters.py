"""Composable posting filters, named views and full-text search.

Inputs are postings joined with their user action and version count (see
``plans.views.listing``); each option becomes one conjunct that Catalyst can push down.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The columns full-text search covers.
SEARCH_COLUMNS = ("title", "company_name", "location_text", "skills_text", "search_text")


def clamp_int(value, fallback: int, low: int, high: int) -> int:
    """Whole number within bounds; text that is not a finite number gives the fallback."""
    if value is None:
        value = fallback
    if isinstance(value, str):
        value = value.strip() or "0"
    try:
        number = float(value)
    except ValueError:
        return fallback
    if not math.isfinite(number):
        return fallback
    return max(low, min(high, math.trunc(number)))


def csv_values(value: str | Sequence[str] | None) -> list[str]:
    parts = (value or "").split(",") if isinstance(value, str) or value is None else value
    return [p.strip() for p in parts if p.strip()]


@dataclass(frozen=True)
class JobFilter:
    q: str = ""
    status: str = "open"
    min_score: int | str | None = None
    eligibility: str | Sequence[str] | None = None
    async_level: str | Sequence[str] | None = None
    remote_scope: str | Sequence[str] | None = None
    company_id: str | None = None
    action: str | None = None
    skills: str | Sequence[str] | None = None
    changed: bool = False


# The saved views of the listing.
VIEWS = {
    "new": JobFilter(action="none"),
    "top": JobFilter(min_score=85, eligibility=("yes", "likely")),
    "worldwide": JobFilter(remote_scope=("worldwide",), async_level=("explicit", "strong"), eligibility=("yes",)),
    "apac": JobFilter(remote_scope=("apac",), eligibility=("yes", "likely")),
    "graphics": JobFilter(skills=("three.js", "webgl", "webgpu", "glsl", "visualization")),
    "changed": JobFilter(changed=True),
    "saved": JobFilter(action="saved"),
    "applied": JobFilter(action="applied"),
}


def view(name: str, **changes) -> JobFilter:
    return replace(VIEWS[name], **changes)


def fold_words(c: Column) -> Column:
    """Lower-case words without diacritics, each surrounded by one blank."""
    accented, plain = _latin_folding()
    words = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), accented, plain), r"[^\p{L}\p{N}\p{Co}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _latin_folding() -> tuple[str, str]:
    """Letters that decompose to one base letter, and those base letters."""
    import unicodedata

    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(code).lower())
        letters = [ch for ch in base if not unicodedata.combining(ch)]
        if len(letters) == 1 and letters[0] != chr(code) and len(chr(code).lower()) == 1 and chr(code).lower() == chr(code):
            accented.append(chr(code))
            plain.append(letters[0])
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code))]
    return "".join(accented + marks), "".join(plain)


def phrases(q: str) -> list[str]:
    """Query tokens: quotes dropped, each a phrase that must occur."""
    tokens = [re.sub(r"[\"']", "", t) for t in q.strip().split()]
    return [t for t in tokens if t]


def search_predicate(q: str, columns: Sequence[str] = SEARCH_COLUMNS) -> Column | None:
    """All phrases must hit, each within some one column; no phrase means no predicate."""
    wanted = phrases(q)
    if not wanted:
        return None
    folded = [fold_words(F.col(c)) for c in columns]
    tests = []
    for phrase in wanted:
        needle = fold_words(F.lit(phrase))
        # A phrase without any word matches nothing but is not a syntax error.
        hit = reduce(lambda a, b: a | b, [text.contains(needle) for text in folded])
        tests.append(hit & (F.trim(needle) != ""))
    return reduce(lambda a, b: a & b, tests)


def search(df: DataFrame, q: str, columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    predicate = search_predicate(q, columns)
    return df if predicate is None else df.filter(predicate)


def has_any_skill(skills: Column, wanted: Sequence[str]) -> Column:
    text = F.lower(F.array_join(skills, " "))
    return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in wanted])


def conditions(f: JobFilter) -> list[Column]:
    found: list[Column] = []
    if f.status != "all":
        found.append(F.col("status") == f.status)
    if f.min_score not in (None, "", 0):
        found.append(F.col("score") >= clamp_int(f.min_score, 0, 0, 100))
    lists = {"eligible_from_korea": f.eligibility, "async_level": f.async_level, "remote_scope": f.remote_scope}
    for column, values in lists.items():
        chosen = csv_values(values)
        if chosen:
            found.append(F.col(column).isin(*chosen))
    if f.company_id:
        found.append(F.col("company_id") == f.company_id)
    if f.action == "none":
        found.append(F.col("action").isNull())
    elif f.action:
        found.append(F.col("action") == f.action)
    skills = csv_values(f.skills)
    if skills:
        found.append(has_any_skill(F.col("skills"), skills))
    if f.changed:
        found.append(F.col("version_count") > 1)
    words = search_predicate(f.q) if f.q.strip() else None
    return found + ([] if words is None else [words])


def filter_jobs(df: DataFrame, f: JobFilter) -> DataFrame:
    tests = conditions(f)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
