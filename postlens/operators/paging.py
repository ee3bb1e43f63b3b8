"""Keyset pages over (score, first_seen_at, id), newest best first."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from .filters import JobFilter, clamp_int, filter_jobs

DEFAULT_LIMIT = 50
# The largest limit Spark takes; a page holds as many rows as its caller asks for.
MAX_LIMIT = 2**31 - 2


@dataclass(frozen=True)
class Cursor:
    score: float
    first_seen_at: float
    id: str


class BadCursor(ValueError):
    pass


def encode_cursor(cursor: Cursor) -> str:
    body = {"score": cursor.score, "firstSeenAt": cursor.first_seen_at, "id": cursor.id}
    text = json.dumps(body, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(text: str) -> Cursor:
    try:
        padded = text.replace("+", "-").replace("/", "_") + "=" * (-len(text) % 4)
        body = json.loads(base64.urlsafe_b64decode(padded))
        score, seen, key = body["score"], body["firstSeenAt"], body["id"]
        numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (score, seen))
        if not numbers or not isinstance(key, str):
            raise BadCursor("invalid cursor fields")
        return Cursor(score, seen, key)
    except BadCursor:
        raise
    except (ValueError, KeyError, TypeError) as error:
        raise BadCursor("invalid cursor") from error


def after(cursor: Cursor) -> Column:
    score, seen, key = F.col("score"), F.col("first_seen_at"), F.col("id")
    return (
        (score < cursor.score)
        | ((score == cursor.score) & (seen < cursor.first_seen_at))
        | ((score == cursor.score) & (seen == cursor.first_seen_at) & (key < cursor.id))
    )


def after_cursor(df: DataFrame, cursor: str | Cursor | None) -> DataFrame:
    if not cursor:
        return df
    return df.filter(after(decode_cursor(cursor) if isinstance(cursor, str) else cursor))


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col("first_seen_at").desc(), F.col("id").desc())


def page_frame(df: DataFrame, f: JobFilter = JobFilter(), limit=None, cursor=None) -> DataFrame:
    """The page and its look-ahead row: a filtered top-k, never a full sort."""
    size = clamp_int(limit, DEFAULT_LIMIT, 1, MAX_LIMIT)
    return ordered(after_cursor(filter_jobs(df, f), cursor)).limit(size + 1)


def page(df: DataFrame, f: JobFilter = JobFilter(), limit=None, cursor=None) -> tuple[list[Row], str | None]:
    """Items of one page and the cursor of the next, for an interactive caller."""
    size = clamp_int(limit, DEFAULT_LIMIT, 1, MAX_LIMIT)
    rows = page_frame(df, f, limit, cursor).collect()
    items = rows[:size]
    if len(rows) <= size:
        return items, None
    last = items[-1]
    return items, encode_cursor(Cursor(last["score"], last["first_seen_at"], last["id"]))
