"""Parsing of landed responses by source kind, all built-in kinds in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.html import html_to_text
from ..functions.text import blank_to_null, normalize_whitespace
from ..functions.url import resolve_url
from ..schemas import BOARD_KINDS, CONFIG, HTML_KINDS, POSTED, SALARY, SOURCE_KINDS
from . import cards, jsonld
from .boards import BOARDS, SHAPE_ERRORS
from .items import ITEMS

Parser = Callable[[DataFrame], DataFrame]


def _items(kinds: tuple[str, ...]) -> Column:
    """One expression from a response row to its posting items, chosen by kind."""
    kind, body = F.col("kind"), F.col("body")
    chosen = F.when(F.lit(False), F.lit(None).cast(ITEMS))
    for name in kinds:
        if name in BOARD_KINDS:
            chosen = chosen.when(kind == name, BOARDS[name](body))
    if "jsonld" in kinds:
        none = F.filter(F.array(F.parse_json(F.lit("null"))), lambda _: F.lit(False))
        chosen = chosen.when((kind == "jsonld") & body.isNotNull(), jsonld.jsonld_items(F.coalesce(jsonld.script_postings(F.col("_scripts")), none)))
    pages = [k for k in kinds if k in HTML_KINDS]
    if pages:
        # Cards see NULL for rows that are not theirs.
        own = F.when(kind.isin(*pages), body)
        chosen = chosen.when(kind.isin(*pages), cards.card_items(own, F.col("config"), kind == "playwright"))
    return chosen


def with_items(df: DataFrame, kinds: tuple[str, ...] = SOURCE_KINDS) -> DataFrame:
    """Add ``items``, ``parse_error`` and ``unreadable`` (scripts that are no JSON) to response rows (source columns
    already joined)."""
    if "config" not in df.columns:
        df = df.withColumn("config", F.lit(None).cast(CONFIG))
    unreadable = F.lit(0)
    if "jsonld" in kinds:
        df = df.withColumn("_scripts", jsonld.script_roots(F.when(F.col("kind") == "jsonld", F.col("body"))))
        # Apart from the postings, so that who asks for the number alone does not look for them.
        unreadable = F.coalesce(jsonld.unreadable_scripts(F.col("_scripts")), F.lit(0))
    df = df.withColumns({"items": _items(kinds), "unreadable": unreadable}).drop("_scripts")
    error = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in SHAPE_ERRORS.items():
        error = error.when((F.col("kind") == name) & F.col("items").isNull(), F.lit(text))
    config = F.col("config")
    for name in ("listSelector", "titleSelector"):
        missing = F.col("kind").isin(*HTML_KINDS) & blank_to_null(config[name]).isNull()
        error = error.when(missing, F.concat(F.col("kind"), F.lit(f" source requires config.{name}")))
    return df.withColumn("parse_error", error)


def empty_signal() -> Column:
    """The parser's own signal for a page without any posting."""
    none = F.coalesce(F.size("items"), F.lit(0)) <= 0
    return F.when(none & (F.col("kind") == "jsonld"), jsonld.SIGNAL_NONE).when(
        none & (F.col("kind") == "static-html"), cards.SIGNAL_NONE
    )


def unreadable_signal() -> Column:
    """The signal for a page with scripts that could not be read."""
    return F.when(F.col("unreadable") > 0, F.concat(F.lit(jsonld.SIGNAL_UNREADABLE), F.col("unreadable").cast("string")))


def explode_items(df: DataFrame, kinds: tuple[str, ...] = SOURCE_KINDS) -> DataFrame:
    """Raw postings of rows that carry ``items``.

    Built in stages so that no costly expression is written out twice. Rows with a parse
    error carry no items. The outer explode keeps Spark from deriving a filter on the items,
    which would parse every body a second time.
    """
    kind = F.col("kind")
    rows = df.select(
        "source_id", "run_id", "kind", "source_url", "company_name", F.posexplode_outer("items").alias("ordinal", "_item"),
        *(["page"] if "page" in df.columns else []),
    ).filter(F.col("ordinal").isNotNull())
    if "page" in df.columns:
        # Postings are numbered over all pages of their source.
        rows = rows.withColumn("ordinal", F.shiftleft((F.col("page") - 1).cast("bigint"), 32) + F.col("ordinal")).drop("page")
    texts = ("external_id", "url", "title", "department", "location_text", "employment_type", "html", "posted_text")
    rows = rows.withColumn("salary", F.lit(None).cast(SALARY)).withColumns({n: F.col("_item")[n] for n in texts})
    if "jsonld" in kinds:
        rows = rows.withColumn("_object", jsonld.jsonld_members(F.col("_item")["document"]))
        record = jsonld.jsonld_record(F.col("_object"))
        record["company_name"] = F.coalesce(record["company_name"], F.col("company_name"))
        embedded = kind == "jsonld"
        rows = rows.withColumns({n: F.when(embedded, c).otherwise(F.col(n)) for n, c in record.items()})
    linked = kind.isin("jsonld", *HTML_KINDS)
    rows = rows.withColumn("_link", F.when(linked, resolve_url(F.col("url"), F.col("source_url"))))
    own_link = F.when((kind == "jsonld") | ((kind == "playwright") & F.col("url").isNotNull()), F.col("_link"))
    # Rendered cards keep their text, static ones are normalized like any fragment.
    plain = F.col("_item")["plain"]
    plain = F.when(kind == "static-html", normalize_whitespace(plain)).otherwise(plain)
    rows = rows.withColumns({"_plain": plain, "_text": html_to_text(F.col("html"))})
    return rows.select(
        "source_id",
        "run_id",
        "ordinal",
        F.coalesce("external_id", own_link).alias("external_id"),
        F.coalesce("_link", "url", "source_url").alias("canonical_url"),
        "title",
        "company_name",
        "department",
        "location_text",
        "employment_type",
        F.coalesce(blank_to_null(F.col("_plain")), F.col("_text"), F.lit("")).alias("description_text"),
        F.struct(F.col("_item")["posted_num"].alias("num"), F.col("posted_text").alias("text")).cast(POSTED).alias("posted"),
        "salary",
    )


def parse_kind(df: DataFrame, kind: str) -> DataFrame:
    """Parse rows that are all of one kind."""
    return explode_items(with_items(df.withColumn("kind", F.lit(kind)), (kind,)), (kind,))


def parse_board_a(df: DataFrame) -> DataFrame:
    return parse_kind(df, "greenhouse")


def parse_board_b(df: DataFrame) -> DataFrame:
    return parse_kind(df, "lever")


def parse_board_c(df: DataFrame) -> DataFrame:
    return parse_kind(df, "ashby")


def parse_jsonld(df: DataFrame) -> DataFrame:
    return parse_kind(df, "jsonld")


def parse_html_cards(df: DataFrame, rendered: bool = False) -> DataFrame:
    return parse_kind(df, "playwright" if rendered else "static-html")


def parse_all(df: DataFrame, custom: Mapping[str, Parser] | None = None) -> DataFrame:
    """Raw postings of every response row.

    Built-in kinds share one scan and one explode. A custom parser takes over
    the rows of its kind and must return the raw posting columns.
    """
    custom = dict(custom or {})
    built_in = tuple(k for k in SOURCE_KINDS if k not in custom)
    parts = [explode_items(with_items(df.filter(F.col("kind").isin(*built_in)), built_in), built_in)]
    parts += [parser(df.filter(F.col("kind") == kind)) for kind, parser in custom.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
