"""Contract checks: each row gets the list of its violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, trim
from ..schemas import (
    ACTIONS,
    ASYNC_LEVELS,
    BOARD_KINDS,
    BROWSER_KIND,
    CONFIG_TEXTS,
    ELIGIBILITIES,
    EVIDENCE_SOURCES,
    HTML_KINDS,
    OBSERVATION_STATUSES,
    SCOPES,
    SOURCE_KINDS,
    WORKPLACES,
)

# Patterns and header names of the contracts.
HEX64 = "^[a-f0-9]{64}$"
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
HTTP_URL = "(?i)^https?://[^\\s/?#]+"
ANY_URL = "(?i)^[a-z][a-z0-9+.-]*:[^\\s]+$"
HEADER_NAME = "^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"
FORBIDDEN_HEADERS = (
    "authorization",
    "cookie",
    "proxy-authorization",
    "host",
    "connection",
    "content-length",
    "transfer-encoding",
    "cf-access-client-id",
    "cf-access-client-secret",
    "x-forwarded-for",
    "x-forwarded-host",
    "x-forwarded-proto",
)


@dataclass(frozen=True)
class Rule:
    """A violation name and the condition under which a row violates it."""

    name: str
    broken: Column


def _text(name: str, low: int, high: int, nullable: bool = False) -> list[Rule]:
    c = F.col(name)
    length = F.char_length(c)
    rules = [Rule(f"{name}:length", ~length.between(low, high))]
    return rules if nullable else [Rule(f"{name}:missing", c.isNull()), *rules]


def _enum(name: str, values) -> list[Rule]:
    return [Rule(f"{name}:enum", F.col(name).isNull() | ~F.col(name).isin(*values))]


def _range(name: str, low=None, high=None, nullable: bool = False) -> list[Rule]:
    c, broken = F.col(name), F.lit(False)
    if low is not None:
        broken = broken | (c < low)
    if high is not None:
        broken = broken | (c > high)
    rules = [Rule(f"{name}:range", broken)]
    return rules if nullable else [Rule(f"{name}:missing", c.isNull()), *rules]


def _pattern(name: str, pattern: str, nullable: bool = False) -> list[Rule]:
    rules = [Rule(f"{name}:pattern", ~F.col(name).rlike(pattern))]
    return rules if nullable else [Rule(f"{name}:missing", F.col(name).isNull()), *rules]


def posting_contract() -> list[Rule]:
    evidence = F.exists(
        "evidence",
        lambda e: ~F.char_length(e["field"]).between(1, 80)
        | ~e["effect"].between(-100, 100)
        | ~F.char_length(e["text"]).between(1, 500)
        | ~e["source"].isin(*EVIDENCE_SOURCES),
    )
    return [
        *_text("external_id", 1, 300),
        *_text("canonical_url", 1, 2_000),
        *_pattern("canonical_url", ANY_URL, True),
        *_text("title", 1, 500),
        *_text("company_name", 1, 300),
        *_text("department", 0, 300, True),
        *_text("location_text", 0, 500, True),
        *_text("employment_type", 0, 120, True),
        *_text("description_text", 0, 48_000),
        *_text("search_text", 0, 12_000),
        Rule("skills:size", F.col("skills").isNull() | (F.size("skills") > 40)),
        Rule("skills:length", F.exists("skills", lambda s: F.char_length(s) > 100)),
        *_enum("workplace_type", WORKPLACES),
        *_enum("remote_scope", SCOPES),
        *_enum("eligible_from_korea", ELIGIBILITIES),
        *_enum("async_level", ASYNC_LEVELS),
        *_text("required_timezone", 0, 80, True),
        *_range("required_overlap_hours", 0, 24, True),
        *_text("salary_currency", 0, 10, True),
        *_range("salary_min", 0, None, True),
        *_range("salary_max", 0, None, True),
        *_text("salary_interval", 0, 30, True),
        *_range("posted_at", 1, None, True),
        *_range("score", 0, 100),
        *_range("confidence", 0, 1),
        Rule("evidence:size", F.col("evidence").isNull() | (F.size("evidence") > 12)),
        Rule("evidence:item", evidence),
        *_pattern("content_hash", HEX64),
    ]


def observation_contract() -> list[Rule]:
    counts = ("fetched_job_count", "previous_job_count", "received_batch_count", "expected_batch_count")
    return [
        *_text("run_id", 1, 200),
        *_text("source_id", 1, 200),
        *_enum("status", OBSERVATION_STATUSES),
        *_range("http_status", 0, 599, True),
        *[rule for name in counts for rule in _range(name, 0)],
        *_text("response_hash", 0, 128, True),
        *_pattern("content_fingerprint", HEX64, True),
        *_text("etag", 0, 1_000, True),
        *_text("last_modified", 0, 1_000, True),
        *_text("error_code", 0, 100, True),
        *_text("error_message", 0, 2_000, True),
        Rule("signals:size", F.size("signals") > 20),
        Rule("signals:length", F.exists("signals", lambda s: F.char_length(s) > 300)),
    ]


def action_contract() -> list[Rule]:
    return [
        *_enum("action", ACTIONS),
        *_text("dismiss_reason", 0, 500, True),
        *_text("notes", 0, 5_000, True),
        *_range("applied_at", 1, None, True),
    ]


def company_contract() -> list[Rule]:
    return [
        *_text("name", 1, 300),
        *_text("slug", 1, 200),
        *_pattern("slug", SLUG, True),
        *_text("careers_url", 1, 2_000, True),
        *_pattern("careers_url", HTTP_URL, True),
        *_text("remote_policy_url", 1, 2_000, True),
        *_pattern("remote_policy_url", HTTP_URL, True),
        *_range("priority", 0, 100),
    ]


def source_contract() -> list[Rule]:
    """Rules of a source row whose ``config`` is the typed configuration struct."""
    config = F.col("config")
    names = F.map_keys(config["headers"])
    values = F.map_values(config["headers"])
    kind = F.col("kind")
    selectors = blank_to_null(config["listSelector"]).isNull() | blank_to_null(config["titleSelector"]).isNull()
    bad_name = F.exists(names, lambda n: ~F.char_length(n).between(1, 100) | ~n.rlike(HEADER_NAME))
    bad_value = F.exists(values, lambda v: (F.char_length(v) > 2_000) | v.rlike("[\\r\\n]"))
    return [
        *_text("company_id", 1, 200),
        *_enum("kind", SOURCE_KINDS),
        *_text("url", 1, 2_000),
        *_pattern("url", HTTP_URL, True),
        *_text("adapter_key", 0, 500, True),
        *_range("crawl_interval_minutes", 30, 43_200),
        *[Rule(f"config.{n}:length", F.char_length(config[n]) > 500) for n in CONFIG_TEXTS],
        Rule("config.headers:name", bad_name),
        Rule("config.headers:value", bad_value),
        Rule("config.headers:forbidden", F.exists(names, lambda n: F.lower(n).isin(*FORBIDDEN_HEADERS))),
        Rule("ADAPTER_KEY_REQUIRED", kind.isin(*BOARD_KINDS) & blank_to_null(trim(F.col("adapter_key"))).isNull()),
        Rule("SELECTORS_REQUIRED", kind.isin(*HTML_KINDS) & selectors),
        Rule("BROWSER_KIND_REQUIRED", F.col("browser_required") & (kind != BROWSER_KIND)),
    ]


def with_errors(df: DataFrame, contract: list[Rule]) -> DataFrame:
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(r.broken, r.name) for r in contract])))


def validate(df: DataFrame, contract: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that hold the contract and rejects with their ``errors``."""
    checked = with_errors(df, contract)
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    return valid, checked.filter(F.size("errors") > 0)


def validate_sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, source_contract())
