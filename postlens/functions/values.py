"""Dates, salaries and derived display values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ascii_regex, blank_to_null, trim

# Salary wording, currency signs and display labels.
SALARY_BY_CODE = (
    r"(?i)\b(USD|EUR|GBP|KRW|JPY|CAD|AUD)\s*[$€£₩¥]?\s*([\d,.]+)\s*(?:-|–|—|to)\s*[$€£₩¥]?\s*([\d,.]+)"
    r"(?:\s*(?:per|/)\s*(year|month|hour))?"
)
SALARY_BY_SIGN = (
    r"(?i)([$€£₩¥])\s*([\d,.]+)\s*(?:-|–|—|to)\s*[$€£₩¥]?\s*([\d,.]+)"
    r"(?:\s*(?:per|/)\s*(year|month|hour))?"
)
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₩": "KRW", "¥": "JPY"}
UNDISCLOSED = "미공개"
ELIGIBILITY_LABELS = {
    "yes": "한국 지원 가능",
    "likely": "한국 지원 유력",
    "unknown": "지원 지역 불명",
    "no": "한국 지원 어려움",
}
ASYNC_LABELS = {
    "explicit": "Async 명시",
    "strong": "Async 강함",
    "weak": "Async 신호",
    "synchronous": "동기식 위험",
    "unknown": "Async 불명",
}
SCOPE_LABELS = {
    "worldwide": "Worldwide",
    "apac": "APAC",
    "country-list": "국가 목록",
    "region-limited": "지역 제한",
    "unknown": "범위 불명",
}
EVIDENCE_LABELS = {
    "eligibleFromKorea": "한국 지원 가능성",
    "asyncLevel": "Async 적합도",
    "remoteScope": "Remote 범위",
    "timezoneOverlap": "시간대 중첩",
    "skills": "기술 스택",
    "roleFit": "직무 적합도",
    "salary": "급여 정보",
}
HEALTH_LABELS = {
    "active": "정상",
    "paused": "일시정지",
    "quarantined": "격리",
    "disabled": "비활성",
}
HEALTH_WARNING = "경고"
STALE_SECONDS = 12 * 3_600
RETRY_MINUTES = 720

_ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})$"
_DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss xx",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "yyyy/M/d",
    "M/d/yyyy",
)


def posted_at(number: Column, text: Column) -> Column:
    """Unix seconds from a number (seconds or milliseconds) or a date text, else NULL."""
    seconds = F.when(number > 10_000_000_000, number / 1_000).otherwise(number)
    from_number = F.when(~F.isnan(number) & (F.abs(number) < 1e18), seconds.cast("bigint"))
    value = blank_to_null(trim(text))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T00:00:00Z"))).when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
        F.when(value.rlike(_ZONE), value).otherwise(F.concat(value, F.lit("Z"))),
    )
    spoken = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    spoken = F.regexp_replace(spoken, r"\s(?:GMT|UTC|Z)$", " +0000")
    zoned = spoken.rlike(r"[+-]\d{4}$")
    parsed = [F.unix_seconds(F.try_to_timestamp(iso))]
    for fmt in _DATE_FORMATS:
        if fmt.endswith("xx"):
            parsed.append(F.when(zoned, F.unix_seconds(F.try_to_timestamp(spoken, F.lit(fmt)))))
        else:
            utc = F.try_to_timestamp(F.concat(spoken, F.lit(" +0000")), F.lit(fmt + " xx"))
            parsed.append(F.when(~zoned, F.unix_seconds(utc)))
    return F.coalesce(from_number, *parsed)


def _amount(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain == "", F.lit(0.0)).otherwise(plain.try_cast("double"))


def salary_from_text(text: Column) -> Column:
    """Currency, range and interval of the first salary range in a text, else NULL."""

    def read(pattern: str, currency) -> Column:
        rx = ascii_regex(pattern)
        lead = F.regexp_extract(text, rx, 1)
        found = F.struct(
            currency(lead).alias("currency"),
            _amount(F.regexp_extract(text, rx, 2)).alias("min"),
            _amount(F.regexp_extract(text, rx, 3)).alias("max"),
            F.lower(blank_to_null(F.regexp_extract(text, rx, 4))).alias("interval"),
        )
        return F.when(text.rlike(rx), found)

    signs = F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair])
    return F.coalesce(read(SALARY_BY_CODE, F.upper), read(SALARY_BY_SIGN, lambda s: F.element_at(signs, s)))


def _choose(c: Column, labels: dict[str, str], default: Column) -> Column:
    chosen = None
    for key, label in labels.items():
        chosen = F.when(c == key, label) if chosen is None else chosen.when(c == key, label)
    return chosen.otherwise(default)


def salary_text(currency: Column, low: Column, high: Column, interval: Column) -> Column:
    def grouped(c: Column) -> Column:
        return F.format_number(F.round(c, 0), 0)

    span = F.when(low.isNotNull() & high.isNotNull(), F.concat(grouped(low), F.lit("–"), grouped(high)))
    span = span.otherwise(grouped(F.coalesce(low, high)))
    tail = F.when(blank_to_null(interval).isNotNull(), F.concat(F.lit(" / "), interval)).otherwise("")
    text = trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), span, tail))
    return F.when(low.isNull() & high.isNull(), F.lit(UNDISCLOSED)).otherwise(text)


def relative_time(at: Column, now: Column) -> Column:
    """Distance to now as a unit and a signed count; far dates give the calendar date."""
    delta = (at - now).cast("double")
    size = F.abs(delta)

    def span(unit: str, seconds: int) -> Column:
        return F.struct(
            F.lit(unit).alias("unit"),
            F.floor(delta / seconds + 0.5).cast("bigint").alias("value"),
            F.lit(None).cast("string").alias("date"),
        )

    day = F.date_from_unix_date(F.floor(at / 86_400).cast("int")).cast("string")
    far = F.struct(F.lit("date").alias("unit"), F.lit(None).cast("bigint").alias("value"), day.alias("date"))
    none = F.struct(
        F.lit("unknown").alias("unit"), F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("date")
    )
    return (
        F.when(at.isNull() | (at == 0), none)
        .when(size < 60, span("second", 1))
        .when(size < 3_600, span("minute", 60))
        .when(size < 86_400, span("hour", 3_600))
        .when(size < 2_592_000, span("day", 86_400))
        .otherwise(far)
    )


def is_stale(next_due_at: Column, now: Column, after: int = STALE_SECONDS) -> Column:
    return (now - next_due_at) > after


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "mixed").otherwise("low")


def health_label(status: Column, failures: Column) -> Column:
    warned = (status == "active") & (F.coalesce(failures, F.lit(0)) != 0)
    return F.when(warned, HEALTH_WARNING).otherwise(_choose(status, HEALTH_LABELS, status))


def health_class(status: Column, failures: Column) -> Column:
    warned = (status == "active") & (F.coalesce(failures, F.lit(0)) != 0)
    return F.when(warned, "source-warning").otherwise(F.concat(F.lit("source-"), status))


def eligibility_label(c: Column) -> Column:
    return _choose(c, ELIGIBILITY_LABELS, c)


def async_label(c: Column) -> Column:
    return _choose(c, ASYNC_LABELS, c)


def scope_label(c: Column) -> Column:
    return _choose(c, SCOPE_LABELS, c)


def evidence_label(field: Column) -> Column:
    return _choose(field, EVIDENCE_LABELS, F.regexp_replace(field, "([a-z])([A-Z])", "$1 $2"))


def sort_evidence(evidence: Column) -> Column:
    """Highest effect first; equal effects keep their order."""
    keyed = F.transform(evidence, lambda e, i: F.struct((-e["effect"]).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def next_due(now: Column, interval_minutes: Column) -> Column:
    return now + interval_minutes.cast("bigint") * 60


def retry_at(now: Column, interval_minutes: Column) -> Column:
    return now + F.greatest(interval_minutes.cast("bigint"), F.lit(RETRY_MINUTES).cast("bigint")) * 60


def http_status_from_error(message: Column) -> Column:
    return F.regexp_extract(message, "HTTP\\s+(\\d{3})", 1).try_cast("int")
