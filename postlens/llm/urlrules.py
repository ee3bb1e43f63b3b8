"""URL filter: pattern rules filed under their rarest literal token, run only on URLs that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlens.llm.shared import lower_ascii

TOKEN = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
REGEX_SIGNS = "([\\\\.^$|?*+()\\[\\]{}])"

#: Fixed values: (action, host, path) of the production rules.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Patterns judged where no host rule fits: (action, literal, regular expression over host and path).
PATTERN_RULES = (
    ("block", "adserver", r"(^|\.)adserver\."),
    ("block", "doubleclick", r"(^|\.)doubleclick\."),
    ("block", "casino", r"(^|[./_-])casino([./_-]|$)"),
    ("block", "xxx", r"(^|[./_-])xxx([./_-]|$)"),
    ("block", "wp login", r"/wp-login\.php$"),
    ("block", "cgi bin", r"/cgi-bin/"),
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(rule_id, action, name, literal, pattern, named) of both kinds; a host rule's pattern is made of its text."""
    hosts = [(i, a, h, p, None, None) for i, (a, h, p) in enumerate(host_rules)]
    others = [(len(hosts) + i, a, None, None, t, p) for i, (a, t, p) in enumerate(pattern_rules)]
    names = ("rule_id", "action", "host", "path", "literal", "regex")
    listed = [F.struct(*[F.lit(v).cast("int" if n == "rule_id" else "string").alias(n) for n, v in zip(names, row)]) for row in hosts + others]
    raw = spark.range(1).select(F.inline(F.array(*listed)))
    quoted = lambda c: F.regexp_replace(c, REGEX_SIGNS, "\\\\$1")
    made = F.concat(F.lit("^([^/]*\\.)?"), quoted(F.col("host")), quoted(F.col("path")))
    return raw.select("rule_id", "action", F.concat("host", "path").alias("name"), F.coalesce("literal", F.concat_ws(" ", "host", "path")).alias("literal"), F.coalesce("regex", made).alias("pattern"), F.col("host").isNotNull().alias("named"))


def tokens_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN), 0))


def file_rules(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Add to each rule the token of its literal that fewest distinct targets hold; ties go to the first by text."""
    wanted = rules.select("rule_id", F.explode(tokens_of(F.col("literal"))).alias("token"))
    held = targets.select(F.explode(tokens_of(F.col("target"))).alias("token"), "n_rows")
    counts = held.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.sum("n_rows").alias("seen"))
    rarest = wanted.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)), "token"))["token"].alias("token"))
    return rules.join(rarest, "rule_id")


def judge_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per row: page_id, url, host, path, rule, verdict, pattern_rule.

    Among host rules that fit, the longest wins (ties: the smallest text); its text is `rule`. Where none fits,
    a pattern rule that matches decides (block before allow; `pattern_rule` is its id), else the verdict is allow.
    URLs are judged once for each distinct host and path. Null urls, and those without `://`, have an empty
    host and path and are allowed. Repeated rows stay. The rule list is an argument of fixed size, so it is
    broadcast; URLs never are."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    target = F.concat("host", "path")
    targets = rows.groupBy("host", "path").agg(F.count("*").alias("n_rows")).withColumn("target", target)
    filed = F.broadcast(file_rules(rules, targets))
    fetched = targets.select("host", "path", "target", F.explode(tokens_of(F.col("target"))).alias("token")).join(filed, "token")
    # The host part of a rule is compared with the lower-cased host; expressions run on fetched pairs only.
    fitting = fetched.where(F.regexp_like("target", F.col("pattern")) & (~F.col("named") | F.col("path").startswith("/")))
    own = F.when(F.col("named"), F.struct((-F.length("name")).alias("size"), F.col("name"), F.col("action")))
    other = F.when(~F.col("named"), F.struct((F.col("action") != "block").alias("mild"), F.col("rule_id"), F.col("action")))
    judged = fitting.groupBy("host", "path").agg(F.min(own).alias("own"), F.min(other).alias("other"))
    verdict = F.coalesce("own.action", "other.action", F.lit("allow"))
    joined = rows.join(judged, ["host", "path"], "left")
    return joined.select("page_id", "url", "host", "path", F.col("own.name").alias("rule"), verdict.alias("verdict"), F.col("other.rule_id").alias("pattern_rule"))
