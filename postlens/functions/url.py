"""URL functions: canonical form, reference resolution and host safety."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind, let, trim

# Query parameters that only track a visit, and hosts a feed must not point at.
TRACKING_PARAM = "(?i)^(?:utm_|fbclid|gclid|mc_cid|mc_eid|ref$|source$)"
LOCAL_NAMES = "^(?:localhost|.*\\.localhost|metadata\\.google\\.internal)$"
PRIVATE_IPV4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
PRIVATE_IPV6 = "^(?:::|::1|(?:fc|fd|fe8|fe9|fea|feb|ff).*|2001:db8:.*|::ffff:.*)$"

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_NUMBER = "(?:0[xX][0-9a-fA-F]*|[0-9]+)"
_NUMERIC_HOST = rf"^{_NUMBER}(?:\.{_NUMBER}){{0,3}}$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def _clean(c: Column) -> Column:
    return F.regexp_replace(trim(c), "[\\t\\n\\r]", "")


def _authority(url: Column) -> Column:
    scheme = F.lower(_part(url, 1))
    authority = _part(url, 2)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    host = (
        F.when(scheme == "http", F.regexp_replace(host, ":(?:80)?$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":(?:443)?$", ""))
        .otherwise(host)
    )
    return F.concat(user, host)


def _settle_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; an empty path is the root."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    trailing = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    settled = F.concat(F.lit("/"), F.array_join(kept, "/"), trailing)
    return F.when(path == "", F.lit("/")).when(path.contains("/."), settled).otherwise(path)


def _web(url: Column) -> Column:
    return url.rlike("(?i)^https?:") & (_part(url, 2) != "")


def canonical_url(c: Column) -> Column:
    """http(s) URL without fragment and tracking parameters, the rest sorted by name.

    Anything else gives NULL.
    """
    return let(_clean(c), _canonical)


def _canonical(url: Column) -> Column:
    pairs = F.filter(F.split(F.substring(_part(url, 4), F.lit(2), F.length(_part(url, 4))), "&"), lambda p: p != "")

    def recode(text: Column) -> tuple[Column, Column]:
        plain = F.coalesce(F.try_url_decode(text), text)
        return plain, F.url_encode(plain)

    def field(pair: Column, i: Column) -> Column:
        plain, name = recode(F.substring_index(pair, "=", 1))
        at = F.position(F.lit("="), pair)
        _, value = recode(F.when(at > 0, F.substring(pair, at + 1, F.char_length(pair))).otherwise(F.lit("")))
        return F.struct(plain.alias("name"), i.alias("i"), F.concat(name, F.lit("="), value).alias("text"))

    fields = F.filter(F.transform(pairs, field), lambda f: ~f["name"].rlike(TRACKING_PARAM))
    query = F.array_join(F.transform(F.array_sort(fields), lambda f: f["text"]), "&")
    base = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), _authority(url), _settle_path(F.translate(_part(url, 3), "\\", "/"))
    )
    has_query = _part(url, 4) != ""
    full = F.when(has_query & (query != ""), F.concat(base, F.lit("?"), query)).otherwise(base)
    return F.when(_web(url), full)


def _serialize(url: Column) -> Column:
    whole = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), _authority(url), _settle_path(_part(url, 3)), _part(url, 4), _part(url, 5)
    )
    return F.when(_web(url), whole).otherwise(url)


def resolve_url(href: Column, base: Column) -> Column:
    """A link resolved against the page it stands on; an empty link is the page itself."""

    def join(pair: Column) -> Column:
        base, link = pair["base"], pair["link"]
        root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
        path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))
        return (
            F.when(F.coalesce(link, F.lit("")) == "", base)
            .when(link.rlike(_SCHEME), link)
            .when(link.startswith("//"), F.concat(_part(base, 1), F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("?"), F.concat(root, path, link))
            .when(link.startswith("#"), F.concat(root, path, _part(base, 4), link))
            .otherwise(F.concat(root, F.regexp_replace(path, "[^/]*$", ""), link))
        )

    pair = F.struct(_clean(base).alias("base"), _clean(href).alias("link"))
    return let(let(pair, join), _serialize)


def _ipv4_number(host: Column) -> Column:
    """Numeric value of a host written as one to four decimal, octal or hex numbers."""

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike("^0[xX]"), F.conv(F.substring(part, 3, 20), 16, 10))
            .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
            .otherwise(part)
            .try_cast("bigint")
        )

    parts = F.transform(F.split(host, "\\."), number)
    size = F.size(parts)
    weighted = F.transform(
        parts, lambda v, i: F.when(i == size - 1, v).otherwise(v * F.pow(F.lit(256), 3 - i).cast("bigint"))
    )
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def _in_private_ipv4(value: Column) -> Column:
    hit = F.lit(False)
    for block in PRIVATE_IPV4:
        base, bits = block.split("/")
        low = sum(int(octet) << (24 - 8 * i) for i, octet in enumerate(base.split(".")))
        hit = hit | value.between(low, low + (1 << (32 - int(bits))) - 1)
    return hit


def url_safety(c: Column) -> Column:
    """``ok`` or why a feed URL is refused, judged from the text alone (no name lookup)."""
    return let(_clean(c), _safety)


def _safety(url: Column) -> Column:
    authority = _part(url, 2)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, "^\\[|\\]$", ""), "\\.$", "")
    return bind({"url": url, "scheme": _part(url, 1), "authority": authority, "host": host}, _judge)


def _judge(part: dict[str, Column]) -> Column:
    scheme, authority, host = part["scheme"], part["authority"], part["host"]
    parsed = part["url"].rlike(_SCHEME) & (scheme != "")
    private = let(_ipv4_number(host), _in_private_ipv4)
    return (
        F.when(~F.coalesce(parsed, F.lit(False)), "invalid-url")
        .when(~F.lower(scheme).isin("http", "https"), "blocked-protocol")
        .when(authority == "", "invalid-url")
        .when(authority.contains("@") & ~authority.rlike("^:?@"), "embedded-credentials")
        .when(host.rlike(LOCAL_NAMES), "local-hostname")
        .when(authority.contains("[") & host.rlike(PRIVATE_IPV6), "private-ip")
        .when(host.rlike(_NUMERIC_HOST) & F.coalesce(private, F.lit(False)), "private-ip")
        .otherwise("ok")
    )
