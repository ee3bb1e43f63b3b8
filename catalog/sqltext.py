"""SQL fragments for text semantics, written for DuckDB."""

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def trim(c: str) -> str:
    return f"trim({c}, {_TRIM})"


def clean(c: str) -> str:
    return trim(
        f"regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[\\t\\r ]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    )


def fold(c: str) -> str:
    return f"translate(lower({clean(c)}), '‐‑‒–—', '-----')"


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, {n - 1}), {_TRIM}) || '…' END"


def snippet(original: str, lowered: str, needle: str) -> str:
    hit = f"strpos({lowered}, lower({needle}))"
    start = f"greatest(1, {hit} - 120)"
    piece = clean(f"substr({original}, {start}, {hit} + length({needle}) + 120 - {start})")
    return f"CASE WHEN {hit} > 0 THEN {piece} ELSE {cut(clean(original), 240)} END"


def any_of(c: str, patterns) -> str:
    return f"regexp_matches({c}, '(?:{'|'.join(patterns)})')"


def first_of(c: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p}'), '')" for p in patterns) + ")"


def contained(c: str, terms) -> str:
    items = ", ".join(f"CASE WHEN contains({c}, '{t}') THEN '{label}' END" for t, label in terms)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"
