"""Posting cards picked from HTML by configured selectors.

The selector subset is: tag, ``*``, ``.class``, ``#id``, ``[attr]`` with the
operators ``= ~= ^= $= *=``, descendant and child combinators, and comma lists.
Anything else is an explicit error. Pages are handled one row at a time inside
Arrow batches; Spark does the partitioning.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions.html import DROPPED_ELEMENTS
from .items import item

SIGNAL_NONE = "required-selector-not-found"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {
    "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    **dict.fromkeys("p div ul ol table section article header footer h1 h2 h3 h4 h5 h6 form pre".split(), {"p"}),
}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, _Node):
                yield node
                stack.extend(reversed(node.children))

    def text(self, skip=frozenset()):
        parts, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in skip:
                stack.extend(reversed(node.children))
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _tree(html: str) -> _Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_ATOM = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]"""
)


def _compound(text: str):
    checks, at = [], 0
    while at < len(text):
        m = _ATOM.match(text, at)
        if not m:
            raise ValueError(f"unsupported selector: {text}")
        at = m.end()
        if m["tag"]:
            checks.append(("tag", m["tag"].lower(), ""))
        elif m["cls"]:
            checks.append(("~=", "class", m["cls"]))
        elif m["id"]:
            checks.append(("=", "id", m["id"]))
        else:
            checks.append((m["op"] or "has", m["attr"].lower(), m["dq"] or m["sq"] or m["bare"] or ""))
    return checks


_COMPILED: dict[str, list] = {}


def compile_selector(selector: str):
    """Alternatives of ``(combinator, checks)`` steps, right-most first."""
    if selector in _COMPILED:
        return _COMPILED[selector]
    alternatives = []
    for part in re.split(r",(?![^\[]*\])", selector):
        tokens = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip())
        if re.sub(r"\s", "", "".join(tokens)) != re.sub(r"\s", "", part):
            raise ValueError(f"unsupported selector: {selector}")
        steps, joint = [], " "
        for token in tokens:
            if token == ">":
                joint = ">"
            else:
                steps.append((joint, _compound(token)))
                joint = " "
        if not steps or joint == ">":
            raise ValueError(f"unsupported selector: {selector}")
        alternatives.append(list(reversed(steps)))
    if len(_COMPILED) > 1_000:
        _COMPILED.clear()
    _COMPILED[selector] = alternatives
    return alternatives


def _holds(node: _Node, checks) -> bool:
    for op, name, want in checks:
        if op == "tag":
            if name not in ("*", node.tag):
                return False
            continue
        have = node.attrs.get(name)
        ok = have is not None and (
            op == "has"
            or (op == "=" and have == want)
            or (op == "~=" and want in have.split())
            or (want != "" and op == "^=" and have.startswith(want))
            or (want != "" and op == "$=" and have.endswith(want))
            or (want != "" and op == "*=" and want in have)
        )
        if not ok:
            return False
    return True


def _chain(node: _Node, steps, at: int = 0) -> bool:
    if not _holds(node, steps[at][1]):
        return False
    if at + 1 == len(steps):
        return True
    above = node.parent
    if steps[at][0] == ">":
        return above is not None and _chain(above, steps, at + 1)
    while above is not None:
        if _chain(above, steps, at + 1):
            return True
        above = above.parent
    return False


def _matches(node: _Node, selector: str) -> bool:
    return any(_chain(node, steps) for steps in compile_selector(selector))


def _first(node: _Node, selector: str | None):
    if not selector:
        return None
    return next((n for n in node.walk() if _matches(n, selector)), None)


def _label(node: _Node | None) -> str | None:
    return (node.text().strip() or None) if node is not None else None


def _card(card: _Node, cfg: dict, rendered: bool) -> dict:
    link_selector = cfg.get("linkSelector") or "a"
    own_link = not rendered and _matches(card, link_selector)
    link = card if own_link else _first(card, link_selector)
    href = link.attrs.get("href") if link is not None else None
    names = ("data-job-id", "data-id", "id")
    keys = [card.attrs[n] for n in names if n in card.attrs and (card.attrs[n] or not rendered)]
    title = _label(_first(card, cfg["titleSelector"]))
    if title is None and _matches(card, cfg["titleSelector"]):
        title = _label(card)
    detail = cfg.get("detailDescriptionSelector")
    body = _first(card, detail) if detail else card
    skip = frozenset() if rendered else frozenset(DROPPED_ELEMENTS)
    time = _first(card, "time")
    return {
        "external_id": keys[0] if keys else (None if rendered else href),
        "url": href,
        "title": title or "",
        "department": _label(_first(card, cfg.get("departmentSelector"))),
        "location_text": _label(_first(card, cfg.get("locationSelector"))),
        "plain": body.text(skip) if body is not None else "",
        "posted_text": time.attrs.get("datetime") if time is not None else None,
    }


def page_cards(html: str, cfg: dict, rendered: bool) -> list[dict]:
    selector = cfg.get("listSelector")
    if not selector or not cfg.get("titleSelector"):
        return []
    found = []
    for node in _tree(html).walk():
        if _matches(node, selector):
            found.append(_card(node, cfg, rendered))
    return found


_CARD_FIELDS = ("external_id", "url", "title", "department", "location_text", "plain", "posted_text")
_CARDS = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in _CARD_FIELDS]))


@F.pandas_udf(_CARDS)
def _cards(pages: pd.DataFrame) -> pd.Series:
    out = []
    for html, cfg, rendered in zip(pages["html"], pages["config"], pages["rendered"]):
        out.append(None if html is None or cfg is None else page_cards(html, cfg, bool(rendered)))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _first_text(pages: pd.DataFrame) -> pd.Series:
    out = []
    for html, selector in zip(pages["html"], pages["selector"]):
        node = _first(_tree(html), selector) if html and selector else None
        out.append(None if node is None or not node.children else node.text(frozenset(DROPPED_ELEMENTS)))
    return pd.Series(out, dtype=object)


def card_items(body: Column, config: Column, rendered: Column) -> Column:
    """Cards of a page as posting items; NULL body gives NULL without leaving the JVM's batch."""
    plain_config = F.struct(
        *[config[n].alias(n) for n in (
            "listSelector", "titleSelector", "locationSelector", "linkSelector", "departmentSelector",
            "detailDescriptionSelector",
        )]
    )
    found = _cards(F.struct(body.alias("html"), plain_config.alias("config"), rendered.alias("rendered")))
    return F.transform(found, lambda c: item(**{n: c[n] for n in _CARD_FIELDS}))


def first_text(body: Column, selector: Column) -> Column:
    """Text of the first element a selector picks; NULL when it picks none or an empty one."""
    return _first_text(F.struct(body.alias("html"), selector.alias("selector")))
