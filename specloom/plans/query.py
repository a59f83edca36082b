"""Search queries as a typed tree.

Words stand side by side for "all of them"; ``AND``, ``OR`` and ``NOT`` in capitals are operators where
they have an operand on either side, and words elsewhere. ``-word`` after an operand excludes,
``"..."`` is a phrase, a last ``*`` asks for a prefix, a first ``^`` for the field's beginning,
``field:`` for one field, and ``NEAR(a b, n)`` for operands at most n tokens apart. Side by side binds
tightest, then NOT, AND and OR, each from the left. Parentheses and all other marks are plain text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

OPERATORS = ("OR", "AND", "NOT")


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens of ``text``."""

    text: str
    prefix: bool = False
    anchored: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class All:
    """Operands side by side; those without any token are passed over."""

    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    left: Node
    right: Node


Node = Phrase | Near | All | Op

_ITEM = re.compile(
    r"""[ \t\n]+
    | (?P<phrase> "(?P<inner>[^"]*) (?:"(?P<star>\*)?|\Z) )
    | (?P<word> (?: [^ \t\n"] | "[^"]*(?:"|\Z) )+ )""",
    re.X,
)


def _word(text: str, fields: frozenset[str]) -> Phrase:
    name, colon, value = text.partition(":")
    field = None
    if colon and value and name.lower() in fields:
        field, text = name.lower(), value
        if value.startswith('"'):
            inner = value[:-1] if value.endswith("*") else value
            closed = len(inner) >= 2 and inner.endswith('"')
            return Phrase(value.strip('"*') if closed else value.strip('"'), closed and value.endswith("*"), False, field)
    anchored = len(text) > 1 and text[0] == "^" and text[1] != "^"
    text = text[1:] if anchored else text
    prefix = len(text) > 1 and text[-1] == "*" and text[-2] != "*"
    return Phrase(text[:-1] if prefix else text, prefix, anchored, field)


def _near(query: str, at: int) -> tuple[Node, int]:
    """The group that opens at ``at``, and where it ends; a group without an operand is plain text."""
    depth, end = 1, at + len("NEAR(")
    while end < len(query) and depth:
        depth += {"(": 1, ")": -1}.get(query[end], 0)
        end += 1
    inner = query[at + len("NEAR(") : end - (depth == 0)] + ")" * max(0, depth - 1)
    if not any(c == '"' or c.isalpha() or c.isdigit() for c in inner):
        return Phrase(query[at:end]), end
    distance = 10
    if last := re.search(r",\s*([0-9]+)\s*\Z", inner):
        inner, distance = inner[: last.start()], int(last[1])
    phrases = []
    for item in re.finditer(r'"([^"]*)(?:"(\*)?|\Z)|[^ \t\n"]+', inner):
        if item[1] is not None:
            phrases.append(Phrase(item[1], item[2] is not None))
        else:
            word = _word(item[0], frozenset())
            phrases.append(Phrase(("^" if word.anchored else "") + word.text, word.prefix))
    return Near(tuple(phrases), distance), end


def parse(query: str, fields: Iterable[str]) -> Node | None:
    """The tree of a query; null for a blank one."""
    fields = frozenset(fields)
    items: list[Node | str] = []
    operand_before = lambda: bool(items) and not isinstance(items[-1], str)
    at = 0
    while at < len(query):
        if query.startswith("NEAR(", at):
            near, at = _near(query, at)
            items.append(near)
            continue
        item = _ITEM.match(query, at)
        at = item.end()
        if item["phrase"] is not None:
            items.append(Phrase(item["inner"], item["star"] is not None))
        elif (word := item["word"]) is not None:
            if word in OPERATORS and operand_before():
                items.append(word)
            elif word in OPERATORS:
                items.append(Phrase(word))
            elif word[0] == "-" and len(word) > 1 and operand_before():
                items += ["NOT", _word(word[1:], fields)]
            else:
                items.append(_word(word, fields))
    if items and isinstance(items[-1], str):
        items[-1] = Phrase(items[-1])
    return _tree(items) if items else None


def _tree(items: list[Node | str]) -> Node:
    for kind in OPERATORS:
        # The last operator of the loosest kind present: from the left within a kind.
        for k in range(len(items) - 1, -1, -1):
            if items[k] == kind:
                return Op(kind, _tree(items[:k]), _tree(items[k + 1 :]))
    return items[0] if len(items) == 1 else All(tuple(items))


def phrases(node: Node) -> list[Phrase | Near]:
    """The leaves from left to right."""
    if isinstance(node, Phrase | Near):
        return [node]
    parts = node.parts if isinstance(node, All) else (node.left, node.right)
    return [leaf for part in parts for leaf in phrases(part)]


def to_match(node: Node) -> str:
    """The tree in the match syntax of SQLite's FTS5, for comparison in tests."""
    quote = lambda p: (f"{p.field} : " if p.field else "") + ("^" if p.anchored else "") + '"' + p.text.replace('"', '""') + '"' + ("*" if p.prefix else "")
    if isinstance(node, Phrase):
        return quote(node)
    if isinstance(node, Near):
        return f"NEAR({' '.join(map(quote, node.phrases))}, {node.distance})"
    if isinstance(node, All):
        return " ".join(map(to_match, node.parts))
    return f"{to_match(node.left)} {node.kind} {to_match(node.right)}"


def single_term(node: Node | None) -> str | None:
    """The text of a query that is one bare word, by which names are ranked."""
    return node.text if isinstance(node, Phrase) and not node.field and " " not in node.text else None


def tokenised(node: Node, tokens: Callable[[str], list[str]]) -> Node | None:
    """The tree without operands that hold no token: passed over side by side, nothing else's match."""
    if isinstance(node, Phrase):
        return node if tokens(node.text) else None
    if isinstance(node, Near):
        kept = tuple(p for p in node.phrases if tokens(p.text))
        return Near(kept, node.distance) if kept else None
    if isinstance(node, All):
        kept = [n for p in node.parts if (n := tokenised(p, tokens)) is not None]
        return None if not kept else kept[0] if len(kept) == 1 else All(tuple(kept))
    left, right = tokenised(node.left, tokens), tokenised(node.right, tokens)
    if node.kind == "OR":
        return left if right is None else right if left is None else Op("OR", left, right)
    if node.kind == "NOT":
        return None if left is None else left if right is None else Op("NOT", left, right)
    return None if left is None or right is None else Op("AND", left, right)
