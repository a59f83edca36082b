"""Citations of other documents found in running text.

Text is first cut into marks: designators (``TS 23.501``), ``RFC`` numbers, bracketed numbers, clause
words, clause numbers, conjunctions and prepositions. Two marks are neighbours if nothing but spaces
and at most one line end lies between them (no-break spaces and degree signs are spaces): a citation
never crosses a blank line. Citations are then sequences of marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

#: The spaces of the corpus, and the forms of numbers and words that citations are made of.
SPACE = "[ \t\f °]"
CLAUSE_NUMBER = r"(?:[A-Z](?:\.\d+[A-Za-z]?)*|\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*)"
DOCUMENT_NUMBER = r"\d+\.\d+(?:-\d{1,2}\b)?"
CLAUSE_WORDS = r"(?:[Cc]lauses?|[Ss]ubclauses?|[Ss]ections?|[Aa]nnexe?s?)"
GAP = rf"(?:{SPACE}+(?:(?:\r\n?|\n){SPACE}*)?|(?:\r\n?|\n){SPACE}*)"

_MARK = re.compile(
    rf"""(?P<spec> \b(?:3GPP{GAP}?)?(?P<type>TS|TR){GAP}?(?P<number>{DOCUMENT_NUMBER}) )
    | (?P<rfc> (?:IETF{GAP})?RFC{GAP}(?P<rfc_number>\d+) )
    | (?P<bracket> \[(?P<ref>\d+[A-Za-z]*)\] )
    | (?P<word> {CLAUSE_WORDS}(?={GAP}) )
    | (?P<join> \b(?:and|or)\b | , )
    | (?P<in> \b(?:of|in)\b )
    | (?P<clause> (?<![\w.]){CLAUSE_NUMBER}(?![A-Za-z]) )""",
    re.X | re.ASCII,
)
_GAP = re.compile(rf"{GAP}?\Z")
_PUNCTUATED = re.compile(rf"(?:{SPACE}*(?:(?:\r\n?|\n){SPACE}*)?[,;]?{SPACE}*|{SPACE}*[,;]?{SPACE}*(?:\r\n?|\n){SPACE}*)\Z")


@dataclass(frozen=True)
class Mark:
    kind: str
    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Citation:
    spec: str
    section: str
    start: int
    end: int


def marks(text: str) -> list[Mark]:
    """The marks of a text from left to right."""
    out = []
    for m in _MARK.finditer(text):
        kind = next(k for k in ("spec", "rfc", "bracket", "word", "join", "in", "clause") if m[k] is not None)
        value = f"{m['type']} {m['number']}" if kind == "spec" else f"RFC {m['rfc_number']}" if kind == "rfc" else m["ref"] if kind == "bracket" else m[0]
        out.append(Mark(kind, value, m.start(), m.end()))
    return out


def bracket_map(text: str) -> dict[str, str]:
    """What bracketed numbers stand for in a list of references; the last entry of a number counts."""
    found = marks(text)
    return {a.text: b.text for a, b in zip(found, found[1:], strict=False) if a.kind == "bracket" and b.kind == "spec" and b.start > a.end and _GAP.match(text[a.end : b.start])}


class _Reader:
    """Sequences of neighbouring marks."""

    def __init__(self, text: str):
        self.text, self.marks = text, marks(text)

    def near(self, k: int, punctuated: bool = False) -> bool:
        """Whether mark k follows mark k - 1 without other text between them."""
        if not 0 < k < len(self.marks):
            return False
        between = self.text[self.marks[k - 1].end : self.marks[k].start]
        return bool((_PUNCTUATED if punctuated else _GAP).match(between))

    def is_(self, k: int, kind: str) -> bool:
        return 0 <= k < len(self.marks) and self.marks[k].kind == kind

    def clause_list(self, k: int) -> tuple[list[Mark], int]:
        """Clause numbers joined by commas and conjunctions from mark k on, each with its own clause word
        and preposition or without; and the mark after them."""
        out: list[Mark] = []
        if not self.is_(k, "clause"):
            return out, k
        out.append(self.marks[k])
        k += 1
        while True:
            j = k
            while self.is_(j, "join") and self.near(j):
                j += 1
            if j == k:
                return out, k
            if self.is_(j, "in") and self.near(j) and self.is_(j + 1, "word") and self.near(j + 1):
                j += 1
            if self.is_(j, "word") and self.near(j):
                j += 1
            if not (self.is_(j, "clause") and self.near(j)):
                return out, k
            out.append(self.marks[j])
            k = j + 1


def _lists_before(r: _Reader) -> Iterator[tuple[str, list[Mark], int, int]]:
    """``clauses 8.2 and 16.11 of TS 23.402``."""
    k = 0
    while k < len(r.marks):
        if r.is_(k, "word") and r.near(k + 1):
            found, j = r.clause_list(k + 1)
            if found and r.is_(j, "in") and r.near(j) and r.is_(j + 1, "spec") and r.near(j + 1):
                yield r.marks[j + 1].text, found, r.marks[k].start, r.marks[j + 1].end
                k = j + 1
                continue
        k += 1


def _lists_after(r: _Reader) -> Iterator[tuple[str, list[Mark], int, int]]:
    """``TS 23.402 clauses 8.2 and 16.11``, ``RFC 3261, section 4``, ``[19] clause 6``."""
    for k, mark in enumerate(r.marks):
        if mark.kind not in ("spec", "rfc", "bracket"):
            continue
        j = k + 1
        comma = r.is_(j, "join") and r.marks[j].text == "," and r.near(j)
        j += comma
        if r.is_(j, "word") and (r.near(j) if comma else r.near(j, punctuated=True)) and r.near(j + 1):
            found, after = r.clause_list(j + 1)
            if found:
                yield mark.text if mark.kind != "bracket" else f"[{mark.text}]", found, mark.start, r.marks[after - 1].end
                continue
        if mark.kind != "bracket":
            yield mark.text, [], mark.start, mark.end


def citations(text: str, brackets: Mapping[str, str] | None = None, own: str | None = None) -> list[Citation]:
    """Every distinct citation of a text, lists first, then single clauses, then whole documents' mentions.

    A designator at the end of a list counts as a mention of the whole document besides. Citations of
    ``own`` are left out, as are bracketed numbers that ``brackets`` doesn't know.
    """
    r, out, seen = _Reader(text), [], set()
    before, after = list(_lists_before(r)), list(_lists_after(r))

    def add(spec: str, section: str, start: int, end: int) -> None:
        if spec.startswith("["):
            spec = (brackets or {}).get(spec[1:-1], "")
        if spec and spec != own and (spec, section) not in seen:
            seen.add((spec, section))
            out.append(Citation(spec, section, start, end))

    for many in (True, False):
        for spec, found, start, end in before:
            if (len(found) > 1) == many:
                for mark in found:
                    add(spec, mark.text, start, end)
        if many:
            for spec, found, start, end in after:
                if len(found) > 1 and not spec.startswith("["):
                    for mark in found:
                        add(spec, mark.text, start, end)
    for kind in ("T", "R", "["):
        for spec, found, start, end in after:
            if spec.startswith("RFC" if kind == "R" else kind) and (kind != "T" or not spec.startswith("RFC")):
                add(spec, found[0].text if found else "", start, found[0].end if found else end)
    return out


def context(text: str, start: int, end: int, window: int = 50) -> str:
    """The match with up to ``window`` bytes on either side, cut at spaces, and dots where text is left out."""
    left, match, right = text[:start].encode(), text[start:end], text[end:].encode()
    a, b = left[-window:] if len(left) > window else left, right[:window]
    if len(left) > window:
        space = a.find(b" ")
        a = a[space + 1 :] if space >= 0 else a
    if len(right) > window:
        space = b.rfind(b" ")
        b = b[:space] if space >= 0 else b
    shown = (a.decode(errors="ignore"), b.decode(errors="ignore"))
    return ("..." if len(a) < len(left) else "") + shown[0] + match + shown[1] + ("..." if len(b) < len(right) else "")


_CODE = re.compile(r"^(```|~~~)[^\n]*\n.*?(?:^\1[^\n]*$|\Z)|(`+)(?!`).+?(?<!`)\2(?!`)|!?\[[^\]\n]*\]\([^)\n]*\)|<a\b.*?</a>", re.M | re.S)
_OWN = re.compile(rf"\b(?P<word>{CLAUSE_WORDS}){GAP}(?P<clause>{CLAUSE_NUMBER})", re.ASCII)


def linkify(text: str, url, exists, own: str | None = None, brackets: Mapping[str, str] | None = None) -> str:
    """Citations as Markdown links; code and existing links stay as they are.

    Of citations that overlap, the first and then the longest wins. ``url(spec, section)`` gives the
    address; where ``exists(spec, section)`` is false the text is marked as unresolved instead. Clause
    words that no document qualifies cite ``own``, if it has that clause.
    """
    closed = [m.span() for m in _CODE.finditer(text)]
    found = [c for c in _all_spans(text, brackets)]
    if own is not None:
        qualified = [(c.start, c.end) for c in found]
        for m in _OWN.finditer(text):
            free = not any(a < m.end() and m.start() < b for a, b in qualified)
            tail = re.match(rf"{GAP}(?:of|in){GAP}(?!(?:the{GAP}present|this){GAP}(?:document|specification))", text[m.end() :])
            if free and not tail and exists(own, m["clause"]):
                found.append(Citation(own, m["clause"], m.start(), m.end()))
    found = [c for c in found if not any(a < c.end and c.start < b for a, b in closed)]
    out, at = [], 0
    for c in sorted(found, key=lambda c: (c.start, c.start - c.end)):
        if c.start >= at:
            shown = text[c.start : c.end]
            out += [text[at : c.start], f"[{shown}]({url(c.spec, c.section)})" if not c.section or exists(c.spec, c.section) else f"{shown} (unresolved)"]
            at = c.end
    return "".join(out) + text[at:]


def _all_spans(text: str, brackets: Mapping[str, str] | None) -> Iterator[Citation]:
    r = _Reader(text)
    for spec, found, start, end in [*_lists_before(r), *_lists_after(r)]:
        if spec.startswith("["):
            spec = (brackets or {}).get(spec[1:-1], "")
        if not spec:
            continue
        if len(found) < 2:
            yield Citation(spec, found[0].text if found else "", start, end)
        else:
            # In a list each number is a link of its own.
            for mark in found:
                yield Citation(spec, mark.text, mark.start, mark.end)
