"""Markup: allowed HTML, and text cut into code and prose."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALLOWED = {"p", "br", "b", "i", "em", "strong", "sup", "sub", "code", "pre", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "a", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "span", "div"}
ATTRIBUTES = {"a": {"href", "title"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}}
DROPPED = {"script", "style", "template", "iframe", "object"}


class _Clean(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in DROPPED
        if tag in ALLOWED and not self.silent:
            kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES.get(tag, ())]
            kept = [(k, v) for k, v in kept if k != "href" or re.match(r"(?:https?://|mailto:|[/#?]|[^:]*\Z)", v, re.I)]
            self.out.append(f"<{tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in kept)}>")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.silent = max(0, self.silent - 1)
        elif tag in ALLOWED and tag != "br" and not self.silent:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(escape(data, quote=False))


def sanitize(html: str) -> str:
    """HTML with allowed elements and attributes alone; scripts and the like go with their content."""
    parser = _Clean()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


@F.arrow_udf(T.StringType())
def sanitize_column(html: pa.Array) -> pa.Array:
    return pa.array([sanitize(x or "") for x in html.to_pylist()], pa.string())


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$\n?|\Z)", re.M | re.S)


def segments(text: str) -> list[tuple[str, str, str]]:
    """``(kind, language, text)``: fenced code apart from prose, in order."""
    out, at = [], 0
    for m in _FENCE.finditer(text):
        if m.start() > at:
            out.append(("text", "", text[at : m.start()]))
        out.append(("code", m[2].strip().split(" ")[0], m[3]))
        at = m.end()
    if at < len(text):
        out.append(("text", "", text[at:]))
    return out


def diff_line_class(line: Column) -> Column:
    """How a line of a unified difference is shown."""
    return F.when(F.startswith(line, F.lit("@@")), "diff-hunk").when(F.startswith(line, F.lit("+")), "diff-add").when(F.startswith(line, F.lit("-")), "diff-del").otherwise("diff-ctx")
