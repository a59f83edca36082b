"""The pictures that a text refers to, and whether two texts show the same ones.

A reference is an ``image://`` address inside Markdown (``![caption](address)``) or an ``img`` tag. It is
read into what matters: the picture's stem, its size query and its caption. Conversion gives a picture
another ending (and may append one), so endings of formats that are converted don't count; other
endings, sizes and telling captions do. A caption that is empty or repeats the picture's name tells nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEME = "image://"
#: Fixed value: the formats that conversion turns into one another.
CONVERTED = {"emf", "wmf", "pcz", "png"}


class Reference(NamedTuple):
    markup: str  #: ``link`` or ``tag``
    stem: str
    query: str
    caption: str  #: empty if it tells nothing


def stem(name: str) -> str:
    """A picture's name up to the endings that conversion gives or takes."""
    parts = name.split(".")
    while len(parts) > 1 and parts[-1].lower() in CONVERTED:
        del parts[-1]
    return ".".join(parts)


def _spellings(name: str) -> tuple[str, str, str]:
    head, dot, ending = name.rpartition(".")
    return name, stem(name), head if dot and "/" not in ending else name


def _reference(markup: str, address: str, caption: str) -> Reference:
    name, mark, size = address.partition("?")
    silent = any(a == b for a, b in zip(_spellings(caption), _spellings(name), strict=True))
    return Reference(markup, stem(name), mark + size, "" if silent else caption)


class _Attributes(HTMLParser):
    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found = dict(reversed(attrs)) if tag == "img" else {}

    handle_startendtag = handle_starttag


def _link(text: str, at: int) -> tuple[int, int, Reference] | None:
    """The Markdown picture whose address begins at a place."""
    close, low = text.find(")", at), text.rfind("]", 0, max(0, at - 2)) + 1
    begin = text.find("![", low, at)
    address = text[at + len(SCHEME) : close]
    name = address.partition("?")[0]
    if close < 0 or begin < 0 or text[at - 2 : at] != "](" or not name or any(c.isspace() for c in name):
        return None
    return begin, close + 1, _reference("link", address, text[begin + 2 : at - 2])


def _tag(text: str, at: int) -> tuple[int, int, Reference] | None:
    """The ``img`` tag around a place, if its source is the address there."""
    begin, close = text.rfind("<", 0, at), text.find(">", at)
    if begin < 0 or close < 0 or ">" in text[begin:at]:
        return None
    reader = _Attributes()
    reader.found = {}
    reader.feed(text[begin : close + 1])
    address = (reader.found.get("src") or "").removeprefix(SCHEME)
    if not address or not text.startswith(address, at + len(SCHEME)):
        return None
    return begin, close + 1, _reference("tag", address, reader.found.get("alt") or "")


def references(text: str) -> Iterator[tuple[int, int, Reference]]:
    """Begin, end and content of each reference, in reading order."""
    at = done = 0
    while (at := text.find(SCHEME, at)) >= 0:
        found = _link(text, at) or _tag(text, at)
        if found and found[0] >= done:
            yield found
            at = done = found[1]
        else:
            at += len(SCHEME)


def shown(text: str) -> str:
    """A key that texts share if they differ in nothing but the spelling of their pictures."""
    out, done = [], 0
    for begin, end, reference in references(text):
        out += [text[done:begin], "\x1e", "\x1f".join(reference), "\x1e"]
        done = end
    return "".join(out) + text[done:]


@F.arrow_udf(T.StringType())
def shown_column(text: pa.Array) -> pa.Array:
    """``shown`` of a column; null counts as empty."""
    return pa.array([shown(x or "") for x in text.to_pylist()], pa.string())


def pictures(df: DataFrame, text: str, out: str = "picture") -> DataFrame:
    """A row for each reference in a text column: ``out`` has its ``position`` among them and its parts."""
    fields = [("position", pa.int32()), *((n, pa.string()) for n in Reference._fields)]

    @F.arrow_udf("array<struct<position:int," + ",".join(f"{n}:string" for n in Reference._fields) + ">>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[{"position": k} | r._asdict() for k, (_, _, r) in enumerate(references(x or ""))] for x in texts.to_pylist()], pa.list_(pa.struct(fields)))

    # Only texts with pictures go through Python.
    return df.where(F.contains(F.col(text), F.lit(SCHEME))).withColumn(out, F.explode(found(F.col(text))))
