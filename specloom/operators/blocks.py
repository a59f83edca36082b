"""Examples of protocols and markup languages inside running text, told by how their lines are built.

Each format says where a block of it opens and where it ends; a text is read from the top, and the first
format that opens at a line takes the lines up to its end. Lines are read as words, and words are looked
up in the names that the formats' public specifications register, so that prose about a protocol stays prose.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Methods, versions and address schemes of SIP (RFC 3261 and its extensions) and RTSP (RFC 2326).
SIP_METHODS = frozenset("ACK BYE CANCEL INFO INVITE MESSAGE NOTIFY OPTIONS PRACK PUBLISH REFER REGISTER SUBSCRIBE UPDATE".split())
RTSP_METHODS = frozenset("ANNOUNCE DESCRIBE GET_PARAMETER OPTIONS PAUSE PLAY RECORD REDIRECT SETUP SET_PARAMETER TEARDOWN".split())
METHODS = SIP_METHODS | RTSP_METHODS
VERSIONS = frozenset(("SIP/2.0", "RTSP/1.0", "RTSP/1.1"))
SCHEMES = frozenset(("sip", "sips", "tel", "rtsp", "rtspu"))
#: Registered header fields of SIP whose names have no hyphen, in lower case.
SIP_FIELDS = frozenset(
    "accept allow authorization contact cseq date encryption event expires from geolocation hide identity join organization path"
    " priority privacy rack reason replaces require route rseq server subject supported timestamp to unsupported via warning".split()
)
#: Fixed value: the types of SDP lines, in the order of RFC 4566.
SDP_TYPES = frozenset("vosiuepcbtrzkam")
#: Declarations of a document type.
DECLARATIONS = ("<!element", "<!attlist", "<!entity", "<!notation")
#: What a text with a block in it has somewhere.
CUES = ("ASN1START", "::=", "SIP/2.0", "RTSP/1.", "sip", "tel:", "rtsp", "=", "<", "$")


def _plain(line: str) -> str:
    return line.replace("\u00a0", " ").strip()


def _unlabelled(line: str) -> str:
    """A line without an example's label or a list's dash before it."""
    head, colon, rest = line.partition(":")
    words = head.lower().split()
    if colon and words[:1] == ["example"] and (len(words) == 1 or len(words) == 2 and words[1].isdigit()):
        return rest.strip()
    return line[1:].strip() if line and unicodedata.category(line[0]) == "Pd" and line[1:2].isspace() else line


def _while(lines: Sequence[str], at: int, belongs: Callable[[int], bool]) -> int:
    """The first line after ``at`` that neither belongs nor is blank."""
    while (at := at + 1) < len(lines) and (not lines[at] or belongs(at)):
        pass
    return at


def _asn1_mark(line: str, word: str) -> bool:
    if not line.startswith("--"):
        return False
    rest = line[2:].lstrip()
    if rest.startswith("/"):
        rest = rest[1:].partition("/")[2].lstrip()
    after = rest[len(word) : len(word) + 1]
    return rest.startswith(word) and not (after.isalnum() or after == "_")


def _asn1(lines: Sequence[str], at: int) -> int:
    if not _asn1_mark(lines[at], "ASN1START"):
        return at
    return next((k + 1 for k in range(at + 1, len(lines)) if _asn1_mark(lines[k], "ASN1STOP")), len(lines))


def _diameter_head(line: str) -> bool:
    together = "".join(line.lower().split())
    return "::=<diameterheader:" in together or "::=<avpheader:" in together


def _avp(line: str) -> bool:
    """A single item in brackets, after how often it may occur."""
    item = line.lstrip("0123456789* \t")
    often = line[: len(line) - len(item)].split()
    pair = item[:1] + item[-1:]
    return len(often) <= 1 and "".join(often).count("*") <= 1 and len(item) > 2 and pair in ("<>", "{}", "[]") and not set(pair) & set(item[1:-1])


def _diameter(lines: Sequence[str], at: int) -> int:
    return _while(lines, at, lambda k: _avp(lines[k]) or _diameter_head(lines[k])) if _diameter_head(lines[at]) else at


def _message_start(line: str) -> bool:
    words = line.split()
    if words and words[0].replace("-", "").replace(">", "") in ("CS", "SC", "SS", "CC") and "->" in words[0]:
        words = words[1:]
    if len(words) < 2:
        return False
    if words[0] in VERSIONS:
        reason = words[2:]
        return len(words[1]) == 3 and words[1].isdigit() and len(reason) <= 4 and all(w[0].isupper() and w.replace("-", "").isalpha() for w in reason)
    if words[0] not in METHODS:
        return False
    if words[-1] in VERSIONS:
        return len(words) == 3
    scheme, colon, rest = " ".join(words[1:]).partition(":")
    return bool(colon) and scheme in SCHEMES and len(rest.split()) == 1


def _header(line: str) -> bool:
    name = line.partition(":")[0].rstrip()
    if ":" in line and (name.lower() in SIP_FIELDS or len(name) == 1 and name.islower() and line[1:2] == ":"):
        return True
    for mark in ":=":
        parts = line.partition(mark)[0].rstrip().split("-")
        if mark in line and len(parts) > 1 and all(p.isascii() and p.isalnum() for p in parts):
            return True
    return False


def _sdp_line(line: str) -> bool:
    return line[1:2] == "=" and line[0] in SDP_TYPES and not line.endswith(".")


def _folded(lines: Sequence[str], at: int) -> bool:
    """Whether a line is the rest of a value that the line before it breaks off with a backslash."""
    if not lines[at - 1].endswith("\\") or lines[at].endswith("."):
        return False
    words = lines[at].split()
    if any(all(w.isalpha() for w in words[k : k + 3]) for k in range(len(words) - 2)):
        return False
    return "=" in lines[at] or ";" in lines[at] or len(words) == 1 and not words[0].isalpha()


def _sip(lines: Sequence[str], at: int) -> int:
    if not _message_start(_unlabelled(lines[at])):
        return at
    return _while(lines, at, lambda k: _message_start(lines[k]) or _header(lines[k]) or _sdp_line(lines[k]) or _folded(lines, k))


def _sdp(lines: Sequence[str], at: int) -> int:
    """Two lines are enough if the first is a version; else it takes three."""
    first = _unlabelled(lines[at])
    if not _sdp_line(first):
        return at
    end = _while(lines, at, lambda k: _sdp_line(lines[k]) or _folded(lines, k))
    return end if sum(map(bool, lines[at:end])) >= (2 if first == "v=0" else 3) else at


def _markup(line: str) -> bool:
    """A tag, a declaration, a comment, or the end of a document type's inner part."""
    after = line[1:].lstrip(" /")
    return line[:1] == "]" or line[:1] == "<" and (line[1:2] in ("!", "?") or after[:1] == "_" or after[:1].isascii() and after[:1].isalpha())


def _markup_start(line: str) -> bool:
    """What opens a block if more markup follows: no closing tag, and whole on its line."""
    low = line.lower()
    tag = _markup(line) and line[1:2] not in ("/", "!", " ") and line[0] == "<"
    return line.endswith(">") and (tag or low.startswith(DECLARATIONS) or low.startswith("<!") and low[2:3] in ("-", "\u2013", "\u2014"))


class _Nesting:
    """What is still open after some lines: brackets, and elements."""

    def __init__(self) -> None:
        self.brackets = self.elements = 0

    def read(self, line: str) -> None:
        self.brackets = max(0, self.brackets + line.count("<") - line.count(">"))
        opened = sum(part[:1] == "_" or part[:1].isascii() and part[:1].isalpha() for part in line.split("<")[1:])
        self.elements = max(0, self.elements + opened - line.count("</") - line.count("/>"))


def _xml(lines: Sequence[str], at: int) -> int:
    low, following = lines[at].lower(), next((x for x in lines[at + 1 :] if x), "")
    whole = low.startswith("<!doctype") or low.startswith("<?xml") and not low[5:6].isalnum()
    if not whole and not (_markup_start(lines[at]) and _markup(following)):
        return at
    nesting, end, k = _Nesting(), at + 1, at
    nesting.read(lines[at])
    while (k := k + 1) < len(lines):
        sure = nesting.brackets > 0 or _markup(lines[k])
        if lines[k] and not sure and not nesting.elements:
            break
        nesting.read(lines[k])
        if lines[k] and sure:
            end = k + 1  # text inside an element counts once markup follows it
    return end


def equation_number(text: str) -> bool:
    inner = text[1:-1].strip()
    return text[:1] == "(" and text[-1:] == ")" and bool(inner) and inner.replace(".", "").replace("-", "").isalnum() and any(c.isdigit() for c in inner) and ("." in inner or "-" in inner)


def _latex(lines: Sequence[str], at: int) -> int:
    """One formula alone on its line, or with nothing after it but its number."""
    parts = lines[at].replace("$$", "$").split("$")
    if len(parts) != 3 or parts[0] or not parts[1].strip():
        return at
    rest = parts[2].strip().lstrip(",.;:").strip()
    return at + (not rest or equation_number(rest))


FORMATS: dict[str, Callable[[Sequence[str], int], int]] = {"asn1": _asn1, "diameter": _diameter, "sip": _sip, "sdp": _sdp, "xml": _xml, "latex": _latex}


#: What a line that opens a block of a kind has at least.
OPENING: dict[str, Callable[[str], bool]] = {
    "asn1": lambda line: line[0] == "-", "diameter": lambda line: "<" in line and "::=" in "".join(line.split()), "sip": lambda line: "/" in line or ":" in line,
    "sdp": lambda line: "=" in line, "xml": lambda line: line[0] == "<", "latex": lambda line: line[0] == "$",
}


def blocks_of(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, first and last line of each block."""
    lines, at = [_plain(x) for x in text.split("\n")], 0
    while at < len(lines):
        kind, end = next(((k, e) for k, f in FORMATS.items() if OPENING[k](lines[at]) and (e := f(lines, at)) > at), ("", at)) if lines[at] else ("", at)
        if kind:
            last = end - 1
            while not lines[last]:
                last -= 1
            yield kind, at, last
        at = max(end, at + 1)


def blocks(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """``by, block, kind, from_line, to_line, body``: a text's blocks, numbered from 1, lines from 0."""
    fields = pa.struct([("block", pa.int32()), ("kind", pa.string()), ("from_line", pa.int32()), ("to_line", pa.int32())])

    @F.arrow_udf("array<struct<block:int,kind:string,from_line:int,to_line:int>>")
    def found(column: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for x in column:
            rows += [(k, *block) for k, block in enumerate(blocks_of(x.as_py()), 1)]
            offsets.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=list(fields)))

    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.contains(F.col(text), F.lit(word))
    rows = spread(texts.select(by, F.col(text).alias("_text"))).where(cue).withColumn("_b", F.explode(found(F.col("_text"))))
    body = F.array_join(F.slice(F.split("_text", "\n"), F.col("_b.from_line") + 1, F.col("_b.to_line") - F.col("_b.from_line") + 1), "\n")
    return rows.select(by, "_b.block", "_b.kind", "_b.from_line", "_b.to_line", body.alias("body"))
