"""Documents as sections: HTML pages and office documents."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.blocks import blocks_of, equation_number
from ..session import spread

#: Entries beyond this size are not unpacked.
MOST_BYTES = 1 << 30
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
SECTION_ROWS = "spec_id string, ord int, number string, title string, level int, parent_number string, content string"
_NUMBERED = re.compile(r"\A(?P<number>(?:Annex\s+)?[A-Z](?:\.\d+[A-Za-z]?)*|\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*)(?:[\s:]+)(?P<title>\S.*)\Z", re.S)


def split_heading(text: str) -> tuple[str, str]:
    """A heading's number and title; without a number both are the text, or what follows a dash."""
    if unicodedata.category(text.strip()[:1] or "x") == "Pd" and text.strip()[1:2].isspace():
        text = text.strip()[1:]
    found = _NUMBERED.match(text.strip())
    if not found:
        return text.strip(), text.strip()
    return re.sub(r"\AAnnex\s+", "", found["number"]), found["title"].strip()


class Outline:
    """Collects sections; a section's parent is the last one of a smaller level."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.blocks: list[str] = []

    def heading(self, level: int, text: str) -> None:
        self.flush()
        number, title = split_heading(text)
        while self.open and self.open[-1]["level"] >= level:
            self.open.pop()
        row = {"ord": len(self.rows), "number": number, "title": title, "level": level, "parent_number": self.open[-1]["number"] if self.open else None, "content": ""}
        self.rows.append(row)
        self.open.append(row)

    def block(self, text: str) -> None:
        if text.strip():
            self.blocks.append(text)

    def flush(self) -> None:
        if self.rows and self.blocks:
            self.rows[-1]["content"] = "\n\n".join(self.blocks)
        self.blocks = []


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.outline, self.text, self.level, self.skip, self.pre = Outline(), [], 0, 0, False

    def _flush(self) -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.pre else " ".join(text.split())
        self.text = []
        if text and self.level:
            self.outline.heading(self.level, text)
        elif text:
            self.outline.block(f"```\n{text}\n```" if self.pre else text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "nav", "footer", "template"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self.level = int(tag[1])
        elif tag in ("p", "div", "li", "tr", "br", "article", "section", "title", "pre"):
            self._flush()
            self.pre = tag == "pre" or (self.pre and tag == "br")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "nav", "footer", "template"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self.level = 0
        elif tag in ("p", "div", "li", "tr", "article", "section", "title", "pre"):
            self._flush()
            self.pre = False

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_sections(html: str) -> list[dict]:
    """The sections of a page by its headings; what stands before the first is left out."""
    parser = _Html()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    parser.outline.flush()
    return parser.outline.rows


def _runs(paragraph: ElementTree.Element) -> str:
    """A paragraph's text with emphasis; adjacent runs of one style are one."""
    parts: list[tuple[str, str]] = []
    for run in paragraph.iter(W + "r"):
        style = run.find(W + "rPr")
        on = lambda tag, style=style: style is not None and (x := style.find(W + tag)) is not None and x.get(W + "val") not in ("0", "false")
        mark = ("**" if on("b") else "") + ("*" if on("i") else "")
        position = style.find(W + "vertAlign") if style is not None else None
        tag = {"superscript": "sup", "subscript": "sub"}.get(position.get(W + "val"), "") if position is not None else ""
        text = "".join("\n" if x.tag == W + "br" else "\t" if x.tag == W + "tab" else x.text or "" for x in run if x.tag in (W + "t", W + "br", W + "tab"))
        text = f"<{tag}>{text}</{tag}>" if tag and text else text
        if parts and parts[-1][0] == mark:
            parts[-1] = (mark, parts[-1][1] + text)
        elif text:
            parts.append((mark, text))
    out = ""
    for mark, text in parts:
        core = text.strip()
        out += text.replace(core, f"{mark}{core}{mark[::-1]}", 1) if mark and core else text
    return out


def table_html(table: ElementTree.Element) -> str:
    """A table as HTML; merged cells become spans."""
    heads = [r.find(f"{W}trPr/{W}tblHeader") is not None for r in table.findall(W + "tr")]
    n_heads = next((k for k, head in enumerate(heads) if not head), len(heads))
    rows = [[(c, int((c.find(f"{W}tcPr/{W}gridSpan").get(W + "val")) if c.find(f"{W}tcPr/{W}gridSpan") is not None else 1)) for c in r.findall(W + "tc")] for r in table.findall(W + "tr")]
    merge = lambda c: (m.get(W + "val") or "continue") if (m := c.find(f"{W}tcPr/{W}vMerge")) is not None else None
    placed = [{sum(s for _, s in row[:k]): (c, s) for k, (c, s) in enumerate(row)} for row in rows]
    out = []
    for r, row in enumerate(placed):
        cells = ""
        for at, (cell, span) in row.items():
            if merge(cell) == "continue":
                continue
            height = 1
            while merge(cell) == "restart" and r + height < len(placed) and at in placed[r + height] and merge(placed[r + height][at][0]) == "continue":
                height += 1
            attrs = (f' colspan="{span}"' if span > 1 else "") + (f' rowspan="{height}"' if height > 1 else "")
            tag = "th" if r < n_heads else "td"
            cells += f"<{tag}{attrs}>{escape('<br>'.join(filter(None, (_runs(p) for p in cell.iter(W + 'p')))), quote=False).replace('&lt;br&gt;', '<br>')}</{tag}>"
        out.append(f"<tr>{cells}</tr>")
    if n_heads:
        out = ["<thead>", *out[:n_heads], "</thead><tbody>", *out[n_heads:], "</tbody>"]
    return "<table>" + "".join(out) + "</table>"


def latex(node: ElementTree.Element) -> str:
    """A formula's tree as LaTeX: fractions, scripts, roots, sums, delimiters, matrices, functions."""
    tag, child = node.tag.removeprefix(M), lambda n: "".join(latex(x) for e in node.findall(M + n)[:1] for x in e)
    value = lambda path, default: (x.get(M + "val") if (x := node.find(path)) is not None else None) or default
    if tag == "t":
        return re.sub(r"([#$%&_{}])", r"\\\1", node.text or "")
    if tag == "f":
        return rf"\frac{{{child('num')}}}{{{child('den')}}}"
    if tag in ("sSub", "sSup", "sSubSup"):
        sub, sup = child("sub"), child("sup")
        return f"{{{child('e')}}}" + (f"_{{{sub}}}" if "Sub" in tag else "") + (f"^{{{sup}}}" if "Sup" in tag else "")
    if tag == "rad":
        degree = child("deg")
        return rf"\sqrt{f'[{degree}]' if degree else ''}{{{child('e')}}}"
    if tag == "nary":
        sign = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int"}.get(value(f"{M}naryPr/{M}chr", "∫"), r"\int")
        sub, sup = child("sub"), child("sup")
        return sign + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + f" {child('e')}"
    if tag == "d":
        inner = ", ".join("".join(latex(x) for x in e) for e in node.findall(M + "e"))
        return rf"\left{value(f'{M}dPr/{M}begChr', '(')}{inner}\right{value(f'{M}dPr/{M}endChr', ')')}"
    if tag == "m":
        rows = (" & ".join("".join(latex(x) for x in e) for e in row.findall(M + "e")) for row in node.findall(M + "mr"))
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"
    if tag == "func":
        return rf"\operatorname{{{child('fName')}}} {child('e')}"
    return "".join(latex(x) for x in node)


#: Fonts of equal widths, which mark code.
CODE_FONTS = {"Courier New", "Courier", "Consolas", "Lucida Console", "Monaco", "Menlo"}
_RELEASE = re.compile(r"\(?\s*Release\s+(\d{1,2})\s*\)?", re.I)
_DOCUMENT_TYPE = re.compile(r"\b(TS|TR)\s+(\d{2})[.\s]?(\d{2,3})\b", re.I)


class _Package:
    """The parts of an office document's archive, none larger than MOST_BYTES."""

    def __init__(self, data: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.archive.namelist())

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        if self.archive.getinfo(name).file_size > MOST_BYTES:
            raise ValueError(f"{name} is too large")
        return self.archive.read(name)

    def tree(self, name: str) -> ElementTree.Element | None:
        data = self.read(name)
        return None if data is None else ElementTree.fromstring(data)

    def body(self) -> ElementTree.Element:
        found = self.tree("word/document.xml")
        if found is None:
            raise ValueError("no document part")
        return next(iter(found.findall(W + "body")), found)

    def targets(self) -> dict[str, str]:
        """What the document's relations lead to."""
        found = self.tree("word/_rels/document.xml.rels")
        return {x.get("Id"): x.get("Target", "") for x in found} if found is not None else {}


class _Styles:
    """Names of styles, and whether a style's text is code: by the font that it, one that it is based on, or
    the document's defaults set."""

    def __init__(self, styles: ElementTree.Element | None):
        each = [] if styles is None else list(styles.iter(W + "style"))
        value = lambda e, tag: x.get(W + "val") if (x := e.find(W + tag)) is not None else None
        fonts = lambda e: [*f.attrib.values()] if (f := next(e.iter(W + "rFonts"), None)) is not None else None
        self.name_of = {s.get(W + "styleId"): value(s, "name") or "" for s in each}
        self.base, self.fonts = {s.get(W + "styleId"): value(s, "basedOn") for s in each}, {s.get(W + "styleId"): fonts(s) for s in each}
        default = styles.find(W + "docDefaults") if styles is not None else None
        self.default = (fonts(default) if default is not None else None) or []

    def name(self, paragraph: ElementTree.Element) -> str:
        style = self.id(paragraph)
        return self.name_of.get(style, style) if style else ""

    def id(self, paragraph: ElementTree.Element) -> str:
        style = paragraph.find(f"{W}pPr/{W}pStyle")
        return style.get(W + "val") or "" if style is not None else ""

    def is_code(self, paragraph: ElementTree.Element) -> bool:
        if re.search(r"\b(?:PL|code|asn)", self.name(paragraph), re.I):
            return True
        style, seen = self.id(paragraph), set()
        while style in self.fonts and style not in seen:
            if self.fonts[style] is not None:
                return bool(CODE_FONTS & set(self.fonts[style]))
            seen.add(style)
            style = self.base[style]
        return bool(self.id(paragraph)) and bool(CODE_FONTS & set(self.default))


def _pictures(paragraph: ElementTree.Element, targets: dict[str, str]) -> list[str]:
    """Markdown of the pictures in a paragraph: drawings with their size, and older shapes with their style's."""
    out = []
    for holder in paragraph.iter():
        local = holder.tag.rsplit("}", 1)[-1]
        if local not in ("inline", "anchor", "shape"):
            continue
        link = next((v for x in holder.iter() if x.tag.rsplit("}", 1)[-1] in ("blip", "imagedata") for k, v in x.attrib.items() if k.rsplit("}", 1)[-1] in ("embed", "id", "link")), None)
        name = targets.get(link or "", "").rsplit("/", 1)[-1]
        if not name:
            continue
        extent = next((x for x in holder if x.tag.rsplit("}", 1)[-1] == "extent"), None)
        if extent is not None:
            width, height = (round(int(extent.get(k) or 0) / 9525) for k in ("cx", "cy"))
        else:
            measures = dict(p.split(":", 1) for p in holder.get("style", "").replace(" ", "").split(";") if ":" in p)
            width, height = (_pixels(measures.get(k, "")) for k in ("width", "height"))
        about = next((x.get("descr") or "" for x in holder if x.tag.rsplit("}", 1)[-1] == "docPr"), "")
        size = f"?w={width}&h={height}" if width and height else ""
        out.append(f"![{about.replace(']', ' ').replace(chr(10), ' ') or 'Figure'}](image://{name}{size})")
    return out


def _pixels(length: str) -> int:
    found = re.fullmatch(r"([0-9]*\.?[0-9]+)(px|pt|in|cm|mm|)", length)
    factor = {"": 1, "px": 1, "pt": 96 / 72, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4}
    return round(float(found[1]) * factor[found[2]]) if found else 0


def _plain(paragraph: ElementTree.Element) -> str:
    return "".join("\n" if x.tag == W + "br" else "\t" if x.tag == W + "tab" else x.text or "" for x in paragraph.iter() if x.tag in (W + "t", W + "br", W + "tab"))


def docx_sections(data: bytes) -> list[dict]:
    """The sections of an office document by its heading styles.

    Paragraphs of code styles become fences; so do runs of plain paragraphs that read as a block of a
    protocol or markup language, or as a formula with its number.
    """
    package = _Package(data)
    body, styles, targets = package.body(), _Styles(package.tree("word/styles.xml")), package.targets()
    outline, code, plain = Outline(), [], []

    def end_code() -> None:
        if code:
            kind = "asn1" if any("::=" in line or "ASN1START" in line for line in code) else ""
            outline.block(f"```{kind}\n" + "\n".join(code) + "\n```")
            code.clear()

    def end_plain() -> None:
        """Paragraphs since the last heading, table or code; ``plain`` has their raw and their written text."""
        raw = [line for line, _ in plain]
        single = [line.replace("\n", " ") for line in raw]  # a paragraph is one line here
        fenced = {a: (kind, b) for kind, a, b in blocks_of("\n".join(single)) if kind != "latex"} if any(raw) else {}
        k = 0
        while k < len(plain):
            if k in fenced:
                kind, last = fenced[k]
                outline.block(f"```{kind}\n" + "\n".join(raw[k : last + 1]) + "\n```")
                k = last + 1
            else:
                outline.block(plain[k][1])
                k += 1
        plain.clear()

    for block in body:
        if block.tag == W + "tbl":
            end_code()
            end_plain()
            outline.block(table_html(block))
        if block.tag != W + "p":
            continue
        found = re.match(r"heading\s+(\d+)", styles.name(block), re.I)
        if found:
            end_code()
            end_plain()
            outline.heading(int(found[1]), " ".join(_plain(block).split()))
        elif styles.is_code(block):
            end_plain()
            code.append("".join(t.text or "" for t in block.iter(W + "t")))
        else:
            end_code()
            pictures, formulas, text = _pictures(block, targets), ["".join(latex(x) for x in m) for m in block.iter(M + "oMath")], _runs(block)
            rest = text.strip().lstrip(",.;:").strip()
            if len(formulas) == 1 and (not rest or equation_number(rest)):
                plain.append(("", f"$${formulas[0]}$$" + (f" {rest}" if rest else "")))
            else:
                written = " ".join(filter(None, (text, *(f"${m}$" for m in formulas))))
                listed = block.find(f"{W}pPr/{W}numPr") is not None and text
                # Formulas and pictures are no lines of a block.
                plain.append(("" if formulas or pictures else _plain(block), "- " + written if listed else written))
            plain.extend(("", p) for p in pictures)
    end_code()
    end_plain()
    outline.flush()
    return outline.rows


def docx_metadata(data: bytes, filename: str, searched: int = 50) -> dict:
    """``spec_id, doc_type, title, version, version_token, release`` of an office document.

    Number and version are the file name's. The type is told by a mention of that very number in the
    properties or before the first heading, or by a line that names the kind of document; without one the
    id's type is TS. The title is the subject up to a release, else the title property, else the first heading.
    """
    package = _Package(data)
    body, styles, core = package.body(), _Styles(package.tree("word/styles.xml")), package.tree("docProps/core.xml")
    named = {x.tag.rsplit("}", 1)[-1]: (x.text or "").strip() for x in core} if core is not None else {}
    paragraphs = [(re.match(r"heading\s", styles.name(p), re.I) is not None, " ".join(_plain(p).split())) for p in body.findall(W + "p")[:searched]]
    cover = [text for text in _until_heading(paragraphs) if text]
    stem = filename.rsplit(".", 1)[0]
    file = re.match(r"(\d{2})(\d{2,3})((?:-\d{1,2})*)-([0-9a-zA-Z]{3})(?:[_-].*)?\Z", stem)
    out = dict.fromkeys(("spec_id", "doc_type", "title", "version", "version_token", "release"), "")
    if file:
        told = [m[1].upper() for text in (*cover, named.get("title", ""), named.get("subject", "")) for m in _DOCUMENT_TYPE.finditer(text) if (m[2], m[3]) == (file[1], file[2])]
        kinds = {"technical specification": "TS", "technical report": "TR"}
        told += [kinds[line] for text in cover if (line := text.strip(" \t;:.,").lower()) in kinds]
        out["doc_type"] = told[0] if told else ""
        out["spec_id"], out["version_token"] = f"{out['doc_type'] or 'TS'} {file[1]}.{file[2]}{file[3]}", file[4].lower()
        out["version"] = ".".join(str(int(c, 36)) for c in file[4])
    else:
        out["spec_id"] = stem
    subject, release = named.get("subject", ""), _RELEASE.search(named.get("subject", ""))
    out["title"] = subject[: release.start()].rstrip("; (") if release else subject or named.get("title", "")
    out["title"] = out["title"] or next((text for is_heading, text in paragraphs if is_heading), "") or out["spec_id"]
    releases = (m[1] for m in [release, *map(_RELEASE.search, cover)] if m)
    out["release"] = next(releases, "")
    return out


def _until_heading(paragraphs: list[tuple[bool, str]]) -> Iterator[str]:
    for is_heading, text in paragraphs:
        if is_heading:
            return
        yield text


#: Media types of pictures by their endings.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf"}
READABLE = {"image/png", "image/jpeg", "image/gif"}


def docx_images(data: bytes) -> list[dict]:
    """``name, mime_type, data, llm_readable`` of the pictures that an office document holds."""
    package = _Package(data)
    out = []
    for name in sorted(n for n in package.names if n.startswith("word/media/") and not n.endswith("/")):
        kind = MEDIA_TYPES.get(name.rsplit(".", 1)[-1].lower(), "application/octet-stream")
        out.append({"name": name.rsplit("/", 1)[-1], "mime_type": kind, "data": package.read(name), "llm_readable": kind in READABLE})
    return out


def _rows(files: DataFrame, parse: Callable[..., list[dict]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """What is parsed from each file, under its key; a file at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [{names[0]: key} | row for row in parse(source, key)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.mapInArrow(run, schema)


_SECTION_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]


def sections_of_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _rows(spread(pages.selectExpr(f"cast({key} as string)", html)), lambda text, _: html_sections(text), SECTION_ROWS, _SECTION_KINDS)


def sections_of_files(files: DataFrame) -> DataFrame:
    """Sections of a ``binaryFile`` table of office documents, by path."""
    return _rows(files.select("path", "content"), lambda data, _: docx_sections(data), SECTION_ROWS, _SECTION_KINDS)


def metadata_of_files(files: DataFrame) -> DataFrame:
    """What office documents say of themselves, by path."""
    schema = "path string, spec_id string, doc_type string, title string, version string, version_token string, release string"
    return _rows(files.select("path", "content"), lambda data, path: [docx_metadata(data, path.rsplit("/", 1)[-1])], schema, [pa.string()] * 7)


def images_of_files(files: DataFrame) -> DataFrame:
    """The pictures of office documents, by path."""
    schema = "path string, name string, mime_type string, data binary, llm_readable boolean"
    return _rows(files.select("path", "content"), lambda data, _: docx_images(data), schema, [pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()])
