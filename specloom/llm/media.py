"""Interleaved documents: text and media references in reading order, payloads resolved by digest.

HTML is parsed into an ordered sequence of structs, each a text block or a media reference with its
position, caption and alternative text. Payloads are kept apart: cut into blocks of samples, each an 8-bit
greyscale PNG image in a pack file of the shared folder. A reference names the SHA-256 digest of a block's
samples, so a block that many documents share is examined once, and a join on the digest carries its
results back to every position that refers to it. ``article`` writes a text's own paragraphs with its
payload's blocks between them, in order.

Defined results: a null html has an empty sequence; a reference whose digest no payload has keeps its
place with null results; references without a digest resolve to nothing; captions belong to all media
of their ``figure``; a null text is an empty one, whose payload is one row of filling; repeated rows give
repeated sequences; an empty table gives empty tables; further columns of the input pass through
``parse``, and one named like its output is replaced; ``store`` leaves them out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import SLICE_ROWS, new_folder, release, slices, written

PART = (("position", "int"), ("kind", "string"), ("text", "string"), ("src", "string"), ("digest", "string"), ("caption", "string"), ("alt", "string"))
BLOCK = "struct<digest:string,path:string,offset:bigint,length:int>"
STORED = f"doc_id long, n_bytes long, key binary, blocks array<{BLOCK}>"
LOOK = "struct<digest:string,look:string>"
EXAMINED = f"key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, blocks array<{LOOK}>"
#: Samples in an image row, and the byte that fills the last row.
WIDTH, FILL = 576, 255
#: Bytes of a payload in one block: whole image rows.
BLOCK_BYTES = 8 * WIDTH
#: The signature of PNG files and the reference scheme of digests.
PNG_SIGNATURE, SCHEME = b"\x89PNG\r\n\x1a\n", "sha256:"
MEDIA, SILENT = {"img", "video", "audio", "source", "embed"}, {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "header", "footer", "nav", "main", "body", "head", "title", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr"}
#: Digests that a task remembers, so as to store copies once; more are stored again, which does no harm.
REMEMBERED, FILE_BYTES = 100_000, 256 << 20


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.figures: list[tuple[int, list[str]]] = []
        self.silent = 0
        self.in_caption = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_text()
        if tag in SILENT:
            self.silent += 1
        elif tag == "figure":
            self.figures.append((len(self.parts), []))
        elif tag == "figcaption":
            self.in_caption += 1
        elif tag in MEDIA:
            have = dict(attrs)
            if src := have.get("src"):
                self._end_text()
                digest = src.removeprefix(SCHEME) if src.startswith(SCHEME) else have.get("data-digest")
                self.parts.append({"kind": "media", "text": None, "src": src, "digest": digest, "caption": None, "alt": have.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_text()
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.in_caption = max(0, self.in_caption - 1)
        elif tag == "figure" and self.figures:
            self._end_figure()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)

    def _end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if not text:
            return
        if self.in_caption and self.figures:
            self.figures[-1][1].append(text)
        else:
            self.parts.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None, "alt": None})

    def _end_figure(self) -> None:
        first, caption = self.figures.pop()
        for part in self.parts[first:] if caption else ():
            if part["kind"] == "media" and part["caption"] is None:
                part["caption"] = " ".join(caption)

    def finish(self) -> list[dict]:
        self.close()
        self._end_text()
        while self.figures:
            self._end_figure()
        return [{"position": k} | part for k, part in enumerate(self.parts)]


def sequence(html: str | None) -> list[dict]:
    """The text blocks and media references of a document in reading order."""
    parser = _Sequence()
    parser.feed(html or "")
    return parser.finish()


def parse(df: DataFrame, html: str = "html", out: str = "parts", keep: bool = True) -> DataFrame:
    """Adds the ordered sequence of an HTML column, which stays or, without ``keep``, goes."""
    fields = pa.struct([(n, pa.int32() if k == "int" else pa.string()) for n, k in PART])
    place = df.columns.index(html)
    kept = [k for k, c in enumerate(df.columns) if c != out and (keep or k != place)]
    schema = T.StructType([df.schema.fields[k] for k in kept]).add(out, T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in PART])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            parts = pa.array([sequence(x) for x in batch.column(place).to_pylist()], pa.list_(fields))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), parts], schema.names)

    return df.mapInArrow(run, schema)


def references(df: DataFrame, keys: list[str], parts: str = "parts") -> DataFrame:
    """One row per media reference, with ``keys``, its place, digest (as bytes; null if it is none) and caption."""
    refs = df.select(*keys, F.explode(F.filter(F.col(f"`{parts}`"), lambda p: p.kind == "media")).alias("_ref"))
    return refs.select(*keys, F.unhex("_ref.digest").alias("digest"), *(F.col(f"_ref.{n}").alias(n) for n in ("position", "src", "caption", "alt")))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of ``media`` (one row per ``digest``) that the digest leads to; null
    where it leads nowhere."""
    return refs.join(media, "digest", "left")


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def key_of(text: Column) -> Column:
    """What equal texts have in common: the SHA-256 of their bytes."""
    return F.unhex(F.sha2(_bytes(text), 256))


def digests_of(text: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """The digests of a text's payload blocks, in order."""
    data, n = _bytes(text), F.octet_length(F.coalesce(text, F.lit("")))
    fill = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    last = F.floor((n + fill - 1) / block_bytes).cast("int")
    rest = F.unhex(F.repeat(F.lit(f"{FILL:02X}"), fill))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.sha2(F.concat(F.substr(data, k * block_bytes + 1, F.lit(block_bytes)), F.when(k == last, rest).otherwise(F.lit(b""))), 256))


def article(text: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """A text's paragraphs as HTML, and after each the figures of the payload blocks that are due by then."""
    safe = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    paragraphs, digests = F.split(safe, "\n"), digests_of(text, block_bytes)

    def body(both: Column) -> Column:
        """Of n paragraphs, the i-th is followed by those of m blocks from i m / n up to (i + 1) m / n."""
        n, m = F.size(both["p"]), F.size(both["d"])

        def figure(k: Column) -> Column:
            caption = F.concat(F.lit("part "), (k + 1).cast("string"), F.lit(" of "), m.cast("string"))
            return F.concat(F.lit(f"<figure><img alt='samples' src='{SCHEME}"), F.element_at(both["d"], k + 1), F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))

        def one(p: Column, i: Column) -> Column:
            low, high = (F.ceil(j.cast("long") * m / n).cast("int") for j in (i, i + 1))
            figures = F.when(high > low, F.array_join(F.transform(F.sequence(low, F.greatest(low, high - 1)), figure), "")).otherwise("")
            return F.concat(F.lit("<p>"), p, F.lit("</p>"), figures)

        return F.array_join(F.transform(both["p"], one), "")

    # A single lambda's argument: paragraphs and digests are made once.
    made = F.transform(F.array(F.struct(paragraphs.alias("p"), digests.alias("d"))), body)
    return F.concat(F.lit("<article>"), F.element_at(made, 1), F.lit("</article>"))


def payload(text: bytes) -> bytes:
    """The bytes filled up to a positive multiple of WIDTH."""
    return text + bytes([FILL]) * (-len(text) % WIDTH if text else WIDTH)


def to_png(data: bytes, level: int = 6) -> bytes:
    """Bytes as the samples of an 8-bit greyscale image, losslessly."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def from_png(image: bytes) -> np.ndarray:
    """The samples, a row each; only 8-bit greyscale without filters is read (``ValueError``)."""
    if image[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, shape = 8, [], None
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            shape = (height, width + 1)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit greyscale image")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not read")
    return lines[:, 1:]


def look(samples: np.ndarray) -> str:
    """A 64-bit average hash: the cells of an 8 x 8 grid brighter than the whole, and the mean."""
    height, width = samples.shape
    columns = np.add.reduceat(samples, np.arange(8) * width // 8, axis=1, dtype=np.int64)
    band = np.arange(height) * 8 // height
    cells, sizes = np.zeros((8, 8), np.int64), np.bincount(band, minlength=8) * (width // 8)
    np.add.at(cells, band, columns)
    total = int(cells.sum())
    # Whole numbers: a cell's mean exceeds the image's if sum * all samples > total * its samples.
    bits = cells * samples.size > total * sizes[:, None]
    return f"{int(np.packbits(bits).tobytes().hex(), 16):016x}:{total // samples.size}"


class _Pack:
    """A task's pack files: stored forms one after another, each distinct one once."""

    def __init__(self, folder: str):
        self.folder, self.file, self.known = folder, None, {}

    def put(self, samples: bytes) -> tuple[str, str, int, int]:
        key = hashlib.sha256(samples).digest()
        if (found := self.known.get(key)) is None:
            image = to_png(samples)
            if self.file is None or self.at >= FILE_BYTES:
                self.close()
                self.path, self.at = f"{self.folder}/{uuid.uuid4().hex}.pack", 0
                files, name = pa.fs.FileSystem.from_uri(self.path)
                self.file = files.open_output_stream(name, compression=None)
            self.file.write(image)
            found = (self.path, self.at, len(image))
            self.at += len(image)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return (key.hex(), *found)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of structs, a list for each row."""
    flat = [x for row in rows for x in row]
    columns = list(zip(*flat, strict=True)) or [()] * kind.num_fields
    fields = [pa.array(c, kind.field(k).type) for k, c in enumerate(columns)]
    ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, [kind.field(k).name for k in range(kind.num_fields)]))


def store(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stores every ``text`` of ``doc_id, text`` (null: empty) and returns, per row, the text's key and where
    the blocks of its payload are.

    A row counts only once its task has ended well, and names the files of that very attempt; files of
    lost attempts are never read. Copies within a task share one stored form.
    """
    if block_bytes <= 0 or block_bytes % WIDTH:
        raise ValueError(f"a block is whole rows of {WIDTH} bytes")
    folder = new_folder(df.sparkSession, "media")
    files, name = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(name, recursive=True)
    block = pa.struct([("digest", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int32())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack(folder)
        for batch in slices(batches, 1):
            sizes, keys, blocks = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                data = payload(text)
                sizes.append(len(text))
                keys.append(hashlib.sha256(text).digest())
                blocks.append([pack.put(data[a : a + block_bytes]) for a in range(0, len(data), block_bytes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _structs(blocks, block)], ["doc_id", "n_bytes", "key", "blocks"])
        pack.close()

    return written(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(save, STORED), "stored", small=True)


def examine(stored: DataFrame) -> DataFrame:
    """Reads the stored forms of each distinct text back and describes it as a whole and by its blocks."""
    spark = stored.sparkSession
    names, look_type = [x.split()[0] for x in EXAMINED.split(", ")], pa.struct([("digest", pa.string()), ("look", pa.string())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                piece, rows, looks = batch.slice(start, SLICE_ROWS), [], []
                for key, blocks in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    whole, form, size, length, tail, seen = hashlib.sha256(), hashlib.sha256(), 0, 0, b"", []
                    for b in blocks:
                        if b["path"] != path:
                            if file is not None:
                                file.close()
                            files, name = pa.fs.FileSystem.from_uri(b["path"])
                            path, file = b["path"], files.open_input_file(name)
                        file.seek(b["offset"])
                        image = file.read(b["length"])
                        samples = from_png(image)
                        data = samples.tobytes()
                        if hashlib.sha256(data).hexdigest() != b["digest"]:
                            raise ValueError(f"stored media at {path}:{b['offset']} differs from its digest")
                        whole.update(data)
                        form.update(image)
                        size, length, tail = size + len(data), length + len(image), data[-32:]
                        seen.append((b["digest"], look(samples)))
                    rows.append((key, size, whole.hexdigest(), zlib.crc32(tail), length, form.hexdigest()))
                    looks.append(seen)
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), _structs(looks, look_type)], names)
        if file is not None:
            file.close()
        release()

    # One place for each text; a task reads its part of few files, in the order of their offsets.
    places = stored.groupBy("key").agg(F.min("blocks").alias("blocks"))
    at = [F.col("blocks")[0]["path"].alias("_path"), F.col("blocks")[0]["offset"].alias("_offset")]
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = places.select("key", "blocks", *at).repartitionByRange(tasks, "_path", "_offset").sortWithinPartitions("_path", "_offset")
    return placed.select("key", "blocks").mapInArrow(load, EXAMINED)


def looks(examined: DataFrame) -> DataFrame:
    """``digest, look``: one row for each distinct block."""
    seen = examined.select(F.explode("blocks").alias("b")).select(F.unhex("b.digest").alias("digest"), "b.look")
    return seen.groupBy("digest").agg(F.min("look").alias("look"))
