"""WARC archives compressed with an embedded Zstandard dictionary.

A dictionary is trained on a bounded sample of the records to be archived (``sample_rows`` records
of at most ``sample_bytes`` each). Every archive file begins with a skippable frame that holds it;
then each record is a Zstandard frame of its own, so that any record can be read by its offset alone.
Each task writes files of its own into the shared folder under fresh names, and a row for each run of
records goes into a manifest table. Only files that the manifest names count: what a lost or repeated
task left behind is never read.

Rows are told to be responses or revisits by digests and ids alone; a revisit's payload goes no further
than the task that reads it. Runs are bounded by compressed and by plain bytes, and are read back a few
megabytes at a time.

Defined results: a null html is an empty payload; a row without page_id is always a response and is
never referred to; rows that repeat the smallest page_id of their payload are all responses; a null
URL leaves out ``WARC-Target-URI``; an empty table gives an empty manifest and reads back as an
empty table; further columns are not archived. With too few records to train on, or ones too small,
the dictionary is made of the sampled records themselves, and of a bare record's head if there are none.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SLICE_BYTES, SLICE_ROWS, new_folder, release, slices, written

#: Magic numbers of the skippable frame for dictionaries and of a Zstandard dictionary.
DICTIONARY_FRAME, DICTIONARY_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, offset long, frames array<int>"
RECORDS = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Bytes of compressed and of plain records in one row of the manifest, and about the most in one file.
RUN_BYTES, RUN_PLAIN, FILE_BYTES = 2 << 20, 16 << 20, 256 << 20
#: Groups of equal payloads whose digests are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 200_000


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, known: tuple[int, str] | None = None) -> bytes:
    """One WARC record: a response, or a revisit of another page's payload, of which length and digest
    (``known``) are enough."""
    kind = "response" if refers_to is None else "revisit"
    length, said = known or (len(payload), digest(payload))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{said}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def parse(raw: bytes) -> tuple:
    """The fields of RECORDS from one record; its lengths and digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    uri = fields.get("WARC-Target-URI")
    uri = uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    refers = fields.get("WARC-Refers-To")
    if refers is None and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"the payload of page {page} differs from its digest")
    return (
        None if page == "none" else int(page),
        fields["WARC-Type"],
        uri,
        said,
        length,
        refers and int(refers[len("<urn:page:") : -1]),
        payload if refers is None else None,
    )


def train(samples: list[bytes], dictionary_bytes: int) -> bytes:
    """A dictionary from sample records: trained, or where they are too few or too small for that, the
    plain bytes that a record most likely shares, the likeliest last."""
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * 1024:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(min(dictionary_bytes, sum(map(len, samples)) // 8), samples).as_bytes()
    return (b"".join(samples) + record(None, "", b"", None, ""))[-dictionary_bytes:]


def _frame(dictionary: bytes) -> bytes:
    """The skippable frame that holds a dictionary; plain bytes are a Zstandard frame inside it."""
    body = dictionary if dictionary[:4] == DICTIONARY_MAGIC else zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


class _Writer:
    """Files of one task; ``runs`` gets a manifest row for each run of records."""

    def __init__(self, folder: str, dictionary: bytes, level: int):
        self.folder, self.head, self.runs = folder, _frame(dictionary), []
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True).compress
        self.file = None

    def add(self, raw: bytes) -> None:
        if self.file is None:
            self._begin()
        frame = self.compress(raw)
        self.file.write(frame)
        self.frames.append(len(frame))
        self.at += len(frame)
        self.plain += len(raw)
        if self.at - self.start >= RUN_BYTES or self.plain >= RUN_PLAIN:
            self._end_run()
            if self.at >= FILE_BYTES:
                self.close()

    def _begin(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        files, name = _open(self.path)
        self.file = files.open_output_stream(name, compression=None)
        self.file.write(self.head)
        self.at = self.start = len(self.head)
        self.frames: list[int] = []
        self.plain = 0

    def _end_run(self) -> None:
        if self.frames:
            self.runs.append((self.path, self.start, self.frames))
        self.start, self.frames, self.plain = self.at, [], 0

    def close(self) -> None:
        if self.file is not None:
            self._end_run()
            self.file.close()
            self.file = None


def embedded_dictionary(data: bytes) -> bytes:
    """The dictionary in a file's leading skippable frame; ``ValueError`` without one."""
    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file does not begin with a dictionary")
    found = data[8 : 8 + size]
    return found if found[:4] == DICTIONARY_MAGIC else zstandard.ZstdDecompressor().decompress(found)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def records_of(data: bytes) -> Iterator[bytes]:
    """Every record of a whole archive file, frame by frame, without a manifest."""
    reader = _decompressor(embedded_dictionary(data))
    rest = data[8 + struct.unpack_from("<I", data, 4)[0] :]
    while rest:
        frame = reader.decompressobj()
        yield frame.decompress(rest)
        rest = frame.unused_data


@functools.lru_cache(maxsize=2)
def _reader(path: str) -> zstandard.ZstdDecompressor:
    files, name = _open(path)
    with files.open_input_file(name) as f:
        head = f.read(8)
        return _decompressor(embedded_dictionary(head + f.read(struct.unpack("<II", head)[1])))


def plan(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, html, sha, size, refers_to``: the smallest page_id with an equal payload, for pages
    that revisit it, whose html is left out.

    Only digests and ids are shuffled to find groups of equal payloads. Up to BROADCAST_GROUPS of them
    are then known to every task, and no payload moves; of more, rows go by their page_id to meet them.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(html.cast("binary"))).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    held = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= min_payload))
    groups = held.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").select(F.col("sha").alias("_sha"), "first")
    groups = written(groups, "payloads", small=True)
    again = (F.col("page_id") > F.col("first")) & (F.col("size") >= min_payload)
    if groups.count() <= BROADCAST_GROUPS:
        both = rows.join(F.broadcast(groups), F.col("sha") == F.col("_sha"), "left").withColumn("refers_to", F.when(again, F.col("first")))
    else:
        revisits = held.select("page_id", "sha", "size").join(groups, F.col("sha") == F.col("_sha")).where(again)
        revisits = revisits.select(F.col("page_id").alias("_page"), "_sha", F.col("first").alias("refers_to")).distinct()
        known = rows.where("page_id is not null").join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
        both = known.drop("_page", "_sha").unionByName(rows.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))
    return both.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "sha", "size", "refers_to")


def write(pages: DataFrame, folder: str, *, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3, dictionary_bytes: int = 64 << 10, sample_rows: int = 800, sample_bytes: int = 16 << 10) -> DataFrame:
    """Archives ``page_id, url, html`` into files under ``folder``; returns the manifest."""
    # The sample's ids first: whole pages would all meet in the task that sorts them.
    chosen = [r.page_id for r in pages.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows).collect()]
    sample = pages.where(F.col("page_id").isin(chosen)).limit(sample_rows).select("page_id", "url", F.substring("html", 1, sample_bytes).alias("html"))
    dictionary = train([record(r.page_id, r.url, (r.html or "").encode(), None, date) for r in sample.toLocalIterator()], dictionary_bytes)
    files, name = _open(folder)
    files.create_dir(name, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, dictionary, level)
        for batch in slices(batches, 2):
            for page_id, url, html, sha, size, refers_to in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                known = (size, base64.b32encode(sha).decode())
                out.add(record(page_id, url, (html or "").encode(), refers_to, date, known))
        out.close()
        if out.runs:
            paths, offsets, frames = zip(*out.runs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(offsets, pa.int64()), pa.array(frames, pa.list_(pa.int32()))], ["path", "offset", "frames"])

    return written(plan(pages, min_payload).mapInArrow(save, MANIFEST), "manifest", small=True)


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest names, each checked against its digest."""
    names, kinds = [x.split()[0] for x in RECORDS.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def some(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, frames in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                files, name = _open(path)
                rows, held = [], 0
                with files.open_input_file(name) as f:
                    f.seek(offset)
                    for size in frames:
                        row = parse(_reader(path).decompress(f.read(size)))
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(row[-1] or b"") if payloads else 0
                        if held >= SLICE_BYTES or len(rows) >= SLICE_ROWS:
                            yield some(rows)
                            rows, held = [], 0
                if rows:
                    yield some(rows)
        release()

    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(load, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to new archives in the shared folder and reads them back."""
    return read(write(pages, new_folder(spark, "warc"), **options), payloads=False)
