"""The archive's listing as a table: entries, links of pages, downloads' outcomes."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import digit_value, token_to_dotted

#: Fixed value: series, number with its part, document and version of an archive entry.
ENTRY = r"\A(?:.*/)?(\d\d)_series/(\d\d\.\d+(?:-\d+)*(?:-[A-Z])?)/([^/]+)-([0-9a-zA-Z]{3,6})\.[zZ][iI][pP]\z"


def entry_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of a listing file, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def _digit(token: Column, at: int) -> Column:
    return digit_value(F.substring(token, at, 1))


def entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """``series, spec, token, release, minor, path`` of the lines that name a version's archive.

    Three-digit tokens are base 36; six digits are two decimal digits for each component.
    """
    # A line is taken apart once: what a generator makes is not computed again by those who use it.
    parts = F.split(F.regexp_replace(line, ENTRY, "$1\u0001$2\u0001$4"), "\u0001")
    found = lines.select(F.col(line).alias("path"), F.explode(F.filter(F.array(parts), lambda p: F.size(p) == 3)).alias("p"))
    token = F.lower(F.col("p")[2])
    short, long_ = F.length(token) == 3, token.rlike(r"\A[0-9]{6}\z")
    two = lambda k: F.substring(token, k, 2).cast("int")
    release = F.when(short, _digit(token, 1)).when(long_, two(1))
    minor = F.when(short, _digit(token, 2) * 36 + _digit(token, 3)).when(long_, two(3) * 100 + two(5))
    number = F.struct(release.alias("release"), minor.alias("minor"))
    rows = found.select(F.col("p")[0].alias("series"), F.col("p")[1].alias("spec"), token.alias("token"), F.explode(F.filter(F.array(number), lambda n: n["release"].isNotNull())).alias("n"), "path")
    return rows.select("series", "spec", "token", "n.release", "n.minor", "path")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per ``href`` of a page, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), 1)
    return pages.select("*", F.posexplode(found).alias("place", "href")).drop(html)


def outcome(names: Column) -> Column:
    """What an archive's file names amount to: a current document, old ones alone, or none."""
    lower = F.transform(names, lambda n: F.lower(n))
    new = F.exists(lower, lambda n: F.endswith(n, F.lit(".docx")))
    old = F.exists(lower, lambda n: F.endswith(n, F.lit(".doc")))
    return F.when(names.isNull(), "FAILED").when(new, "OK").when(old, "DOC_ONLY").otherwise("NO_DOC")


def release_of_file(name: Column) -> Column:
    """The release that a document's file name ends with (``...-i60.docx``)."""
    token = F.regexp_extract(F.lower(name), r"-([0-9a-z])[0-9a-z]{2}\.docx?\z", 1)
    return F.when(token != "", digit_value(token))


def api_file(name: Column) -> Column:
    """``spec_id, api_name`` of a description's file name (``TS29510_Nnrf_NFManagement.yaml``)."""
    part = lambda k: F.regexp_extract(name, r"\ATS(\d{2})(\d{3})_(.+)\.ya?ml\z", k)
    return F.when(part(3) != "", F.struct(F.concat(F.lit("TS "), part(1), F.lit("."), part(2)).alias("spec_id"), part(3).alias("api_name")))


def document_file(name: Column, doc_type: Column | None = None) -> Column:
    """``spec_id, token, release`` of a document's file name (``38101-1-i60.docx``, ``23501-i60_cover.docx``).

    The name doesn't tell the document's type: ``doc_type`` does, or else it is TS.
    """
    form = r"\A(\d{2})(\d{2,3})((?:-\d{1,2})*)-([0-9a-zA-Z]{3})(?:[_-].*)?\.[^.]*\z"
    part = lambda k: F.regexp_extract(name, form, k)
    kind = F.coalesce(doc_type, F.lit("TS")) if doc_type is not None else F.lit("TS")
    token = F.lower(part(4))
    return F.when(part(1) != "", F.struct(F.concat(kind, F.lit(" "), part(1), F.lit("."), part(2), part(3)).alias("spec_id"), token.alias("token"), _digit(token, 1).alias("release")))


def fresh_listing(spark: SparkSession, path: str, max_age_hours: float = 24) -> DataFrame | None:
    """``line`` of a kept listing that is young enough and not empty, else null."""
    import time

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or time.time() - files.getFileStatus(at).getModificationTime() / 1000 > max_age_hours * 3600:
        return None
    lines = entry_lines(spark, path)
    return None if lines.isEmpty() else lines


def members(archives: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """``path, name, data, error`` of a ``binaryFile`` table of ZIP archives: a row for each file inside.

    A file that says it is larger than ``most_bytes``, or an archive that can't be read, is a row with
    its ``error`` and without data. Names lose their folders; ``.`` and ``..`` are no names.
    """

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for entry in archive.infolist():
                    name = entry.filename.replace("\\", "/").rsplit("/", 1)[-1]
                    if entry.is_dir() or name in ("", ".", ".."):
                        continue
                    if entry.file_size > most_bytes:
                        yield path, name, None, f"{entry.file_size} bytes are too many"
                        continue
                    with archive.open(entry) as file:
                        data = file.read(most_bytes + 1)  # whatever the archive says
                    yield (path, name, data, None) if len(data) <= most_bytes else (path, name, None, "more bytes than it says")
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError) as error:
            yield path, None, None, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows_of(path, content):  # one file at a time
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["path", "name", "data", "error"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, data binary, error string")


def cover_last(files: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Adds ``file_order``: a document's files by name, its covers after all others."""
    order = Window.partitionBy(*by).orderBy(F.contains(F.col(name), F.lit("_cover")), name)
    return files.withColumn("file_order", F.row_number().over(order))


def with_doc_type(rows: DataFrame, known: DataFrame, key: str, spec_id: str = "spec_id") -> DataFrame:
    """Records under the document type that one of a document's files tells (``key, doc_type``): only the
    file with the cover knows it, and all files' records get one id. Ids of no type stay."""
    told = known.where("doc_type <> ''").groupBy(key).agg(F.max("doc_type").alias("_type"))
    typed = F.when(F.col("_type").isNotNull() & F.col(spec_id).rlike(r"\AT[SR] "), F.concat(F.col("_type"), F.substr(spec_id, F.lit(3)))).otherwise(F.col(spec_id))
    return rows.join(told, key, "left").withColumn(spec_id, typed).drop("_type")


def with_archive_version(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Records with the version, token and release of the archive entry that they came from, where it has
    them: what a document says of itself is a guess. A token of another form is itself the version."""
    said = entries.select(key, F.col("token").alias("_token"), F.col("release").alias("_release"))
    both = rows.join(said, key, "left")
    has, release = F.coalesce(F.col("_token"), F.lit("")) != "", F.coalesce(F.col("_release"), F.lit(0))
    changed = {"version": F.when(has, F.coalesce(token_to_dotted(F.col("_token")), F.col("_token"))).otherwise(F.col("version"))}
    if "version_token" in rows.columns:
        changed["version_token"] = F.when(has, F.col("_token")).otherwise(F.col("version_token"))
    if "release" in rows.columns:
        changed["release"] = F.when(release != 0, release.cast("string")).otherwise(F.col("release"))
    return both.withColumns(changed).select(rows.columns)
