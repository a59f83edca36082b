"""API descriptions as rows: parsed once, flattened into chunks, references resolved with joins."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schemas as s

TARGET = "struct<file:string,schema:string>"
PARTS = f"spec_id string, api_name string, filename string, kind string, name string, place int, body string, refs array<{TARGET}>, request {TARGET}, error string"
OWNER = ["spec_id", "api_name", "filename"]


def _dealt(docs: DataFrame) -> int:
    """Partitions for descriptions that take long to read."""
    spark = docs.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts(docs: DataFrame) -> DataFrame:
    """The schemas and operations of every description, ``body`` as JSON, with what they refer to; an
    operation's ``request`` is the schema of its body.

    A description that can't be read is one row with its ``error``. Reading takes far longer than moving
    a text, so descriptions are dealt to all cores first, however few files they come from.
    """
    names = ["spec_id", "api_name", "filename", "kind", "name", "place", "body", "refs", "request", "error"]
    target = pa.struct([("file", pa.string()), ("schema", pa.string())])
    types = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.list_(target), target, pa.string()]

    def rows_of(spec: str, api: str, filename: str, text: str | None) -> Iterator[tuple]:
        try:
            doc = s.read(text or "")
            found = [("schema", n, node, None) for n, node in s.schemas(doc)]
            found += [("operation", f"{m.upper()} {p}", node, s.request_schema(node)) for m, p, node in s.operations(doc)]
        except Exception as error:  # noqa: BLE001  bad rows are results here
            yield spec, api, filename, None, None, 0, None, [], None, str(error)
            return
        to = lambda ref: {"file": ref[0] or filename, "schema": ref[1]}
        for place, (kind, name, node, request) in enumerate(found):
            refs = [to(ref) for ref in dict.fromkeys(s.references(node))]
            yield spec, api, filename, kind, name, place, json.dumps(node, sort_keys=True, default=str), refs, request and to(request), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                piece = batch.slice(at, 100)
                rows = [row for doc in zip(*(piece.column(k).to_pylist() for k in range(4)), strict=True) for row in rows_of(*doc)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(*OWNER, "content").repartition(_dealt(docs)).mapInArrow(run, PARTS)


def resolved(found: DataFrame) -> DataFrame:
    """Adds ``targets`` to schemas (the bodies of those they refer to, by file and schema; one step) and
    ``asked`` to operations (their request's schema with its own targets).

    A reference without a file, or with the description's own, stays inside the description; of several
    descriptions in files of one name, the last by document and name is meant.
    """
    known = found.where("kind = 'schema'")
    last = found.where("filename <> ''").groupBy("filename").agg(F.max(F.struct("spec_id", "api_name")).alias("w"))

    # None of these tables has a bound, and many of their rows take few bytes on the way: sizes of shuffles
    # would have them collected by the driver, to be broadcast.
    def owned(rows: DataFrame) -> DataFrame:
        """``file, schema`` of the rows' references with the description that is meant."""
        own = F.col("file") == F.col("filename")
        rows = rows.join(last.select(F.col("filename").alias("file"), "w").hint("merge"), "file", "left")
        return rows.withColumns({"t_spec": F.when(own, F.col("spec_id")).otherwise(F.col("w.spec_id")), "t_api": F.when(own, F.col("api_name")).otherwise(F.col("w.api_name"))}).drop("w")

    named = [F.col("spec_id").alias("t_spec"), F.col("api_name").alias("t_api"), F.col("filename").alias("file"), F.col("name").alias("schema")]
    on, key = ["t_spec", "t_api", "file", "schema"], [*OWNER, "kind", "name"]
    refs = owned(known.select(*key, F.explode("refs").alias("r")).select(*key, "r.*"))
    targets = refs.join(known.select(*named, F.col("body").alias("target")).hint("merge"), on).groupBy(*key).agg(F.collect_list(F.struct("file", "schema", "target")).alias("targets"))
    schemas = known.join(targets.hint("merge"), key, "left")
    operations = owned(found.where("kind = 'operation'").withColumns({"file": F.col("request.file"), "schema": F.col("request.schema")}))
    asked = schemas.select(*named, F.struct(F.col("filename").alias("file"), F.col("name").alias("schema"), "body", "targets").alias("asked"))
    both = operations.join(asked.hint("merge"), on, "left").withColumn("targets", F.lit(None).cast(schemas.schema["targets"].dataType))
    columns = [*found.columns, "targets"]
    return schemas.select(*columns, F.lit(None).cast(asked.schema["asked"].dataType).alias("asked")).unionByName(both.select(*columns, "asked"))


def chunks(docs: DataFrame) -> DataFrame:
    """``ord, spec_id, api_name, filename, kind, name, body``: the searchable texts of all parts.

    ``ord`` follows file names and the places within a file. The parts are kept (on disk, made again if
    an executor is lost) until the session's cache is cleared: descriptions are read once.
    """
    found = parts(docs).where("error is null").persist(StorageLevel.DISK_ONLY)
    rows = resolved(found)

    @F.arrow_udf("string")
    def text(kind: pa.Array, name: pa.Array, filename: pa.Array, body: pa.Array, targets: pa.Array, asked: pa.Array) -> pa.Array:
        def described(schema: str, file: str, node: str, found: list | None) -> list[str]:
            bodies = {(t["file"], t["schema"]): json.loads(t["target"]) for t in found or ()}
            return s.describe(schema, json.loads(node), lambda f, x: bodies.get((f or file, x)))

        out = []
        for k, n, file, b, found, a in zip(*(c.to_pylist() for c in (kind, name, filename, body, targets, asked)), strict=True):
            if k == "schema":
                lines = described(n, file, b, found)
            else:
                lines = s.describe_operation(n, json.loads(b), described(a["schema"], a["file"], a["body"], a["targets"]) if a else None)
            out.append("\n".join(lines))
        return pa.array(out, pa.string())

    rows = rows.withColumn("body", text("kind", "name", "filename", "body", "targets", "asked"))
    # Numbers of places alone are sorted, in ranges; texts only meet their numbers.
    place = ["filename", "spec_id", "api_name", "place"]
    order = found.select(*place).orderBy(*place).withColumn("ord", F.monotonically_increasing_id())
    return rows.join(order.hint("merge"), place).select("ord", *OWNER, "kind", "name", "body")


def listing(docs: DataFrame, spec_id: str | None = None) -> DataFrame:
    rows = docs if not spec_id else docs.where(F.col("spec_id") == spec_id)
    return rows.select("spec_id", "api_name", "version", "filename").orderBy("spec_id", "api_name")


def find(docs: DataFrame, spec_id: str, name: str) -> DataFrame:
    """A description by its name, whatever the case, or its file's name with or without the extension:
    the exact name first."""
    file = F.regexp_replace(F.lower("filename"), r"\.ya?ml\z", "")
    wanted = F.regexp_replace(F.lower(F.lit(name)), r"\.ya?ml\z", "")
    fit = (F.lower("api_name") == name.lower()) | (file == wanted)
    rank = F.when(F.col("api_name") == name, 0).when(F.lower("api_name") == name.lower(), 1).otherwise(2)
    return docs.where((F.col("spec_id") == spec_id) & fit).orderBy(rank, "api_name").limit(1)


def owners(found: DataFrame, schema: str) -> DataFrame:
    """The descriptions that define a schema of this name, whatever the case."""
    return found.where((F.col("kind") == "schema") & (F.lower("name") == schema.lower())).select("spec_id", "api_name", "name").distinct().orderBy("spec_id", "api_name", "name")


def restricted(docs: DataFrame, path: str | None = None, schema: str | None = None) -> DataFrame:
    """Adds ``part``, the description cut to a path or schema as YAML, or ``error``. Descriptions are dealt
    to all cores first, as by ``parts``."""

    @F.arrow_udf("struct<part:string,error:string>")
    def cut(content: pa.Array) -> pa.Array:
        parts, errors = [], []
        for text in content:
            part = error = None
            try:
                part = s.written(s.restrict(s.read(text.as_py() or ""), path, schema))
            except Exception as fault:  # noqa: BLE001  bad rows are results here
                error = str(fault)
            parts.append(part)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(parts, pa.string()), pa.array(errors, pa.string())], ["part", "error"])

    return docs.repartition(_dealt(docs)).withColumn("_c", cut("content")).select("*", "_c.*").drop("_c")
