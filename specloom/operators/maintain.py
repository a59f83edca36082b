"""Keeping tables up to date: keyed replacement, superseding, cascades, cache eviction, atomic swaps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import alternate_id
from .references import edges


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the rows in place of those of equal keys (null equals null)."""
    new = rows.select([F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [table[k].eqNullSafe(new[f"_{k}"]) for k in keys]
    return table.join(new, same, "left_anti").unionByName(rows.select(table.columns))


def delete_document(tables: dict[str, DataFrame], spec_id: str, version: str) -> dict[str, DataFrame]:
    """All tables without a version of a document; citations of it by others stay."""
    own = {"specs": ("id", "version"), "edges": ("source_spec_id", "source_version")}
    out = {}
    for name, rows in tables.items():
        a, b = own.get(name, ("spec_id", "version"))
        out[name] = rows.where(~((F.col(a) == spec_id) & F.col(b).eqNullSafe(F.lit(version))))
    return out


def superseded(specs: DataFrame, incoming: DataFrame) -> DataFrame:
    """``id, version`` of documents that incoming ones replace: other versions of the same id, unless the
    incoming version is empty, and any version under the other document type."""
    new = incoming.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    same = specs.join(new, F.col("id") == F.col("_id")).where((F.col("_version") != "") & (F.col("version") != F.col("_version")))
    other = specs.join(new.withColumn("_other", alternate_id(F.col("_id"))), F.col("id") == F.col("_other"))
    return same.select("id", "version").unionByName(other.select("id", "version")).distinct()


def insert_documents(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``specs``, ``sections``, ``images`` and ``edges`` with new documents in place of what they supersede.

    Citations of replaced sections go; those of the new ones are ``new["edges"]``, or are read from
    ``new["sections"]``.
    """
    if "edges" in tables and "edges" not in new and "sections" in new:
        new = new | {"edges": edges(new["sections"])}
    old = superseded(tables["specs"], new["specs"]).select(F.col("id").alias("_i"), F.col("version").alias("_v"))
    gone = old.unionByName(new["specs"].select(F.col("id").alias("_i"), F.col("version").alias("_v"))).distinct()
    ids = {"specs": ("id", "version"), "edges": ("source_spec_id", "source_version")}
    out = {}
    for name, rows in tables.items():
        a, b = ids.get(name, ("spec_id", "version"))
        kept = rows.join(gone, (rows[a] == gone["_i"]) & rows[b].eqNullSafe(gone["_v"]), "left_anti")
        out[name] = kept.unionByName(new[name].select(rows.columns)) if name in new else kept
    return out


def merge_files(rows: DataFrame, by: Sequence[str], file_order: str, order: str) -> DataFrame:
    """Of rows that several files give for one key, the last file's, at the place of the first."""
    others = [c for c in rows.columns if c not in (*by, order, file_order)]
    merged = rows.groupBy(*by).agg(F.max(F.struct(file_order, order, *others)).alias("_r"), F.min(F.struct(file_order, order)).alias("_first"))
    return merged.select(*by, F.col(f"_first.{order}").alias(order), *(f"_r.{o}" for o in others))


def evict(entries: DataFrame, limit: int, keep: tuple[str, str] | None = None) -> DataFrame:
    """The cache entries that stay when the least recently used go until the bytes fit.

    Ties go by row order (``ord``), older first; the entry just fetched always stays. A negative limit
    keeps all.
    """
    if limit < 0:
        return entries
    fetched = F.lit(False) if keep is None else (F.col("spec_id") == keep[0]) & (F.col("version") == keep[1])
    # What is kept comes first; then the most recent as long as they fit. Days are added up first, so that
    # no task orders more than the entries of a day.
    marked = entries.withColumn("_fetched", fetched).withColumn("_day", F.when(F.col("_fetched"), F.lit(None)).otherwise(F.to_date(F.col("last_used_at").cast("timestamp"))))
    newest = (F.col("_day").isNull() & F.col("_fetched")).desc(), F.col("_day").desc_nulls_last()
    days = marked.groupBy("_day", "_fetched").agg(F.sum("bytes").alias("_bytes"))
    days = days.withColumn("_ahead", F.coalesce(F.sum("_bytes").over(Window.orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_day", "_fetched").orderBy(F.desc("last_used_at"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("_in", F.sum("bytes").over(inside)).alias("e").join(days.alias("d"), F.col("e._day").eqNullSafe(F.col("d._day")) & (F.col("e._fetched") == F.col("d._fetched")))
    return summed.where((F.col("d._ahead") + F.col("e._in") <= limit) | F.col("e._fetched")).select(*(F.col(f"e.{c}") for c in entries.columns))


def touch(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Entries with the last use that an access log knows of."""
    seen = log.groupBy("spec_id", "version").agg(F.max("used_at").alias("_used"))
    return entries.join(seen, ["spec_id", "version"], "left").withColumn("last_used_at", F.greatest("last_used_at", "_used")).drop("_used")


def sizes(sections: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``spec_id, version, bytes`` that a cached document takes."""
    own = sections.select("spec_id", "version", (F.octet_length("content") + F.octet_length("title")).cast("long").alias("b"))
    if images is not None:
        own = own.unionByName(images.select("spec_id", "version", (F.octet_length("data") + F.octet_length("name")).cast("long").alias("b")))
    return own.groupBy("spec_id", "version").agg(F.sum("b").alias("bytes"))


class _Place:
    """A published table's folder: row folders under fresh names, and a pointer file that names those that
    count. The pointer is replaced by one rename, so readers see the old rows or the new ones, and what a
    crash left behind is never read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.settings = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._at(self.path).getFileSystem(self.settings)

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def pointer(self) -> dict | None:
        at = self._at(f"{self.path}/current")
        if not self.files.exists(at):
            return None
        stream = self.files.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def switch(self, pointer: dict) -> None:
        """The new pointer takes the old one's place; folders that only the one before the old named go."""
        before = self.pointer() or {"folders": {}, "gone": []}
        pointer["gone"] = sorted(set(before["folders"].values()) - set(pointer["folders"].values()))
        fresh = self._at(f"{self.path}/next-{uuid.uuid4().hex}")
        stream = self.files.create(fresh)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        # The pointer is replaced in one step.
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self.settings).rename(fresh, self._at(f"{self.path}/current"), how)
        for folder in before["gone"]:
            self.files.delete(self._at(f"{self.path}/{folder}"), True)

    def write(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> dict[str, str]:
        """Folders of the buckets that have rows."""
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)
        version = f"rows-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
        found = self.files.listStatus(self._at(f"{self.path}/{version}"))
        names = [x.getPath().getName() for x in found if x.isDirectory()]
        return {n.removeprefix("_bucket="): f"{version}/{n}" for n in names if n.startswith("_bucket=")}

    def read(self, folders: Iterable[str], schema: str) -> DataFrame:
        paths, kind = [f"{self.path}/{f}" for f in folders], T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)


def publish(rows: DataFrame, path: str, keys: Sequence[str] = (), buckets: int = 64) -> None:
    """Replaces a whole table. With ``keys`` its rows are laid out in buckets for ``publish_changes``."""
    place = _Place(rows.sparkSession, path)
    place.switch({"schema": rows.schema.json(), "keys": list(keys), "buckets": buckets, "folders": place.write(rows, keys, buckets)})


def publish_changes(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Rows in place of those of equal keys in a published table, made if it isn't there. Only the buckets
    that the keys fall into are written again."""
    place = _Place(rows.sparkSession, path)
    old = place.pointer()
    if old is None:
        publish(rows, path, keys, buckets)
        return
    if list(keys) != old["keys"]:
        raise ValueError(f"{path} is laid out by {old['keys']}")
    touched = [str(r.b) for r in rows.select(F.pmod(F.xxhash64(*keys), F.lit(old["buckets"])).alias("b")).distinct().collect()]  # at most as many as buckets
    there = place.read([old["folders"][b] for b in touched if b in old["folders"]], old["schema"])
    fresh = place.write(upsert(there, rows, keys), keys, old["buckets"])
    place.switch(old | {"folders": {b: f for b, f in old["folders"].items() if b not in touched} | fresh})


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published table or index; ``LookupError`` where none is built."""
    place = _Place(spark, path)
    pointer = place.pointer()
    if pointer is None:
        raise LookupError(f"not built: {path}")
    return place.read(pointer["folders"].values(), pointer["schema"])


def drop(spark: SparkSession, path: str) -> bool:
    """Removes a published table or index, and says whether there was one; the pointer goes first."""
    place = _Place(spark, path)
    had = place.pointer() is not None
    place.files.delete(place._at(f"{place.path}/current"), False)
    place.files.delete(place._at(place.path), True)
    return had


def refresh(spark: SparkSession, path: str, rows: Callable[[], DataFrame], rebuild: bool) -> None:
    """After its texts changed, an index is built again or dropped; one that was never built stays so."""
    if _Place(spark, path).pointer() is not None:
        if rebuild:
            publish(rows(), path)
        else:
            drop(spark, path)


def limit_generation(spark: SparkSession, path: str, generation: int) -> bool:
    """Drops a cache that an older (or newer) layout of the library wrote; says whether it did."""
    place = _Place(spark, f"{path}/generation")
    kept = place.pointer()
    if kept is not None and kept.get("generation") == generation:
        return False
    files = place.files
    if files.exists(place._at(path)):
        files.delete(place._at(path), True)
    place.switch({"generation": generation, "folders": {}})
    return kept is not None
