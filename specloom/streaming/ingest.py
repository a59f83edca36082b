"""Tables kept up to date from streams: batches of changed documents, and the cache's access log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.maintain import publish_changes


def upsert_into(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that replaces rows of equal keys in a published table.

    Of several rows for a key in one batch the one with the greatest values counts. Only buckets with
    changed keys are written again. A batch that is given again, after a failure, leaves the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in keys]
        rows = batch.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, "_r.*").select(batch.columns)
        publish_changes(rows, path, keys)

    return apply


def ingest(changes: DataFrame, path: str, keys: Sequence[str], checkpoint: str) -> DataStreamWriter:
    return changes.writeStream.foreachBatch(upsert_into(path, keys)).option("checkpointLocation", checkpoint)


def last_uses(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The last use of each document and hour, from a stream of ``spec_id, version, used_at``."""
    hours = log.withWatermark("used_at", late).groupBy(F.window("used_at", "1 hour"), "spec_id", "version")
    return hours.agg(F.max("used_at").alias("used_at"), F.count("*").alias("uses")).select("spec_id", "version", "used_at", "uses", F.col("window.start").alias("hour"))
