"""Results written out: JSON lines, and pictures as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame, indent: bool = False) -> DataFrame:
    """``json``: each row as one object; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": str(indent).lower()}).alias("json"))


def write_json(rows: DataFrame, folder: str) -> None:
    """JSON lines, in files of the tasks that wrote them."""
    as_json(rows).write.mode("overwrite").text(folder)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """``spec_id, version, name, path`` of ``spec_id, version, name, data``: each picture as a file of its own.

    A picture is written under a fresh name and moved to its place when it is whole, so that a task that
    is run again leaves the same files. Names are escaped, so that none leads out of its folder. The files
    are written when the result is computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(4)]
            paths = []
            for *place, data in zip(*keys, batch.column(4), strict=True):
                path = f"{top}/{place[3]}"
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                fresh = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(fresh, compression=None) as out:
                    out.write(data.as_py() or b"")
                files.move(fresh, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(paths, pa.string())], ["spec_id", "version", "name", "path"])

    part = lambda c: F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("."), F.lit("%2E"))
    name = F.when(F.col("name").isin(".", ".."), part("name")).otherwise(F.url_encode("name"))
    file = F.concat_ws("/", part("spec_id"), part("version"), name).alias("file")
    return images.select("spec_id", "version", "name", file, "data").mapInArrow(run, "spec_id string, version string, name string, path string")
