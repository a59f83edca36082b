"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Times are UTC; a map built from repeated keys keeps the last; plans adapt to sizes seen at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "specloom", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, one of this machine if all runs
    in one process, as in tests; ``ValueError`` on a cluster, whose executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="specloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores if their files are fewer than that (a file may be a single task): for work
    that takes far longer than moving a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df
