"""Intermediate tables."""

import pytest

from specloom.llm import tables


def test_written_tables_are_removed(spark):
    rows = tables.written(spark.range(5).toDF("k"), "t")
    assert rows.count() == 5 and rows.schema.fieldNames() == ["k"]
    (path,) = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    tables.remove_written()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
