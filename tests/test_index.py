"""A written index in blocks, and what is told from unpacked ones."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from specloom.functions.tokens import fold, prose_words, stem
from specloom.operators import fts


def _texts(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", "a b", "A-b c"]), " ".join(rng.choices(["a", "b", "running", "runs", "Größe", "x_y"], k=rng.randrange(60)))) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, title string, content string").repartition(2).cache()


def test_a_term_is_a_row_of_a_block(spark, tmp_path):
    index = fts.plain_index(_texts(spark), "doc_id", {"title": 5.0, "content": 1.0})
    written = index.write(f"file://{tmp_path}/index")
    rows = spark.read.parquet(f"file://{tmp_path}/index/postings").where("bucket >= 0").count()
    terms = index.postings.select("term").distinct().count()
    assert rows <= 16 * terms < index.postings.count()
    key = ["doc", "field", "pos", "term"]
    assert sorted(map(tuple, written.postings.select(key).collect())) == sorted(map(tuple, index.postings.select(key).collect()))
    want = index.postings.groupBy("term").agg(F.count("*"), F.countDistinct("doc"))
    assert sorted(map(tuple, written.terms().collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, index.terms().collect()))


def test_blocks_of_any_size(monkeypatch):
    texts = ["running runs", "", None, "the_cell the runs Größe", "a", "b " * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["t"] * 6), pa.array(texts)], ["doc", "f0", "f1"])
    found = []
    for most in (1, 5, 10**6):
        monkeypatch.setattr(fts, "BLOCK", most)
        got = []
        for block in fts._blocks(batch, prose_words, stem):
            for r in block.to_pylist():
                stops = [*r["starts"][1:], len(r["places"])]
                got += [(d, f, p, r["term"]) for d, f, a, b in zip(r["docs"], r["fields"], r["starts"], stops, strict=False) for p in r["places"][a:b]]
        found.append(sorted(got))
    want = [(k, f, p, stem(w)) for k, pair in enumerate(zip(["t"] * 6, texts, strict=True)) for f, x in enumerate(pair) for p, w in enumerate(prose_words(x or ""))]
    assert found == [sorted(want)] * 3


def test_groups_by_windows():
    rng = random.Random(9)
    for _ in range(500):
        k, distance = rng.randrange(2, 4), rng.randrange(4)
        starts = [sorted(rng.sample(range(25), rng.randrange(1, 8))) for _ in range(k)]
        sizes = [rng.randrange(1, 3) for _ in range(k)]
        windows = []
        for low in set().union(*starts):
            firsts = [min((x for x in s if x >= low), default=None) for s in starts]
            if None not in firsts and max(firsts) - min(x + n - 1 for x, n in zip(firsts, sizes, strict=True)) - 1 <= distance:
                windows.append((low, max(firsts)))
        assert fts.within(starts, sizes, distance) == [sum(any(a <= x <= b for a, b in windows) for x in s) for s in starts]


def test_folding_by_characters():
    assert [fold(x) for x in ("ÀÉ", "ABC", "İx", "áb")] == ["ae", "abc", "ix", "ab"]
