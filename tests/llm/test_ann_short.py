"""Queries whose probed lists hold too few vectors, on clustered vectors."""

import numpy as np

from specloom.llm import ann


def test_every_query_gets_k(spark):
    rng = np.random.default_rng(3)
    n, d = 3000, 8
    # Large clusters far apart, so that few lists are probed, and some of three vectors each.
    sizes = [290] * 10 + [3] * 34
    at = np.repeat(np.arange(len(sizes)), sizes)[:n]
    centres = rng.standard_normal((len(sizes), d))
    centres *= 100 / np.linalg.norm(centres, axis=1)[:, None]
    x = rng.permutation(centres[at]) + 0.1 * rng.standard_normal((len(at), d))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    counts = {r.query_id: r["count"] for r in ann.search(df, query_every=5, list_rows=40, sample_rows=2000).groupBy("query_id").count().collect()}
    assert set(counts) == set(range(0, len(x), 5)) and set(counts.values()) == {20}


def test_enough_lists():
    sizes = np.array([[30, 1, 1, 1], [3, 0, 18, 1], [3, 0, 17, 1], [1, 1, 1, 1]])
    assert ann.enough(sizes, 1, 20).tolist() == [1, 3, 4, 4] and ann.enough(sizes, 2, 20).tolist() == [2, 3, 4, 4]


def test_candidates_are_abandoned_early():
    """On the vectors of the shared tables: the k-th best tightens chunk by chunk and list by list."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array(rows.column("embedding").to_pylist(), float)
    ids = rows.column("vec_id").to_numpy()
    n = ann.lists_for(len(x), 0.3, 40, 16_384, 8)
    assert n > 3 and ann.lists_for(4 * len(x), 0.3, 40, 16_384, 8) == 2 * n - 1 and ann.lists_for(10, 0.3, 40, 16_384, 8) == 1
    index = ann.fit(x, float((x * x).sum(1).max()), n, 0.96, 20, 7)
    ask = ids % 20 == 0
    found = ann.scan(index, ids, x, ids[ask], x[ask], np.full(ask.sum(), -np.inf), 20, 2.6, 16, chunk=64)
    assert found.read == len(x) * ask.sum() and found.abandoned > 0.03 * found.read
    scores = x[ask] @ x.T
    scores[np.arange(ask.sum()), np.flatnonzero(ask)] = -np.inf
    best = np.sort(scores, axis=1)[:, -20:]
    again = ann.scan(index, ids, x, ids[ask], x[ask], best[:, 0], 20, 2.6, 16, chunk=64)
    assert again.abandoned > found.abandoned
    for result in (found, again):
        hits = sum((result.scores[result.query_ids == i] >= b[0] - 1e-9).sum() for i, b in zip(ids[ask], best, strict=True))
        assert hits >= 0.9 * 20 * ask.sum()
