"""Nearest neighbours by largest inner product: inverted lists scanned with early abandonment.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero: then
the largest inner product is the smallest Euclidean distance. A random rotation makes the first d
components of a difference a fair sample of all of them. Lists are the cells of centroids fitted on a
bounded sample (``sample_rows`` vectors), about ``list_factor`` times the root of all vectors many, as long
as the sample holds ``per_centroid`` vectors for each and a list would hold ``list_rows``. On the sample
the number of lists to probe is also set: the fewest that hold ``recall`` of its own true neighbours.
Every vector is indexed. A query whose probed lists hold too few vectors for k goes on to further lists,
nearest first.

Lists are probed in rounds, nearest first, each of more lists than the one before; a round begins with the
k-th best that the rounds before it found. Within a list the rotated vectors are read in chunks, and a
chunk in blocks of columns: after each block a hypothesis test (partial distance scaled to all dimensions
against the k-th best so far, with ``epsilon`` standard errors of slack) abandons the vectors that will not
be among the k nearest. The survivors' inner products are then computed on the original vectors in double
precision, component by component in order, so that equal vectors get equal scores, and tighten the k-th
best for the next chunk.

Lists and their queries are cut into tiles of bounded size, so a list that holds a third of all
vectors is as many tiles as it needs. Defined results: vectors that are null, zero, of another length
than most, or hold null or non-finite components take no part, nor do rows without an id; rows with an
equal id count as one, the smallest vector standing for it; with fewer than k candidates all are
returned; ties go to the smaller id; an empty table gives an empty table; further columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """What the driver fits: rotation, centroids of rotated vectors, and how many lists to probe."""

    rotation: np.ndarray
    centroids: np.ndarray
    largest: float  #: M squared
    probes: int

    def points(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their further component, rotated."""
        rest = np.sqrt(np.maximum(0.0, self.largest - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))]) @ self.rotation

    def order(self, points: np.ndarray) -> np.ndarray:
        """The lists of each point or query, nearest first."""
        return np.argsort(np.einsum("ij,ij->i", self.centroids, self.centroids) - 2 * points @ self.centroids.T, axis=1, kind="stable")


def fit(sample: np.ndarray, largest: float, lists: int, recall: float, k: int, seed: int) -> Index:
    """Centroids by Lloyd's rounds on the sample; probes by the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    index = Index(np.linalg.qr(rng.standard_normal((size, size)))[0], np.zeros((1, size)), largest, 1)
    points = index.points(sample)
    distinct = np.unique(points.round(9), axis=0)
    index.centroids = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(10):
        near = index.order(points)[:, 0]
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(sums))
        index.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], index.centroids)
    near = index.order(points)[:, 0]
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    ranks = np.argsort(index.order(index.queries(sample[asked])), axis=1)
    at = np.sort(np.take_along_axis(ranks, near[best], axis=1).ravel())
    index.probes = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1
    return index


def enough(sizes: np.ndarray, probes: int, k: int) -> np.ndarray:
    """How many of its lists, whose sizes are given nearest first, each query probes: ``probes``, and as
    many more as it takes to hold k vectors beside the query's own."""
    short = (np.cumsum(sizes, axis=1) <= k).sum(axis=1) + 1
    return np.minimum(np.maximum(probes, short), sizes.shape[1])


@dataclass
class Scan:
    """What a scan has found for each of its queries, and how much it did: pairs read, and pairs that a
    test abandoned before the last column."""

    query_ids: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    read: int
    abandoned: int


def _slack(seen: int, size: int, epsilon: float) -> float:
    """How far a distance scaled from ``seen`` of its columns may exceed the one to beat: ``epsilon``
    standard errors of a sample without replacement of rotated, so nearly normal, components."""
    return 1 + epsilon * (2 * (1 / seen - 1 / size)) ** 0.5 + 1e-6


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; ties go to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, beat: np.ndarray, k: int, epsilon: float, columns: int, chunk: int = 512) -> Scan:
    """The k best of a tile's vectors for each of its queries; ``beat`` is the score each has to reach.

    The vectors nearest to their centroids come first: they set a k-th best that most others miss early.
    """
    points, asks = index.points(x), index.queries(q)
    near = np.argsort(np.einsum("ij,ij->i", points - points.mean(axis=0), points - points.mean(axis=0)), kind="stable") if len(points) else np.zeros(0, int)
    points, ids, x = points[near], ids[near], x[near]
    size, abandoned = points.shape[1], 0
    norms = np.einsum("ij,ij->i", q, q) + index.largest
    out: list[tuple] = []
    for a in range(0, len(q), 64):
        part, best = slice(a, a + 64), beat[a : a + 64].copy()
        mine, mine_ids, asked = asks[part], query_ids[part], q[part]
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for c in range(0, len(x), chunk):
            some, limit = points[c : c + chunk], (norms[part] - 2 * best) * (1 + 1e-9) + 1e-12
            # The first block of columns for all pairs, further ones for those still in question.
            seen = min(columns, size)
            first = some[:, :seen], mine[:, :seen]
            partial = (first[0] ** 2).sum(1)[None, :] + (first[1] ** 2).sum(1)[:, None] - 2 * first[1] @ first[0].T
            row, col = np.nonzero(partial * (size / seen) <= limit[:, None] * _slack(seen, size, epsilon) + 1e-9)
            partial, abandoned = partial[row, col], abandoned + partial.size * (seen < size) - len(row) * (seen < size)
            while seen < size and len(row):
                upto = min(seen + columns, size)
                difference = some[col, seen:upto] - mine[row, seen:upto]
                partial = partial + np.einsum("ij,ij->i", difference, difference)
                seen = upto
                keep = partial * (size / seen) <= limit[row] * _slack(seen, size, epsilon) + 1e-9
                abandoned += (len(keep) - int(keep.sum())) * (seen < size)
                row, col, partial = row[keep], col[keep], partial[keep]
            keep = ids[c + col] != mine_ids[row]
            row, col = row[keep], c + col[keep]
            score = np.zeros(len(row))
            for d in range(x.shape[1]):
                score += asked[row, d] * x[col, d]
            held = _best(*(np.concatenate(pair) for pair in zip(held, (row, ids[col], score), strict=True)), k)
            # Whoever has k by now has a k-th best to beat.
            starts, ends = (np.searchsorted(held[0], np.arange(len(mine)), side=s) for s in ("left", "right"))
            full = ends - starts >= k
            best[full] = np.maximum(best[full], held[2][ends[full] - 1])
        out.append((mine_ids[held[0]], held[1], held[2]))
    found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return Scan(*found, read=len(x) * len(q), abandoned=abandoned)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def lists_for(n: int, list_factor: float, list_rows: int, sample_rows: int, per_centroid: int) -> int:
    """How many lists n vectors get."""
    return max(1, min(round(list_factor * n**0.5), n // list_rows, min(n, sample_rows) // per_centroid))


def search(vectors: DataFrame, *, query_every: int = 20, k: int = 20, recall: float = 0.96, sample_rows: int = 16_384, per_centroid: int = 8, list_factor: float = 0.3, list_rows: int = 40, rounds: Sequence[float] = (0.0, 0.1, 0.35), tile: int = 4096, epsilon: float = 2.6, columns: int = 16, seed: int = 7) -> DataFrame:
    """The ``k`` nearest of ``vec_id, embedding`` for every row whose id ``query_every`` divides.

    ``rounds`` says after which share of its probed lists each round of a query begins (at least one list
    later than the round before). Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = written(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    common = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.size("x") == common["size"])
    largest = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("x").toArrow()
    index = fit(_matrix(sample.column("x")), largest, lists_for(common["n"], list_factor, list_rows, sample_rows, per_centroid), recall, k, seed)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            near = shared.value.order(shared.value.points(x))[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["vec_id", "x", "list"])

    placed = written(rows.select("vec_id", "x").mapInArrow(place, "vec_id long, x array<double>, list int"), "placed")
    held = np.zeros(len(index.centroids), np.int64)
    for row in placed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list
        held[row["list"]] = row["n"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = shared.value.order(shared.value.queries(_matrix(batch.column(1)))).astype(np.int32)
                probes = [o[:n] for o, n in zip(order, enough(held[order], shared.value.probes, k), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(probes, pa.list_(pa.int32()))], ["query_id", "x", "probes"])

    asked = placed.where(F.col("vec_id") % query_every == 0).select("vec_id", "x")
    asked = written(asked.mapInArrow(ask, "query_id long, x array<double>, probes array<int>"), "asked")

    def tiles(wanted: DataFrame) -> DataFrame:
        """The scans of ``query_id, x, list, beat`` against their lists."""
        # Both counts have a row for each list, of which the sample bounds the number.
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / tile).alias("row_tiles")).join(wanted.groupBy("list").agg(F.ceil(F.count("*") / tile).alias("query_tiles")), "list")
        sizes = F.broadcast(sizes)
        left = placed.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), "row_tiles").alias("r"), F.explode(F.sequence(F.lit(0), F.col("query_tiles") - 1)).alias("c"), "vec_id", "x")
        right = wanted.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("row_tiles") - 1)).alias("r"), F.pmod(F.xxhash64("query_id"), "query_tiles").alias("c"), "query_id", F.col("x").alias("y"), "beat")

        def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
            if not rows.num_rows or not queries.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            beat = queries.column("beat").to_numpy()
            found = scan(shared.value, rows.column("vec_id").to_numpy(), _matrix(rows.column("x")), queries.column("query_id").to_numpy(), _matrix(queries.column("y")), beat, k, epsilon, columns)
            return pa.table({"query_id": found.query_ids, "vec_id": found.ids, "score": found.scores})

        return left.groupBy("list", "r", "c").cogroup(right.groupBy("list", "r", "c")).applyInArrow(run, FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # The list at place p (from 1) is of the last round whose beginning it has reached.
    begins = [F.greatest(F.lit(r), F.ceil(F.size("probes") * F.lit(float(share)))) for r, share in enumerate(rounds)]
    round_of = lambda p: sum(((p > begin).cast("int") for begin in begins[1:]), F.lit(0))
    probes = F.transform("probes", lambda x, i: F.struct(x.alias("list"), round_of(i + 1).alias("round")))
    wanted, found = asked.select("query_id", "x", F.explode(probes).alias("p")).select("query_id", "x", "p.list", "p.round"), None
    for r in range(len(rounds)):
        here = wanted.where(F.col("round") == r).drop("round")
        if found is None:
            here = here.withColumn("beat", F.lit(float("-inf")))
        else:
            beat = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
            here = here.join(beat, "query_id", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
        new = tiles(here)
        found = best(new if found is None else found.drop("rank").unionByName(new))
        found = written(found, "found") if r + 1 < len(rounds) else found
    return found.select("query_id", "rank", "vec_id", "score")
