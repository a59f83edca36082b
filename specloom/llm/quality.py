"""Text quality by a generalised additive model with pairwise interactions.

Features are cut into bins by their quantiles. In every round each feature in turn gets a shallow
tree, fitted to the current logistic gradients of its own bins alone and added, damped, to its
look-up table; then the strongest pairs of features get tables of their own in the same way, by trees
that cut once in either feature. A score is the sum of one table entry per feature and per pair, so
whole batches are scored by additions of bins.

The model is fitted on the driver from at most ``sample_rows`` labelled rows, those smallest by a hash
of their id; everything else covers all rows. Features see nothing but the text.

Defined results: a null text is an empty one and is scored like any text; labelled rows with a null id
or label are not learnt from; contradicting labels of one id count as 0; without both labels among the
learnt rows every score is the share of 1 (1/2 without rows); of an id's several texts the least is
learnt from (null before all); repeated rows get equal scores; an empty
table gives an empty table; further columns pass through, and one named like the output is replaced.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import slices

#: Bytes counted together, each per byte of the text.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "high": bytes(range(128, 256)),
    "newline": b"\n", "pipe": b"|", "bang": b"!?", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "stop": b".", "comma": b",;:", "quote": b"\"'()-",
}
FEATURES = ("bytes", "words", "lines", *CLASSES, "word_length", "word_spread", "longest_word", "distinct_words", "commonest_word", "distinct_pairs", "distinct_lines", "entropy", "short_words")
_OF_BYTE = np.array([[b in members for members in CLASSES.values()] for b in range(256)], float)


def describe(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    counts = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in texts], float).reshape(-1, 256)
    sizes = counts.sum(1)
    share = counts / np.maximum(sizes, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    out = np.zeros((len(texts), len(FEATURES)))
    shape = np.zeros((len(texts), 9))
    for i, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        if not words:
            continue
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        seen = Counter(words)
        pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
        shape[i] = (n, len(lines), lengths.mean(), lengths.std(), lengths.max(), len(seen) / n, max(seen.values()) / n, pairs, len(set(lines)) / max(1, len(lines)))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(sizes), np.log1p(shape[:, 0]), np.log1p(shape[:, 1])
    k = 3 + len(CLASSES)
    out[:, 3:k] = share @ _OF_BYTE
    out[:, k : k + 7] = shape[:, 2:]
    out[:, k + 7] = entropy
    out[:, k + 8] = shape[:, 0] / np.maximum(sizes, 1)
    return out


@dataclass
class Additive:
    """Look-up tables over binned features; scores are sums of entries."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    joint: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  #: coarse bin of each bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f, table in enumerate(self.single):
            out += table[bins[:, f]]
        for (f, g), table in zip(self.pairs, self.joint, strict=True):
            out += table[self.coarse[f][bins[:, f]], self.coarse[g][bins[:, g]]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(x))))


def _step(gradient: np.ndarray, weight: np.ndarray, damp: float = 5.0) -> np.ndarray:
    return gradient / (weight + damp)


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over the ordered bins of one feature, as a value for each bin."""
    spans = [(0, len(gradient))]
    g, w = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 5.0)
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for span in spans:
            a, b = span
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = gain_of(a, at) + gain_of(at, b) - gain_of(a, b)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), span, int(at[k]))
        if best[1] is None:
            break
        a, b = best[1]
        spans.remove(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in spans:
        out[a:b] = _step(g[b] - g[a], w[b] - w[a])
    return out


def _cross(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut in either feature: its gain, and a value for each cell."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(gradient)
    corner = lambda t: (t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1])
    quarters = list(zip(corner(g), corner(w), strict=True))
    gain = sum(a * a / (b + 5.0) for a, b in quarters)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(gradient)
    for (a, b), cells in zip(quarters, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), strict=True):
        out[cells] = _step(a[i, j], b[i, j])
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, *, rounds: int = 250, pair_rounds: int = 60, n_pairs: int = 10, bins: int = 32, coarse: int = 8, leaves: int = 3, rate: float = 0.15) -> Additive:
    """Cyclic boosting on features ``x`` and labels ``y`` of 0 and 1."""
    model = Additive()
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        model.base = float(np.log(share / (1 - share)))
        return model
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    for f in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)))
        size = len(model.cuts[f]) + 1
        model.single.append(np.zeros(size))
        model.coarse.append(np.arange(size) * min(coarse, size) // size)
    at = model.bins(x)
    raw = model.raw(at)
    for _ in range(rounds):
        for f, table in enumerate(model.single):
            p = 1 / (1 + np.exp(-raw))
            update = rate * _shallow_tree(np.bincount(at[:, f], y - p, len(table)), np.bincount(at[:, f], p * (1 - p), len(table)), leaves)
            table += update
            raw += update[at[:, f]]
    # Pairs are ranked by what one cross-shaped tree would still gain over its single cuts.
    cells = np.column_stack([model.coarse[f][at[:, f]] for f in range(x.shape[1])])
    sizes = [int(c.max()) + 1 for c in model.coarse]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        key, shape = cells[:, f] * sizes[g] + cells[:, g], (sizes[f], sizes[g])
        return np.bincount(key, y - p, sizes[f] * sizes[g]).reshape(shape), np.bincount(key, p * (1 - p), sizes[f] * sizes[g]).reshape(shape)

    ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda fg: -_cross(*grids(*fg))[0])
    model.pairs = ranked[:n_pairs]
    model.joint = [np.zeros((sizes[f], sizes[g])) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for (f, g), table in zip(model.pairs, model.joint, strict=True):
            update = rate * _cross(*grids(f, g))[1]
            table += update
            raw += update[cells[:, f], cells[:, g]]
    return model


def held_out(doc_id: Column, mod: int = 5, is_: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == is_


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = 20_000) -> Additive:
    """The model from labelled rows that the hold-out rule leaves to learn from, ``sample_rows`` at most."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toArrow()
    if not chosen.num_rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    wanted = F.broadcast(spark.createDataFrame(chosen).withColumnRenamed("doc_id", "_id"))
    known = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    # Rows that repeat an id beyond the sample's size would have no bound: of each id one text is learnt from, the least.
    if known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = known.groupBy("doc_id").agg(F.min(F.struct("text", "_label")).alias("k")).select("doc_id", "k.*")
    known = known.select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x = describe([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    found = known.mapInArrow(run, "x array<double>, y int").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # whatever the order of arrival
    return train(x[order], y[order])


def score(docs: DataFrame, model: Additive, *, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(describe([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()])) for part in slices([pa.RecordBatch.from_arrays([texts], ["t"])], 0)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, scores(F.col(f"`{text}`")))
