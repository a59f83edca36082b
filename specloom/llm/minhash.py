"""Near-duplicate documents by bottom-k sketches of word shingles.

One 64-bit hash orders all shingles; a document's sketch is its k smallest values. Documents with
equal sets are one class from the start, and only the smallest id of each class goes on. Inverted
lists of the retained values give the overlaps: of two sets with the wanted similarity, at least
``shared_at_least`` retained values are common, so a list need only hold a document under its rarest
values, and one whose values are mostly its own is in no list. Pairs are filtered by the similarity
of the union of their sketches, then the exact similarity of the full sets decides.

A list of up to ``short`` documents gives all its pairs. In a longer one, all are compared with its
centre, the document that shares most of its shingles; who is not linked to the list's largest
component then is held against every member outside its own component, in rounds of bounded size,
until nobody is left; who had a turn in one list has others in further lists, as largest components
change. Inside a component no pair can add a reachable document, so no link that matters is lost. Pairs are left out beforehand if they cannot reach the similarity, because too many shingles
of one occur in no other candidate, or because what both share with the centre and what they share
beside it would not be enough: of a group of n near copies about n pairs are compared.

``shared_at_least`` is six standard deviations below the mean number of common values of a pair just
at the threshold (a loss in less than one in 10^8 such pairs); sets smaller than the sketch are exact.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; fewer
words than a shingle make one shingle of all of them; rows with equal id count as one document, and a
row without id is linked with nothing and kept; repeated rows get equal results; an empty table gives
an empty table; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import merges, remove_written, slices, written, written_so_far

CACHED_WORDS = 200_000
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Candidate ids are broadcast up to this many (16 MB).
BROADCAST_IDS = 1_000_000


class Shingler:
    """Sets of word shingles as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.int64)
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            for k, value in enumerate(found):
                if value is None:
                    found[k] = self.cache[words[k]] = xxhash.xxh3_64_intdigest(words[k])
        one = np.array(found, np.uint64)
        width = min(self.words, len(one))
        out = np.full(len(one) - width + 1, np.uint64(width))
        for k in range(width):
            out *= MULTIPLY
            out += one[k : k + len(out)]
        out ^= out >> np.uint64(31)
        out *= MIX
        out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


def _kept(df: DataFrame, kind: str) -> DataFrame:
    """A table written after a shuffle: where Spark leaves small partitions as they are, in a few files."""
    return written(df, kind, small=not merges(df.sparkSession))


def _shared_at_least(k: int, percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(k * p - 6 * math.sqrt(k * p * (1 - p))))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def sets(docs: DataFrame, words: int) -> DataFrame:
    """``node, n, shingles`` of ``doc_id, text``; the shingles in order, so that they begin with the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 1):
            found = [shingler.hashes(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), _lists(found)], ["node", "n", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, n long, shingles array<long>")


def signatures(docs: DataFrame, words: int, k: int) -> DataFrame:
    """``doc_id, n, mark, sketch``: the size of the set, a 128-bit hash of it, and its k smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 1):
            sizes, marks, sketches = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingler.hashes(text or b"")
                sizes.append(len(found))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(found[:k].copy())  # the whole set goes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), _lists(sketches)], ["doc_id", "n", "mark", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, mark binary, sketch array<long>")


def overlaps(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``v, node, n, len``: each class under the rarest of its retained values, where others are too."""
    postings = classes.select("node", "n", F.explode("sketch").alias("v"))
    common = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = postings.join(common, "v").select("node", "n", "v", F.struct("df", "v").alias("rarity"))
    need = F.when(F.col("n") < F.lit(k * percent / 100), F.ceil(F.col("n") * percent / 100)).otherwise(_shared_at_least(k, percent))
    # A class's values that nobody shares are its rarest: they take the first places.
    held = held.groupBy("node", "n").agg(F.array_sort(F.collect_list("rarity")).alias("rare"))
    places = F.greatest(F.least(F.col("n"), F.lit(k)) - need + 1 - (F.least(F.col("n"), F.lit(k)) - F.size("rare")), F.lit(0)).cast("int")
    listed = _kept(held.select("node", "n", F.explode(F.slice("rare", F.lit(1), places)).alias("r")).select("node", "n", "r.v"), "lists")
    lengths = listed.groupBy("v").agg(F.count("*").alias("len")).where("len > 1")
    return listed.join(lengths, "v")


def _can_reach(a: str, b: str, percent: int) -> Column:
    """Whether the shingles that each of them shares with anybody would be enough."""
    least = F.least(F.col(f"{a}.free"), F.col(f"{b}.free"))
    return (100 + percent) * least >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, full: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that the sketches, and then the full sets, find similar enough."""
    right = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    left = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.join(right, "b").join(left, "a")
    ka, kb = F.slice("sa", 1, k), F.slice("sb", 1, k)
    union = F.slice(F.array_sort(F.array_union(ka, kb)), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect(ka, kb), union))
    near = estimate >= F.when(F.size(union) < k, F.lit(1)).otherwise(_shared_at_least(k, percent))
    inner = F.size(F.array_intersect("sa", "sb"))
    exact = (100 + percent) * inner >= percent * (F.size("sa") + F.size("sb"))
    return both.where(near & exact).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``a, b`` that are not the smallest of their component.

    Alternates two steps until nothing changes: link all larger neighbours of a node to its smallest
    neighbour, then all smaller ones. Only minima are gathered, so a node may have any number of links.
    """

    def smallest(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m"))

    def state(links: DataFrame) -> tuple:
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row.n, row.h

    links = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = smallest(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        links = _kept(small, "links")
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, k: int = 64, short: int = 64, pairs_per_node: int = 4096, pairs_at_least: int = 100_000) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of ``percent`` / 100 or more.

    Takes ``doc_id, text``; returns ``doc_id, n_shingles, component_id, kept`` for every row.
    """
    rows, earlier = docs.select("doc_id", "text"), written_so_far()
    marked = written(signatures(rows, words, k), "signatures")
    classes = marked.where("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n", "sketch"), "doc_id").alias("s"))
    classes = _kept(classes.select("mark", "node", "s.n", "s.sketch"), "classes")
    lists = _kept(overlaps(classes, k, percent), "overlaps")
    ids = lists.select("node").distinct()
    ids = _kept(ids.withColumnRenamed("node", "doc_id"), "candidates")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    full = _kept(sets(rows.join(wanted, "doc_id", "left_semi"), words), "sets")

    # Shingles of a candidate that no other candidate has cannot be common to a pair.
    owned = full.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    owned = owned.groupBy("node").agg(F.count("*").alias("own"))
    lists = _kept(lists.join(owned, "node", "left").withColumn("free", F.col("n") - F.coalesce("own", F.lit(0))).drop("own"), "lists")

    few = lists.where(F.col("len") <= short)
    pairs = few.alias("p").join(few.alias("q"), (F.col("p.v") == F.col("q.v")) & (F.col("p.node") < F.col("q.node")) & _can_reach("p", "q", percent)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    found = verified(pairs, full, k, percent)

    # Long lists: everyone against the list's centre, and what each has beside the centre's shingles.
    many = lists.where(F.col("len") > short)
    centre = many.groupBy("v").agg(F.min(F.struct((1 - F.col("free") / F.col("n")).alias("r"), "node")).alias("c")).select("v", F.col("c.node").alias("centre"))
    many = many.join(centre, "v")
    other = full.select(F.col("node").alias("centre"), F.col("shingles").alias("sc"))
    beside = many.select("centre", "node").distinct().join(full.select("node", "shingles"), "node").join(other, "centre")
    beside = beside.select("centre", "node", F.size(F.array_intersect("shingles", "sc")).alias("inner"), F.size("sc").alias("n_centre"), F.size("shingles").alias("n_node"), F.array_except("shingles", "sc").alias("rest"))
    beside = _kept(beside, "beside")
    starred = beside.where((F.col("node") != F.col("centre")) & ((100 + percent) * F.col("inner") >= percent * (F.col("n_centre") + F.col("n_node"))))
    starred = starred.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    links = _kept(found.unionByName(starred.distinct()), "edges")
    roots = components(links)

    # What is left of the long lists.
    keys = many.groupBy("node").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.max("len").alias("most"))
    many = _kept(many.join(keys, "node").join(beside.select("centre", "node", "inner", "rest"), ["centre", "node"]), "long")
    size, done = many.select("node").distinct().count(), None
    while size:
        now = _kept(many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "now")
        largest = now.groupBy("v", "root").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "root")).alias("g")).select("v", F.col("g.root").alias("main"))
        fewest = now.groupBy("v").agg(F.min("n").alias("n_min"))
        reach = (100 + percent) * F.col("free") >= percent * (F.col("n") + F.col("n_min"))
        outside = now.join(largest, "v").join(fewest, "v").where((F.col("root") != F.col("main")) & reach).drop("main", "n_min")
        # A list's main component changes from round to round, so who had a turn in one list may have another in the next.
        outside = outside if done is None else outside.join(done, ["v", "node"], "left_anti")
        outside = _kept(outside, "outside")
        work = outside.groupBy("node").agg(F.max("most").alias("most")).agg(F.sum("most")).first()[0] or 0
        if not work:
            break
        share = min(1.0, max(pairs_per_node * size, pairs_at_least) / work)
        turn = outside if share == 1 else outside.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
        # A pair that meets in several lists is taken from the first of them. Two sets have at most so much
        # in common as the lesser has with the centre, and what they have in common beside it.
        once = F.col("p.v") == F.array_min(F.array_intersect("p.vs", "q.vs"))
        inner = F.least("p.inner", "q.inner") + F.size(F.array_intersect("p.rest", "q.rest"))
        enough = (100 + percent) * inner >= percent * (F.col("p.n") + F.col("q.n"))
        more = turn.alias("p").join(now.alias("q"), (F.col("p.v") == F.col("q.v")) & (F.col("p.root") != F.col("q.root")) & _can_reach("p", "q", percent) & once & enough)
        more = more.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
        new = verified(more, full, k, percent)
        links = _kept(links.unionByName(new), "edges")
        roots = components(links)
        if share == 1:
            break
        had = turn.select("v", "node")
        done = _kept(had if done is None else done.unionByName(had), "done")
        pairs_per_node *= 4

    ends = _kept(classes.select("mark", "node").join(roots, "node", "left").select("mark", F.coalesce("root", "node").alias("component_id")), "ends")
    remove_written(earlier, [marked, ends])
    out = marked.where("n > 0 and doc_id is not null").select("doc_id", "n", "mark").join(ends, "mark", "left")
    rest = marked.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n", "component_id").unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
