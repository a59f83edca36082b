"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts up to ``order`` bytes. In a context that was seen T times with q
different next bytes, a byte seen c times has probability c / (T + q), and q / (T + q) is left for an
escape to the next shorter context (method C). Bytes that the longer context could have given are
excluded there. Below the empty context all bytes not yet excluded are equally likely. Byte 255, which
UTF-8 never uses, stands before the text and once after its end, so that the probabilities of all
texts sum to one.

The model is trained beforehand and fixed while scoring. The bytes that follow a context also follow
its suffix, so the excluded bytes of any escape are those of the context just left: their number and
their weight one level below are constants of that context. A score is then a sum of table look-ups,
made for all positions of a batch at once.

Training counts (order + 1)-grams and words in each task, and adds the counts up by key. Words are
kept as 64-bit hashes (xxh3). Up to ``max_grams`` grams are broadcast. More of them stay a table, cut into
slices of contexts that end with the same two bytes: texts are dealt into blocks of about ``block_bytes``,
each block asks once for every distinct gram that it holds, a slice answers each gram that is asked for
once, and a join brings the answers back to the blocks. However large the model, texts are read twice
(to ask and to score), and nothing that grows with it meets on the driver. The most frequent words, at
most ``max_words``, are broadcast; the rest are looked up by a join, to which only the tokens that need it go.

Defined results: a null text is empty: one end token, scored as any text; a null id counts as the
empty string in the hold-out rule; repeated rows are learnt from, and scored, each on its own; without
training rows the model is uniform, N and V are 0; an empty table gives an empty table; further
columns are not returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import slices, written

EDGE = 255
GRAM, WORD = 0, 1
#: Hash under which the end of a text is counted among the words.
END = -(1 << 63)
#: Bytes of text handled at once, and distinct keys that a task gathers before it passes them on.
BLOCK_BYTES, GATHERED = 1 << 18, 1_000_000


def words(text: bytes) -> list[bytes]:
    """Runs without the six ASCII spaces, A-Z lower-cased."""
    return text.lower().split()


def word_key(word: bytes) -> int:
    key = xxhash.xxh3_64_intdigest(word) - (1 << 63)
    return key if key != END else END + 1


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte and at each end, and the lengths of the texts' shares.

    The context is in the high bits, its oldest byte first.
    """
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * order + x + edge for x in texts), np.uint8)
    counts = np.array([len(x) + 1 for x in texts], np.int64)
    size = len(data) - order
    keys = np.zeros(max(0, size), np.int64)
    for k in range(order + 1):
        keys <<= 8
        keys |= data[k : k + size]
    keep = np.ones(len(keys), bool)
    ends = np.cumsum(counts + order)[:-1]
    for k in range(order):
        keep[ends - 1 - k] = False
    return keys[keep], counts


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield start, k
            start, size = k, 0
        size += len(text) + 8
    if start < len(texts):
        yield start, len(texts)


def _pieces(texts: list[bytes], order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text of a piece with their grams, and how many of these are whose. A text that is a
    block of its own and longer than one comes in several pieces."""
    for a, b in _blocks(texts):
        if b - a > 1 or len(texts[a]) <= BLOCK_BYTES:
            yield a, b, *grams(texts[a:b], order)
            continue
        edge = bytes([EDGE])
        data = edge * order + texts[a] + edge
        for at in range(0, len(data) - order, BLOCK_BYTES):
            part = np.frombuffer(data[at : at + BLOCK_BYTES + order], np.uint8)
            keys = np.zeros(len(part) - order, np.int64)
            for k in range(order + 1):
                keys <<= 8
                keys |= part[k : k + len(keys)]
            yield a, b, keys, np.array([len(keys)])


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def count(docs: DataFrame, order: int) -> DataFrame:
    """``kind, key, n``: the grams and words of a text column, added up over all rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, vocabulary = [], 0, Counter()

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 65_536):
                part = slice(a, a + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part]), pa.array(n[part])], ["kind", "key", "n"])

        def of_words() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter((END if w == b"" else word_key(w) for w in vocabulary), np.int64, len(vocabulary))
            yield from rows(WORD, keys, np.fromiter(vocabulary.values(), np.int64, len(vocabulary)))
            vocabulary.clear()

        for batch in slices(batches, 0):
            texts = _texts(batch.column(0))
            for _, _, each, _ in _pieces(texts, order):
                keys, n = np.unique(each, return_counts=True)
                found.append((keys, n))
                held += len(keys)
                if held > GATHERED:
                    keys, n = _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, held = [(keys, n)], len(keys)
                    if held > GATHERED // 2:
                        yield from rows(GRAM, keys, n)
                        found, held = [], 0
            for a, b in _blocks(texts):
                for text in texts[a:b]:
                    vocabulary.update(words(text))
                vocabulary[b""] += b - a
                if len(vocabulary) > GATHERED // 3:
                    yield from of_words()
        if found:
            yield from rows(GRAM, *_sums(*(np.concatenate(x) for x in zip(*found, strict=True))))
        yield from of_words()

    return docs.mapInArrow(gather, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """The contexts of one length and the bytes seen after them."""

    events: np.ndarray  #: context and byte, sorted
    counts: np.ndarray
    contexts: np.ndarray  #: sorted
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray  #: the weight, one level below, of the bytes seen here


def _level(events: np.ndarray, counts: np.ndarray) -> Level:
    contexts = events >> 8
    first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(events) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, first) if len(events) else counts
    return Level(events, counts, contexts[first], total, np.diff(np.r_[first, len(events)]), np.zeros(len(first), np.int64))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes, if they are small enough."""
    return counts.astype(np.int32) if not len(counts) or counts.max() < 1 << 31 else counts


class Trie:
    """Contexts of up to ``order`` bytes, or those of a slice together with all of one byte or none."""

    def __init__(self, order: int, events: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        """``events`` are (order + 1)-grams, ``pairs`` all 2-grams of the corpus."""
        self.order, tables = order, {}
        for k in range(order, 1, -1):
            events, counts = _sums(events & ((1 << 8 * (k + 1)) - 1), counts)
            tables[k] = _level(events, counts)
        tables[1] = _level(*_sums(pairs, pair_counts))
        tables[0] = _level(*_sums(pairs & 255, pair_counts))
        for k in range(order, 0, -1):
            high, low = tables[k], tables[k - 1]
            weight = low.counts[np.searchsorted(low.events, high.events & ((1 << 8 * k) - 1))]
            first = np.cumsum(high.distinct) - high.distinct
            high.below = np.add.reduceat(weight, first) if len(first) else high.below
        self.levels = [tables[k] for k in range(order, -1, -1)]
        top = self.levels[0]
        owner = np.repeat(np.arange(len(top.contexts)), top.distinct)
        self.top = np.log10(top.counts / (top.total + top.distinct)[owner]) if len(owner) else np.zeros(0)
        top.counts = np.zeros(0, np.int64)  # no longer needed
        for level in self.levels:
            level.counts, level.total, level.distinct, level.below = map(_narrow, (level.counts, level.total, level.distinct, level.below))
        self.index: KeyIndex | None = None

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        if self.index is None:
            self.index = KeyIndex(self.levels[0].events)
        at = self.index.find(keys)
        out = np.where(at >= 0, self.top[at] if len(self.top) else 0.0, 0.0).astype(np.float64)
        open_ = np.flatnonzero(at < 0)
        keys = keys[open_]
        lost, excluded = np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        for k, level in enumerate(self.levels):
            key = keys & ((1 << 8 * (self.order - k + 1)) - 1)
            # What is still open at the longest context has no event there.
            event, hit = _search(level.events, key) if k else (open_, np.zeros(len(open_), bool))
            context, seen = _search(level.contexts, key >> 8)
            if not len(level.contexts):
                continue
            weight = level.total[context] - lost
            kinds = level.distinct[context] - excluded
            with np.errstate(divide="ignore", invalid="ignore"):
                if k:
                    out[open_[hit]] += np.log10(level.counts[event[hit]] / (weight + kinds)[hit])
                escape = np.log10(kinds / (weight + kinds))
            left = seen & ~hit & (kinds > 0)
            out[open_[left]] += escape[left]
            lost, excluded = np.where(seen, level.below[context], lost)[~hit], np.where(seen, level.distinct[context], excluded)[~hit]
            open_, keys = open_[~hit], keys[~hit]
        out[open_] -= np.log10(256 - excluded)
        return out


def _search(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KeyIndex:
    """Open addressing over distinct 64-bit keys, filled and searched for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, (3 * len(keys) // 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            kept = self.slots[at] == rest
            rest, at = rest[~kept], at[~kept] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at, rest, wanted = self._home(keys), np.arange(len(keys)), keys
        while len(rest):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == wanted)
            out[rest[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            rest, wanted, at = rest[more], wanted[more], at[more] + 1 & (1 << self.bits) - 1
        return out


class Vocabulary:
    """Words to broadcast: their keys, and the log10 of their counts plus one."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.logs, self.index = keys, np.log10(counts + 1.0), None

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = KeyIndex(self.keys)
        return self.index.find(keys)


def held_out(doc_id: Column, mod: int = 7, is_: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == is_


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    found = df.select(*columns).toArrow()
    return [np.ascontiguousarray(found.column(c).to_numpy()).astype(np.int64, copy=False) for c in columns]


def _slice(key: Column, slices_: int) -> Column:
    """Grams whose contexts end with the same two bytes are of one slice."""
    return (F.shiftright(key, 8).bitwiseAND(0xFFFF) % slices_).cast("int")


def _by_blocks(ids: DataFrame, counted: DataFrame, pairs, order: int, slices_: int, block_bytes: int) -> DataFrame:
    """``_row, score`` of ``_row, text``, by a model that no worker holds whole."""
    size = ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = ids.select("_row", "text", F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-size // block_bytes)))).alias("block"))

    def ask(block: pa.Table) -> pa.Table:
        number, found, held = block.column("block")[0].as_py(), [], 0
        for batch in block.to_batches():
            for _, _, keys, _ in _pieces(_texts(batch.column(1)), order):
                found.append(np.unique(keys))
                held += len(found[-1])
                if held > GATHERED:
                    found = [np.unique(np.concatenate(found))]
                    held = len(found[0]) // 2
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table({"block": np.full(len(keys), number, np.int64), "key": keys})

    asked = written(dealt.groupBy("block").applyInArrow(ask, "block long, key long"), "lm-asked")

    def answer(keys: pa.Table, model: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        trie = Trie(order, *(np.ascontiguousarray(model.column(c).to_numpy()) for c in ("key", "n")), *pairs.value)
        wanted = keys.column("key").to_numpy()
        return pa.table({"key": wanted, "log": np.concatenate([trie.logs(wanted[a : a + BLOCK_BYTES]) for a in range(0, len(wanted), BLOCK_BYTES)])})

    distinct = asked.select("key").distinct().withColumn("slice", _slice(F.col("key"), slices_)).groupBy("slice")
    model = counted.select("key", "n", _slice(F.col("key"), slices_).alias("slice")).groupBy("slice")
    known = distinct.cogroup(model).applyInArrow(answer, "key long, log double")

    def add_up(block: pa.Table, logs: pa.Table) -> pa.Table:
        order_ = np.argsort(logs.column("key").to_numpy(), kind="stable")
        keys, values = logs.column("key").to_numpy()[order_], logs.column("log").to_numpy()[order_]
        rows, sums = [], []
        for batch in block.to_batches():
            texts = _texts(batch.column(1))
            total = np.zeros(len(texts))
            for a, b, mine, counts in _pieces(texts, order):
                total[a:b] += np.add.reduceat(values[np.searchsorted(keys, mine)], np.cumsum(counts) - counts)
            rows.append(batch.column(0).to_numpy())
            sums.append(total)
        none = np.zeros(0)
        return pa.table({"_row": np.concatenate([none.astype(np.int64), *rows]), "score": np.concatenate([none, *sums])})

    return dealt.groupBy("block").cogroup(asked.join(known, "key").groupBy("block")).applyInArrow(add_up, "_row long, score double")


def score(docs: DataFrame, train: Column, *, order: int = 5, max_grams: int = 4_000_000, max_words: int = 2_000_000, block_bytes: int = 64 << 20) -> DataFrame:
    """Scores ``doc_id, text``; learns from the rows where ``train`` holds.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~train).alias("held_out"))
    table = written(count(rows.where("not held_out").select("text"), order), "lm")
    grams_, words_ = table.where(f"kind = {GRAM}"), table.where(f"kind = {WORD}")

    # Words seen at least 2^j times, for each j; the smallest j is taken at which they can be broadcast.
    sizes = words_.groupBy(F.floor(F.log2("n")).cast("int").alias("j")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r.n for r in sizes), sum(r.words for r in sizes)
    j = next(j for j in range(64) if sum(r.words for r in sizes if r.j >= j) <= max_words)
    often = 1 << j
    known = spark.sparkContext.broadcast(Vocabulary(*_arrays(words_.where(F.col("n") >= often), "key", "n")))
    endings = words_.where(F.col("key") == END).select("n").collect()
    end_log = math.log10(endings[0].n + 1) if endings else None
    floor = math.log10(total + distinct + 1)

    n_grams = grams_.count()
    pairs = spark.sparkContext.broadcast(_arrays(grams_.groupBy((F.col("key").bitwiseAND(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")), "key", "n"))
    ids, columns = rows.withColumn("_row", F.monotonically_increasing_id()), "_row long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<key:long,n:long>>"
    if n_grams <= max_grams:
        trie = spark.sparkContext.broadcast(Trie(order, *_arrays(grams_, "key", "n"), *pairs.value))
        scored = ids.mapInArrow(_scorer(trie, known, end_log, often), columns)
        scored = written(scored, "lm-scored") if often > 1 else scored
    else:
        ids = written(ids, "lm-rows")
        sums = written(_by_blocks(ids, grams_, pairs, order, min(1 << 16, -(-4 * n_grams // max_grams)), block_bytes), "lm-sums")
        counted = ids.mapInArrow(_scorer(None, known, end_log, often), columns).drop("score")
        scored = written(counted.join(sums, "_row"), "lm-scored")
    if often > 1:
        rare = scored.where(F.size("rare") > 0).select("_row", F.explode("rare").alias("w")).select("_row", "w.key", F.col("w.n").alias("times"))
        rare = rare.join(words_.where(F.col("n") < often), "key").groupBy("_row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_base"))
        scored = scored.join(rare, "_row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("rare_known", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("rare_base", F.lit(0.0)))
    return scored.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )


def _scorer(trie, known, end_log: float | None, often: int):
    """Scores batches of ``doc_id, text, held_out, _row``; without a trie all scores are 0."""
    rare_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def of_words(texts: list[bytes], held: list[bool]) -> list[tuple]:
        """n_tokens, n_known, summed logs and the words that a join must look up."""
        logs = known.value.logs
        tokens = [words(x) for x in texts]
        sizes = [len(x) for x in tokens]
        flat = [w for t in tokens for w in t]
        distinct = list(dict.fromkeys(flat))
        keys = np.fromiter(map(word_key, distinct), np.int64, len(distinct))
        memo = dict(zip(distinct, range(len(distinct)), strict=True))
        which = np.fromiter(map(memo.__getitem__, flat), np.int64, len(flat))
        at = known.value.find(keys)
        value = np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0)
        out, start = [], 0
        for size, out_ in zip(sizes, held, strict=True):
            mine = which[start : start + size]
            start += size
            have = at[mine] >= 0
            n_known, base, rare = int(have.sum()), float(value[mine].sum()), None
            if often > 1 and n_known < size:
                if not out_ and often == 2:
                    # A training text's own word that was not seen twice was seen once.
                    base += (size - n_known) * math.log10(2)
                    n_known = size
                else:
                    k, n = np.unique(keys[mine[~have]], return_counts=True)
                    rare = [{"key": a, "n": b} for a, b in zip(k.tolist(), n.tolist(), strict=True)]
            out.append((size + 1, n_known + (end_log is not None), base + (end_log or 0.0), rare))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts, held = _texts(batch.column(1)), batch.column(2).to_pylist()
            sums, found = np.zeros(len(texts)), []
            for a, b, keys, counts in _pieces(texts, trie.value.order) if trie is not None else ():
                sums[a:b] += np.add.reduceat(trie.value.logs(keys), np.cumsum(counts) - counts)
            for a, b in _blocks(texts):
                found += of_words(texts[a:b], held[a:b])
            n_tokens, n_known, base, rare = zip(*found, strict=True) if found else ((), (), (), ())
            arrays = [batch.column(3), batch.column(0).cast(pa.string()), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums), pa.array(rare, rare_type)]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    return run
