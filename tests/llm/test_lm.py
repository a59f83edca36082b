"""The vectorised model against a direct walk of the context trie."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from specloom.llm import lm

TEXTS = ["abracadabra", "abra abra\ncadabra", "", None, "éa éa éb", "zebra", "Abra ABRA x", "  ", "abracadabra", "q" * 300, "mixed\x0bwords\tand é"]


def contexts_of(train: list[bytes], order: int) -> dict:
    """The bytes seen after each context."""
    seen = defaultdict(Counter)
    for t in train:
        data = bytes([255]) * order + t + bytes([255])
        for at in range(order, len(data)):
            for k in range(order + 1):
                seen[data[at - k : at]][data[at]] += 1
    return seen


def walk(train: list[bytes], text: bytes, order: int, seen: dict | None = None) -> float:
    """log10 of the probability of a text, byte by byte."""
    seen = contexts_of(train, order) if seen is None else seen
    total, data = 0.0, bytes([255]) * order + text + bytes([255])
    for at in range(order, len(data)):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            here = {b: n for b, n in seen[data[at - k : at]].items() if b not in excluded}
            whole = sum(here.values()) + len(here)
            if data[at] in here:
                total += math.log10(here[data[at]] / whole)
                break
            if here:
                total += math.log10(len(here) / whole)
                excluded |= here.keys()
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize(("order", "max_grams", "max_words"), [(5, 10**6, 10**6), (3, 20, 10**6), (2, 10**6, 3), (4, 15, 5), (5, 10**6, 9)])
def test_scores_equal_a_direct_walk(spark, order, max_grams, max_words):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in lm.score(docs, ~lm.held_out(F.col("doc_id")), order=order, max_grams=max_grams, max_words=max_words, block_bytes=60).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    assert any(held.values()) and not all(held.values())
    train = [(t or "").encode() for i, t in rows if not held[i]]
    tokens = lambda t: [*t.lower().split(), None]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        text = (t or "").encode()
        got = out[i]
        assert got.held_out == held[i] and got.train_tokens == n
        assert got.n_tokens == len(tokens(text))
        assert got.n_known == sum(counts[w] > 0 for w in tokens(text))
        assert got.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(text)), abs=1e-8)
        assert got.score == pytest.approx(walk(train, text, order), abs=1e-8)


def test_next_bytes_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abcabd"), (3, "abx")], "doc_id long, text string")
    table = lm.count(docs.select("text"), 3).where("kind = 0").toPandas().sort_values("key")
    keys, n = table.key.to_numpy(), table.n.to_numpy()
    trie = lm.Trie(3, keys, n, *lm._sums(keys & 0xFFFF, n))
    for context in (b"abc", b"xab", b"zzz", b"\xff\xffa"):
        import numpy as np

        base = int.from_bytes(context) << 8
        assert (10 ** trie.logs(np.arange(256) + base)).sum() == pytest.approx(1)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(docs, F.lit(False)).collect()}
    assert out[1].score == pytest.approx(-3 * math.log10(256)) and out[1].train_tokens == 0 and out[1].n_known == 0
    assert out[1].base_score == 0.0 and out[None].n_tokens == 1
    assert lm.score(docs.limit(0), ~lm.held_out(F.col("doc_id"))).count() == 0


@pytest.mark.parametrize("max_grams", [10**6, 50])
def test_long_texts_and_repeated_ids(spark, max_grams):
    """Texts longer than a block of bytes come in pieces; rows that share an id are scored each on its own."""
    rows = [(1, "ab cd " * 180_000), (1, "ab cd"), (1, "ab cd"), (None, "cd"), (None, None), (4, "\u00e9" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "_row": F.lit(7), "held_out": F.lit(1)})
    out = lm.score(docs, ~lm.held_out(F.col("doc_id")), max_grams=max_grams).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [(t or "").encode() for i, t in rows if not held(i)]
    seen = contexts_of(train, 5)
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len((t or "").split()) + 1) for i, t in rows)
    want = sorted(walk(train, (t or "").encode(), 5, seen) for i, t in rows)
    assert sorted(r.score for r in out) == pytest.approx(want, rel=1e-8)


def test_pieces_of_long_texts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "BLOCK_BYTES", 64)
    texts = [b"short", b"x" * 50 + bytes(range(200)), b"", b"y" * 64, b"z" * 65, b"end"]
    for order in (2, 5):
        mine: dict = {}
        for a, b, keys, counts in lm._pieces(texts, order):
            ends = np.cumsum(counts)
            for k, (low, high) in enumerate(zip(ends - counts, ends, strict=True)):
                mine[a + k] = [*mine.get(a + k, ()), *keys[low:high].tolist()]
        assert mine == {k: lm.grams([t], order)[0].tolist() for k, t in enumerate(texts)}
