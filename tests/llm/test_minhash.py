"""Components against all pairs of exact sets."""

import random

import pytest

from specloom.llm import minhash


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        if words:
            sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets.get(i, ())), find(i)) for i, _ in rows}


def corpus(seed: int, copies: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    common = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    texts: list[str | None] = [None, "", "  \n", "one", "One", "two words", "two words", "a b c", "a b c d"]
    for _ in range(copies):  # a star of near copies around one document
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(rng.randrange(1, 200))] + common))
        words = texts[-1].split()
        for _ in range(3):
            k = rng.randrange(len(words))
            words[k : k + 1] = [] if rng.random() < 0.5 else [word()]
            texts.append(" ".join(words).upper())
    texts += [texts[20]] * 25
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "copies", "short", "per_node", "width"), [(1, 90, 64, 256, 4), (2, 120, 8, 1, 4), (3, 60, 4, 256, 5)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, copies, short, per_node, width):
    rows = corpus(seed, copies)
    want = brute(rows, width, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs, words=width, percent=80, short=short, pairs_per_node=per_node).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_chain_of_links(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 150), (7, 7)]
    roots = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {k: 1 for k in range(2, 61)} | {200: 100, 150: 100}


def test_null_ids_repeats_and_no_rows(spark):
    rows = [(None, "x y z w v"), (1, "x y z w v"), (1, "x y z w v"), (None, None), (5, "x y z w v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs, words=4).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("5", 2, "1", False), ("None", 0, "None", True), ("None", 2, "None", True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
