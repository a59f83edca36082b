"""Mixing, quality, neighbours and dialogues against direct versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import ann, chat, mixing, quality


def filled(sizes, weights, share, cap):
    """Targets by filling sources again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(cap * sizes[s] for s in full)) / (sum(weight[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize(("seed", "share", "cap"), [(1, 1.5, 2.0), (2, 0.4, 2.0), (3, 2.4, 3.0)])
def test_mix(spark, seed, share, cap):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        source = rng.choices(["a", "b", "B", "\u00e9", None, "tiny", "void"], [50, 20, 10, 10, 10, 2, 0])[0]
        rows.append((k if k % 50 else None, source, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200]))))
    rows += [(1000, "void", None), (1001, "void", " \t"), (1002, "a", "x y"), (1002, "a", "x y"), (1003, "a", "z\x0bz " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("taken", F.lit("clash"))
    got = mixing.plan(df, share=share, cap=cap).collect()
    sizes: dict = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes, (3, 1, 2), share, cap)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), len((t or "").split())) for i, s, t in rows)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= cap * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1
    again = mixing.plan(df.repartition(7), share=share, cap=cap).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.plan(df).count() == 0
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.taken) for r in mixing.plan(df).collect()] == [(0, 0.0, 0)]


def test_model_learns_singles_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    signal = 3 * (x[:, 0] > 0.6) - 2 * (x[:, 1] < 0.3) + 4 * ((x[:, 2] > 0.5) ^ (x[:, 3] > 0.5)) - 2
    y = (rng.random(6000) < 1 / (1 + np.exp(-signal))).astype(float)
    model = quality.train(x[:4000], y[:4000], n_pairs=2)
    assert (2, 3) in model.pairs
    p = model.scores(x[4000:])
    best = 1 / (1 + np.exp(-signal[4000:]))
    loss = lambda q: -np.mean(y[4000:] * np.log(q) + (1 - y[4000:]) * np.log(1 - q))
    assert loss(p) < loss(best) + 0.05


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x, y = rng.random((500, 3)), (rng.random(500) < 0.5).astype(float)
    model = quality.train(x, y, rounds=5, pair_rounds=3, n_pairs=2)
    for row, score in zip(x[:50], model.scores(x[:50]), strict=True):
        total = model.base
        at = [int(np.searchsorted(c, v, side="right")) for c, v in zip(model.cuts, row, strict=True)]
        total += sum(t[b] for t, b in zip(model.single, at, strict=True))
        total += sum(t[model.coarse[f][at[f]], model.coarse[g][at[g]]] for (f, g), t in zip(model.pairs, model.joint, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.train(x, np.ones(500)).scores(x).min() > 0.99 and quality.train(np.zeros((0, 3)), np.zeros(0)).scores(x)[0] == 0.5


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert ((scored.score >= 0.3) == (scored.quality == 1)).mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 50_000), (3, "word " * 50_000)], "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert {r.score for r in quality.score(docs.withColumn("score", F.lit("clash")), quality.Additive()).collect()} == {0.5}


def test_fitting_equals_a_direct_version():
    """Cyclic boosting row by row and cut by cut, without sums over bins."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((160, 3)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    rounds, pair_rounds, rate, damp, leaves, bins, coarse = 6, 4, 0.15, 5.0, 3, 8, 4
    model = quality.train(x, y, rounds=rounds, pair_rounds=pair_rounds, n_pairs=2, bins=bins, coarse=coarse, leaves=leaves, rate=rate)
    cuts = [sorted(set(np.quantile(x[:, f], [k / bins for k in range(1, bins)]).tolist())) for f in range(3)]
    bin_of = lambda f, v: sum(c <= v for c in cuts[f])
    b = [[bin_of(f, x[i, f]) for f in range(3)] for i in range(len(x))]
    n_bins = [len(c) + 1 for c in cuts]
    wide = [[k * min(coarse, n) // n for k in range(n)] for n in n_bins]
    raw = [math.log(y.mean() / (1 - y.mean()))] * len(x)

    def leaf(rows):
        """Sum of gradients and of weights."""
        p = [1 / (1 + math.exp(-raw[i])) for i in rows]
        return sum(y[i] - q for i, q in zip(rows, p, strict=True)), sum(q * (1 - q) for q in p)

    gain = lambda gw: gw[0] ** 2 / (gw[1] + damp)
    for _ in range(rounds):
        for f in range(3):
            spans = [(0, n_bins[f])]
            within = lambda a, z, f=f: [i for i in range(len(x)) if a <= b[i][f] < z]
            while len(spans) < leaves:
                found = [(gain(leaf(within(a, k))) + gain(leaf(within(k, z))) - gain(leaf(within(a, z))), a, z, k) for a, z in spans for k in range(a + 1, z)]
                best = max(found, key=lambda t: t[0])
                if best[0] <= 1e-9:
                    break
                spans.remove(best[1:3])
                spans += [(best[1], best[3]), (best[3], best[2])]
            steps = [(within(a, z), rate * g / (w + damp)) for a, z in spans for g, w in [leaf(within(a, z))]]
            for mine, step in steps:
                for i in mine:
                    raw[i] += step
    cell = [[wide[f][b[i][f]] for f in range(3)] for i in range(len(x))]

    def cross(f, g):
        """The best four quarters, with their gain."""
        best = (0.0, [])
        for p in range(max(wide[f])):
            for q in range(max(wide[g])):
                quarters = [[i for i in range(len(x)) if (cell[i][f] <= p) == low and (cell[i][g] <= q) == left] for low in (True, False) for left in (True, False)]
                total = sum(gain(leaf(rows)) for rows in quarters)
                best = max(best, (total, quarters), key=lambda t: t[0])
        return best

    pairs = sorted([(0, 1), (0, 2), (1, 2)], key=lambda fg: -cross(*fg)[0])[:2]
    assert model.pairs == pairs
    for _ in range(pair_rounds):
        for f, g in pairs:
            steps = [(mine, rate * s / (w + damp)) for mine in cross(f, g)[1] for s, w in [leaf(mine)]]
            for mine, step in steps:
                for i in mine:
                    raw[i] += step
    assert model.scores(x) == pytest.approx([1 / (1 + math.exp(-r)) for r in raw], abs=1e-9)


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours(spark, clustered):
    rng = np.random.default_rng(5)
    n, d = 3000, 24
    centres = rng.standard_normal((12, d)) * 3
    x = rng.standard_normal((n, d)) + (centres[rng.integers(0, 12, n)] if clustered else 0)
    x[500:1500] = x[500]  # a third are one vector
    x = x.astype(np.float32).astype(float)
    rows = [(k, x[k].tolist()) for k in range(n)]
    bad = [(9000, None), (9020, [0.0] * d), (9040, [float("nan")] * d), (9060, [1.0, None] + [0.0] * (d - 2)), (9080, [float("inf")] + [0.0] * (d - 1)), (9100, [1.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4).withColumn("x", F.lit(1))
    got = ann.search(df, list_rows=150, tile=200, sample_rows=2000).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == list(range(0, n, 20))
    hits = 0
    for q, mine in found.items():
        scores = np.zeros(n)
        for k in range(d):
            scores += x[:, k] * x[q, k]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(n), -scores))[:20]
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 21)) and len({m[1] for m in mine}) == 20
        assert all(m[2] == scores[m[1]] for m in mine)
        assert [m[1] for m in mine] == [m[1] for m in sorted(mine, key=lambda m: (-m[2], m[1]))]
        hits += len({m[1] for m in mine} & set(want.tolist()))
    assert hits >= 0.93 * 20 * len(found)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 2.0)]
    assert ann.search(df.limit(0)).count() == 0


def _rendered(rows, side, fixed=("system",)):
    """A dialogue's text and mask from one side, turn after turn."""
    text, mask = "", []
    clean = lambda x: x.replace("<|", "< |")
    for _, speaker, said in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", hashlib.md5(clean(r[2] or "").encode()).hexdigest())):
        name = "user" if speaker is None else clean(speaker) if speaker in fixed else "user name=" + clean(speaker).replace("\n", " ")
        text += "<|im_start|>" + ("assistant" if speaker == side else name) + "\n"
        begin = len(text)
        text += clean(said or "") + "<|im_end|>\n"
        mask += [(begin, len(text))] if speaker == side else []
    return text, mask


def test_perspectives(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob\n<|x", None), (1, 3, None, "who"), (1, 3, None, "who"), (1, 3, None, "\u00e9 else"), (2, 0, "system", "alone"), (None, 0, "x", "y"), (1, None, "x", "y"), (1, 5000, "ann", "late"), (3, -7, "z", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash"))
    got = {(r.conv_id, r.side, r.segment): r for r in chat.perspectives(df).collect()}
    assert sorted(got) == [(1, "ann", 0), (1, "bob\n<|x", 0), (3, "z", 0)]
    for (conv, side, _), r in got.items():
        mine = [x[1:] for x in rows if x[0] == conv and x[1] is not None]
        assert (r.text, [(s["begin"], s["end"]) for s in r.mask], r.n_turns) == (*_rendered(mine, side), len(mine))
        assert r.mask_chars == sum(b - a for a, b in _rendered(mine, side)[1])
    assert chat.perspectives(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [4 << 20, 3000])
def test_long_dialogues(spark, piece, monkeypatch):
    """Ten thousand turns, many of them equal: one rendering, or pieces that fit together."""
    monkeypatch.setattr(chat, "RANGE_ROWS", 700)
    rng = random.Random(4)
    rows = [(9, k // 3, rng.choice(["ann", "bob", "cy", "system", None]), rng.choice(["yes", "no", "w" * 40, None])) for k in range(10_000)]
    rows += [(8, 0, "ann", "short"), (8, 1, "cy", "too"), (9, 500, "dee", "once")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got: dict = {}
    for r in chat.perspectives(df, piece_chars=piece).collect():
        got.setdefault((r.conv_id, r.side), []).append(r)
    assert sorted(got) == [(8, "ann"), (8, "cy"), (9, "ann"), (9, "bob"), (9, "cy"), (9, "dee")]
    for (conv, side), pieces in got.items():
        pieces.sort(key=lambda r: r.segment)
        text, mask = _rendered([x[1:] for x in rows if x[0] == conv], side)
        assert "".join(r.text for r in pieces) == text and [(s["begin"], s["end"]) for r in pieces for s in r.mask] == mask
        assert len(pieces) == 1 if conv == 8 or piece > 100_000 else len(pieces) > 50 and max(len(r.text) for r in pieces) < piece + 200
