"""Long lists worked off in several rounds against all pairs."""

import random

import pytest
from test_minhash import brute

from specloom.llm import minhash


def drifting(seed: int, chains: int, steps: int, length: int) -> list[tuple[int, str]]:
    """Chains of texts from one beginning, each with a few other words than the one before."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(200))
    base, texts = [word() for _ in range(length)], []
    for _ in range(chains):
        words = list(base)
        for _ in range(steps):
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(length)] = word()
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "chains", "steps", "length"), [(10, 3, 40, 40), (1, 10, 12, 20)])
def test_several_rounds_equal_all_pairs(spark, seed, chains, steps, length):
    rows = drifting(seed, chains, steps, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs, words=1, percent=80, short=4, pairs_per_node=1, pairs_at_least=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 1, 80)
