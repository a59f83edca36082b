"""Encoding against the public library's, whole and piece by piece."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from specloom.llm.bpe import Bpe, Tokenizer, packed_ids, read_ranks

PATHS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.fixture(scope="module", params=PATHS)
def coders(request):
    ranks = read_ranks(public_tokenizers.path(request.param))
    return Bpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(coders):
    mine, theirs = coders
    rng, tokens = random.Random(1), list(mine.ranks)
    for k in range(6000):
        if k % 2:
            text = b"".join(rng.choices(tokens, k=rng.randrange(1, 8))).decode("utf8", "ignore")
        else:
            text = "".join(rng.choices("abenthio  \n\t\r'sll\u00e9\u4e2d\u56fd\u306e\u0301\u200d\U0001f469\u00a0\x1c.,!?|12", k=rng.randrange(60)))
        ids = theirs.encode_ordinary(text)
        assert mine.encode(text) == ids, repr(text)
        assert mine.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "   ", "\n\n \n", "a  b   c", " a", "a ", "don't", "a" * 5000, "\u00e9" * 3000, "ab " * 2000, "x" + " " * 3000 + "y", "<|endoftext|>"])
def test_edges(coders, text):
    mine, theirs = coders
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_long_piece_takes_linear_time(coders):
    import time

    mine, _ = coders
    rng = random.Random(2)

    def seconds(n):
        text = "".join(rng.choices("abcdefghij", k=n))
        began = time.process_time()
        mine.encode(text)
        return time.process_time() - began

    seconds(1000)
    assert seconds(160_000) < 16 * max(seconds(20_000), 0.02)


def test_a_token_that_merges_never_make():
    singles = {bytes([b]): b for b in range(256)}
    ranks = singles | {b"ab": 256, b"bc": 257, b"abcd": 258}  # abcd has no two halves
    mine = Bpe(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcde", "abc", "xabcd", "abab"):
        assert mine.encode(text) == theirs.encode_ordinary(text)
    with pytest.raises(ValueError):
        mine.decode([999])
    with pytest.raises(ValueError):
        Bpe({b"a": 0}, public_tokenizers.PATTERN)


def test_columns(spark):
    path = public_tokenizers.path(PATHS[0])
    tokenizer = Tokenizer(spark, path, public_tokenizers.PATTERN)
    rows = [(1, "Hello w\u00f6rld"), (2, None), (3, ""), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit(1))
    both = tokenizer.decode(tokenizer.encode(df)).withColumn("packed", packed_ids(F.col("ids"))).collect()
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    assert sorted(str(r.doc_id) for r in both) == ["1", "2", "3", "3", "None"]
    for r in both:
        assert r.ids == theirs.encode_ordinary(r.text or "") and r.decoded == (r.text or "").encode()
        assert r.packed == b"".join(i.to_bytes(4, "little") for i in r.ids) and r.token == 1
    assert tokenizer.encode(df.limit(0)).count() == 0
    assert tokenizer.encode(df.withColumn("ids", F.lit("clash"))).where("doc_id = 1").first().ids == theirs.encode_ordinary(rows[0][1])
    with pytest.raises(ValueError):
        Tokenizer(spark, path, public_tokenizers.PATTERN, max_vocabulary_bytes=10)
    assert base64.b64encode(b"x")  # the file's form


def test_digests(spark):
    path = public_tokenizers.path(PATHS[0])
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    texts = ["Hello w\u00f6rld", None, "", " ".join(f"w{k * 7919}" for k in range(600_000)), "\u4e2d" * 9, *(f"row {k}" for k in range(2500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "more": F.lit(1)}).coalesce(1)
    out = Tokenizer(spark, path, public_tokenizers.PATTERN).digests(df)
    assert out.columns == ["doc_id", "more", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: r for r in out.collect()}
    for k, text in enumerate(texts):
        ids = theirs.encode_ordinary(text or "")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
