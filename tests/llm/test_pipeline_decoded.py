"""The last stage decodes what it encodes."""

import hashlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_tokens_decode_to_the_text(spark):
    texts = [None, "", "plain words", " é 漢字 \U0001f600\n\n tabs\t", "x" * 3000] + [f"row {i}" for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.tokenise(spark, docs.coalesce(1), SF).collect()}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert all(r.n_tokens == len(r.ids) for r in got.values())
