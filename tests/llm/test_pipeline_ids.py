"""Near copies among rows whose ids repeat or are missing."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
A, B, C, D = "a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z v w"


def test_repeated_and_missing_ids(spark):
    rows = [(5, B), (3, A), (5, A), (5, B), (7, C), (7, D), (None, A), (None, C.upper()), (None, "new one in here now"), (None, "new one in here now"), (None, None), (None, None), (8, None), (9, None)]
    want = sorted(map(str, [(3, A), (5, B), (7, C), (7, D), (None, "new one in here now"), (None, None), (8, None), (9, None)]))
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key int").repartition(parts)
        got = corpus_pipeline.deduplicate(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == want
