"""Each stage of the pipeline against a direct version of its decisions."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from specloom.llm import quality
from specloom.llm.bpe import read_ranks
from specloom.llm.tables import table, written

SF = "/root/testdata/sf0.001"


def near(rows, width=5, percent=80):
    """The smallest id that each document reaches by links between similar shingle sets."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        if words:
            sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}
    low = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "byte_bpe"]
    docs = table(spark, SF, "documents")
    columns = docs.columns

    judged = written(corpus_pipeline.judge(spark, docs, SF), "t")
    assert judged.columns == columns
    scores = {r.doc_id: r._s for r in quality.score(docs, quality.fit(docs, table(spark, SF, "labels")), out="_s").collect()}
    assert {r.doc_id for r in judged.collect()} == {i for i, s in scores.items() if s >= 0.3} and judged.count() < docs.count()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in judged.collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())

    unique = written(corpus_pipeline.deduplicate(spark, judged, SF), "t")
    assert unique.columns == columns
    low = near([(r.doc_id, r.text) for r in judged.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted({i for i, m in low.items() if i == m})

    mixed = written(corpus_pipeline.mix(spark, unique, SF), "t")
    assert mixed.columns == columns
    copies: dict = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    from specloom.llm import mixing

    for r in mixing.plan(unique).collect():
        assert copies.get(r.doc_id, 0) == (int(r.taken / r.size + 0.5) if r.size else 0)

    tokens = corpus_pipeline.tokenise(spark, mixed, SF).collect()
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(tokens) == mixed.count() and all(r.ids == theirs.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in tokens)


def test_stages_with_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "", "en", None, 0), (3, "A b c d e f g", "en", None, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    unique = corpus_pipeline.deduplicate(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in unique.collect()) == ["1", "2", "None"]
    from pyspark.sql import functions as F

    clash = docs.withColumns({"score": F.lit(0.0), "copies": F.lit(0), "id": F.lit(9), "taken": F.lit(1), "size": F.lit(1), "node": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, clash, SF).columns == clash.columns, name
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert {r.doc_id for r in mixed.collect()} <= {1, 3} and mixed.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
