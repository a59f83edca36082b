"""Very long texts, clashing names and nulls in every column, operator by operator."""

import base64
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from specloom.llm import mixing, quality, urls, warc
from specloom.llm.minhash import near_duplicates
from specloom.llm.queries import URL_RULES
from specloom.llm.tables import new_folder

LONG = " ".join(f"w{k * 7919 % 100_003}" for k in range(90_000))
NAMES = ("node", "n", "v", "k", "sha", "size", "refers_to", "score", "key", "mark", "copies", "_row", "digest", "n_tokens", "ids", "path")


def clash():
    return {c: F.lit("clash") for c in NAMES}


def test_near_duplicates(spark):
    changed = LONG.replace("w7919 ", "other ", 1)
    half = " ".join(LONG.split()[:45_000])
    rows = [(1, LONG), (2, changed), (3, half), (4, LONG.upper()), (None, LONG), (5, None), (5, None), (6, "a b")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash()).repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("1", "1", True), ("2", "1", False), ("3", "3", True), ("4", "1", False), ("None", "None", True), ("5", "5", True), ("5", "5", True), ("6", "6", True)])


def test_warc(spark):
    rows = [(1, "u" * 5000, LONG * 3), (2, None, LONG * 3), (None, None, None), (None, "x", LONG * 3), (3, "", ""), (4, "z", None)]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clash()).repartition(2), new_folder(spark, "warc"))).collect()
    sha = base64.b32encode(hashlib.sha1((LONG * 3).encode()).digest()).decode()
    assert sorted((str(r.page_id), r.target_uri, r.payload_bytes, str(r.refers_to)) for r in got if r.target_uri is not None) == sorted([("1", "u" * 5000, len(LONG) * 3, "None"), ("None", "x", len(LONG) * 3, "None"), ("3", "", 0, "None"), ("4", "z", 0, "3")])
    assert [r.payload_digest for r in got if r.page_id in (1, 2)] == [sha, sha] and [r.refers_to for r in got if r.page_id == 2] == [1]


def test_revisits_by_a_join(spark, monkeypatch):
    """More groups of equal payloads than are broadcast."""
    rows = [(k, None, f"<p>{k % 40}</p>") for k in range(100)] + [(None, None, "<p>1</p>"), (7, None, "<p>7</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    plain = sorted(map(str, warc.plan(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, warc.plan(pages).collect())) == plain
    assert {r.page_id: (r.refers_to, r.html is None) for r in warc.plan(pages).collect() if r.page_id in (3, 43, 83)} == {3: (None, False), 43: (3, True), 83: (3, True)}


def test_quality_and_urls(spark):
    rows = [(1, LONG), (2, None), (None, ""), (1, "x"), (1, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.columns.count("score") == 1 and out.count() == 5
    pages = spark.createDataFrame([(None, None), (1, "http://" + "a." * 90_000 + "net/x")], "page_id long, url string").withColumns(clash())
    assert sorted(str(r.rule) for r in urls.judge(pages, URL_RULES, "allow").collect()) == ["None", "net/"]


def test_mixing_rows_without_ids(spark):
    """Rows that share an id, or have none, are spread by their texts; wholly equal rows are taken alike in sum."""
    rows = [(None, "a", f"t{k} x y") for k in range(3000)] + [(5, "a", "same one")] * 40 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == round(1.5 * (9000 + 80)) and all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, mixing.plan(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_last_stage(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, LONG, "en", "s", 1), (1, LONG, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash())
    out = corpus_pipeline.tokenise(spark, docs, "")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert sorted((str(r.doc_id), r.n_tokens == len(r.ids), r.decoded_sha256) for r in out.collect()) == sorted([("None", True, hashlib.sha256(b"").hexdigest())] + [("1", True, hashlib.sha256(LONG.encode()).hexdigest())] * 2)
