"""URL rules, archives and media against direct versions."""

import base64
import fnmatch
import hashlib
import random
import re
import zlib

import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from specloom.llm import media, urls, warc
from specloom.llm.queries import URL_RULES
from specloom.llm.tables import new_folder


def test_globs_match_like_regular_expressions():
    rng = random.Random(1)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**", ".", "\u00e9"], k=rng.randrange(1, 9))) for _ in range(60)]
    forms = [re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", g)).encode().decode(), re.S) for g in globs]
    texts = ["".join(rng.choices("ab/.\u00e9", k=rng.randrange(12))) for _ in range(400)] + ["", "a" * 3000]
    for k in (1, 7, 60):
        found = urls.GlobSet(globs[:k]).first_match([t.encode() for t in texts])
        want = [next((j for j in range(k) if forms[j].fullmatch(t)), -1) for t in texts]
        assert found.tolist() == want


def direct(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls(spark):
    given = [None, "", "x", "http://", "http://net", "http://net/", "http://a.NET/x?y#z", "http://anet/", "https://Example.net/en/1", "http://example.net/enx", "http://x.example.net/en/", "http://a.example.com/de/", "http://example.com/de",
             "http://w.org/fr/?q", "http://w.org/FR/", "http://\u00c9.org/fr/\n", "a://b://net/", "http://evil.com/x.net/", "http://x?.net/", "http://x.net#/", "http://" + "a" * 5000 + ".net/" + "b" * 5000, "http://net/", "http://u:p@x.net:80/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "page_id long, url string").withColumn("extra", F.lit(1))
    for r in urls.judge(df, URL_RULES, "allow").collect():
        assert (r.host, r.path, r.rule, r.verdict) == direct(r.url), r.url
    assert urls.judge(df.limit(0), URL_RULES, "allow").count() == 0
    clash = urls.judge(df.withColumns({"host": F.lit(1), "rule": F.lit(2), "Verdict": F.lit(3)}), URL_RULES, "allow").collect()
    assert [(r.host, r.rule, r.verdict) for r in clash] == [(direct(u)[0], *direct(u)[2:]) for u in given]
    many = [urls.Rule("block", f"h{k}.test", "/") for k in range(300)]
    got = urls.judge(spark.createDataFrame([("http://a.h271.test/x",), ("http://h300.test/",)], "url string"), many, "allow").collect()
    assert [r.rule for r in got] == ["h271.test/", None]
    assert fnmatch is not None


@pytest.fixture
def pages(spark):
    rng = random.Random(3)
    texts = ["<p>" + " ".join(rng.choices(["alpha", "beta", "gamma", "\u00e9t\u00e9"], k=400)) + "</p>" for _ in range(60)]
    rows = [(k, f"http://h/{k}", texts[k % 40]) for k in range(100, 200)] + [(5, None, texts[0]), (7, "u\r\n%", None), (8, "", ""), (None, "n", texts[1]), (3, "d", texts[39]), (3, "d", texts[39])]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def test_archive_round_trip(spark, pages):
    rows, df = pages
    folder = new_folder(spark, "warc")
    manifest = warc.write(df, folder)
    got = warc.read(manifest).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = sorted((str(p), u, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), str(None if p is None or first[h or ""] == p else first[h or ""])) for p, u, h in rows)
    assert sorted((str(r.page_id), r.target_uri, r.payload_bytes, r.payload_digest, str(r.refers_to)) for r in got) == [(a, b, c, d, e) for a, b, c, d, e in want]
    assert all((r.record_type == "revisit") == (r.refers_to is not None) and (r.payload is None) == (r.record_type == "revisit") for r in got)
    # Files can be read without the manifest, and begin with the dictionary's frame.
    files, name = pyarrow.fs.FileSystem.from_uri(folder)
    infos = [f for f in files.get_file_info(pyarrow.fs.FileSelector(name)) if f.path.endswith(".warc.zst")]
    count = 0
    for info in infos:
        data = files.open_input_file(info.path).read()
        assert data[:4] == b"\x5d\x2a\x4d\x18" and warc.embedded_dictionary(data)[:4] == warc.DICTIONARY_MAGIC
        assert zstandard.get_frame_parameters(data[8 + int.from_bytes(data[4:8], "little") :]).dict_id
        count += sum(1 for raw in warc.records_of(data) if warc.parse(raw))
    assert count == len(rows)


def test_archive_edges(spark, pages):
    _, df = pages
    assert warc.archive(spark, df.limit(0)).count() == 0
    small = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "")], "page_id long, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive(spark, small).collect()} == {(1, None), (2, 1), (3, None)}
    assert {(r.page_id, r.refers_to) for r in warc.archive(spark, small, min_payload=2).collect()} == {(1, None), (2, None), (3, None)}
    lone = spark.createDataFrame([(None, None, "x")], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    assert [(r.page_id, r.payload) for r in warc.read(warc.write(small.unionByName(lone), folder)).orderBy("page_id").collect()] == [(None, b"x"), (1, b"a"), (2, None), (3, b"")]
    files, name = pyarrow.fs.FileSystem.from_uri(folder)
    for info in files.get_file_info(pyarrow.fs.FileSelector(name)):  # however few the records, there is a dictionary
        if info.path.endswith(".warc.zst"):
            data = files.open_input_file(info.path).read()
            assert b"WARC-Record-ID" in warc.embedded_dictionary(data) and all(warc.parse(x) for x in warc.records_of(data))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload", None, "d").replace(b"payload", b"Payload"))


def test_sequences():
    html = "<h1>T &amp; t</h1><p>one <b>two</b></p><figure><img src='sha256:ab' alt='A'><img src=b data-digest=cd><figcaption>both <i>x</i></figcaption></figure><script>no</script>tail<video src=v></video><img>"
    parts = media.sequence(html)
    assert [p["position"] for p in parts] == list(range(6))
    assert [(p["kind"], p["text"] or p["src"], p["digest"], p["caption"]) for p in parts] == [("text", "T & t", None, None), ("text", "one two", None, None), ("media", "sha256:ab", "ab", "both x"), ("media", "b", "cd", "both x"), ("text", "tail", None, None), ("media", "v", None, None)]
    assert media.sequence(None) == [] and media.sequence("<figure><img src=x>") [0]["caption"] is None


def test_samples():
    for text in (b"", b"a", b"x" * 576, b"y" * 577, bytes(range(256)) * 9):
        data = media.payload(text)
        assert len(data) % 576 == 0 and len(data) > 0 and data.startswith(text) and set(data[len(text) :]) <= {255}
        assert media.from_png(media.to_png(data)).tobytes() == data
    with pytest.raises(ValueError):
        media.from_png(b"no")
    broken = bytearray(media.to_png(media.payload(b"abc")))
    broken[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def test_media_by_digest(spark):
    rows = [(1, "same"), (2, "same"), (3, None), (4, "\u00e9" * 1000), (None, "same"), (5, ""), (6, "x" * 4608), (7, "z" * 700_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).repartition(3)
    stored = media.store(df)
    assert stored.columns == ["doc_id", "n_bytes", "key", "blocks"]
    seen = {bytes(r.key): r for r in media.examine(stored).collect()}
    assert len(seen) == 5
    for r in stored.collect():
        text = (dict(rows).get(r.doc_id) or "").encode()
        data, found = media.payload(text), seen[bytes(r.key)]
        assert (r.n_bytes, r.key) == (len(text), hashlib.sha256(text).digest())
        assert (found.payload_bytes, found.payload_sha256, found.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        blocks = [data[a : a + media.BLOCK_BYTES] for a in range(0, len(data), media.BLOCK_BYTES)]
        assert [b.digest for b in r.blocks] == [b.digest for b in found.blocks] == [hashlib.sha256(b).hexdigest() for b in blocks]
        forms = b"".join(map(media.to_png, blocks))
        assert (found.media_bytes, found.media_sha256) == (len(forms), hashlib.sha256(forms).hexdigest())
        assert [b.look for b in found.blocks] == [media.look(media.from_png(media.to_png(b))) for b in blocks]
    some = next(r for r in stored.collect() if r.doc_id == 1).blocks[0].digest
    docs = spark.createDataFrame([(1, f"<p>a</p><figure><img src='sha256:{some}'><figcaption>c</figcaption></figure><img src='sha256:00'><img src='x'>"), (2, None)], "k long, html string").withColumn("parts", F.lit("clash"))
    shown = media.resolve(media.references(media.parse(docs), ["k"]), media.looks(media.examine(stored))).orderBy("position").collect()
    assert [(r.position, r.caption, r.look is not None) for r in shown] == [(1, "c", True), (2, None, False), (3, None, False)]
    assert media.examine(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    with pytest.raises(ValueError):
        media.store(df, 100)


def test_articles_interleave(spark):
    """Paragraphs and payload blocks in turn, whatever there are more of; digests as they are stored."""
    texts = [None, "", "one line", "a & b\n<p>\n\nlast", "w" * 10_000, "long " * 2000 + "\nshort\n" + "\u00e9" * 4000, "\n".join(f"line {k}" for k in range(1800)), "x" * 4608]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    stored = {r.doc_id: r for r in media.store(df.select(F.col("k").alias("doc_id"), "text")).collect()}
    for r in media.parse(df.withColumn("html", media.article(F.col("text")))).withColumn("key", media.key_of(F.col("text"))).collect():
        text = texts[r.k] or ""
        digests = [b.digest for b in stored[r.k].blocks]
        media_ = [p for p in r.parts if p.kind == "media"]
        assert [p.position for p in r.parts] == list(range(len(r.parts))) and r.key == stored[r.k].key
        assert [p.digest for p in media_] == digests and [p.caption for p in media_] == [f"part {k + 1} of {len(digests)}" for k in range(len(digests))]
        assert [p.text for p in r.parts if p.kind == "text"] == [" ".join(x.split()) for x in text.split("\n") if x.strip()]
    last = {r.k: r.parts for r in media.parse(df.withColumn("html", media.article(F.col("text")))).collect()}[6]
    kinds = "".join(p.kind[0] for p in last)
    assert kinds.count("m") == 4 and max(map(len, kinds.split("m"))) < 800 and not kinds.startswith("mm")
