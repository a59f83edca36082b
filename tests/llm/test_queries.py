"""Every registered training-data query, as the driver calls it, against a direct version on whole small tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from test_lm import contexts_of, walk
from test_minhash import brute
from test_mix_quality_ann_chat import filled

from specloom.llm import media
from specloom.llm.bpe import read_ranks
from specloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(name, *columns):
    return list(zip(*pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict().values(), strict=True))


def words(text):
    return (text or "").encode().lower().split()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_op2(spark):
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for doc_id, text in rows("documents", "doc_id", "text"):
        ids = theirs.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = QUERIES["op2_byte_bpe"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_op3(spark):
    docs = rows("documents", "doc_id", "text")
    got = {r.doc_id: r for r in QUERIES["op3_lm_score"](spark, SF).collect()}
    train = [(t or "").encode() for i, t in docs if crc(i) % 7 != 2]
    counts = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for doc_id, text in docs:
        r, tokens = got[doc_id], [*words(text), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(doc_id) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
    short = sorted(docs, key=lambda d: len(d[1] or ""))[:12]
    contexts = contexts_of(train, 5)
    for doc_id, text in short:
        assert got[doc_id].score == pytest.approx(walk(train, (text or "").encode(), 5, contexts), rel=1e-9, abs=1e-7)


def test_op4(spark):
    table = rows("embeddings", "vec_id", "embedding")
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    got: dict = {}
    for r in QUERIES["op4_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(ids[ids % 20 == 0])
    hits = 0
    for q, mine in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        exact = {i: sum(a * b for a, b in zip(x[at].tolist(), v.tolist(), strict=True)) for i, v in zip(ids.tolist(), x, strict=True) if i != q}
        best = sorted(exact, key=lambda i: (-exact[i], i))[:20]
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] == pytest.approx(exact[m[1]], abs=1e-12) for m in mine)
        assert [m[1] for m in mine] == [m[1] for m in sorted(mine, key=lambda m: (-m[2], m[1]))]
        hits += len({m[1] for m in mine} & set(best))
    assert hits >= 0.9 * 20 * len(got)


def test_op5(spark):
    docs = rows("documents", "doc_id", "source", "text")
    sizes: Counter = Counter()
    for _, source, text in docs:
        sizes[source] += len(words(text))
    want, taken = filled(sizes, (3, 1, 2), 1.5, 2.0), Counter()
    got = QUERIES["op5_mixing"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((i, len(words(t)), sizes[s]) for i, s, t in docs)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, QUERIES["op5_mixing"](spark, SF).collect())) == sorted(map(str, got))


def test_op6(spark):
    """On the next larger tables: the smallest have too few labels to learn from."""
    folder = SF.replace("0.001", "0.01")
    read = lambda name, *columns: list(zip(*pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pydict().values(), strict=True))
    labels = dict(read("labels", "doc_id", "quality"))
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, folder).collect()}
    assert len(got) == len(read("documents", "doc_id"))
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    out = [i for i in labels if i in got and crc(i) % 5 == 0]
    assert len(out) > 50 and sum(got[i].predicted == labels[i] for i in out) >= 0.95 * len(out)


def test_op8(spark):
    docs = rows("documents", "doc_id", "text")
    want = brute(docs, 4, 80)
    got = {r.doc_id: r for r in QUERIES["op8_minhash"](spark, SF).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_op9(spark):
    pages = rows("pages", "page_id", "html")
    first: dict = {}
    for page, html in pages:
        first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, html in pages:
        data, origin = (html or "").encode(), first[html or ""]
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if origin == page else "revisit", None if origin == page else origin))
    got = QUERIES["op9_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_op10(spark):
    got = {r.doc_id: r for r in QUERIES["op10_media"](spark, SF).collect()}
    docs = rows("documents", "doc_id", "text")
    assert len(got) == len(docs) and any(";" in r.feature for r in got.values())
    for doc_id, text in docs:
        data = (text or "").encode()
        full = media.payload(data)
        blocks = [full[a : a + media.BLOCK_BYTES] for a in range(0, len(full), media.BLOCK_BYTES)]
        forms = [media.to_png(b) for b in blocks]
        # Paragraphs and blocks in turn: block k follows paragraph floor(k n / m).
        paragraphs, places, position = (text or "").split("\n"), [], 0
        for i, paragraph in enumerate(paragraphs):
            position += bool(paragraph.split())
            for k in range(len(blocks)):
                if k * len(paragraphs) // len(blocks) == i:
                    places.append(f"{position}|part {k + 1} of {len(blocks)}|{media.look(media.from_png(forms[k]))}")
                    position += 1
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (r.media_bytes, r.media_sha256) == (sum(map(len, forms)), hashlib.sha256(b"".join(forms)).hexdigest())
        assert r.feature == ";".join(places)
