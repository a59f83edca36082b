"""What a worker or the driver holds does not grow with the tables."""

import tracemalloc

import pyarrow as pa
import yaml

from specloom.functions import schemas
from specloom.operators import blocks, diff, openapi

DOCS = "spec_id string, api_name string, filename string, content string"


def test_descriptions_are_dealt_to_all_cores(spark):
    rows = [("TS 1", f"A{k}", f"a{k}.yaml", "openapi: 3.0.0\ncomponents:\n  schemas:\n    S: {enum: [yes, no]}\n") for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    cut = openapi.restricted(docs, schema="S")
    assert cut.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.part for r in cut.collect()} == {"openapi: 3.0.0\ncomponents:\n  schemas:\n    S:\n      enum:\n      - 'yes'\n      - 'no'\n"}


def test_references_are_resolved_without_broadcasts(spark):
    text = "components:\n  schemas:\n    S: {type: object, properties: {a: {$ref: 'b.yaml#/components/schemas/T'}}}\n    T: {type: string}\n"
    docs = spark.createDataFrame([("TS 1", "A", "a.yaml", text), ("TS 1", "B", "b.yaml", text)], DOCS)
    found = openapi.chunks(docs)
    assert found.count() == 4
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_events_are_read_like_the_loader():
    for text in ("a: &x [1, 2]\nb: *x\n", "a: 1\na: 2\n", "<<: {a: 1}\nb: 2\n", "a: !!int '3'\n", "? [a]\n: 1\n", "a: ~\nb: 1e3\nc: 0x1f\nd: 2020-01-01\ne: yes\nf: True\n", "a: [\n", "a: 1\n---\nb: 2\n", "a: *x\n", "a: &x 1\nb: &x 2\nc: *x\n"):
        want = got = None
        try:
            want = yaml.load(text, schemas._loader())
        except yaml.YAMLError as error:
            want = str(error)
        try:
            got = schemas.read(text)
        except yaml.YAMLError as error:
            got = str(error)
        assert got == want, text
    for doc in ({"a": "", "b": ["x" * 50 + " " + "y" * 50]}, {"": [1, None]}, {"q": 'say "x"\t' + "word " * 30}, {"é": "ü"}, {"s": "it's", "n": [True, 1.5, "1", "yes"]}):
        assert schemas.written(doc) == yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def test_edits_keep_few_bytes_a_step():
    a, b = [f"a{k}" for k in range(600)], [f"b{k}" for k in range(600)]
    tracemalloc.start()
    script, exact = diff.edits(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not exact and len(script) == 1200 and peak < 8_000_000


def test_opening_lines_miss_no_block():
    firsts = {
        "asn1": ["-- ASN1START", "-- /x/ ASN1START"], "diameter": ["Req ::= < Diameter Header: 316 >", "R : : = <AVP Header: 1>"], "sip": ["INVITE sip:a@b SIP/2.0", "SIP/2.0 200 OK", "BYE tel:1", "Example 1: BYE tel:1"],
        "sdp": ["v=0", "Example: v=0"], "xml": ["<a>", "<?xml x?>", "<!doctype x>"], "latex": ["$x$", "$$x$$, (7.3-1)"],
    }
    for kind, lines in firsts.items():
        for line in lines:
            text = [line, *{"xml": ["<b>", "</b>"], "sdp": ["o=1", "s=1"]}.get(kind, [])]
            assert (blocks.FORMATS[kind](text, 0) > 0) <= blocks.OPENING[kind](line)
            assert blocks.FORMATS[kind](text, 0) == 0 or next(blocks.blocks_of("\n".join(text)))[0] == kind
    assert pa.array([len(list(blocks.blocks_of("x\n\ny")))]).to_pylist() == [0]
