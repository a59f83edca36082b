"""Citations, differences, definitions, API descriptions, pages, versions, maintenance, sources."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from specloom.functions import markup, scalar, schemas
from specloom.functions.citations import bracket_map, citations, context, linkify
from specloom.operators import catalog, defs, diff, hierarchy, maintain
from specloom.sources import archive, documents


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see TS 23.501 clause 5.1", {("TS 23.501", "5.1")}),
        ("see TS 23.501, clause 5.1", {("TS 23.501", "5.1")}),
        ("3GPP TS 33.203 Annex H", {("TS 33.203", "H")}),
        ("TR36.873", {("TR 36.873", "")}),
        ("PARTS23.501", set()),
        ("TS 38.101-1", {("TS 38.101-1", "")}),
        ("TS 23.501-123", {("TS 23.501", "")}),
        ("clause 5.1 of TS 23.402", {("TS 23.402", "5.1"), ("TS 23.402", "")}),
        ("clauses 8.2 and 16.11 of TS 23.402", {("TS 23.402", "8.2"), ("TS 23.402", "16.11"), ("TS 23.402", "")}),
        ("TS 23.402 clauses 8.2, 8.3 and 16.11", {("TS 23.402", "8.2"), ("TS 23.402", "8.3"), ("TS 23.402", "16.11")}),
        ("clause 4.12.2 and in clause 4.12.2a of TS 23.502", {("TS 23.502", "4.12.2"), ("TS 23.502", "4.12.2a"), ("TS 23.502", "")}),
        ("RFC 3261 section 4.1", {("RFC 3261", "4.1")}),
        ("[19] clause 6", {("TS 33.203", "6")}),
        ("[20] clause 6", set()),
        ("clause 5\n\nof TS 23.402", {("TS 23.402", "")}),
        ("clause 5\nof TS 23.402", {("TS 23.402", "5"), ("TS 23.402", "")}),
        ("TS 23.999 itself", set()),
        ("no citation here", set()),
    ],
)
def test_citations(text, want):
    assert {(c.spec, c.section) for c in citations(text, {"19": "TS 33.203"}, own="TS 23.999")} == want


def test_bracket_map():
    assert bracket_map('[1] 3GPP TS 23.501: "x"\n[2] IETF RFC 3261\n[3] TR 21.905') == {"1": "TS 23.501", "3": "TR 21.905"}


def test_context_is_cut_at_spaces():
    text = "x" * 30 + " " + "word " * 20 + "TS 23.501" + " after" * 20
    at = text.index("TS 23.501")
    found = context(text, at, at + 9)
    assert found.startswith("...word") and found.endswith("after...") and "TS 23.501" in found
    assert context("aé TS 1", 3, 7) == "aé TS 1"


def test_links():
    url = lambda spec, section: f"u:{spec}/{section}"
    exists = lambda spec, section: section != "9.9"
    assert linkify("see TS 23.501 clause 5.1.", url, exists) == "see [TS 23.501 clause 5.1](u:TS 23.501/5.1)."
    assert linkify("`TS 23.501` and [TS 23.501](x)", url, exists) == "`TS 23.501` and [TS 23.501](x)"
    assert linkify("TS 23.501 clause 9.9", url, exists) == "TS 23.501 clause 9.9 (unresolved)"
    assert linkify("in clause 4.2 here", url, exists, own="TS 1.1") == "in [clause 4.2](u:TS 1.1/4.2) here"
    assert linkify("in clause 4.2 of the book", url, exists, own="TS 1.1") == "in clause 4.2 of the book"


def test_edits_rebuild_the_new_text():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        script, exact = diff.edits(a, b)
        assert exact and [x for op, x in script if op != "-"] == b and [x for op, x in script if op != "+"] == a
    a, b = [str(k) for k in range(50)], [str(-k - 1) for k in range(50)]
    script, exact = diff.edits(a, b, most=10)
    assert not exact and [x for op, x in script if op != "-"] == b


def test_unified():
    a, b = list("abcdefghij"), list("abcXefghij")
    assert diff.unified(a, b, 1) == "@@ -3,3 +3,3 @@\n c\n-d\n+X\n e"
    assert diff.unified(a, a) == ""
    assert diff.unified([], ["x"]) == "@@ -0,0 +1 @@\n+x"


def test_structural(spark):
    schema = "number string, title string, content string"
    old = spark.createDataFrame([("1", "Scope", "# 1 Scope\na"), ("2", "Gone", "x"), ("3", "Moved", "m"), ("4", "Same", "s"), ("5", "Dup", "d"), ("6", "Dup", "d")], schema)
    new = spark.createDataFrame([("1", "Range", "# 1 Range\na"), ("3a", "moved ", "m2"), ("4", "Same", "s"), ("7", "Dup", "d")], schema)
    got = {(r.change, r.number, r.old_number) for r in diff.structural(old, new).collect()}
    assert got == {("retitled", "1", "1"), ("removed", None, "2"), ("renumbered", "3a", "3"), ("content", "3a", "3"), ("removed", None, "5"), ("removed", None, "6"), ("added", "7", None)}
    assert diff.structural(old, old).count() == 0


def test_definitions(spark):
    text = "A ::= no\n```asn1\n-- ASN1START\nX-Y DEFINITIONS AUTOMATIC TAGS ::=\n\tMaxN INTEGER ::= 5 -- five\n\n-- c\nThe-Type ::= SEQUENCE {\n a B\n}\n-- ASN1STOP\nEND\nstray\n```\n```asn1\n-- /example/ ASN1START\nE ::= NULL\n```\n```asn1\nOpen ::= NULL"
    rows = spark.createDataFrame([(1, "s", "1", "6.1", "t", text), (2, "s", "1", "6.2", "t", "```asn1\nthe-type ::= NULL\n```")], "ord long, spec_id string, version string, number string, title string, content string")
    found = defs.extract(rows).orderBy("ord")
    assert [(r.name, r.body) for r in found.collect()] == [("MaxN", "\tMaxN INTEGER ::= 5 -- five"), ("The-Type", "The-Type ::= SEQUENCE {\n a B\n}"), ("Open", "Open ::= NULL"), ("the-type", "the-type ::= NULL")]
    names = lambda df: [r.name for r in df.collect()]
    assert names(defs.lookup(found, "the-type")) == ["the-type"]
    assert names(defs.lookup(found, "The Type")) == ["The-Type"]
    assert names(defs.suggestions(found, "type")) == ["The-Type", "the-type"]


def test_schemas():
    doc = schemas.read("paths:\n  /a/{id}:\n    post: {requestBody: {content: {b: {schema: {$ref: 'x.yaml#/components/schemas/T'}}}}}\n  /ab: {get: {summary: s}}\ncomponents:\n  schemas:\n    S: {type: object, enum: [yes, 2001-01-01], properties: {p: {items: {$ref: '#/components/schemas/S'}}}}")
    assert [(m, p) for m, p, _ in schemas.operations(doc)] == [("post", "/a/{id}"), ("get", "/ab")]
    assert schemas.request_schema(doc["paths"]["/a/{id}"]["post"]) == ("x.yaml", "T")
    lines = schemas.describe("S", dict(schemas.schemas(doc))["S"], lambda f, s: {"type": "string"})
    assert lines == ["S:", "  type: object", "  enum: yes, 2001-01-01", "  properties:", "    p:", "      items:", "        $ref: #/components/schemas/S", "        # expanded:", "        S:", "          type: string"]
    node = {"$ref": "#/components/schemas/A", "allOf": [{"$ref": "z.yaml#/components/schemas/Z"}, {"type": "object", "nullable": True, "properties": {"q": {}}}, "odd"], "required": ["a", ["b"]], "properties": {"n": {"$ref": "other", "minimum": 1e21, "maximum": 2.5, "enum": [1, 1e-7, 3.0, 2.5e6, 123456.0, 10000000]}, "o": 1}}
    assert schemas.describe("T", node, lambda f, s: {"$ref": "#/components/schemas/B", "description": 7} if s == "A" else None) == [
        "T:", "  $ref: #/components/schemas/A", "  # expanded:", "  A:", "    $ref: #/components/schemas/B", "  allOf:", "    - $ref: z.yaml#/components/schemas/Z", "    - nullable: true", "    - type: object", "      property: q",
        "  properties:", "    n:", "      $ref: other", "      enum: 1, 1e-07, 3, 2.5e+06, 123456, 10000000", "      maximum: 2.5", "      minimum: 1e+21", "    o:",
    ]
    assert list(schemas.restrict(doc, path="/a")["paths"]) == ["/a/{id}"]
    with pytest.raises(ValueError, match="there are: S"):
        schemas.restrict(doc, schema="none")


def test_versions(spark):
    rows = [("18.6.0",), ("v18.6.0",), ("i60",), ("vi60",), ("18.06.0",), ("va0",), ("x",), ("",), (None,), ("36.0.0",)]
    df = spark.createDataFrame(rows, "v string").select("v", scalar.normalize_version(F.col("v")).alias("n"), scalar.dotted_to_token(F.col("v")).alias("t"))
    got = {r.v: (r.n, r.t) for r in df.collect()}
    assert got["18.6.0"] == ("18.6.0", "i60") and got["v18.6.0"][0] == "18.6.0" and got["i60"][0] == "18.6.0" and got["vi60"][0] == "18.6.0"
    assert got["18.06.0"][0] == "18.6.0" and got["va0"][0] == "31.10.0" and got["x"][0] is None and got["36.0.0"] == ("36.0.0", None)
    pairs = spark.createDataFrame([("18.6", "18.6.0"), ("18.10.0", "18.9.9"), ("", "0.0.0"), ("18.x", "18")], "a string, b string")
    assert [r.c for r in pairs.select(scalar.compare_versions(F.col("a"), F.col("b")).alias("c")).collect()] == [-1, 1, -1, 0]
    tokens = spark.range(36**2).select(F.concat_ws(".", (F.col("id") % 36).cast("string"), F.floor(F.col("id") / 36).cast("string"), F.lit("7")).alias("v"))
    assert tokens.where(scalar.token_to_dotted(scalar.dotted_to_token(F.col("v"))) != F.col("v")).count() == 0


def test_pages_cover_the_text(spark):
    text = "\n".join(("line %d " % k) * (k % 3) for k in range(100))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "x" * 500)], "k int, text string")
    pages = hierarchy.pages(rows, ["k"], max_lines=10, max_chars=200).orderBy("k", "page").collect()
    for k, whole in ((1, text), (2, ""), (3, "x" * 500)):
        mine = [p for p in pages if p.k == k]
        assert "\n".join(p.text for p in mine) == whole and all(p.lines <= 12 for p in mine)


def test_parents(spark):
    rng = random.Random(2)
    levels = [rng.randrange(1, 6) for _ in range(60)]
    stack, want = [], []
    for k, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        want.append(stack[-1] if stack else None)
        stack.append(k)
    rows = spark.createDataFrame([(1, k, level) for k, level in enumerate(levels)], "d int, ord long, level int")
    assert [r.parent_ord for r in hierarchy.parents(rows, ["d"]).orderBy("ord").collect()] == want


def test_eviction_equals_the_loop(spark):
    rng = random.Random(4)
    for _ in range(5):
        rows = [(f"s{k}", "1", rng.randrange(1, 40), rng.randrange(6), k) for k in range(25)]
        limit, keep = rng.randrange(0, 400), rows[rng.randrange(25)][:2]
        left = sorted(rows, key=lambda r: (r[3], r[4]))
        while sum(r[2] for r in left) > limit and any(r[:2] != keep for r in left):
            left.remove(next(r for r in left if r[:2] != keep))
        entries = spark.createDataFrame(rows, "spec_id string, version string, bytes long, last_used_at int, ord long")
        got = maintain.evict(entries.withColumn("last_used_at", F.timestamp_seconds(F.col("last_used_at") * 40_000)), limit, keep)
        kept = {r.spec_id for r in got.collect()}
        # What stays is the most recent that fit beside the kept one.
        assert kept == {r[0] for r in left}


def test_insert_supersedes(spark):
    specs = lambda rows: spark.createDataFrame(rows, "id string, version string")
    sections = lambda rows: spark.createDataFrame(rows, "spec_id string, version string, number string")
    tables = {"specs": specs([("TS 1.1", "1.0.0"), ("TR 2.2", "1.0.0"), ("TS 3.3", "1.0.0")]), "sections": sections([("TS 1.1", "1.0.0", "1"), ("TR 2.2", "1.0.0", "1"), ("TS 3.3", "1.0.0", "1")])}
    new = {"specs": specs([("TS 1.1", "2.0.0"), ("TS 2.2", "1.0.0"), ("TS 3.3", "")]), "sections": sections([("TS 1.1", "2.0.0", "1")])}
    out = maintain.insert_documents(tables, new)
    assert {tuple(r) for r in out["specs"].collect()} == {("TS 1.1", "2.0.0"), ("TS 2.2", "1.0.0"), ("TS 3.3", "1.0.0"), ("TS 3.3", "")}
    assert {tuple(r) for r in out["sections"].collect()} == {("TS 1.1", "2.0.0", "1"), ("TS 3.3", "1.0.0", "1")}


def test_published_tables_and_streams(spark, tmp_path):
    from specloom.streaming.ingest import ingest, last_uses

    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], schema).write.parquet(source)
    run = lambda: ingest(spark.readStream.schema(schema).parquet(source), path, ["k"], str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    kept = maintain.current(spark, path)
    spark.createDataFrame([(2, "z"), (3, "y")], schema).write.mode("append").parquet(source)
    run()
    assert {tuple(r) for r in maintain.current(spark, path).collect()} == {(1, "c"), (2, "z"), (3, "y")}
    assert {tuple(r) for r in kept.collect()} == {(1, "c"), (2, "b")}  # a reader keeps what it began with
    folders = lambda: {f for x in maintain._Place(spark, path).pointer()["folders"].values() for f in [x.split("/")[0]]}
    assert len(folders()) == 2  # the bucket of 1 was not written again
    with pytest.raises(ValueError):
        maintain.publish_changes(spark.createDataFrame([(1, "a")], schema), path, ["v"])
    maintain.publish(spark.createDataFrame([], schema), path)
    assert maintain.current(spark, path).collect() == [] and maintain.current(spark, path).columns == ["k", "v"]
    log = spark.sql("select 's' spec_id, '1' version, timestamp'2024-01-01 10:05:00' used_at union all select 's', '1', timestamp'2024-01-01 10:50:00'")
    assert last_uses(log).collect()[0].uses == 2


def test_index_lifecycle(spark, tmp_path):
    path, rows = str(tmp_path / "defs"), lambda: spark.createDataFrame([(1, "A")], "ord long, name string")
    with pytest.raises(LookupError, match="not built"):
        maintain.current(spark, path)
    maintain.refresh(spark, path, rows, rebuild=True)  # what was never built stays so
    assert not maintain.drop(spark, path)
    maintain.publish(rows(), path)
    maintain.refresh(spark, path, lambda: spark.createDataFrame([(2, "B")], "ord long, name string"), rebuild=True)
    assert [r.name for r in maintain.current(spark, path).collect()] == ["B"]
    maintain.refresh(spark, path, rows, rebuild=False)
    with pytest.raises(LookupError):
        maintain.current(spark, path)
    cache = tmp_path / "cache"
    assert not maintain.limit_generation(spark, str(cache), 3)
    (cache / "entry").write_text("x")
    assert not maintain.limit_generation(spark, str(cache), 3) and (cache / "entry").exists()
    assert maintain.limit_generation(spark, str(cache), 4) and not (cache / "entry").exists()


def test_archive_entries(spark):
    lines = spark.createDataFrame([("archive/38_series/38.101-1/38101-1-i60.zip",), ("23_series/23.501/23501-101203.ZIP",), ("23_series/23.501/readme.txt",), ("",)], "line string")
    assert {tuple(r)[:5] for r in archive.entries(lines).collect()} == {("38", "38.101-1", "i60", 18, 216), ("23", "23.501", "101203", 10, 1203)}


def test_update_plan(spark):
    a = spark.createDataFrame([("TS 1.1", "2.0.0"), ("TS 2.2", "1.0.0")], "id string, version string")
    have = spark.createDataFrame([("TR 1.1", "1.9.0"), ("TS 2.2", "1.0.0"), ("TS 4.4", "1.0.0"), ("TS 5.5", "1.0.0")], "id string, version string")
    everything = a.unionByName(spark.createDataFrame([("TS 4.4", "9.0.0")], "id string, version string"))
    assert {tuple(r) for r in catalog.update_plan(a, have, below_cap=everything).collect()} == {("TR 1.1", "update", "1.9.0", "2.0.0"), ("TS 4.4", "remove", "1.0.0", None)}


def test_html_and_docx():
    rows = documents.html_sections("<title>t</title><h1>1 Scope</h1><p>a <b>b</b></p><pre>x\n y</pre><h2>1.1 Sub</h2><p>c</p><script>no</script><h1>Annex A: More</h1>")
    assert [(r["number"], r["title"], r["level"], r["parent_number"]) for r in rows] == [("1", "Scope", 1, None), ("1.1", "Sub", 2, "1"), ("A", "More", 1, None)]
    assert rows[0]["content"] == "a b\n\n```\nx\n y\n```"
    w, m = documents.W[1:-1], documents.M[1:-1]
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = f"""<w:document xmlns:w="{w}" xmlns:m="{m}"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>1\tScope</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">bold </w:t></w:r><w:r><w:t>plain</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="PL"/></w:pPr><w:r><w:t>A ::= NULL</w:t></w:r></w:p>
<w:tbl><w:tr>{cell("a", '<w:gridSpan w:val="2"/>')}{cell("b", '<w:vMerge w:val="restart"/>')}</w:tr><w:tr>{cell("c")}{cell("d")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>
<w:p><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>x</m:t></m:r></m:den></m:f></m:oMath></w:p></w:body></w:document>"""
    styles = f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    (row,) = documents.docx_sections(data.getvalue())
    assert (row["number"], row["title"]) == ("1", "Scope")
    assert row["content"] == '**bold** plain\n\n```asn1\nA ::= NULL\n```\n\n<table><tr><td colspan="2">a</td><td rowspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>\n\n$$\\frac{1}{x}$$'


def test_markup():
    assert markup.sanitize('<p onclick="x">a<script>b</script><a href="javascript:x">c</a><a href="/d">e</a>') == '<p>a<a>c</a><a href="/d">e</a>'
    assert markup.segments("a\n```py\nx\n```\nb") == [("text", "", "a\n"), ("code", "py", "x\n"), ("text", "", "b")]


def test_blocks():
    from specloom.operators.blocks import blocks_of

    found = lambda text: [(k, a, b) for k, a, b in blocks_of(text)]
    assert found("EXAMPLE 1:\tINVITE sip:a@b SIP/2.0\n\nVia: x\nf: y\nP-Early-Media=no\n\nv=0\na=fmtp:1 \\\nmode-set=0;x\nIt ends.\n") == [("sip", 0, 8)]
    assert found("- RTSP/1.0 200 OK\nCSeq: 1\nS->C RTSP/1.0 404 Not Found") == [("sip", 0, 2)]
    assert found("BYE sip: a@b\nNOTE: no") == [("sip", 0, 0)]
    for prose in ("INVITE is sent", "SIP/2.0 200 OK is sent to the UE", "INVITE sip:a@b SIP/2.0 is sent", "v= (protocol version).\no= (owner).", "m=<media>\na=b", "x=1\ny=2\nq=3", "<userid>\nis prose", "a < b", "$x$ is", "costs $5", "Header: x", "::= < Header >"):
        assert found(prose) == [], prose
    assert found("A ::= <AVP Header: 9 1>\n1*{ X }\n\n [ Y ]\n* < Z >\n[a][b]") == [("diameter", 0, 4)]
    assert found("t=0 0\nm=audio\n\na=x\n") == [("sdp", 0, 3)]
    assert found("<?xml version='1.0'?>\n<!-- a\nremark -->\n<x\n a='1'>\nfree text\n</x>\nAfterwards.") == [("xml", 0, 6)]
    assert found("<!DOCTYPE a [\n<!ELEMENT a (b)>\n]>\nProse") == [("xml", 0, 2)] and found("<a>\n<b>\nnever closed\nprose") == [("xml", 0, 1)]
    assert found("-- ASN1START\nA ::= NULL\n<x>") == [("asn1", 0, 2)] and found("-- ASN1STARTED\n--ASN1STOP") == []
    assert found("$$a+b$$\n$x$ , (A.4-2)\n$x$ (dB)\n$x$ and $y$") == [("latex", 0, 0), ("latex", 1, 1)]


def test_figures_and_indents(spark):
    from specloom.functions.figures import Reference, references, shown

    only = lambda text: [r for _, _, r in references(text)]
    assert only("a ![image3.emf](image://image3.emf?w=2) b") == [Reference("link", "image3", "?w=2", "")]
    assert shown("![](image://i1.wmf.png)") == shown("![i1.wmf](image://i1.wmf)") == shown("![i1.wmf.png](image://i1.emf)")
    assert only("![A map](image://m.jpg)") == [Reference("link", "m.jpg", "", "A map")] and shown("![](image://m.jpg)") != shown("![](image://m.png)")
    assert shown("![](image://m.png?w=1)") != shown("![](image://m.png?w=2)") and shown("x ![](image://m.png)") != shown("![](image://m.png)")
    assert only('<img width="2" src="image://x.PNG" alt="x.png"><IMG\nsrc="image://y.z?w=1">') == [Reference("tag", "x", "", ""), Reference("tag", "y.z", "?w=1", "")]
    for none in ("image://x.png", "![a]( image://x.png)", "[a](image://x.png)", "![](image://a b)", '<a src="image://x">', '<img alt="image://x">', "<img", "![](image://"):
        assert only(none) == [] and shown(none) == none
    schema = "number string, title string, content string"
    old, new = spark.createDataFrame([("1", "t", "![](image://a.emf)")], schema), spark.createDataFrame([("1", "t", "![](image://a.png)")], schema)
    assert diff.structural(old, new).count() == 0
    rows = spark.createDataFrame([("\n\ta b \n  c\n\n",)], "t string")
    assert rows.select(scalar.keep_indent(F.col("t"))).first()[0] == "\u00a0" * 4 + "a b\n" + "\u00a0" * 2 + "c"


def test_resolve(spark):
    rows = spark.createDataFrame([("a", "18.6.0"), ("a", "18.10.0"), ("a", "19.0.0"), ("b", "17.1.0")], "spec_id string, version string")
    got = lambda request: {tuple(r) for r in catalog.resolve(rows, request).collect()}
    assert got("") == got("latest") == {("a", "19.0.0"), ("b", "17.1.0")}
    assert got("18") == got("Rel-18") == {("a", "18.10.0")} and got("i60") == got("18.6.0") == {("a", "18.6.0")}
    with pytest.raises(ValueError):
        got("no such")


def test_linked_sections(spark):
    from specloom.operators import references

    rows = [(1, "TS 1.1", "1", "4.2", "a", "In clause 4.3 and clause 9; see TS 2.2 clause 5, TS 2.2 clause 6, TS 9.9 clause 1."), (2, "TS 1.1", "1", "4.3", "b", None), (3, "TS 2.2", "1", "5", "c", "")]
    sections = spark.createDataFrame(rows, "ord long, spec_id string, version string, number string, title string, content string")
    linked = {r.ord: r.linked for r in references.linkified(sections).collect()}
    assert linked[1] == "In [clause 4.3](/specs/TS%201.1/sections/4.3) and clause 9; see [TS 2.2 clause 5](/specs/TS%202.2/sections/5), TS 2.2 clause 6 (unresolved), [TS 9.9 clause 1](/specs/TS%209.9/sections/1)."
    assert linked[2] == "" and linked[3] == ""


def test_comparability_and_listings(spark, tmp_path):
    rows = spark.createDataFrame([("1",)], "number string")
    assert diff.why_not_comparable("TS 1", rows, rows, "1.0.0", "2.0.0") is None
    assert "both versions" in diff.why_not_comparable("TS 1", rows, rows, "1.0.0", "1.0.0")
    assert "parts: a, b" in diff.why_not_comparable("TS 1", rows.limit(0), rows.limit(0), "", "", parts=["a", "b"])
    path = tmp_path / "list.txt"
    assert archive.fresh_listing(spark, str(path)) is None
    path.write_text("\n a \n")
    assert [r.line for r in archive.fresh_listing(spark, str(path)).collect()] == ["a"]
    assert archive.fresh_listing(spark, str(path), -1) is None


def test_pages_and_their_notes(spark):
    bounds = lambda text, n, chars=0: list(hierarchy.page_bounds(text.split("\n"), n, chars))
    assert bounds("a\nb\nc\nd\ne\n\nf", 5) == [(0, 6), (6, 7)]  # on through the blank line
    assert bounds("a\nb\nc\nd\ne\nf\n\ng", 5) == [(0, 5), (5, 8)]  # which is too far away
    assert bounds("a\n\nb", 1) == [(0, 2), (2, 3)] and bounds("", 3) == [(0, 1)]
    assert bounds("aaaa\nb\n\nc", 9, 4) == [(0, 1), (1, 3), (3, 4)]
    rows = hierarchy.pages(spark.createDataFrame([("k", "a\nb\nc")], "k string, text string"), ["k"], max_lines=2)
    assert [r.t for r in rows.select("page", hierarchy.page_text(rows).alias("t")).orderBy("page").collect()] == ["[Lines 1-2 of 3]\n\na\nb\n\n[Truncated. Use offset=2 to continue]", "[Lines 3-3 of 3]\n\nc"]


def _office(body, styles="", core="", rels="", media=()):
    w, a = documents.W[1:-1], "http://schemas.openxmlformats.org/drawingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:m="{documents.M[1:-1]}" xmlns:a="{a}" xmlns:r="r" xmlns:v="v"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style>{styles}</w:styles>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="dc">{core}</c>')
        z.writestr("word/_rels/document.xml.rels", f"<r>{rels}</r>")
        for name, content in media:
            z.writestr(f"word/media/{name}", content)
    return data.getvalue()


def _paragraph(text, style=""):
    text = text.replace("&", "&amp;").replace("<", "&lt;")
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def test_office_blocks_pictures_and_styles(spark, tmp_path):
    drawing = '<w:p><w:r><w:drawing><a:inline><a:extent cx="95250" cy="190500"/><a:docPr descr="A map"/><a:blip r:embed="r1"/></a:inline></w:drawing></w:r></w:p>'
    shape = '<w:p><w:r><w:pict><v:shape style="width:7.5pt; height:15pt"><v:imagedata r:id="r2"/></v:shape></w:pict></w:r></w:p>'
    head = '<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    formula = "<w:p><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath><w:r><w:t>, (7.3-1)</w:t></w:r></w:p>"
    lines = ["The call:", "INVITE sip:a@b SIP/2.0", "Via: x", "", "Done.", "R ::= < Diameter Header: 1 >", " < Session-Id >", "End", "<a>", "<b/>", "</a>", "-- ASN1START", "A ::= NULL", "-- ASN1STOP"]
    body = _paragraph("1 Scope", "H1") + "".join(map(_paragraph, lines)) + _paragraph("int x;", "Derived") + drawing + shape + head + formula + _paragraph("\u2013 RRCSetup", "H1") + _paragraph("text")
    styles = '<w:style w:styleId="Mono"><w:rPr><w:rFonts w:ascii="Courier New"/></w:rPr></w:style><w:style w:styleId="Derived"><w:basedOn w:val="Mono"/></w:style>'
    rels = '<x Id="r1" Target="media/image1.png"/><x Id="r2" Target="media/image2.emf"/>'
    data = _office(body, styles, "<dc:title>T</dc:title><dc:subject>Procedures; Stage 2 (Release 18)</dc:subject>", rels, [("image1.png", b"p"), ("image2.emf", b"e")])
    scope, setup = documents.docx_sections(data)
    assert scope["content"].split("\n\n") == [
        "The call:", "```sip\nINVITE sip:a@b SIP/2.0\nVia: x\n```", "Done.", "```diameter\nR ::= < Diameter Header: 1 >\n < Session-Id >\n```", "End", "```xml\n<a>\n<b/>\n</a>\n```", "```asn1\n-- ASN1START\nA ::= NULL\n-- ASN1STOP\n```",
        "```\nint x;\n```", "![A map](image://image1.png?w=10&h=20)", "![Figure](image://image2.emf?w=10&h=20)", "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>c</td></tr></tbody></table>", "$$x$$ (7.3-1)",
    ]
    assert (setup["number"], setup["title"], setup["content"]) == ("RRCSetup", "RRCSetup", "text")
    cover = _office(_paragraph("3GPP TR 23.501 V18.6.0") + _paragraph("Technical Report") + _paragraph("1 Scope", "H1"), core="<dc:title>Report title</dc:title>")
    assert documents.docx_metadata(cover, "23501-i60_cover.docx") == {"spec_id": "TR 23.501", "doc_type": "TR", "title": "Report title", "version": "18.6.0", "version_token": "i60", "release": ""}
    told = documents.docx_metadata(data, "38331-2-h10.docx")
    assert (told["spec_id"], told["doc_type"], told["title"], told["release"]) == ("TS 38.331-2", "", "Procedures; Stage 2", "18")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "38331-h10.docx").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path / "d"))
    assert documents.sections_of_files(files).count() == 2
    assert [r.spec_id for r in documents.metadata_of_files(files).collect()] == ["TS 38.331"]
    assert [(r.name, r.mime_type, bytes(r.data), r.llm_readable) for r in documents.images_of_files(files).orderBy("name").collect()] == [("image1.png", "image/png", b"p", True), ("image2.emf", "image/x-emf", b"e", False)]


def test_archives_and_sinks(spark, tmp_path):
    from specloom.sources import sinks

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/b.docx", b"one")
        z.writestr("../evil.docx", b"two")
        z.writestr("big.docx", b"0" * 5000)
    rows = spark.createDataFrame([("x.zip", data.getvalue()), ("y.zip", b"no archive")], "path string, content binary")
    got = {(r.path, r.name): (r.data and bytes(r.data), r.error is None) for r in archive.members(rows, 1000).collect()}
    assert got == {("x.zip", "b.docx"): (b"one", True), ("x.zip", "evil.docx"): (b"two", True), ("x.zip", "big.docx"): (None, False), ("y.zip", None): (None, False)}
    images = spark.createDataFrame([("TS 1", "1.0.0", "a/../b.png", b"p"), ("..", "", "b.png", b"q")], "spec_id string, version string, name string, data binary")
    paths = {r.spec_id: r.path for r in sinks.write_images(images, f"file://{tmp_path}/img").collect()}
    assert {k: open(p, "rb").read() for k, p in paths.items()} == {"TS 1": b"p", "..": b"q"} and all(p.startswith(f"{tmp_path}/img/") and ".." not in p.split("/") for p in paths.values())
    table = spark.createDataFrame([(1, "\u00e9"), (2, None)], "k int, v string")
    sinks.write_json(table, f"{tmp_path}/json")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect()) == ['{"k":1,"v":"\u00e9"}', '{"k":2}']
    assert '"k" : 1' in sinks.as_json(table, indent=True).first().json


def test_diff_lines(spark):
    rows = spark.createDataFrame([("@@ -1 +1 @@",), ("+a",), ("-b",), (" c",)], "l string")
    assert [r.c for r in rows.select(markup.diff_line_class(F.col("l")).alias("c")).collect()] == ["diff-hunk", "diff-add", "diff-del", "diff-ctx"]
