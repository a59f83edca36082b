"""The graph of citations between sections: built in Arrow batches, looked up with joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import CLAUSE_NUMBER, CLAUSE_WORDS, bracket_map, citations, context, linkify
from ..functions.scalar import ascii_istartswith, is_external
from ..schema import EDGES

PAGE = 500


def reference_lists(sections: DataFrame) -> DataFrame:
    """``spec_id, version, list``: the first section in order that is number 2 or titled like a list of
    references."""
    named = (F.col("number") == "2") | F.lower("title").isin("references", "normative references", "informative references")
    return sections.where(named).groupBy("spec_id", "version").agg(F.min_by("content", "ord").alias("list"))


def bracket_maps(sections: DataFrame) -> DataFrame:
    """``spec_id, version, brackets``: what a document's bracketed numbers stand for, read once a document."""

    @F.arrow_udf("map<string,string>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([list(bracket_map(x.as_py() or "").items()) for x in texts], pa.map_(pa.string(), pa.string()))

    return reference_lists(sections).select("spec_id", "version", read("list").alias("brackets"))


def edges(sections: DataFrame) -> DataFrame:
    """The citations of all sections, once for each target of a section."""
    spark = sections.sparkSession
    rows = sections.select("spec_id", "version", "number", "content").join(bracket_maps(sections), ["spec_id", "version"], "left")
    names = [x.split()[0] for x in EDGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out, piece = [], batch.slice(at, 100)
                for spec, version, number, text, brackets in zip(*(piece.column(k).to_pylist() for k in range(5)), strict=True):
                    for c in citations(text or "", dict(brackets or ()), spec):
                        out.append((spec, version, number, c.spec, c.section, context(text, c.start, c.end)))
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    # Reading texts takes longer than moving them: all cores get their share.
    dealt = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("spec_id", "version", "number", "content", "brackets").repartition(dealt).mapInArrow(run, EDGES)


def titles(sections: DataFrame) -> DataFrame:
    """One title per section number of a document, of the version that comes first."""
    return sections.groupBy("spec_id", "number").agg(F.min_by("title", "ord").alias("target_title"))


def with_titles(found: DataFrame, sections: DataFrame) -> DataFrame:
    known = titles(sections).select(F.col("spec_id").alias("target_spec"), F.col("number").alias("target_section"), "target_title")
    return found.join(known, ["target_spec", "target_section"], "left").withColumn("target_title", F.coalesce("target_title", F.lit("")))


def outgoing(found: DataFrame, spec_id: str, section: str, version: str | None = None, subsections: bool = False) -> DataFrame:
    if not section:
        raise ValueError("outgoing references need a section")
    own = F.col("source_section") == section
    own = own | ascii_istartswith(F.col("source_section"), section + ".") if subsections else own
    rows = found.where((F.col("source_spec_id") == spec_id) & own)
    return rows if version is None else rows.where(F.col("source_version") == version)


def incoming(found: DataFrame, spec_id: str, section: str = "", subsections: bool = False) -> DataFrame:
    """Citations of a document; of one section, if given, with those of its subsections or without."""
    rows = found.where(F.col("target_spec") == spec_id)
    if not section:
        return rows
    own = F.col("target_section") == section
    return rows.where(own | ascii_istartswith(F.col("target_section"), section + ".") if subsections else own)


def reference_page(found: DataFrame, offset: int = 0) -> DataFrame:
    order = ("source_spec_id", "source_version", "source_section", "target_spec", "target_section")
    return found.orderBy(*order).offset(max(0, offset)).limit(PAGE)


def dangling(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations of a section that its document, which the corpus has, does not have."""
    known = sections.select(F.col("spec_id").alias("target_spec")).distinct()
    there = sections.select(F.col("spec_id").alias("target_spec"), F.col("number").alias("target_section")).distinct()
    inner = found.where((F.col("target_section") != "") & ~is_external(F.col("target_spec")))
    return inner.join(known, "target_spec", "left_semi").join(there, ["target_spec", "target_section"], "left_anti")


def degrees(found: DataFrame) -> DataFrame:
    """``spec_id, cites, cited``: how many other documents a document cites and is cited by."""
    pairs = found.select("source_spec_id", "target_spec").distinct()
    out = pairs.groupBy(F.col("source_spec_id").alias("spec_id")).agg(F.count("*").alias("cites"))
    back = pairs.groupBy(F.col("target_spec").alias("spec_id")).agg(F.count("*").alias("cited"))
    return out.join(back, "spec_id", "full_outer").na.fill(0, ["cites", "cited"])


def linkified(sections: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Sections with ``linked``: their content with citations as links.

    A citation of a section that its document, which the corpus has, lacks is marked as unresolved; RFCs
    and documents outside the corpus are not checked. Unqualified clause words cite the document itself
    where it has the clause. What exists is found by joins; a section takes only its own targets along.
    """
    found = edges(sections) if found is None else found
    key = ["spec_id", "version", "number"]
    missing = dangling(found, sections).groupBy(F.col("source_spec_id").alias("spec_id"), F.col("source_version").alias("version"), F.col("source_section").alias("number"))
    missing = missing.agg(F.collect_set(F.concat_ws("#", "target_spec", "target_section")).alias("missing"))
    words = F.regexp_extract_all("content", F.lit(rf"{CLAUSE_WORDS}\s+({CLAUSE_NUMBER})"), 1)
    named = sections.select(*key, F.explode(F.array_distinct(words)).alias("clause"))
    there = sections.select("spec_id", "version", F.col("number").alias("clause")).distinct()
    own = named.join(there, ["spec_id", "version", "clause"]).groupBy(*key).agg(F.collect_set("clause").alias("own"))
    rows = sections.join(missing, key, "left").join(own, key, "left").join(bracket_maps(sections), ["spec_id", "version"], "left")

    @F.arrow_udf("string")
    def link(batch: pa.Array) -> pa.Array:
        out = []
        for item in batch:
            row = item.as_py()  # one text at a time
            gone, mine, spec = set(row["missing"] or ()), set(row["own"] or ()), row["spec_id"]
            exists = lambda s, n, gone=gone, mine=mine, spec=spec: n in mine if s == spec else f"{s}#{n}" not in gone
            url = lambda s, n: f"https://www.rfc-editor.org/rfc/rfc{s[4:]}" + (f"#section-{n}" if n else "") if s.startswith("RFC ") else f"/specs/{s.replace(' ', '%20')}" + (f"/sections/{n}" if n else "")
            out.append(linkify(row["content"] or "", url, exists, spec, dict(row["brackets"] or ())))
        return pa.array(out, pa.string())

    return rows.withColumn("linked", link(F.struct("content", "spec_id", "missing", "own", "brackets"))).drop("missing", "own", "brackets")
