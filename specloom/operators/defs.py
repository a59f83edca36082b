"""Named definitions: found in fenced code by runs of lines, looked up by exact or folded name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import definition_key

#: The fence that holds definitions, and the mark of an example that holds none.
FENCE = "```asn1"
EXAMPLE = r"\A--\s*/[^/]*/\s*ASN1START\b"


def defined_name(line: Column) -> Column:
    """The name that a line assigns, or null: an identifier before ``::=`` on a line that is neither a
    comment nor a module's header."""
    before = F.when(F.instr(line, "::=") > 0, F.substring_index(line, "::=", 1))
    text = F.trim(F.translate(before, " \t", "  "))
    header = text.rlike(r"(?:\A|\s)DEFINITIONS(?:\s|\z)")
    name = F.regexp_extract(text, r"\A[A-Za-z][A-Za-z0-9-]*", 0)
    return F.when(~header & (name != ""), name)


def extract(sections: DataFrame) -> DataFrame:
    """``ord, name, key, spec_id, version, section_number, section_title, body`` of all definitions.

    Only sections that hold a fence are split. A definition runs from its line to the next one, the
    module's END or the fence's end, without blank and comment lines at its end.
    """
    held = sections.where(F.contains("content", F.lit(FENCE)))
    lines = held.select("ord", "spec_id", "version", "number", "title", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    order = Window.partitionBy("ord").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.startswith("line", F.lit("```"))
    # Marks alternate: one that is exactly the fence opens, and the next mark of any kind closes.
    marks = lines.where(mark).withColumn("opens", F.col("line") == FENCE)
    state = F.aggregate(
        F.col("m"),
        F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<at:int,open:boolean>>").alias("seen")),
        lambda s, x: F.struct((~s["open"] & x["opens"]).alias("open"), F.concat(s["seen"], F.array(F.struct(x["at"].alias("at"), (~s["open"] & x["opens"]).alias("open")))).alias("seen")),
    )["seen"]
    fences = marks.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("at", "opens"))).alias("m")).select("ord", F.explode(state).alias("f")).select("ord", "f.at", "f.open")
    lines = lines.join(fences, ["ord", "at"], "left")
    lines = lines.withColumn("inside", F.coalesce(F.last("open", ignorenulls=True).over(upto), F.lit(False))).withColumn("fence", F.sum(F.when(F.col("open").isNotNull(), 1).otherwise(0)).over(upto))
    bare = F.trim(F.translate("line", " \t", "  "))
    in_fence = Window.partitionBy("ord", "fence").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inner = lines.where("inside and open is null").withColumn("example", F.max(F.when(bare.rlike(EXAMPLE), 1).otherwise(0)).over(in_fence)).where("example = 0")
    inner = inner.withColumn("name", defined_name(F.col("line"))).withColumn("breaks", F.col("name").isNotNull() | (bare == "END"))
    inner = inner.withColumn("run", F.sum(F.col("breaks").cast("int")).over(in_fence)).withColumn("filler", (bare == "") | F.startswith(bare, F.lit("--")))
    body = F.array_sort(F.collect_list(F.struct("at", "line", "filler")))
    runs = inner.where("run > 0").groupBy("ord", "spec_id", "version", "number", "title", "fence", "run").agg(body.alias("b"))
    head = F.element_at("b", 1)
    last = F.array_max(F.transform(F.filter("b", lambda x: ~x["filler"]), lambda x: x["at"]))
    text = F.array_join(F.transform(F.filter("b", lambda x: x["at"] <= F.greatest(last, head["at"])), lambda x: x["line"]), "\n")
    found = runs.withColumn("name", defined_name(head["line"])).where("name is not null").select(
        "ord", F.col("name"), definition_key(F.col("name")).alias("key"), "spec_id", "version", F.col("number").alias("section_number"), F.col("title").alias("section_title"), text.alias("body"), head["at"].alias("_at")
    )
    return found.withColumn("ord", F.col("ord") * 1_000_000 + F.col("_at")).drop("_at")


def lookup(defs: DataFrame, name: str, spec_id: str | None = None) -> DataFrame:
    """Definitions of exactly this name; else those whose folded name is the same, all of the name that
    comes first."""
    rows = defs if spec_id is None else defs.where(F.col("spec_id") == spec_id)
    key = definition_key(F.lit(name))
    close = rows.where((F.col("name") == name) | ((F.col("key") == key) & (key != "")))
    best = close.agg(F.min(F.struct((F.col("name") != name).alias("folded"), "ord", "name")).alias("b")).select(F.col("b.name").alias("name"))
    return close.join(F.broadcast(best), "name", "left_semi").orderBy("ord")


def suggestions(defs: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Names whose folded form holds the wanted one or is held by it, in document order."""
    key = definition_key(F.lit(name))
    near = (F.instr(F.col("key"), key) > 0) | (F.instr(key, F.col("key")) > 0)
    return defs.where((key != "") & (F.col("key") != "") & near).groupBy("name").agg(F.min("ord").alias("ord")).orderBy("ord").limit(limit)


def listing(defs: DataFrame, by: str = "spec_id") -> DataFrame:
    """Names by runs of consecutive definitions in one section, each name once a run."""
    order = Window.partitionBy(by).orderBy("ord")
    changed = F.lag("section_number").over(order).eqNullSafe(F.col("section_number"))
    runs = defs.withColumn("run", F.sum(F.when(changed, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = runs.groupBy(by, "run", "section_number", "section_title", "name").agg(F.min("ord").alias("ord"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return names.groupBy(by, "run", "section_number", "section_title").agg(ordered.alias("names"))


def stats(defs: DataFrame) -> DataFrame:
    return defs.agg(F.count("*").alias("definitions"), F.countDistinct("spec_id", "name").alias("names"), F.countDistinct("spec_id").alias("specs"))
