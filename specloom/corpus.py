"""The shared tables seen as a corpus: documents, sections, citations, definitions and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, title, content``: a document's first line, and all of it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ids like those of specifications."""
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, "TR ").otherwise("TS ")
    part = F.when(n % 7 == 0, F.concat(F.lit("-"), (n % 4 + 1).cast("string"))).otherwise("")
    number = F.concat((n % 18 + 21).cast("string"), F.lit("."), F.lpad((F.floor(n / 4)).cast("string"), 5, "0"))
    return table(spark, sf_dir, "documents").select(F.concat(kind, number, part).alias("id"), F.concat_ws(".", (n % 20).cast("string"), (n % 7).cast("string"), F.lit("0")).alias("version"), F.col("lang").alias("series"), "doc_id")


SPECS_SQL = """specs AS (
    SELECT CASE WHEN doc_id % 3 = 0 THEN 'TR ' ELSE 'TS ' END || (doc_id % 18 + 21)::VARCHAR || '.' || lpad((doc_id // 4)::VARCHAR, 5, '0')
        || CASE WHEN doc_id % 7 = 0 THEN '-' || (doc_id % 4 + 1)::VARCHAR ELSE '' END AS id,
        (doc_id % 20)::VARCHAR || '.' || (doc_id % 7)::VARCHAR || '.0' AS version, lang AS series, doc_id FROM documents)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spec_id, version, ord`` of orders: a customer's document, versioned by the order's date."""
    day = F.col("o_orderdate")
    version = F.concat_ws(".", (F.year(day) - 1990).cast("string"), F.month(day).cast("string"), F.day(day).cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("TS 23."), F.col("o_custkey").cast("string")).alias("spec_id"), version.alias("version"), F.col("o_orderkey").alias("ord"))


DATED_SQL = """dated AS (
    SELECT 'TS 23.' || o_custkey::VARCHAR AS spec_id, o_orderkey AS ord, year(o_orderdate) - 1990 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
        (year(o_orderdate) - 1990)::VARCHAR || '.' || month(o_orderdate)::VARCHAR || '.' || day(o_orderdate)::VARCHAR AS version FROM orders)"""


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spec_id, ord, number, title, level, content``: each region as a document of nations, their
    customers, and the customers' orders."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("spec_id"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    n, c, o = (F.col(k).cast("string") for k in ("n_nationkey", "c_custkey", "o_orderkey"))
    first = nation.select("spec_id", n.alias("number"), F.col("n_name").alias("title"), F.lit(1).alias("level"), F.lit("").alias("content"))
    owned = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    second = owned.select("spec_id", F.concat_ws(".", n, c).alias("number"), F.col("c_name").alias("title"), F.lit(2).alias("level"), F.col("c_mktsegment").alias("content"))
    third = orders.join(owned, F.col("o_custkey") == F.col("c_custkey")).select("spec_id", F.concat_ws(".", n, c, o).alias("number"), F.col("o_orderstatus").alias("title"), F.lit(3).alias("level"), F.col("o_orderpriority").alias("content"))
    rows = first.unionByName(second).unionByName(third)
    parts = F.split("number", r"\.")
    at = [F.coalesce(F.get(parts, F.lit(k)).cast("long"), F.lit(-1)) + 1 for k in range(3)]
    return rows.withColumn("ord", at[0] * 10**14 + at[1] * 10**8 + at[2])


CLAUSES_SQL = """clauses AS (
    SELECT n_regionkey::VARCHAR AS spec_id, n_nationkey::VARCHAR AS number, n_name AS title, 1 AS level, '' AS content,
        (n_nationkey::BIGINT + 1) * 100000000000000 AS ord FROM nation
    UNION ALL SELECT n_regionkey::VARCHAR, n_nationkey::VARCHAR || '.' || c_custkey::VARCHAR, c_name, 2, c_mktsegment,
        (n_nationkey::BIGINT + 1) * 100000000000000 + (c_custkey + 1) * 100000000 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey::VARCHAR, n_nationkey::VARCHAR || '.' || c_custkey::VARCHAR || '.' || o_orderkey::VARCHAR, o_orderstatus, 3, o_orderpriority,
        (n_nationkey::BIGINT + 1) * 100000000000000 + (c_custkey + 1) * 100000000 + o_orderkey + 1
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose sections are the turns; the level follows the turn."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("spec_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("number"), F.col("role").alias("title"), (F.col("turn") % 4 + 1).cast("int").alias("level"), F.col("text").alias("content"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, place, target``: links from page to page of a site, by path."""
    from .sources.archive import links

    return links(table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("source"), "place", F.col("href").alias("target"))


def part_sections(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    """Two versions of one document: parts as sections, some renumbered, retitled, edited or gone."""
    n, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    # Names repeat; with the key they are titles of their own but for every fifth.
    title = F.when(n % 5 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", n.cast("string")))
    rows = p.select(n.alias("n"), title.alias("title"), F.concat(F.lit("# "), F.col("p_name"), F.lit("\n"), F.col("p_type"), F.lit("\n"), F.col("p_brand")).alias("content"))
    n = F.col("n")
    if old:
        return rows.where(n % 11 != 3).select(n.cast("string").alias("number"), "title", "content")
    number = F.when(n % 13 == 4, F.concat(F.lit("A."), n.cast("string"))).otherwise(n.cast("string"))
    content = F.when(n % 9 == 2, F.concat("content", F.lit("\nnew"))).when(n % 9 == 5, F.concat("content", F.lit("\n\n"))).otherwise(F.col("content"))
    return rows.where(n % 17 != 6).select(number.alias("number"), F.when(n % 19 == 7, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")).alias("title"), content.alias("content"))


PARTS_SQL = """base AS (
    SELECT p_partkey AS n, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' ' || p_partkey::VARCHAR END AS title,
        p_type || chr(10) || p_brand AS body FROM part
), o AS (SELECT n::VARCHAR AS number, title, body, 3 AS lines FROM base WHERE n % 11 <> 3
), w AS (
    SELECT CASE WHEN n % 13 = 4 THEN 'A.' || n::VARCHAR ELSE n::VARCHAR END AS number,
        CASE WHEN n % 19 = 7 THEN title || ' (new)' ELSE title END AS title,
        CASE WHEN n % 9 = 2 THEN body || chr(10) || 'new' WHEN n % 9 = 5 THEN body || chr(10) || chr(10) ELSE body END AS body,
        CASE WHEN n % 9 = 2 THEN 4 WHEN n % 9 = 5 THEN 5 ELSE 3 END AS lines FROM base WHERE n % 17 <> 6)"""


def code_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sections whose fences define their nation's parts: definitions, comments, examples."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    fence = F.concat(
        F.lit("Text ::= not code\n```asn1\n-- ASN1START\nModule-"), n, F.lit(" DEFINITIONS AUTOMATIC TAGS ::=\nBEGIN\n\tSupplier-"), n, F.lit("-Name ::= SEQUENCE {\n  a INTEGER,\n  b Key-"), n,
        F.lit("\n}\n\n-- next\nmaxKey"), n, F.lit(" INTEGER ::= 4 -- tail\nEND\n```\nbetween\n```asn1\n-- /example/ ASN1START\nExample ::= NULL\n```\n```\nOther ::= NULL\n```"),
    )
    return s.select(F.col("s_suppkey").alias("ord"), (F.concat(F.lit("TS 38."), F.col("s_nationkey").cast("string"))).alias("spec_id"), F.lit("18.0.0").alias("version"), F.concat(F.lit("6."), n).alias("number"), F.col("s_name").alias("title"), fence.alias("content"))
