"""One query per operator over the shared tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus as c
from .functions import figures, markup, scalar
from .operators import blocks, catalog, defs, diff, fts, hierarchy, maintain, openapi, references
from .session import shared_folder
from .sources import archive, documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Search --------------------------------------------------------------------------------------------

WEIGHTS = {"title": 5.0, "content": 1.0}
_POSTINGS = r"""f AS (
    SELECT doc_id AS doc, 'title' AS field, split_part(text, chr(10), 1) AS t FROM documents
    UNION ALL SELECT doc_id, 'content', text FROM documents
), tk AS (SELECT doc, field, regexp_extract_all(lower(t), '[\p{L}\p{N}-]+') AS l FROM f),
p AS (SELECT doc, field, unnest(l) AS term, unnest(range(len(l))) AS pos FROM tk),
dl AS (SELECT doc, sum(len(l)) AS d FROM tk GROUP BY doc), st AS (SELECT count(*) AS total, avg(d) AS average FROM dl)"""


def _search_sql(occurrences: list[str], holds: str, tail: str = "", columns: str = "doc AS doc_id, score") -> str:
    """``occurrences[k]`` gives doc, field of each occurrence of phrase k; ``holds`` speaks of ``h0``, ``h1``..."""
    occ = " UNION ALL ".join(f"SELECT {k} AS k, doc, field FROM ({sql})" for k, sql in enumerate(occurrences))
    flags = ", ".join(f"bool_or(k = {k}) AS h{k}" for k in range(len(occurrences)))
    return f"""WITH {_POSTINGS}, occ AS ({occ}),
fr AS (SELECT k, doc, sum(CASE field WHEN 'title' THEN 5.0 ELSE 1.0 END)::DOUBLE AS f FROM occ GROUP BY k, doc),
ni AS (SELECT k, count(*) AS n FROM fr GROUP BY k),
idf AS (SELECT k, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END AS w FROM ni, st),
sc AS (SELECT doc, round(-sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average))), 6) AS score, {flags}
    FROM fr JOIN idf USING (k) JOIN dl USING (doc), st GROUP BY doc),
hit AS (SELECT doc, score FROM sc WHERE {holds})
SELECT {columns} FROM hit {tail}"""


def _term(word: str) -> str:
    return f"SELECT doc, field FROM p WHERE term = '{word}'"


#: Folders of the indexes that a session has written, by their texts.
_INDEXED: dict[tuple, str] = {}


def _text_index(spark: SparkSession, sf_dir: str) -> fts.Index:
    """The index of a folder's documents: the first search writes it, others read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED:
        folder = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        fts.plain_index(c.texts(spark, sf_dir), "doc_id", WEIGHTS).write(folder)
        _INDEXED[key] = folder
    return fts.read(spark, _INDEXED[key], WEIGHTS, fts.plain_tokeniser())


def _scores(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return fts.matches(_text_index(spark, sf_dir), text).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_POSTINGS}, s AS (SELECT term, count(*) AS n, count(DISTINCT doc) AS docs FROM p GROUP BY term) SELECT term, n, docs FROM s")
def index_terms(spark, sf_dir):
    """Every term of a newly written index, as it is read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index = fts.plain_index(c.texts(spark, sf_dir), "doc_id", WEIGHTS).write(folder)
    return index.terms()


@query(_search_sql([_term("license")], "h0"))
def search_term(spark, sf_dir):
    return _scores(spark, sf_dir, "license")


@query(_search_sql([_term("license"), _term("the")], "h0 AND h1"))
def search_adjacent(spark, sf_dir):
    return _scores(spark, sf_dir, "license the")


@query(_search_sql([_term("license"), _term("version")], "h0 AND h1"))
def search_and(spark, sf_dir):
    return _scores(spark, sf_dir, "license AND version")


@query(_search_sql([_term("license"), _term("und")], "h0 OR h1"))
def search_or(spark, sf_dir):
    return _scores(spark, sf_dir, "license OR und")


@query(_search_sql([_term("of"), _term("the"), _term("license")], "h0 AND h1 AND NOT h2"))
def search_not(spark, sf_dir):
    return _scores(spark, sf_dir, "of the NOT license")


@query(_search_sql([_term("the"), _term("license"), _term("der")], "(h0 AND NOT h1) OR h2"))
def search_precedence(spark, sf_dir):
    return _scores(spark, sf_dir, "the -license OR der")


@query(_search_sql(["SELECT a.doc, a.field FROM p a JOIN p b ON a.doc = b.doc AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"], "h0"))
def search_phrase(spark, sf_dir):
    return _scores(spark, sf_dir, '"of the"')


@query(_search_sql(["SELECT doc, field FROM p WHERE starts_with(term, 'licens')"], "h0"))
def search_prefix(spark, sf_dir):
    return _scores(spark, sf_dir, "licens*")


@query(_search_sql(["SELECT a.doc, a.field FROM p a JOIN p b ON a.doc = b.doc AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'the' AND starts_with(b.term, 'th')"], "h0"))
def search_phrase_prefix(spark, sf_dir):
    return _scores(spark, sf_dir, '"the th"*')


@query(_search_sql(["SELECT doc, field FROM p WHERE term = 'the' AND field = 'title'", _term("and")], "h0 AND h1"))
def search_field(spark, sf_dir):
    return _scores(spark, sf_dir, "title:the and")


@query(_search_sql(["SELECT doc, field FROM p WHERE term = 'the' AND pos = 0"], "h0"))
def search_anchored(spark, sf_dir):
    return _scores(spark, sf_dir, "^the")


@query(f"""WITH {_POSTINGS}, hit AS (
    SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc AND a.field = b.field
    WHERE a.term = 'license' AND b.term = 'the' AND greatest(a.pos, b.pos) - least(a.pos, b.pos) - 1 <= 3)
SELECT doc AS doc_id FROM hit""")
def search_near(spark, sf_dir):
    return _scores(spark, sf_dir, "NEAR(license the, 3)").select("doc_id")


@query(_search_sql([_term("license")], "h0", "ORDER BY score, doc LIMIT 10 OFFSET 5", "doc AS doc_id, score, (SELECT count(*) FROM hit) AS total_count"))
def search_page(spark, sf_dir):
    found = _scores(spark, sf_dir, "license").withColumnRenamed("doc_id", "doc")
    return fts.page(found, 10, 5).select(F.col("doc").alias("doc_id"), "score", "total_count")


@query(_search_sql([_term("license")], "h0", "JOIN documents ON doc = doc_id WHERE lang = 'en' ORDER BY score, doc LIMIT 10"))
def search_filtered(spark, sf_dir):
    found = _scores(spark, sf_dir, "license").withColumnRenamed("doc_id", "doc")
    ours = c.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return fts.page(found.join(ours, F.col("doc") == F.col("doc_id"))).select("doc_id", "score")


@query(r"""WITH k AS (SELECT event_id AS doc, event_type AS name, props AS body FROM events),
tk AS (SELECT doc, name, len(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) + len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) AS d,
    len(list_filter(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), lambda x: x = 'view')) * 5.0 + len(list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), lambda x: x = 'view')) AS f FROM k),
st AS (SELECT count(*) AS total, avg(d) AS average, count(*) FILTER (WHERE f > 0) AS n FROM tk)
SELECT doc, CASE WHEN lower(name) = 'view' THEN 0 WHEN contains(lower(name), 'view') THEN 1 ELSE 2 END AS name_rank,
    round(-(CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average)), 6) AS score
FROM tk, st WHERE f > 0 ORDER BY name_rank, score, doc LIMIT 50""")
def search_chunks(spark, sf_dir):
    events = c.table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.lit("TS 1").alias("spec_id"), F.lit("api").alias("api_name"), F.col("event_type").alias("name"), F.col("props").alias("body"), F.lit("schema").alias("kind"))
    index = fts.plain_index(events, "ord", {"name": 5.0, "body": 1.0}, r"[\p{L}\p{N}]+")
    rows = fts.search_chunks(events, index, "view", ["TS 1"], "API", "schema", 50)
    return rows.select("doc", fts.name_rank(F.col("name"), "view").alias("name_rank"), F.round("score", 6).alias("score"))


_FAMILY = "'TS ' || (doc_id % 9)::VARCHAR || CASE WHEN doc_id % 4 = 0 THEN '-' || (doc_id % 3)::VARCHAR ELSE '' END"


@query(_search_sql([_term("license")], "h0", f"JOIN documents ON doc = doc_id WHERE {_FAMILY} IN ('TS 3', 'TS 5') OR starts_with({_FAMILY}, 'TS 3-') OR starts_with({_FAMILY}, 'TS 5-') ORDER BY score, doc LIMIT 200 OFFSET 1"))
def search_family(spark, sf_dir):
    k = F.col("doc_id")
    spec = F.concat(F.lit("TS "), (k % 9).cast("string"), F.when(k % 4 == 0, F.concat(F.lit("-"), (k % 3).cast("string"))).otherwise(""))
    sections = c.table(spark, sf_dir, "documents").select(k.alias("ord"), spec.alias("spec_id"))
    rows = fts.search_sections(sections, _text_index(spark, sf_dir), "license", ["TS 3", "TS 5"], 500, 1)
    return rows.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query()
def search_stemmed(spark, sf_dir):
    sections = c.texts(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.lit("").alias("spec_id"), F.lit("").alias("number"), "title", "content")
    index = fts.section_index(sections).write(f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    rows = fts.search_sections(sections, index, "licenses OR licensing", limit=20)
    return fts.with_snippets(rows, index, "licenses OR licensing", ["content", "title"]).select("ord", F.round("score", 6).alias("score"), "snippet")


# Catalogue and versions ----------------------------------------------------------------------------


@query(f"""WITH {c.SPECS_SQL}, hit AS (SELECT id, version, series FROM specs WHERE series = 'en' AND (id ILIKE '23.%' OR id ILIKE 'TS 23.%' OR id ILIKE 'TR 23.%'))
SELECT *, (SELECT count(*) FROM hit) AS total_count FROM hit ORDER BY id, version LIMIT 20 OFFSET 3""")
def list_specs(spark, sf_dir):
    rows, total = catalog.specs_page(c.specs(spark, sf_dir).drop("doc_id"), "en", "23.", 0, 3)
    return rows.withColumn("total_count", F.lit(total).cast("long"))


@query(f"WITH {c.SPECS_SQL} SELECT regexp_replace(id, '-[0-9]+$', '') AS family, count(DISTINCT id) AS parts FROM specs WHERE id LIKE '%-%' GROUP BY 1")
def spec_families(spark, sf_dir):
    parts = c.specs(spark, sf_dir).where(F.contains("id", F.lit("-"))).select("id").distinct()
    return parts.groupBy(F.regexp_replace("id", r"-[0-9]+\z", "").alias("family")).agg(F.count("*").alias("parts"))


@query(f"""WITH {c.SPECS_SQL} SELECT id, version, CASE WHEN id LIKE 'TS %' THEN 'TR ' || substr(id, 4) ELSE 'TS ' || substr(id, 4) END AS other,
    substr(id, 4) AS bare, 'Rel-' || split_part(version, '.', 1) AS label, id || ' v' || version AS shown, substr(id, 4, 2) AS number_series,
    '/specs/' || replace(id, ' ', '%20') || '/sections/5.1' AS url, lower(replace(replace(replace(id, ' ', ''), '.', ''), '-', '')) AS key FROM specs""")
def spec_labels(spark, sf_dir):
    i, v = F.col("id"), F.col("version")
    return c.specs(spark, sf_dir).select(
        "id", "version", scalar.alternate_id(i).alias("other"), scalar.bare_id(i).alias("bare"), scalar.release_label(v).alias("label"), scalar.spec_label(i, v).alias("shown"),
        scalar.series_of(i).alias("number_series"), scalar.reference_url(i, F.lit("5.1")).alias("url"), scalar.definition_key(i).alias("key"),
    )


_DIGIT = "substr('0123456789abcdefghijklmnopqrstuvwxyz', {} + 1, 1)"


@query(f"WITH {c.DATED_SQL} SELECT ord, version, CASE WHEN y <= 35 THEN {_DIGIT.format('y')} || {_DIGIT.format('m')} || {_DIGIT.format('d')} END AS token, version AS back, version AS normal, y AS release FROM dated")
def version_tokens(spark, sf_dir):
    v = F.col("version")
    rows = c.dated(spark, sf_dir).select("ord", "version", scalar.dotted_to_token(v).alias("token"), scalar.release_of(v).cast("long").alias("release"))
    return rows.withColumn("back", scalar.token_to_dotted(F.col("token"))).withColumn("normal", scalar.normalize_version(F.concat(F.lit("v0"), v)))


@query(f"WITH {c.DATED_SQL} SELECT spec_id, arg_max(version, y * 10000 + m * 100 + d) AS version FROM dated GROUP BY spec_id")
def newest_versions(spark, sf_dir):
    return catalog.newest(c.dated(spark, sf_dir), ["spec_id"])


@query(f"WITH {c.DATED_SQL} SELECT ord, CASE WHEN y * 10000 + m * 100 + d < 50115 THEN -1 WHEN y * 10000 + m * 100 + d > 50115 THEN 1 ELSE 0 END AS cmp FROM dated")
def compare_version_numbers(spark, sf_dir):
    return c.dated(spark, sf_dir).select("ord", scalar.compare_versions(F.col("version"), F.lit("5.1.15")).alias("cmp"))


@query(f"""WITH {c.DATED_SQL}, a AS (SELECT spec_id, version, max(CASE WHEN ord % 3 = 0 THEN 2 WHEN ord % 2 = 0 THEN 1 ELSE 0 END) AS r, any_value(y * 10000 + m * 100 + d) AS k FROM dated GROUP BY ALL)
SELECT spec_id, version, CASE r WHEN 2 THEN 'database' WHEN 1 THEN 'cached' ELSE 'archive' END AS availability,
    row_number() OVER (PARTITION BY spec_id ORDER BY k DESC) AS place FROM a""")
def list_versions(spark, sf_dir):
    rows = c.dated(spark, sf_dir)
    found = catalog.versions(("archive", rows), ("cached", rows.where("ord % 2 = 0")), ("database", rows.where("ord % 3 = 0")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("spec_id").orderBy(scalar.version_key(F.col("version")).desc())).cast("long"))


@query(f"""WITH {c.DATED_SQL}, r AS (SELECT *, {_DIGIT.format('y')} || {_DIGIT.format('m')} || {_DIGIT.format('d')} AS token FROM dated)
SELECT spec_id[4:] AS spec, max((y, m * 36 + d, token))[1] AS release, max((y, m * 36 + d, token))[3] AS token FROM r WHERE y <= 6 GROUP BY 1""")
def latest_entries(spark, sf_dir):
    rows = c.dated(spark, sf_dir)
    line = F.concat(F.lit("archive/23_series/"), scalar.bare_id(F.col("spec_id")), F.lit("/"), F.replace(scalar.bare_id(F.col("spec_id")), F.lit("."), F.lit("")), F.lit("-"), scalar.dotted_to_token(F.col("version")), F.lit(".zip"))
    return catalog.latest_entries(archive.entries(rows.select(line.alias("line"))), max_release=6).select("spec", F.col("release").cast("long").alias("release"), "token")


@query(f"""WITH {c.DATED_SQL}, g AS (SELECT spec_id, max((y, m, d, version)) AS n, max(CASE WHEN ord % 4 <> 0 THEN (y, m, d, version) END) AS h FROM dated GROUP BY spec_id)
SELECT spec_id AS id, 'update' AS action, h[4] AS have_version, n[4] AS archive_version FROM g WHERE h IS NOT NULL AND n > h AND spec_id NOT LIKE '%7'
UNION ALL SELECT spec_id, 'remove', h[4], NULL FROM g WHERE h IS NOT NULL AND spec_id LIKE '%7'""")
def update_plan(spark, sf_dir):
    rows = c.dated(spark, sf_dir)
    everything = catalog.newest(rows, ["spec_id"]).withColumnRenamed("spec_id", "id")
    have = catalog.newest(rows.where("ord % 4 <> 0"), ["spec_id"]).withColumnRenamed("spec_id", "id")
    return catalog.update_plan(everything.where("id not like '%7'"), have, below_cap=everything)


@query(f"WITH {c.DATED_SQL} SELECT spec_id, arg_max(version, m * 100 + d) AS version FROM dated WHERE y = 6 GROUP BY spec_id")
def resolve_release(spark, sf_dir):
    return catalog.resolve(c.dated(spark, sf_dir), "Rel-6")


@query(f"WITH {c.DATED_SQL} SELECT DISTINCT spec_id, version FROM dated WHERE y = 5 AND m = 3 AND d = 9")
def resolve_version(spark, sf_dir):
    return catalog.resolve(c.dated(spark, sf_dir), "v5.03.9")


@query(f"""WITH {c.DATED_SQL} SELECT spec_id, version, CASE WHEN bool_or(ord % 3 = 0) THEN 'database' WHEN bool_or(ord % 2 = 0) THEN 'cache' ELSE 'archive' END AS place FROM dated GROUP BY ALL""")
def version_places(spark, sf_dir):
    rows = c.dated(spark, sf_dir)
    return catalog.placed(("database", rows.where("ord % 3 = 0")), ("cache", rows.where("ord % 2 = 0")), ("archive", rows))


# Hierarchy -----------------------------------------------------------------------------------------


@query(f"""WITH {c.CLAUSES_SQL} SELECT ord, number, title, level, repeat('  ', level - 1) || '- ' || number || ' ' || title AS line FROM clauses WHERE spec_id = '2'""")
def table_of_contents(spark, sf_dir):
    rows = c.clauses(spark, sf_dir).withColumn("parent_number", F.lit(None).cast("string")).withColumn("version", F.lit(""))
    found = hierarchy.toc(rows, "2")
    return found.select("ord", "number", "title", "level", hierarchy.toc_line(F.col("number"), F.col("title"), F.col("level")).alias("line"))


@query(f"WITH {c.CLAUSES_SQL} SELECT number, title, content FROM clauses WHERE number = '8' OR starts_with(number, '8.')")
def section_subtree(spark, sf_dir):
    return hierarchy.subtree(c.clauses(spark, sf_dir), "8").select("number", "title", "content")


@query(f"WITH {c.CLAUSES_SQL} SELECT split_part(number, '.', 1) AS top, md5(string_agg(title || ' ' || content, chr(10) || chr(10) ORDER BY ord)) AS digest FROM clauses GROUP BY 1")
def joined_sections(spark, sf_dir):
    rows = c.clauses(spark, sf_dir).withColumn("top", F.substring_index("number", ".", 1))
    return hierarchy.joined_text(rows.withColumn("content", F.concat_ws(" ", "title", "content")), ["top"]).select("top", F.md5("text").alias("digest"))


@query("""SELECT conv_id::VARCHAR AS spec_id, turn AS ord, lag(turn::VARCHAR) OVER w AS previous, lead(turn::VARCHAR) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adjacent_sections(spark, sf_dir):
    return hierarchy.neighbours(c.turns(spark, sf_dir), ["spec_id"]).select("spec_id", "ord", "previous", "next")


@query("""SELECT a.conv_id::VARCHAR AS spec_id, a.turn AS ord, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn % 4 < a.turn % 4) AS parent_ord FROM conversations a""")
def parent_sections(spark, sf_dir):
    return hierarchy.parents(c.turns(spark, sf_dir), ["spec_id"], deepest=5).select("spec_id", "ord", "parent_ord")


@query("SELECT conv_id::VARCHAR AS spec_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole, TRUE AS fits, TRUE AS tight, TRUE AS runs_on FROM conversations GROUP BY conv_id")
def paged_text(spark, sf_dir):
    """Pages put together again are the whole text. Each keeps its limits and has no room for the next one's
    first line; without a limit of characters one has more lines only up to a blank one."""
    whole = hierarchy.joined_text(c.turns(spark, sf_dir), ["spec_id"])
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    put_together = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    first = F.split_part(F.lead("text").over(Window.partitionBy("spec_id").orderBy("page")), F.lit("\n"), F.lit(1))
    short = hierarchy.pages(whole, ["spec_id"], max_lines=10, max_chars=2000)
    short = short.withColumn("fits", (F.col("lines") <= 10) & ((F.length("text") < 2000) | (F.col("lines") == 1)))
    short = short.withColumn("tight", first.isNull() | (F.col("lines") == 10) | (F.length("text") + F.length(first) + 2 > 2000))
    short = short.groupBy("spec_id").agg(put_together.alias("whole"), F.bool_and("fits").alias("fits"), F.bool_and("tight").alias("tight"))
    last = F.substring_index("text", "\n", -1)
    long_ = hierarchy.pages(whole, ["spec_id"], max_lines=10)
    runs_on = (F.col("lines") <= 10) | ((F.col("lines") <= 12) & (last == ""))
    long_ = long_.groupBy("spec_id").agg(F.bool_and(runs_on).alias("on"), put_together.alias("again"))
    return short.join(long_, "spec_id").select("spec_id", "whole", "fits", "tight", (F.col("on") & (F.col("again") == F.col("whole"))).alias("runs_on"))


@query(f"""WITH {c.SPECS_SQL} SELECT id, version, id || ' v' || version || ' (Rel-' || split_part(version, '.', 1) || ')' AS header,
    'v' || version || ' (Rel-' || split_part(version, '.', 1) || CASE WHEN doc_id % 2 = 0 THEN ', archived' ELSE '' END || ')' AS label,
    '[Compare: ' || id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' — Section 5.1' END || ' — v' || version || ' → the database version]' AS compared FROM specs""")
def provenance_lines(spark, sf_dir):
    i, v, k = F.col("id"), F.col("version"), F.col("doc_id")
    side = F.concat(F.lit("v"), v)
    return c.specs(spark, sf_dir).select(
        "id", "version", scalar.spec_header(i, v, v).alias("header"), scalar.version_label(v, v, k % 2 == 0).alias("label"),
        scalar.compare_header(i, F.when(k % 3 != 0, "5.1").otherwise(""), side, scalar.version_label(F.lit(""), v, F.lit(False))).alias("compared"),
    )


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS width, round(p_size * 96.0 / 72)::BIGINT AS height FROM part""")
def shape_sizes(spark, sf_dir):
    size = F.col("p_size").cast("string")
    width = F.when(F.col("p_partkey") % 4 == 0, F.lit("z-index:1")).otherwise(F.concat(F.lit(" width : "), size, F.lit("px")))
    style = F.concat(width, F.lit("; height:"), size, F.lit("pt;margin-width:9pt"))
    return c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scalar.shape_size(style).alias("s")).select("k", "s.*")


@query("""WITH d AS (SELECT p_partkey AS k, 'TS 23.' || p_size::VARCHAR AS spec_id, p_size % 3 = 0 AS report FROM part)
SELECT k, CASE WHEN report THEN 'TR ' || substr(spec_id, 4) ELSE spec_id END AS spec_id, CASE WHEN k % 2 = 0 THEN '18.' || (k % 7)::VARCHAR || '.0' WHEN k % 5 = 0 THEN '101203' ELSE '1.0.0' END AS version,
    CASE WHEN k % 2 = 0 THEN '18' ELSE '7' END AS release, row_number() OVER (PARTITION BY spec_id ORDER BY k % 3 = 0, lpad(k::VARCHAR, 9, '0')) AS file_order FROM d""")
def reconciled_records(spark, sf_dir):
    """Records under the type that their document's cover tells, with their archive entry's version, covers last."""
    k = F.col("k")
    rows = c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("TS 23."), F.col("p_size").cast("string")).alias("spec_id"), F.lit("1.0.0").alias("version"), F.lit("7").alias("release"), F.col("p_size"))
    rows = archive.cover_last(rows.withColumn("name", F.concat(F.lpad(k.cast("string"), 9, "0"), F.when(k % 3 == 0, "_cover.docx").otherwise(".docx"))), ["spec_id"])
    told = rows.select("p_size", F.when((F.col("p_size") % 3 == 0) & (k == F.min("k").over(Window.partitionBy("p_size"))), "TR").otherwise("").alias("doc_type"))
    entries = rows.select("k", F.when(k % 2 == 0, F.concat(F.lit("i"), (k % 7).cast("string"), F.lit("0"))).when(k % 5 == 0, "101203").alias("token"), F.when(k % 2 == 0, 18).otherwise(0).alias("release"))
    rows = archive.with_archive_version(archive.with_doc_type(rows, told, "p_size"), entries, "k")
    return rows.select("k", "spec_id", "version", "release", F.col("file_order").cast("long").alias("file_order"))


@query(f"WITH {c.CLAUSES_SQL} SELECT spec_id, md5(string_agg(repeat('#', level) || ' ' || number || ' ' || title || CASE WHEN content <> '' THEN chr(10) || chr(10) || content ELSE '' END, chr(10) || chr(10) ORDER BY ord)) AS digest FROM clauses GROUP BY spec_id")
def markdown_documents(spark, sf_dir):
    return hierarchy.markdown(c.clauses(spark, sf_dir), ["spec_id"]).select("spec_id", F.md5("text").alias("digest"))


# Differences ---------------------------------------------------------------------------------------


@query(f"""WITH {c.PARTS_SQL}, j AS (SELECT coalesce(o.number, w.number) AS number, o.title AS ot, w.title AS wt, o.body AS ob, w.body AS wb, o.lines AS ol, w.lines AS wl FROM o FULL JOIN w ON o.number = w.number),
gone AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(ot))) AS u FROM j WHERE wt IS NULL), fresh AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(wt))) AS u FROM j WHERE ot IS NULL),
mv AS (SELECT g.number AS old_number, f.number, g.ot, f.wt, g.ob, f.wb, g.ol, f.wl FROM gone g JOIN fresh f ON lower(trim(g.ot)) = lower(trim(f.wt)) WHERE g.u = 1 AND f.u = 1)
SELECT 'removed' AS change, NULL AS number, number AS old_number, ot AS old_title, NULL AS new_title, ol AS old_lines, 0 AS new_lines FROM gone WHERE number NOT IN (SELECT old_number FROM mv)
UNION ALL SELECT 'added', number, NULL, NULL, wt, 0, wl FROM fresh WHERE number NOT IN (SELECT number FROM mv)
UNION ALL SELECT 'retitled', number, number, ot, wt, ol, wl FROM j WHERE ot <> wt
UNION ALL SELECT 'content', number, number, ot, wt, ol, wl FROM j WHERE ob <> wb
UNION ALL SELECT 'renumbered', number, old_number, ot, wt, ol, wl FROM mv
UNION ALL SELECT 'content', number, old_number, ot, wt, ol, wl FROM mv WHERE ob <> wb""")
def structural_diff(spark, sf_dir):
    return diff.structural(c.part_sections(spark, sf_dir, True), c.part_sections(spark, sf_dir, False))


@query()
def textual_diff(spark, sf_dir):
    """Every document against the next one of its source with the same first line."""
    rows = c.table(spark, sf_dir, "documents").withColumn("first", F.split_part("text", F.lit("\n"), F.lit(1)))
    order = Window.partitionBy("source", "first").orderBy("doc_id")
    pairs = rows.withColumn("next_id", F.lead("doc_id").over(order)).withColumn("next_text", F.lead("text").over(order)).where("next_id is not null")
    return diff.textual(pairs.select("doc_id", "next_id", "text", "next_text"), "text", "next_text").drop("text", "next_text")


# Pictures ------------------------------------------------------------------------------------------


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a document for each size: every third as converted, every fifth as its source too."""
    p, k = c.table(spark, sf_dir, "part"), F.col("p_partkey")
    base = F.concat(F.lit("image"), k.cast("string"))
    row = lambda name, kind, readable: F.struct(F.concat(base, F.lit(name)).alias("name"), F.lit(kind).alias("mime_type"), F.lit(readable).alias("llm_readable"))
    each = F.array_compact(F.array(F.when(k % 3 == 0, row(".png", "image/png", True)), F.when((k % 3 != 0) | (k % 5 == 0), row(".emf", "image/x-emf", False))))
    return p.select(F.concat(F.lit("TS "), F.col("p_size").cast("string")).alias("spec_id"), F.lit("1").alias("version"), F.col("p_name").cast("binary").alias("data"), F.explode(each).alias("i")).select("spec_id", "version", "data", "i.*")


_IMAGES = """i AS (SELECT p_partkey AS k, p_size, 'image' || p_partkey::VARCHAR || '.png' AS name, 'image/png' AS mime_type, TRUE AS llm_readable FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, p_size, 'image' || p_partkey::VARCHAR || '.emf', 'image/x-emf', FALSE FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 = 0)"""


@query(f"WITH {_IMAGES} SELECT name, mime_type, llm_readable FROM i WHERE p_size = 7 ORDER BY name")
def image_list(spark, sf_dir):
    return catalog.image_list(_images(spark, sf_dir), "TS 7", "1")


@query(f"""WITH {_IMAGES}, a(asked, k) AS (VALUES ('image15.emf', 15), ('image15.wmf', 15), ('image16.png', 16), ('image18', 18), ('image1', -1))
SELECT asked, name, llm_readable FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY (name = asked) DESC, llm_readable DESC, name) AS r FROM a JOIN i USING (k)) WHERE r = 1""")
def image_named(spark, sf_dir):
    """By the very name, else by the name without its ending, readable ones first."""
    images = _images(spark, sf_dir).withColumn("spec_id", F.lit("all"))
    asked = ("image15.emf", "image15.wmf", "image16.png", "image18", "image")
    each = [catalog.image(images, "all", "1", name).select(F.lit(name).alias("asked"), "name", "llm_readable") for name in asked]
    return functools.reduce(DataFrame.unionByName, each)


@query(f"""WITH {c.CLAUSES_SQL} SELECT ord, CASE WHEN spec_id <> '2' THEN 'Region ' || spec_id END AS spec_title, CASE WHEN spec_id <> '2' THEN '18' END AS spec_release FROM clauses""")
def sections_with_specs(spark, sf_dir):
    specs = c.table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("id"), F.lit("1").alias("version"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("title"), F.lit("18").alias("release"))
    return catalog.with_specs(c.clauses(spark, sf_dir).withColumn("version", F.lit("1")), specs).select("ord", "spec_title", "spec_release")


# References ----------------------------------------------------------------------------------------

_LINKS = """links AS (SELECT page_id AS source, unnest(h) AS target, unnest(range(len(h))) AS place
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages))"""


@query(f"WITH {_LINKS} SELECT source, place, target FROM links")
def page_links(spark, sf_dir):
    return c.page_links(spark, sf_dir).select("source", F.col("place").cast("long").alias("place"), "target")


@query(f"""WITH {_LINKS}, e AS (SELECT DISTINCT source::VARCHAR AS s, target AS t FROM links), o AS (SELECT s, count(*) AS n FROM e GROUP BY s), i AS (SELECT t, count(*) AS n FROM e GROUP BY t)
SELECT coalesce(s, t) AS spec_id, coalesce(o.n, 0) AS cites, coalesce(i.n, 0) AS cited FROM o FULL JOIN i ON s = t""")
def reference_degrees(spark, sf_dir):
    found = c.page_links(spark, sf_dir).select(F.col("source").cast("string").alias("source_spec_id"), F.col("target").alias("target_spec"))
    return references.degrees(found)


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cite their customer's section in the customer's nation; every seventh cites none that is there."""
    o = c.table(spark, sf_dir, "orders").join(c.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(c.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    section = F.concat_ws(".", F.col("n_nationkey").cast("string"), (F.col("c_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 10**7).otherwise(0)).cast("string"))
    return o.select(F.col("o_orderkey").cast("string").alias("source_spec_id"), F.lit("1").alias("source_version"), F.lit("4").alias("source_section"), F.col("n_regionkey").cast("string").alias("target_spec"), section.alias("target_section"), F.lit("").alias("context"))


_EDGES = """e AS (SELECT o_orderkey::VARCHAR AS source_spec_id, n_regionkey::VARCHAR AS target_spec, n_nationkey::VARCHAR || '.' || (c_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 10000000 ELSE 0 END)::VARCHAR AS target_section
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {c.CLAUSES_SQL}, {_EDGES} SELECT source_spec_id, target_spec, target_section, coalesce(title, '') AS target_title FROM e LEFT JOIN clauses ON target_spec = spec_id AND target_section = number")
def references_with_titles(spark, sf_dir):
    found = references.with_titles(_order_edges(spark, sf_dir), c.clauses(spark, sf_dir))
    return found.select("source_spec_id", "target_spec", "target_section", "target_title")


@query(f"WITH {_EDGES} SELECT source_spec_id, target_section FROM e WHERE target_spec = '1' AND (target_section = '6' OR starts_with(target_section, '6.')) ORDER BY source_spec_id, target_spec, target_section LIMIT 500")
def references_incoming(spark, sf_dir):
    found = references.incoming(_order_edges(spark, sf_dir), "1", "6", subsections=True)
    return references.reference_page(found).select("source_spec_id", "target_section")


@query(f"""WITH {_EDGES}, s AS (SELECT source_spec_id::BIGINT % 50 AS k, '4' || CASE source_spec_id::BIGINT % 3 WHEN 0 THEN '' WHEN 1 THEN '.A' ELSE '1' END AS source_section, target_spec, target_section FROM e)
SELECT source_section, target_spec, target_section FROM s WHERE k = 7 AND source_section IN ('4', '4.A') ORDER BY source_section, target_spec, target_section LIMIT 500 OFFSET 3""")
def references_outgoing(spark, sf_dir):
    """Out of a section and its subsections; section 41 is none of them."""
    k = F.col("source_spec_id").cast("long")
    section = F.concat(F.lit("4"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".A").otherwise("1"))
    found = _order_edges(spark, sf_dir).withColumns({"source_section": section, "source_spec_id": F.concat(F.lit("C"), (k % 50).cast("string"))})
    rows = references.outgoing(found, "C7", "4", version="1", subsections=True)
    return references.reference_page(rows, 3).select("source_section", "target_spec", "target_section")


@query(f"WITH {c.CLAUSES_SQL}, {_EDGES} SELECT source_spec_id, target_spec, target_section FROM e WHERE NOT EXISTS (SELECT 1 FROM clauses WHERE spec_id = target_spec AND number = target_section)")
def references_dangling(spark, sf_dir):
    return references.dangling(_order_edges(spark, sf_dir), c.clauses(spark, sf_dir)).select("source_spec_id", "target_spec", "target_section")


_CITING = """s AS (SELECT doc_id, 'TS ' || (21 + doc_id % 9)::VARCHAR || '.' || (100 + doc_id % 50)::VARCHAR AS t, (1 + doc_id % 8)::VARCHAR || '.' || (doc_id % 5)::VARCHAR AS n FROM documents)"""


@query(f"""WITH {_CITING} SELECT doc_id::VARCHAR AS source_spec_id, t AS target_spec, n AS target_section FROM s
UNION ALL SELECT doc_id::VARCHAR, t, n || '.1' FROM s UNION ALL SELECT doc_id::VARCHAR, t, '' FROM s
UNION ALL SELECT doc_id::VARCHAR, 'RFC 3261', '4' FROM s UNION ALL SELECT doc_id::VARCHAR, 'TR 33.203', 'H' FROM s""")
def reference_extraction(spark, sf_dir):
    return references.edges(_citing(spark, sf_dir)).where("source_section = '1'").select("source_spec_id", "target_spec", "target_section")


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sentences that cite: a list before a designator, an RFC's section, a bracketed number."""
    n = F.col("doc_id")
    spec = F.concat(F.lit("TS "), (n % 9 + 21).cast("string"), F.lit("."), (n % 50 + 100).cast("string"))
    clause = F.concat((n % 8 + 1).cast("string"), F.lit("."), (n % 5).cast("string"))
    text = F.concat("text", F.lit("\n\nSee clauses "), clause, F.lit(" and "), clause, F.lit(".1 of 3GPP\n"), spec, F.lit(". Also RFC 3261, section 4; and [7], Annex H there."))
    rows = c.table(spark, sf_dir, "documents").select(n.cast("string").alias("spec_id"), F.lit("1").alias("version"), n.alias("ord"), text.alias("content"))
    listed = rows.select("spec_id", "version", (F.col("ord") + 10**9).alias("ord"), F.lit("2").alias("number"), F.lit("References").alias("title"), F.lit("[7] 3GPP TR 33.203: \"x\"").alias("content"))
    return rows.select("spec_id", "version", "ord", F.lit("1").alias("number"), F.lit("t").alias("title"), "content").unionByName(listed)


@query(f"""WITH {_CITING} SELECT doc_id::VARCHAR AS spec_id, md5(text || chr(10) || chr(10) || 'See clauses [' || n || '](/specs/' || replace(t, ' ', '%20') || '/sections/' || n || ') and [' || n || '.1](/specs/' || replace(t, ' ', '%20') || '/sections/' || n || '.1) of [3GPP' || chr(10) || t || '](/specs/' || replace(t, ' ', '%20') || ')' || '. Also [RFC 3261, section 4](https://www.rfc-editor.org/rfc/rfc3261#section-4); and [[7], Annex H](/specs/TR%2033.203/sections/H) there.') AS digest FROM s JOIN documents USING (doc_id)""")
def linked_references(spark, sf_dir):
    linked = references.linkified(_citing(spark, sf_dir)).where("number = '1'")
    return linked.select("spec_id", F.md5("linked").alias("digest"))


# Definitions ---------------------------------------------------------------------------------------

_DEFS = """d AS (SELECT s_suppkey AS k, 'TS 38.' || s_nationkey::VARCHAR AS spec_id, s_suppkey::VARCHAR AS n, s_name FROM supplier), defs AS (
    SELECT k * 2 AS ord, 'Supplier-' || n || '-Name' AS name, 'supplier' || n || 'name' AS key, spec_id, '6.' || n AS section_number, s_name AS section_title,
        chr(9) || 'Supplier-' || n || '-Name ::= SEQUENCE {' || chr(10) || '  a INTEGER,' || chr(10) || '  b Key-' || n || chr(10) || '}' AS body FROM d
    UNION ALL SELECT k * 2 + 1, 'maxKey' || n, 'maxkey' || n, spec_id, '6.' || n, s_name, 'maxKey' || n || ' INTEGER ::= 4 -- tail' FROM d)"""


@query(f"WITH {_DEFS} SELECT name, key, spec_id, section_number, section_title, body FROM defs")
def definitions(spark, sf_dir):
    return defs.extract(c.code_sections(spark, sf_dir)).select("name", "key", "spec_id", "section_number", "section_title", "body")


@query(f"WITH {_DEFS} SELECT name, spec_id, body FROM defs WHERE name = 'Supplier-7-Name'")
def definition_lookup(spark, sf_dir):
    return defs.lookup(defs.extract(c.code_sections(spark, sf_dir)), "Supplier 7 name").select("name", "spec_id", "body")


@query(f"WITH {_DEFS} SELECT name, row_number() OVER (ORDER BY min(ord)) AS place FROM defs WHERE contains(key, 'key1') OR contains('key1', key) GROUP BY name ORDER BY min(ord) LIMIT 10")
def definition_suggestions(spark, sf_dir):
    found = defs.suggestions(defs.extract(c.code_sections(spark, sf_dir)), "Key-1")
    return found.select("name", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))


@query(f"WITH {_DEFS} SELECT spec_id, section_number, string_agg(name, ',' ORDER BY ord) AS names FROM defs GROUP BY spec_id, section_number")
def definition_listing(spark, sf_dir):
    found = defs.listing(defs.extract(c.code_sections(spark, sf_dir)))
    return found.select("spec_id", "section_number", F.array_join("names", ",").alias("names"))


@query(f"WITH {_DEFS} SELECT count(*) AS definitions, count(DISTINCT (spec_id, name)) AS names, count(DISTINCT spec_id) AS specs FROM defs")
def definition_stats(spark, sf_dir):
    return defs.stats(defs.extract(c.code_sections(spark, sf_dir)))


# API descriptions ----------------------------------------------------------------------------------


def _api_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description for each customer: one path, and two schemas of which one refers to the nation's."""
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    yaml = F.concat(
        F.lit("openapi: 3.0.0\npaths:\n  /c/"), k, F.lit(":\n    post:\n      summary: put one\n      requestBody:\n        content:\n          application/json:\n            schema:\n              $ref: '#/components/schemas/C"), k,
        F.lit("'\n    get:\n      summary: \"yes\"\ncomponents:\n  schemas:\n    C"), k, F.lit(":\n      type: object\n      required: [a]\n      properties:\n        a: {type: string}\n        on: {$ref: 'nation.yaml#/components/schemas/N"), n, F.lit("'}\n    Flag:\n      enum: [yes, no]\n"),
    )
    docs = c.table(spark, sf_dir, "customer").select(F.concat(F.lit("TS 29."), n).alias("spec_id"), F.concat(F.lit("Api_"), k).alias("api_name"), F.lit("1").alias("version"), F.concat(F.lit("c"), k, F.lit(".yaml")).alias("filename"), yaml.alias("content"))
    shared = c.table(spark, sf_dir, "nation").agg(F.concat(F.lit("components:\n  schemas:\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("    N"), F.col("n_nationkey").cast("string"), F.lit(": {type: string, description: "), "n_name", F.lit("}")))), "\n")).alias("content"))
    return docs.unionByName(shared.select(F.lit("TS 29.99").alias("spec_id"), F.lit("Nations").alias("api_name"), F.lit("1").alias("version"), F.lit("nation.yaml").alias("filename"), "content"))


_API = """d AS (SELECT 'TS 29.' || c_nationkey::VARCHAR AS spec_id, 'Api_' || c_custkey::VARCHAR AS api_name, c_custkey::VARCHAR AS k, c_nationkey::VARCHAR AS n FROM customer)"""


@query(f"""WITH {_API} SELECT api_name, 'schema' AS kind, 'C' || k AS name, 'nation.yaml/N' || n AS refs FROM d UNION ALL SELECT api_name, 'schema', 'Flag', '' FROM d
UNION ALL SELECT api_name, 'operation', 'POST /c/' || k, 'c' || k || '.yaml/C' || k FROM d UNION ALL SELECT api_name, 'operation', 'GET /c/' || k, '' FROM d
UNION ALL SELECT 'Nations', 'schema', 'N' || n_nationkey::VARCHAR, '' FROM nation""")
def api_parts(spark, sf_dir):
    refs = F.array_join(F.transform("refs", lambda r: F.concat_ws("/", r["file"], r["schema"])), ",")
    return openapi.parts(_api_docs(spark, sf_dir)).select("api_name", "kind", "name", refs.alias("refs"))


@query(f"""WITH {_API}, c AS (SELECT api_name, k, chr(10) || '  type: object' || chr(10) || '  required: a' || chr(10) || '  properties:' || chr(10) || '    a:' || chr(10) || '      type: string' || chr(10) || '    on:' || chr(10)
    || '      $ref: nation.yaml#/components/schemas/N' || n || chr(10) || '      # expanded:' || chr(10) || '      N' || n || ':' || chr(10) || '        type: string' || chr(10) || '        description: ' || n_name AS body FROM d JOIN nation ON n = n_nationkey::VARCHAR)
SELECT api_name, 'schema' AS kind, 'C' || k AS name, 'C' || k || ':' || body AS body FROM c
UNION ALL SELECT api_name, 'schema', 'Flag', 'Flag:' || chr(10) || '  enum: yes, no' FROM d
UNION ALL SELECT api_name, 'operation', 'GET /c/' || k, 'GET /c/' || k || chr(10) || '  summary: yes' FROM d
UNION ALL SELECT api_name, 'operation', 'POST /c/' || k, 'POST /c/' || k || chr(10) || '  summary: put one' || chr(10) || '  requestBody:' || chr(10) || replace('    C' || k || ':' || body, chr(10), chr(10) || '    ') FROM c
UNION ALL SELECT 'Nations', 'schema', 'N' || n_nationkey::VARCHAR, 'N' || n_nationkey::VARCHAR || ':' || chr(10) || '  type: string' || chr(10) || '  description: ' || n_name FROM nation""")
def api_chunks(spark, sf_dir):
    return openapi.chunks(_api_docs(spark, sf_dir)).select("api_name", "kind", "name", "body")


@query(f"""WITH {_API} SELECT api_name, CASE WHEN k::BIGINT % 3 = 0 THEN NULL ELSE 'openapi: 3.0.0' || chr(10) || 'components:' || chr(10) || '  schemas:' || chr(10) || '    Flag:' || chr(10) || '      enum:' || chr(10) || '      - yes' || chr(10) || '      - no' || chr(10) END AS part,
    CASE WHEN k::BIGINT % 3 = 0 THEN 'no such schema; there are: C' || k || ', None' END AS error FROM d""")
def api_restricted(spark, sf_dir):
    other = F.when(F.col("filename").substr(F.lit(2), F.length("filename") - 6).cast("long") % 3 == 0, F.replace("content", F.lit("Flag:"), F.lit("None:"))).otherwise(F.col("content"))
    docs = _api_docs(spark, sf_dir).where("api_name <> 'Nations'").withColumn("content", other)
    return openapi.restricted(docs, schema="Flag").select("api_name", F.replace(F.replace("part", F.lit("'yes'"), F.lit("yes")), F.lit("'no'"), F.lit("no")).alias("part"), "error")


@query(f"WITH {_API} SELECT spec_id, api_name, 'Flag' AS name FROM d")
def api_schema_owners(spark, sf_dir):
    return openapi.owners(openapi.parts(_api_docs(spark, sf_dir)), "flag")


@query("SELECT 'TS 29.' || c_nationkey::VARCHAR AS spec_id, 'Api_' || c_custkey::VARCHAR AS api_name FROM customer WHERE c_custkey = 17")
def api_find(spark, sf_dir):
    docs = _api_docs(spark, sf_dir)
    spec = docs.where("api_name = 'Api_17'").select("spec_id").first()[0]
    return openapi.find(docs, spec, "C17.YAML").select("spec_id", "api_name")


@query(f"WITH {_API} SELECT spec_id, api_name, '1' AS version, 'c' || k || '.yaml' AS filename FROM d WHERE spec_id = 'TS 29.3'")
def api_listing(spark, sf_dir):
    return openapi.listing(_api_docs(spark, sf_dir), "TS 29.3")


@query("SELECT event_type, (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark, sf_dir):
    rows = c.table(spark, sf_dir, "events").withColumn("v", F.parse_json("props"))
    return rows.groupBy("event_type", F.variant_get("v", "$.k", "long").alias("k")).agg(F.count("*").alias("n"))


# Maintenance ---------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0
UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 100 = 0""")
def upserted(spark, sf_dir):
    key = F.col("c_custkey")
    rows = c.table(spark, sf_dir, "customer")
    old = rows.where(key % 5 != 0).select(key.alias("key"), F.col("c_mktsegment").alias("value"))
    new = rows.where(key % 3 == 0).select(key.alias("key"), F.lit("new").alias("value")).unionByName(rows.where(key % 100 == 0).select((-key).alias("key"), F.lit("new").alias("value")))
    return maintain.upsert(old, new, ["key"])


@query(f"""WITH {c.DATED_SQL}, old AS (SELECT DISTINCT spec_id, version FROM dated WHERE ord % 4 <> 0), inc AS (SELECT spec_id, arg_max(version, y * 10000 + m * 100 + d) AS version FROM dated GROUP BY spec_id)
SELECT old.spec_id AS id, old.version FROM old JOIN inc ON old.spec_id = inc.spec_id AND old.version <> inc.version""")
def superseded_versions(spark, sf_dir):
    rows = c.dated(spark, sf_dir)
    old = rows.where("ord % 4 <> 0").select(F.col("spec_id").alias("id"), "version").distinct()
    return maintain.superseded(old, catalog.newest(rows, ["spec_id"]).withColumnRenamed("spec_id", "id"))


def _documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Regions as documents with their sections, and citations between neighbouring nations' sections."""
    sections = c.clauses(spark, sf_dir).withColumn("version", F.lit("1"))
    specs = sections.select(F.col("spec_id").alias("id"), "version").distinct()
    cited = sections.where("level = 2").select(F.col("spec_id").alias("source_spec_id"), F.col("version").alias("source_version"), F.col("number").alias("source_section"), ((F.col("spec_id").cast("int") + F.length("title") + 1) % 5).cast("string").alias("target_spec"), F.lit("1").alias("target_section"), F.lit("").alias("context"))
    return {"specs": specs, "sections": sections, "edges": cited}


_DELETED = "SELECT spec_id AS a, number AS b, 'sections' AS name FROM clauses WHERE spec_id <> '3' UNION ALL SELECT DISTINCT spec_id, '', 'specs' FROM clauses WHERE spec_id <> '3'"


@query(f"WITH {c.CLAUSES_SQL} {_DELETED} UNION ALL SELECT spec_id, ((spec_id::INT + length(title) + 1) % 5)::VARCHAR, 'edges' FROM clauses WHERE level = 2 AND spec_id <> '3'")
def deleted_document(spark, sf_dir):
    left = maintain.delete_document(_documents(spark, sf_dir), "3", "1")
    rows = left["sections"].select(F.col("spec_id").alias("a"), F.col("number").alias("b"), F.lit("sections").alias("name"))
    rows = rows.unionByName(left["specs"].select(F.col("id").alias("a"), F.lit("").alias("b"), F.lit("specs").alias("name")))
    return rows.unionByName(left["edges"].select(F.col("source_spec_id").alias("a"), F.col("target_spec").alias("b"), F.lit("edges").alias("name")))


@query(f"""WITH {c.CLAUSES_SQL}, new AS (SELECT n_nationkey::VARCHAR AS number, n_name FROM nation)
{_DELETED} UNION ALL SELECT spec_id, ((spec_id::INT + length(title) + 1) % 5)::VARCHAR, 'edges' FROM clauses WHERE level = 2 AND spec_id <> '3'
UNION ALL SELECT '3', number, 'sections' FROM new UNION ALL SELECT '3', '', 'specs' UNION ALL SELECT '3', 'TS 23.' || (number::INT + 100)::VARCHAR, 'edges' FROM new, (VALUES ('5.1'), ('')) t(section) UNION ALL SELECT '3', 'RFC 3261', 'edges' FROM new""")
def inserted_document(spark, sf_dir):
    """A new version of a document in place of the old; its citations are read from its sections."""
    tables, n = _documents(spark, sf_dir), F.col("n_nationkey")
    text = F.concat(F.lit("As clause 5.1 of TS 23."), (n + 100).cast("string"), F.lit(" says; see RFC 3261, section 4."))
    sections = c.table(spark, sf_dir, "nation").select(F.lit("3").alias("spec_id"), n.cast("long").alias("ord"), n.cast("string").alias("number"), F.col("n_name").alias("title"), F.lit(1).alias("level"), text.alias("content"), F.lit("2").alias("version"))
    new = {"specs": spark.createDataFrame([("3", "2")], "id string, version string"), "sections": sections.select(tables["sections"].columns)}
    left = maintain.insert_documents(tables, new)
    rows = left["sections"].select(F.col("spec_id").alias("a"), F.col("number").alias("b"), F.lit("sections").alias("name"))
    rows = rows.unionByName(left["specs"].select(F.col("id").alias("a"), F.lit("").alias("b"), F.lit("specs").alias("name")))
    return rows.unionByName(left["edges"].select(F.col("source_spec_id").alias("a"), F.col("target_spec").alias("b"), F.lit("edges").alias("name")))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 'third' WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_mktsegment END AS value FROM customer
UNION ALL SELECT -c_custkey, 'second' FROM customer WHERE c_custkey % 100 = 50""")
def published_changes(spark, sf_dir):
    """A table published, changed twice by buckets, and read by its pointer."""
    path, key, rows = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}", F.col("c_custkey"), c.table(spark, sf_dir, "customer")
    maintain.publish(rows.select(key.alias("key"), F.col("c_mktsegment").alias("value")), path, ["key"], 8)
    second = rows.where(key % 3 == 0).select(key.alias("key")).unionByName(rows.where(key % 100 == 50).select((-key).alias("key")))
    maintain.publish_changes(second.withColumn("value", F.lit("second")), path, ["key"])
    maintain.publish_changes(rows.where(key % 7 == 0).select(key.alias("key"), F.lit("third").alias("value")), path, ["key"])
    return maintain.current(spark, path)


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("spec_id")).agg(F.lit("1").alias("version"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"), F.max("o_orderdate").alias("last_used_at"), F.min("o_orderkey").alias("ord"))


@query("""WITH e AS (SELECT o_custkey::VARCHAR AS spec_id, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes, max(o_orderdate) AS last_used_at, min(o_orderkey) AS ord FROM orders GROUP BY 1),
r AS (SELECT *, sum(bytes) OVER (ORDER BY (spec_id = '7') DESC, last_used_at DESC, ord DESC ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT spec_id, bytes FROM r WHERE s <= 50000000 OR spec_id = '7'""")
def evicted_cache(spark, sf_dir):
    return maintain.evict(_cache(spark, sf_dir), 50_000_000, ("7", "1")).select("spec_id", "bytes")


@query("""SELECT o_custkey::VARCHAR AS spec_id, greatest(max(o_orderdate), any_value(t)) AS last_used_at FROM orders LEFT JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) ON user_id = o_custkey GROUP BY o_custkey""")
def touched_cache(spark, sf_dir):
    log = c.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("spec_id"), F.lit("1").alias("version"), F.col("ts").alias("used_at"))
    return maintain.touch(_cache(spark, sf_dir), log).select("spec_id", "last_used_at")


@query(f"WITH {c.CLAUSES_SQL} SELECT spec_id, sum(strlen(title) + strlen(content))::BIGINT AS bytes FROM clauses GROUP BY spec_id")
def cached_sizes(spark, sf_dir):
    return maintain.sizes(c.clauses(spark, sf_dir).withColumn("version", F.lit("1"))).select("spec_id", "bytes")


@query("""SELECT l_orderkey AS key, max((l_suppkey, l_linenumber, l_returnflag))[3] AS flag, min((l_suppkey, l_linenumber))[2] AS place FROM lineitem GROUP BY l_orderkey""")
def merged_files(spark, sf_dir):
    rows = c.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("flag"))
    return maintain.merge_files(rows, ["key"], "file", "place").select("key", "flag", "place")


# Sources and documents -----------------------------------------------------------------------------


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'DOC_ONLY' WHEN 2 THEN 'NO_DOC' WHEN 3 THEN 'FAILED' ELSE 'OK' END AS status,
    CASE WHEN p_size < 36 AND p_partkey % 5 IN (0, 1) THEN p_size END AS release FROM part""")
def download_outcomes(spark, sf_dir):
    k = F.col("p_partkey")
    token = F.lower(F.conv(F.col("p_size").cast("string"), 10, 36))
    stem = F.concat(F.lit("23501-"), token, F.lit("00"))
    names = F.when(k % 5 == 0, F.array(F.lit("cover.DOC"), F.concat(stem, F.lit(".DOCX")))).when(k % 5 == 1, F.array(F.lit("readme.txt"), F.concat(stem, F.lit(".doc")))).when(k % 5 == 2, F.array(F.lit("a.txt"))).when(k % 5 == 4, F.array(F.lit("a.docx")))
    release = F.when(F.col("p_size") < 36, archive.release_of_file(F.element_at(names, -1)))
    return c.table(spark, sf_dir, "part").select(k.alias("k"), archive.outcome(names).alias("status"), release.alias("release"))


@query("SELECT s_suppkey AS k, 'TS ' || lpad((s_suppkey % 90 + 10)::VARCHAR, 2, '0') || '.501' AS spec_id, 'N_' || s_name AS api_name FROM supplier")
def api_file_names(spark, sf_dir):
    name = F.concat(F.lit("TS"), (F.col("s_suppkey") % 90 + 10).cast("string"), F.lit("501_N_"), "s_name", F.lit(".yaml"))
    return c.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), archive.api_file(name).alias("f")).select("k", "f.*")


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'TR ' ELSE 'TS ' END || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 900 + 100)::VARCHAR, 3, '0') || CASE WHEN p_partkey % 4 = 0 THEN '-' || (p_partkey % 9)::VARCHAR ELSE '' END AS spec_id,
    'g' || (p_size % 10)::VARCHAR || '0' AS token, 16 AS release FROM part""")
def document_file_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat((k % 90 + 10).cast("string"), (k % 900 + 100).cast("string"), F.when(k % 4 == 0, F.concat(F.lit("-"), (k % 9).cast("string"))).otherwise(""), F.lit("-G"), (F.col("p_size") % 10).cast("string"), F.lit("0_cover.docx"))
    return c.table(spark, sf_dir, "part").select(k.alias("k"), archive.document_file(name, F.when(k % 3 == 0, "TR")).alias("f")).select("k", "f.*")


#: Lines of a text with a block of each kind (where each begins and ends) among lines that are none.
_EXAMPLE = (
    "The call:", "INVITE sip:@K@x.test @V", "Call-ID: @K", "Privacy: id", "v=0", "which the server answers.", "", "Req ::= < Diameter Header: 316 >", " < Session-Id >", "*[ AVP ]",
    "End. SIP/2.0 200 OK is sent", "v=0", "o=- @K 0 IN IP4 h", "m=audio 9 RTP/AVP 0", "so be it", "<a>", "<b>@K</b>", "some text", "</a>", "x=1", "-- /x/ ASN1START", "A ::= NULL", "", "-- ASN1STOP",
    "$x = @K$, (7.3-1)", "NOTE: <userid> alone", "m=<media> <port>", "where: $x$ is known",
)
_PLACES = {"sip": (1, 4), "diameter": (7, 9), "sdp": (11, 13), "xml": (15, 18), "asn1": (20, 23), "latex": (24, 24)}


@query("SELECT event_id AS k, kind, CAST(a + 2 * (event_id % 3) AS INT) AS from_line, CAST(b + 2 * (event_id % 3) AS INT) AS to_line FROM events CROSS JOIN (VALUES "
       + ", ".join(f"('{kind}', {a}, {b})" for kind, (a, b) in _PLACES.items()) + ") p(kind, a, b) WHERE kind <> 'sip' OR event_id % 5 <> 0")
def protocol_blocks(spark, sf_dir):
    k = F.col("event_id")
    text = F.concat(F.repeat(F.lit("Prose.\n\n"), (k % 3).cast("int")), F.replace(F.replace(F.lit("\n".join(_EXAMPLE)), F.lit("@K"), k.cast("string")), F.lit("@V"), F.when(k % 5 == 0, "SIP/9.9").otherwise("SIP/2.0")))
    rows = c.table(spark, sf_dir, "events").select(k.alias("k"), text.alias("text"))
    return blocks.blocks(rows, "k").select("k", "kind", "from_line", "to_line")


def _pictured(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """A text with a link and a tag for each part; every seventh is of a format that is not converted."""
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("fig"), k, F.when(F.col("p_partkey") % 7 == 0, ".jpg").otherwise(ending))
    text = F.concat(F.lit("See ![A "), k, F.lit("](image://"), name, F.lit("?w="), F.col("p_size").cast("string"), F.lit(") and <img width='1' src=\"image://"), name, F.lit("\" alt=\""), name, F.lit("\"> or image://none."))
    return c.table(spark, sf_dir, "part").select("p_partkey", "p_size", text.alias("content"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size, 'fig' || p_partkey::VARCHAR || CASE WHEN p_partkey % 7 = 0 THEN '.jpg' ELSE '' END AS stem FROM part)
SELECT k, 0 AS position, 'link' AS markup, stem, '?w=' || p_size::VARCHAR AS query, 'A ' || k::VARCHAR AS caption FROM p UNION ALL SELECT k, 1, 'tag', stem, '', '' FROM p""")
def picture_references(spark, sf_dir):
    return figures.pictures(_pictured(spark, sf_dir, ".wmf.PNG"), "content").select(F.col("p_partkey").alias("k"), "picture.*")


@query("SELECT p_partkey AS k, p_size % 10 <> 0 AS same FROM part")
def picture_spellings(spark, sf_dir):
    """Texts whose pictures were converted on one side, and on every tenth size shown larger."""
    old, new = _pictured(spark, sf_dir, ".emf"), _pictured(spark, sf_dir, ".png")
    larger = F.when(F.col("p_size") % 10 == 0, F.replace("content", F.lit("?w="), F.lit("?w=9"))).otherwise(F.col("content"))
    both = old.select("p_partkey", "content").join(new.select("p_partkey", larger.alias("other")), "p_partkey")
    return both.select(F.col("p_partkey").alias("k"), (figures.shown_column("content") == figures.shown_column("other")).alias("same"))


@query()
def page_sections(spark, sf_dir):
    return documents.sections_of_pages(c.table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def clean_pages(spark, sf_dir):
    return c.table(spark, sf_dir, "pages").select("page_id", markup.sanitize_column("html").alias("html"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, lower(trim(split_part(text, chr(10), 1))) AS title, '## 4 x' || doc_id::VARCHAR AS heading, round(n_chars / 9525.0)::BIGINT AS px, round(n_chars * 96.0 / 72)::BIGINT AS pt FROM documents")
def text_functions(spark, sf_dir):
    title = F.concat(F.lit("x"), F.col("doc_id").cast("string"))
    return c.table(spark, sf_dir, "documents").select(
        "doc_id", scalar.line_count(F.col("text")).cast("long").alias("lines"), scalar.normalize_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        scalar.heading(F.lit(2), F.lit("4"), title).alias("heading"), scalar.emu_to_pixels(F.col("n_chars")).alias("px"), scalar.css_to_pixels(F.concat(F.col("n_chars").cast("string"), F.lit("pt"))).alias("pt"),
    )
