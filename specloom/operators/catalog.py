"""Documents and their versions: listing, choosing, and planning updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ascii_istartswith, bare_id, normalize_version, release_of, release_request, version_key

#: From the weakest to the strongest place where a version can be had.
AVAILABILITY = ("archive", "cached", "database")


def specs_page(specs: DataFrame, series: str | None = None, query: str | None = None, limit: int = 0, offset: int = 0) -> tuple[DataFrame, int]:
    """Documents of a series, or whose id begins with a query with or without its type, and their number.

    A limit of 0 is 20, at most 1000 are given, and a negative limit gives all and ignores the offset.
    """
    rows = specs if not series else specs.where(F.col("series") == series)
    if query:
        wanted = [query, f"TS {query}", f"TR {query}"]
        rows = rows.where(reduce(lambda a, b: a | b, (ascii_istartswith(F.col("id"), w) for w in wanted)))
    total, ordered = rows.count(), rows.orderBy("id", "version")
    return (ordered if limit < 0 else ordered.offset(max(0, offset)).limit(20 if limit == 0 else min(limit, 1000))), total


def versions(*places: tuple[str, DataFrame]) -> DataFrame:
    """``spec_id, version, availability`` from ``(availability, spec_id + version)`` tables.

    Of several places the strongest counts; within a document the newest version is first.
    """
    ranked = [rows.select("spec_id", "version", F.lit(AVAILABILITY.index(name)).alias("rank")) for name, rows in places]
    best = reduce(DataFrame.unionByName, ranked).groupBy("spec_id", "version").agg(F.max("rank").alias("rank"))
    names = F.array(*map(F.lit, AVAILABILITY))
    return best.select("spec_id", "version", F.element_at(names, F.col("rank") + 1).alias("availability")).orderBy("spec_id", version_key(F.col("version")).desc())


def newest(rows: DataFrame, by: list[str], version: str = "version") -> DataFrame:
    """The newest version of each document; an empty version loses to any number."""
    return rows.groupBy(*by).agg(F.max_by(version, version_key(F.col(version))).alias(version))


def resolve(available: DataFrame, request: str = "") -> DataFrame:
    """``spec_id, version`` that a request means in each document's versions: the newest for none or
    ``latest``, the newest of a release for ``18`` or ``Rel-18``, else that very version in either form.

    Documents without such a version have no row; a request of no known form is an error.
    """
    asked = request.strip()
    rows = available.select("spec_id", "version")
    if asked and asked.lower() != "latest":
        spark = available.sparkSession
        text = F.lit(asked)
        release, wanted = spark.range(1).select(release_request(text), normalize_version(text)).first()
        if release is None and wanted is None:
            raise ValueError(f"invalid version {request!r}")
        rows = rows.where(release_of(F.col("version")) == release if release is not None else normalize_version(F.col("version")) == wanted)
    return newest(rows, ["spec_id"])


def placed(*places: tuple[str, DataFrame]) -> DataFrame:
    """``spec_id, version, place``: where each version is read from, the first of the places that has it."""
    ranked = [rows.select("spec_id", "version", F.struct(F.lit(k).alias("rank"), F.lit(name).alias("place")).alias("p")) for k, (name, rows) in enumerate(places)]
    best = reduce(DataFrame.unionByName, ranked).groupBy("spec_id", "version").agg(F.min("p").alias("p"))
    return best.select("spec_id", "version", "p.place")


def latest_entries(entries: DataFrame, release: int | None = None, max_release: int | None = None, series: list[str] | None = None, spec: str | None = None) -> DataFrame:
    """Of the archive entries that pass all filters, the newest per document, ordered by document.

    Entries are ordered by release, minor number and raw token.
    """
    rows = entries if release is None else entries.where(F.col("release") == release)
    rows = rows if max_release is None else rows.where(F.col("release") <= max_release)
    rows = rows if not series else rows.where(F.col("series").isin(series))
    rows = rows if not spec else rows.where(F.replace("spec", F.lit("."), F.lit("")) == spec.replace(".", ""))
    others = [c for c in rows.columns if c != "spec"]
    best = rows.groupBy("spec").agg(F.max_by(F.struct(*others), F.struct("release", "minor", "token")).alias("e"))
    return best.select("spec", "e.*").select(rows.columns).orderBy("spec")


def update_plan(archive: DataFrame, have: DataFrame, capped: bool = False, below_cap: DataFrame | None = None) -> DataFrame:
    """``id, action, have_version, archive_version`` for documents to fetch again or to remove.

    Ids are compared without their type. A document changes if the archive is newer, or simply other
    than what is had when a highest release is set. It is removed if it is in ``below_cap``'s archive
    but has no version there any more.
    """
    new = archive.select(bare_id(F.col("id")).alias("key"), F.col("version").alias("archive_version"))
    old = have.select("id", bare_id(F.col("id")).alias("key"), F.col("version").alias("have_version"))
    both = old.join(new, "key")
    change = F.col("archive_version") != F.col("have_version") if capped else version_key(F.col("archive_version")) > version_key(F.col("have_version"))
    plan = both.where(change).select("id", F.lit("update").alias("action"), "have_version", "archive_version")
    if below_cap is not None:
        known = below_cap.select(bare_id(F.col("id")).alias("key")).distinct()
        gone = old.join(known, "key", "left_semi").join(new, "key", "left_anti")
        plan = plan.unionByName(gone.select("id", F.lit("remove").alias("action"), "have_version", F.lit(None).cast("string").alias("archive_version")))
    return plan


def family(specs: DataFrame, spec_id: str) -> DataFrame:
    """The ids of a document's parts (``id-...``)."""
    return specs.where(F.startswith("id", F.lit(spec_id + "-"))).select("id").distinct().orderBy("id")


def with_specs(sections: DataFrame, specs: DataFrame) -> DataFrame:
    """Sections with the title and release of their document's version; null where the catalogue lacks it."""
    known = specs.select(F.col("id").alias("spec_id"), "version", F.col("title").alias("spec_title"), F.col("release").alias("spec_release"))
    return sections.join(known, ["spec_id", "version"], "left")


def image_list(images: DataFrame, spec_id: str, version: str) -> DataFrame:
    """A document's pictures without their data."""
    rows = images.where((F.col("spec_id") == spec_id) & (F.col("version") == version))
    return rows.select("name", "mime_type", "llm_readable").orderBy("name")


def image(images: DataFrame, spec_id: str, version: str, name: str) -> DataFrame:
    """An image by name, or by its name without extension: readable ones first, then by name."""
    base = F.regexp_replace(F.lit(name), r"\.[^.]*\z", "")
    rows = images.where((F.col("spec_id") == spec_id) & (F.col("version") == version))
    fit: Column = (F.col("name") == name) | F.startswith("name", F.concat(base, F.lit(".")))
    return rows.where(fit).orderBy((F.col("name") == name).desc(), F.desc("llm_readable"), "name").limit(1)
