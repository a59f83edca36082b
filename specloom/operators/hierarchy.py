"""Sections as a tree: tables of contents, subtrees, parents, neighbours and pages of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ascii_istartswith


def toc(sections: DataFrame, spec_id: str, version: str | None = None) -> DataFrame:
    """The sections of a document in their order, without content."""
    rows = sections.where(F.col("spec_id") == spec_id)
    rows = rows if version is None else rows.where(F.col("version") == version)
    return rows.select("ord", "number", "title", "level", "parent_number").orderBy("ord")


def toc_line(number: Column, title: Column, level: Column) -> Column:
    """An indented line; the number is left out where it is the title itself."""
    label = F.when((number == title) | (number == ""), title).otherwise(F.concat_ws(" ", number, title))
    return F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0))), F.lit("- "), label)


def subtree(sections: DataFrame, number: str, descendants: bool = True) -> DataFrame:
    """A section, and those whose numbers continue its number after a dot (A-Z case aside)."""
    own = F.col("number") == number
    return sections.where(own | ascii_istartswith(F.col("number"), number + ".") if descendants else own)


def joined_text(sections: DataFrame, by: list[str], order: str = "ord", content: str = "content") -> DataFrame:
    """The contents of each group in order, a blank line between two of them."""
    ordered = F.array_sort(F.collect_list(F.struct(order, content)))
    return sections.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[content]), "\n\n").alias("text"))


def parents(sections: DataFrame, by: list[str], order: str = "ord", deepest: int = 9) -> DataFrame:
    """Adds ``parent_ord``: the nearest earlier section of a smaller level."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col(order)), ignorenulls=True).over(before)) for k in range(0, deepest)]
    return sections.withColumn("parent_ord", F.greatest(*latest))


def neighbours(sections: DataFrame, by: list[str], order: str = "ord", key: str = "number") -> DataFrame:
    """Adds ``previous`` and ``next``, the keys of the adjacent sections."""
    near = Window.partitionBy(*by).orderBy(order)
    return sections.withColumn("previous", F.lag(key).over(near)).withColumn("next", F.lead(key).over(near))


def page_bounds(lines: list[str], max_lines: int, max_chars: int) -> Iterator[tuple[int, int]]:
    """First line and end of each page, from 0."""
    begin, total = 0, len(lines)
    while begin < total:
        end = min(total, begin + max_lines)
        if max_chars > 0:
            room = max_chars
            for k in range(begin, end):
                room -= len(lines[k]) + 1
                if room < 0:
                    end = max(k, begin + 1)
                    break
        elif end < total:
            blank = next((k for k in range(end, min(total, end + max(1, (end - begin) // 5))) if not lines[k]), None)
            end = end if blank is None else blank + 1
        yield begin, end
        begin = end


def pages(texts: DataFrame, by: list[str], text: str = "text", max_lines: int = 200, max_chars: int = 0) -> DataFrame:
    """Texts cut into pages: ``page, from_line, to_line, lines, of_lines, text``, whole lines each.

    A page ends before the line that would exceed ``max_lines``, or ``max_chars`` code points with line
    ends (if that is above 0), except that it always has one line. Without a limit of characters it runs
    on through a blank line that is less than a fifth of its lines away. Pages of a text in order are the
    whole text.
    """

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def bounds(column: pa.Array) -> pa.Array:
        found = [[{"begin": a, "end": b} for a, b in page_bounds((x or "").split("\n"), max_lines, max_chars)] for x in column.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))

    rows = texts.select(*by, F.split(F.coalesce(text, F.lit("")), "\n").alias("_l"), F.posexplode(bounds(F.col(text))).alias("page", "_b"))
    size = F.col("_b.end") - F.col("_b.begin")
    return rows.select(*by, "page", (F.col("_b.begin") + 1).alias("from_line"), F.col("_b.end").alias("to_line"), size.alias("lines"), F.size("_l").alias("of_lines"), F.array_join(F.slice("_l", F.col("_b.begin") + 1, size), "\n").alias("text"))


def page_text(page: DataFrame) -> Column:
    """A page as it is shown: which lines it has, and where to go on if it is not the last."""
    number = lambda c: page[c].cast("string")
    more = F.when(page["to_line"] < page["of_lines"], F.concat(F.lit("\n\n[Truncated. Use offset="), number("to_line"), F.lit(" to continue]"))).otherwise("")
    return F.concat(F.lit("[Lines "), number("from_line"), F.lit("-"), number("to_line"), F.lit(" of "), number("of_lines"), F.lit("]\n\n"), page["text"], more)


def markdown(sections: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """Each document's sections as one Markdown text."""
    from ..functions.scalar import heading

    body = F.concat_ws("\n\n", heading(F.col("level"), F.col("number"), F.col("title")), F.when(F.col("content") != "", F.col("content")))
    return joined_text(sections.withColumn("_body", body), by, order, "_body")
