"""Scalar functions as column expressions: versions, identifiers, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789" + LOWER


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased, as the prefix and name look-ups fold case."""
    return F.translate(text, UPPER, LOWER)


def ascii_istartswith(text: Column, prefix: Column | str) -> Column:
    return F.startswith(ascii_lower(text), ascii_lower(prefix if isinstance(prefix, Column) else F.lit(prefix)))


def escape_like(text: Column) -> Column:
    """Backslash before each of the three characters that LIKE takes specially."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


# Versions ------------------------------------------------------------------------------------------


def is_dotted(version: Column) -> Column:
    return F.coalesce(version.rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\z"), F.lit(False))


def digit_value(character: Column) -> Column:
    """The value of a base-36 digit; 0 for an empty text and -1 for anything else."""
    return F.instr(F.lit(DIGITS), F.lower(character)) - 1


def token_to_dotted(token: Column) -> Column:
    """``i60`` to ``18.6.0``: three base-36 digits; null for anything else."""
    digits = [digit_value(F.substring(token, k, 1)).cast("string") for k in (1, 2, 3)]
    return F.when(token.rlike(r"\A[0-9a-zA-Z]{3}\z"), F.concat_ws(".", *digits))


def dotted_to_token(version: Column) -> Column:
    """``18.6.0`` to ``i60``; null unless there are three numbers of at most 35."""
    digits = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    token = F.array_join(F.transform(digits, lambda n: F.when(n <= 35, F.substr(F.lit(DIGITS), n + 1, F.lit(1)))), "")
    return F.when(is_dotted(version) & (F.length(token) == 3), token)


def normalize_version(version: Column) -> Column:
    """A dotted version from a dotted or three-digit form, with or without a leading ``v``; else null.

    A ``v`` and two more digits is itself a token and is read as one.
    """
    text = F.trim(version)
    bare = F.when(text.rlike(r"\A[vV][0-9]+\."), F.substr(text, F.lit(2))).when(text.rlike(r"\A[vV][0-9a-zA-Z]{3}\z"), F.substr(text, F.lit(2))).otherwise(text)
    whole = F.transform(F.split(bare, r"\."), lambda x: x.try_cast("int").cast("string"))
    return F.when(is_dotted(bare) & ~F.exists(whole, lambda x: x.isNull()), F.array_join(whole, ".")).otherwise(token_to_dotted(F.lower(bare)))


def version_key(version: Column, width: int = 4) -> Column:
    """Sortable components: numbers, -1 where one is missing or no number, of equal length for all."""
    parts = F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda x: F.when(x.rlike(r"\A[0-9]+\z"), x.try_cast("bigint")).otherwise(F.lit(-1).cast("bigint")))
    parts = F.transform(parts, lambda x: F.coalesce(x, F.lit(-1).cast("bigint")))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(-1).cast("bigint"), width)), 1, width)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def release_of(version: Column) -> Column:
    """The first component; null if it is no number."""
    return F.regexp_extract(version, r"\A([0-9]+)(?:\.|\z)", 1).try_cast("int")


def release_label(version: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Rel-"), release_of(version).cast("string")), F.lit(""))


def release_request(text: Column) -> Column:
    """The release asked for by ``18`` or ``Rel-18``; null for any other request."""
    return F.regexp_extract(F.trim(text), r"\A(?:[Rr][Ee][Ll]-)?([0-9]{1,2})\z", 1).try_cast("int")


# Identifiers ---------------------------------------------------------------------------------------


def alternate_id(spec_id: Column) -> Column:
    """The same number under the other document type; null for ids of neither type."""
    rest = F.substr(spec_id, F.lit(4))
    return F.when(F.startswith(spec_id, F.lit("TS ")), F.concat(F.lit("TR "), rest)).when(F.startswith(spec_id, F.lit("TR ")), F.concat(F.lit("TS "), rest))


def bare_id(spec_id: Column) -> Column:
    return F.regexp_replace(spec_id, r"\AT[SR] ", "")


def series_of(spec_id: Column) -> Column:
    return F.regexp_extract(spec_id, r"([0-9]+)\.[0-9]+", 1)


def is_external(spec_id: Column) -> Column:
    return F.startswith(spec_id, F.lit("RFC "))


def reference_url(spec_id: Column, section: Column) -> Column:
    """The public page of an RFC section, or the corpus's own address of a section."""
    number = F.substr(spec_id, F.lit(5))
    rfc = F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), number, F.when(section != "", F.concat(F.lit("#section-"), section)).otherwise(""))
    own = F.concat(F.lit("/specs/"), F.replace(F.url_encode(spec_id), F.lit("+"), F.lit("%20")), F.when(section != "", F.concat(F.lit("/sections/"), F.url_encode(section))).otherwise(""))
    return F.when(is_external(spec_id), rfc).otherwise(own)


def definition_key(name: Column) -> Column:
    """Letters and digits alone, lower-cased: the folded form under which names are found."""
    return F.regexp_replace(ascii_lower(name), r"[^a-z0-9]", "")


# Texts ---------------------------------------------------------------------------------------------


def normalize_title(title: Column) -> Column:
    return F.lower(F.trim(title))


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def strip_heading(text: Column) -> Column:
    """Without a first line that is a heading mark."""
    return F.regexp_replace(text, r"\A#[^\n]*\n?", "")


def spec_label(spec_id: Column, version: Column) -> Column:
    return F.when(F.coalesce(version, F.lit("")) == "", spec_id).otherwise(F.concat(spec_id, F.lit(" v"), version))


def spec_header(spec_id: Column, version: Column, release: Column) -> Column:
    """``TS 23.501 v18.6.0 (Rel-18)``; what is empty is left out."""
    label = release_label(release)
    return F.concat(spec_label(spec_id, version), F.when(label == "", "").otherwise(F.concat(F.lit(" ("), label, F.lit(")"))))


def version_label(version: Column, release: Column, archived: Column) -> Column:
    """One side of a comparison: ``v17.9.0 (Rel-17, archived)``."""
    label = release_label(release)
    notes = F.concat_ws(", ", F.when(label != "", label), F.when(archived, F.lit("archived")))
    named = F.concat(F.lit("v"), version, F.when(notes == "", "").otherwise(F.concat(F.lit(" ("), notes, F.lit(")"))))
    return F.when(F.coalesce(version, F.lit("")) == "", F.lit("the database version")).otherwise(named)


def compare_header(spec_id: Column, section: Column, old: Column, new: Column) -> Column:
    """The line over every page of a comparison."""
    place = F.when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(F.lit(" \u2014 Section "), section))
    return F.concat(F.lit("[Compare: "), spec_id, place, F.lit(" \u2014 "), old, F.lit(" \u2192 "), new, F.lit("]"))


def heading(level: Column, number: Column, title: Column) -> Column:
    """An ATX heading; the number is left out where it is the title itself."""
    marks = F.repeat(F.lit("#"), F.greatest(F.least(level, F.lit(6)), F.lit(1)))
    return F.concat(marks, F.lit(" "), F.when((number == title) | (number == ""), title).otherwise(F.concat_ws(" ", number, title)))


def keep_indent(text: Column) -> Column:
    """Lines' leading white space as no-break spaces, four for a tab; blank lines at either end go."""
    blank = F.lit("\u00a0")

    def line(x: Column) -> Column:
        lead = F.regexp_extract(x, r"\A[ \t\u00a0]*", 0)
        wide = F.replace(F.translate(lead, " ", "\u00a0"), F.lit("\t"), F.repeat(blank, F.lit(4)))
        core = F.regexp_replace(x, r"\A[\s\u00a0]+|[\s\u00a0]+\z", "")
        return F.when(core == "", "").otherwise(F.concat(wide, core))

    lines = F.array_join(F.transform(F.split(text, "\n"), line), "\n")
    return F.regexp_replace(lines, r"\A\n+|\n+\z", "")


# Measures ------------------------------------------------------------------------------------------


def emu_to_pixels(emu: Column) -> Column:
    """Drawing units (914400 an inch) at 96 pixels an inch, rounded."""
    return F.round(emu / 9525).cast("long")


def css_to_pixels(length: Column) -> Column:
    """A style length in px, pt, in, cm or mm as whole pixels; null for other units."""
    number = F.regexp_extract(F.trim(length), r"\A([0-9]*\.?[0-9]+)\s*[a-z]*\z", 1).try_cast("double")
    unit = F.regexp_extract(F.trim(length), r"([a-z]*)\z", 1)
    factor = F.when(unit.isin("", "px"), 1.0).when(unit == "pt", 96 / 72).when(unit == "in", 96.0).when(unit == "cm", 96 / 2.54).when(unit == "mm", 96 / 25.4)
    return F.round(number * factor).cast("long")


def shape_size(style: Column) -> Column:
    """``width, height`` of a shape's style (``width:453.6pt;height:340pt``) in pixels, 0 where it has none;
    of a measure given twice the last counts."""
    parts = F.transform(F.split(style, ";"), lambda x: F.transform(F.split(x, ":", 2), lambda y: F.trim(y)))

    def last(name: str) -> Column:
        found = F.filter(parts, lambda x: (F.size(x) == 2) & (x[0] == name))
        return F.coalesce(css_to_pixels(F.try_element_at(found, F.lit(-1))[1]), F.lit(0))

    return F.struct(last("width").alias("width"), last("height").alias("height"))
