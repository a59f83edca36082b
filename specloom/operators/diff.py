"""Two versions of a document compared: by structure with joins, by lines in Arrow batches."""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.figures import shown_column
from ..functions.scalar import line_count, normalize_title, strip_heading

#: Edits beyond which two texts count as replaced as a whole.
MOST_EDITS = 1024


def _body(content: Column) -> Column:
    """What counts as a section's content: without its heading, pictures by one spelling. Only contents
    with pictures go through Python."""
    text = strip_heading(content)
    return F.when(F.contains(text, F.lit("image://")), shown_column(text)).otherwise(text)


def structural(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The differences of ``number, title, content``: one row each.

    ``change`` is ``added``, ``removed``, ``retitled``, ``content`` or ``renumbered``. A removed and an
    added section with the same title, unique on either side, are one renumbered section; if its
    content changed too, that is a second row. What is equal in title and content gives no row.
    """
    by = list(by)
    side = lambda rows, p: rows.select(*by, "number", F.struct(F.col("title"), F.col("content")).alias(p))
    both = side(old, "o").join(side(new, "n"), [*by, "number"], "full_outer")
    body = lambda c: _body(F.col(f"{c}.content"))
    gone, fresh = F.col("n").isNull(), F.col("o").isNull()
    kinds = F.array(
        F.when(gone, "removed").when(fresh, "added"),
        F.when(~gone & ~fresh & (F.col("o.title") != F.col("n.title")), "retitled"),
        F.when(~gone & ~fresh & (body("o") != body("n")), "content"),
    )
    rows = both.select(*by, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change"), "number", "o", "n")
    moved = rows.where(F.col("change").isin("removed", "added"))
    moved = moved.withColumn("_t", normalize_title(F.coalesce("n.title", "o.title"))).withColumn("_alone", F.count("*").over(Window.partitionBy(*by, "_t", "change")))
    single = moved.where("_alone = 1 and _t <> ''")
    was = single.where("change = 'removed'").select(*by, "_t", F.col("number").alias("old_number"), F.col("o").alias("_o"))
    now = single.where("change = 'added'").select(*by, "_t", F.col("number"), F.col("n").alias("_n"))
    pairs = was.join(now, [*by, "_t"])
    edited = _body(F.col("_o.content")) != _body(F.col("_n.content"))
    renumbered = pairs.select(*by, F.explode(F.filter(F.array(F.lit("renumbered"), F.when(edited, "content")), lambda k: k.isNotNull())).alias("change"), "number", "old_number", F.col("_o").alias("o"), F.col("_n").alias("n"))
    used = pairs.select(*by, F.lit("removed").alias("change"), F.col("old_number").alias("number")).unionByName(pairs.select(*by, F.lit("added").alias("change"), "number"))
    rest = rows.join(used, [*by, "change", "number"], "left_anti")
    old_number = F.when(F.col("change") == "added", F.lit(None)).otherwise(F.col("number"))
    out = rest.withColumn("old_number", old_number).unionByName(renumbered)
    lines = lambda c: F.when(F.col(c).isNotNull(), line_count(F.col(f"{c}.content"))).otherwise(0).cast("long")
    return out.select(*by, "change", F.when(F.col("change") != "removed", F.col("number")).alias("number"), "old_number", F.col("o.title").alias("old_title"), F.col("n.title").alias("new_title"), lines("o").alias("old_lines"), lines("n").alias("new_lines"))


def lines_of(contents: Sequence[str]) -> list[str]:
    """Sections' lines as they are shown together; empty sections give none."""
    parts = [c.rstrip("\n") for c in contents if c and c.rstrip("\n")]
    return "\n\n".join(parts).split("\n") if parts else []


def edits(a: Sequence[str], b: Sequence[str], most: int = MOST_EDITS) -> tuple[list[tuple[str, str]], bool]:
    """A shortest list of ``(' ' | '-' | '+', line)`` that turns ``a`` into ``b``, and whether it is one.

    Beyond ``most`` edits the differing middle is given as removed and added whole.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle = _shortest(x, y, most)
    exact = middle is not None
    if middle is None:
        middle = [("-", line) for line in x] + [("+", line) for line in y]
    return [(" ", line) for line in b[:head]] + middle + [(" ", line) for line in b[len(b) - tail :]], exact


def _shortest(x: Sequence[str], y: Sequence[str], most: int) -> list[tuple[str, str]] | None:
    """Breadth first over the number of edits; each diagonal keeps its furthest place."""
    # What is reached after d edits, on the diagonals -d, -d + 2 to d: four bytes each.
    trail = [array("i", [0])]
    for d in range(min(most, len(x) + len(y)) + 1):
        before, reached = trail[-1], array("i")
        for k in range(-d, d + 1, 2):
            at = (k + d) // 2
            down = at == 0 or (at != d and before[at - 1] < before[at])
            i = before[at] if down else before[at - 1] + 1
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
            reached.append(i)
            if i >= len(x) and i - k >= len(y):
                return _walk_back(x, y, trail)
        trail.append(reached)
    return None


def _walk_back(x: Sequence[str], y: Sequence[str], trail: Sequence[Sequence[int]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    i, j = len(x), len(y)
    for d in range(len(trail) - 1, 0, -1):
        before, at = trail[d], (i - j + d) // 2
        down = at == 0 or (at != d and before[at - 1] < before[at])
        from_i = before[at] if down else before[at - 1]
        while i > from_i + (not down):
            i, j = i - 1, j - 1
            out.append((" ", y[j]))
        if down:
            j -= 1
            out.append(("+", y[j]))
        else:
            i -= 1
            out.append(("-", x[i]))
    out += [(" ", line) for line in reversed(y[:j])]
    return out[::-1]


def unified(a: Sequence[str], b: Sequence[str], context: int = 3) -> str:
    """Hunks with ``context`` lines around changes; empty for equal texts, without a last line end."""
    return shown(*edits(a, b), context)


def shown(script: Sequence[tuple[str, str]], exact: bool, context: int = 3) -> str:
    """The hunks of a list of edits."""
    changed = [k for k, (op, _) in enumerate(script) if op != " "]
    if not changed:
        return ""
    hunks: list[list[int]] = []
    for k in changed:
        low, high = max(0, k - context), min(len(script), k + context + 1)
        if hunks and low <= hunks[-1][1]:
            hunks[-1][1] = high
        else:
            hunks.append([low, high])
    out = [] if exact else ["(too many changes: shown as replaced)"]
    at_a = at_b = done = 0
    for low, high in hunks:
        at_a += sum(op != "+" for op, _ in script[done:low])
        at_b += sum(op != "-" for op, _ in script[done:low])
        n_a = sum(op != "+" for op, _ in script[low:high])
        n_b = sum(op != "-" for op, _ in script[low:high])
        out.append(f"@@ -{_span(at_a, n_a)} +{_span(at_b, n_b)} @@")
        out += [op + line for op, line in script[low:high]]
        at_a, at_b, done = at_a + n_a, at_b + n_b, high
    return "\n".join(out)


def _span(at: int, n: int) -> str:
    return f"{at + (n > 0)},{n}" if n != 1 else str(at + 1)


def textual(pairs: DataFrame, old: str, new: str, context: int = 3) -> DataFrame:
    """Adds ``diff``, ``inserted`` and ``deleted`` for two text columns; null counts as empty."""

    @F.arrow_udf("struct<diff:string,inserted:long,deleted:long>")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        # A batch's texts are taken one pair at a time.
        out: list[list] = [[], [], []]
        for x, y in zip(a, b, strict=True):
            script, exact = edits(lines_of([x.as_py() or ""]), lines_of([y.as_py() or ""]))
            for column, value in zip(out, (shown(script, exact, context), sum(op == "+" for op, _ in script), sum(op == "-" for op, _ in script)), strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["diff", "inserted", "deleted"])

    return pairs.withColumn("_d", compare(F.col(old), F.col(new))).select("*", "_d.*").drop("_d")


def why_not_comparable(spec_id: str, old: DataFrame, new: DataFrame, old_version: str, new_version: str, section: str = "", parts: list[str] | None = None) -> str | None:
    """Why two versions of a document, or of its section, can't be compared; null if they can."""
    if old.isEmpty() and new.isEmpty():
        if parts:
            return f"{spec_id} has multiple parts: {', '.join(parts)}; name one"
        return f"section {section} is in neither version of {spec_id}" if section else f"{spec_id} has no sections in either version"
    return f"both versions are v{old_version}" if old_version and old_version == new_version else None
