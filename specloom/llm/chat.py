"""Multi-party dialogues as training texts, once from each participant's side.

For every participant the whole dialogue is rendered with that speaker as the assistant and all others
as named users; the mask lists the character ranges to be learnt: the assistant's words and the end
mark after them. Speakers in ``fixed`` (system messages) keep their role on every side and have no
side of their own.

A dialogue is one row for each side, however many turns it has, as long as its rendering has at most
``piece_chars`` characters; only a longer one is cut, where a further ``piece_chars`` begin, into rows
numbered by ``segment``. Mask ranges are places in the whole rendering in either case, so that the
segments' texts put together fit them. Where the segments of a long dialogue begin is found by sums
over ranges of its turns, never by ordering the dialogue in one task.

Defined results: rows without a conversation or a turn number are left out; a turn without a speaker
is a user without a name and makes no participant; a null text is empty; turn marks inside a text or a
speaker's name are broken by a space, and line ends inside a name become spaces; equal turn numbers are
ordered by speaker, then by the MD5 of the text, and repeated rows appear as often as they are given; a
dialogue of fixed speakers alone has no rendering; an empty table gives an empty table; further columns
are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: The marks around a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns in one range of a long dialogue, about.
RANGE_ROWS = 20_000
ORDER = ("turn", "speaker", "digest")


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _role(side: Column | None, speaker: Column, fixed: Sequence[str]) -> Column:
    """What stands for a speaker, on a side or on that of nobody who speaks."""
    name = F.translate(_safe(speaker), "\r\n", "  ")
    role = F.when(speaker.isNull(), F.lit("user")).when(speaker.isin(*fixed), name).otherwise(F.concat(F.lit("user name="), name))
    return role if side is None else F.when(speaker == side, F.lit("assistant")).otherwise(role)


def _chars(role: Column) -> Column:
    return (F.length(role) + F.length("content") + F.lit(len(OPEN) + 1 + len(CLOSE))).cast("long")


def _cut(rows: DataFrame, sides: DataFrame, fixed: Sequence[str], piece_chars: int) -> tuple[DataFrame, DataFrame]:
    """The turns of long dialogues with their ``segment``, and ``begin``, where each segment of a side does."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    parts = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, "conv_id", *ORDER, "tie").withColumn("part", F.spark_partition_id())
    parts = written(parts, "chat-parts")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("conv_id", "part").agg(F.sum("chars").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(earlier("conv_id").orderBy("part")), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("chars").over(earlier("conv_id", "part").orderBy(*ORDER, "tie")), F.lit(0))
    placed = parts.withColumn("inside", inside).join(ahead, ["conv_id", "part"]).withColumn("start", F.col("inside") + F.col("ahead"))
    placed = written(placed.withColumn("segment", F.floor(F.col("start") / piece_chars).cast("long")).drop("inside", "ahead", "part", "tie"), "chat-placed")
    # A side's own turns are as much shorter, or longer, than on others' sides.
    own = placed.groupBy("conv_id", F.col("speaker").alias("side"), "segment").agg(F.count("*").alias("own"))
    grid = placed.groupBy("conv_id", "segment").agg(F.min("start").alias("start")).join(sides, "conv_id").join(own, ["conv_id", "side", "segment"], "left")
    before = F.coalesce(F.sum("own").over(earlier("conv_id", "side").orderBy("segment")), F.lit(0))
    change = F.lit(len("assistant")) - F.length(_role(None, F.col("side"), fixed))
    return placed.drop("start"), grid.withColumn("begin", (F.col("start") + before * change).cast("long")).select("conv_id", "side", "segment", "begin")


def perspectives(turns: DataFrame, *, fixed: Sequence[str] = ("system",), piece_chars: int = 4 << 20) -> DataFrame:
    """``conv_id, side, segment, n_turns, text, mask, mask_chars`` from ``conv_id, turn, role, text``.

    ``mask`` is an array of structs ``begin, end`` in characters of the side's whole rendering.
    """
    content = _safe(F.coalesce("text", F.lit("")))
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").alias("speaker"), content.alias("content"))
    rows = rows.withColumn("digest", F.md5(F.col("content").cast("binary"))).withColumn("chars", _chars(_role(None, F.col("speaker"), fixed)))
    sides = rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*fixed)).select("conv_id", F.col("speaker").alias("side")).distinct()
    long_ = rows.groupBy("conv_id").agg(F.sum("chars").alias("all")).where(F.col("all") > piece_chars).select("conv_id")
    keys = ["conv_id", "side", "segment"]
    if long_.isEmpty():
        seen = rows.withColumn("segment", F.lit(0).cast("long")).join(sides, "conv_id").withColumn("begin", F.lit(0).cast("long"))
    else:
        long_ = written(long_, "chat-long")
        placed, begins = _cut(rows.join(long_, "conv_id", "left_semi"), sides, fixed, piece_chars)
        both = rows.join(long_, "conv_id", "left_anti").withColumn("segment", F.lit(0).cast("long")).unionByName(placed)
        seen = both.join(sides, "conv_id").join(begins, keys, "left").withColumn("begin", F.coalesce("begin", F.lit(0)))

    # Running places within a piece, whose size is bounded.
    seen = seen.withColumn("role", _role(F.col("side"), F.col("speaker"), fixed)).withColumn("chars", _chars(F.col("role")))
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    seen = seen.withColumn("place", F.row_number().over(order)).withColumn("end", F.col("begin") + F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.coalesce(F.col("speaker") == F.col("side"), F.lit(False))
    message = F.struct("place", F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("content"), F.lit(CLOSE)).alias("text"), F.when(own, F.struct((F.col("end") - F.length("content") - len(CLOSE)).alias("begin"), "end")).alias("span"))
    grouped = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(message)).alias("m"))
    mask = F.filter(F.transform("m", lambda x: x["span"]), lambda x: x.isNotNull())
    out = grouped.select(*keys, F.size("m").cast("long").alias("n_turns"), F.array_join(F.transform("m", lambda x: x["text"]), "").alias("text"), mask.alias("mask"))
    return out.withColumn("mask_chars", F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"]))
