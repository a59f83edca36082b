"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source's documents are shuffled (by a hash of their id and text) and laid end to end; the line is cut
into blocks of equally many words. Slot i of the mix has the point frac(i * golden ratio), and the
point's place among the cumulative weights names the slot's source. The r-th slot of a source takes
the r-th block of its line, from the start again after the last, until the source has its target;
where the schedule ends a few slots short of that, the remaining blocks follow in slots of their own.
At any length of the mix the sources' shares are thus within a few blocks of their weights.

No step orders a whole source in one task: the line is laid out by ranges of hash values, whose sums
are added up first, and slots are counted by runs of the schedule in the same way.

Defined results: a null text has size 0; documents of size 0 take no part and have nothing taken; a
null source is a source of its own, after all others; rows that share an id, or have none, are told
apart by their texts, and wholly equal rows are laid out one after another; a source without words has target 0; an empty table gives an
empty table; further columns are left out of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Golden-ratio points are multiples of GOLDEN modulo PERIOD, both whole: 2^31 / golden ratio, made odd.
PERIOD, GOLDEN = 1 << 31, 1327217885
#: Cells by which points find their source, and slots that are counted together.
CELLS, RUN = 4096, 4096
#: Documents that share a range of hash values, on average.
RANGE_ROWS = 2000
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """The number of words: runs without the six ASCII spaces."""
    spaces = F.lit(" \t\n\x0b\x0c\r")
    # A mark for each word and the spaces after it: unlike a count of matches, it holds no list of them.
    return F.coalesce(F.length(F.regexp_replace(F.btrim(text, spaces), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to one row per ``source`` with its ``source_size``.

    The sources share ``share`` times all words by weight; the weights repeat in the order of code
    points, null last. None gets more than ``cap`` times its size: sources are full in the order of
    size over weight, and those before a full one are full, so one running sum finds them all.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "weight", F.col("source").isNull(), F.encode("source", "utf-8"))
    before, here_on, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = rows.withColumns({"full_words": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open_weight": F.sum("weight").over(here_on), "words": F.sum("source_size").over(all_) * F.lit(float(share))})
    # The level of words per unit of weight if this source and all after it are open.
    level = (F.col("words") - F.col("full_words")) / F.col("open_weight")
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    first_open = F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("weight")).alias("o"), "level"))).over(all_).getField("level")
    return rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), first_open * F.col("weight")))).select("source", "source_size", "target")


def _running(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, part: str, full: list[str]) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the earlier rows of the same ``by``.

    ``part`` cuts each ``by`` into ordered parts of bounded size: their sums are added up first.
    """
    sums = rows.groupBy(*by, part).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, [*by, part]).withColumn(out, F.col("_in") + F.col("_ahead")).select(*full, out)


def plan(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 256, blocks_per_source: int = 64) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``doc_id, source, text``.

    Blocks have ``block_words`` words, or fewer if the smallest target would not have
    ``blocks_per_source`` of them.
    """
    spark = docs.sparkSession
    line = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    line = written(line, "sizes", small=True)
    per_source = line.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = targets(per_source.select("source", "source_size"), weights, share, cap)
    goals = goals.withColumn("goal", F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * F.lit(float(cap))).cast("long")))
    goals = written(goals.join(per_source.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("s", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8")))), "goals", small=True)
    least, total = goals.where("goal > 0").agg(F.min("goal"), F.sum("goal")).first()
    block = max(1, min(block_words, (least or 1) // blocks_per_source))
    slots = (total or 0) // block

    # A row for each source: broadcast up to BROADCAST_SOURCES of them.
    few = F.broadcast if goals.count() <= BROADCAST_SOURCES else (lambda df: df)

    # Each source's line: where every document with words begins.
    known = goals.select(F.col("source").alias("_s"), "s", "rows", "source_size", "target", "goal")
    line = line.join(few(known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    spread = F.xxhash64("doc_id", "tie", F.lit(20))
    laid = line.where("size > 0").withColumn("h", spread).withColumn("part", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.greatest(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(1))).cast("long"))
    laid = _running(laid, ["s"], ["h", "doc_id", "size", "tie"], "size", "start", "part", ["doc_id", "source", "size", "s", "source_size", "target"])

    # Slots: points, their sources, and their ranks within the sources.
    edge = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    bands = goals.where("goal > 0").withColumn("high", F.round(F.sum("goal").over(edge) / F.lit(float(total or 1)) * PERIOD).cast("long"))
    bands = bands.withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("s"))).select("s", "goal", "low", "high")
    cell = PERIOD // CELLS
    cells = bands.select("*", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.greatest(F.col("high") - 1, F.col("low")) / cell))).alias("cell"))
    points = spark.range(slots).withColumn("point", F.col("id") % PERIOD * GOLDEN % PERIOD).withColumn("cell", F.floor(F.col("point") / cell))
    hits = points.join(few(cells), "cell").where("point >= low and point < high").select("id", "s", "goal", F.floor(F.col("id") / RUN).alias("run"), F.lit(1).alias("one"))
    ranked = _running(hits, ["s"], ["id"], "one", "rank", "run", ["s", "goal"])
    wanted = F.ceil(F.col("goal") / block)
    had = hits.groupBy("s").agg(F.count("*").alias("had"))
    rest = bands.join(had, "s", "left").select("s", "goal", F.coalesce("had", F.lit(0)).alias("had")).where(F.col("had") < wanted)
    rest = rest.select("s", "goal", F.explode(F.sequence(F.col("had"), wanted - 1)).alias("rank"))
    schedule = ranked.where(F.col("rank") < wanted).unionByName(rest)

    # The words of a slot, as a range of the source's endless line; a range may end one round and begin the next.
    sizes = few(goals.select("s", "source_size"))
    spans = schedule.join(sizes, "s").withColumn("a", F.col("rank") * block).withColumn("b", F.least(F.col("a") + block, F.col("goal")))
    spans = spans.select("s", "source_size", F.explode(F.filter(F.array(*(
        F.struct(F.greatest(F.col("a") - F.col("source_size") * k, F.lit(0)).alias("a"), F.least(F.col("b") - F.col("source_size") * k, F.col("source_size")).alias("b")) for k in range(int(-(-cap // 1)) + 1)
    )), lambda x: x.a < x.b)).alias("w")).select("s", "w.a", "w.b")
    # Slots meet documents in blocks of the line.
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    spans = spans.select("s", "block", F.greatest("a", F.col("block") * block).alias("a"), F.least("b", (F.col("block") + 1) * block).alias("b"))
    spans = spans.groupBy("s", "block", "a", "b").agg(F.count("*").alias("times"))
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    both = F.greatest(F.lit(0), F.least(F.col("b"), F.col("start") + F.col("size")) - F.greatest(F.col("a"), F.col("start")))
    taken = pieces.join(spans, ["s", "block"]).groupBy("s", "start").agg(F.sum(both * F.col("times")).alias("taken"))
    out = laid.join(taken, ["s", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    none = line.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return out.select(*columns).unionByName(none.select(*columns))
