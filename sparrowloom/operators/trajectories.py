"""Trajectory time series: every operator works within one series, keyed and ordered by columns.

All are windows over (series, order) or joins that carry the series key, so
series spread over the cluster; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import BLOCKS


def _order(series: list[str], order: list[str]):
    return Window.partitionBy(*series).orderBy(*order)


def noop_flag(small: Column, grip: Column, series: list[str], order: list[str]) -> Column:
    """True for a row without motion: small, and with the grip of the row before, or before any row that moved.

    A dropped row carries the grip of the last kept one, so comparing with the
    row before is comparing with the last kept row.
    """
    w = _order(series, order)
    moved = F.max(~small).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return small & (~F.coalesce(moved, F.lit(False)) | (grip == F.lag(grip).over(w)))


def change_flag(channels: list[Column], series: list[str], order: list[str]) -> Column:
    """True where a channel differs in the next row (the earlier row of a change)."""
    w = _order(series, order)
    out = F.lit(False)
    for c in channels:
        out = out | F.coalesce(F.lead(c).over(w) != c, F.lit(False))
    return out


def time_axis(series: list[str], order: list[str], hertz: float) -> Column:
    return (F.row_number().over(_order(series, order)) - 1) / F.lit(float(hertz))


def segments(indexed: DataFrame, series: list[str], index: str, splits: DataFrame) -> DataFrame:
    """(series, segment, start, end): the stretches between 0, the split points and the length."""
    length = indexed.groupBy(*series).agg((F.max(index) + 1).cast("bigint").alias("length"))
    ends = length.select(*series, F.explode(F.array(F.lit(0).cast("bigint"), F.col("length"))).alias("bound"))
    bounds = ends.unionByName(splits.select(*series, F.col("split").cast("bigint").alias("bound"))).distinct()
    w = Window.partitionBy(*series).orderBy("bound")
    return bounds.select(*series, (F.row_number().over(w) - 1).alias("segment"), F.col("bound").alias("start"), F.lead("bound").over(w).alias("end")).where("end is not null")


def resample_lookahead(samples: DataFrame, anchors: DataFrame, series: list[str], time: str, value: str, horizon: float, steps: int) -> DataFrame:
    """(series, anchor, k, at, value): a grid of steps + 1 points from each anchor to horizon seconds on, linearly interpolated.

    The grid ends at the series' last sample at the latest, and values clamp to
    the ends. Grid points and samples are sorted together in each series; the
    sample before and after every point then come from windows, so no point is
    paired with every sample.
    """
    last = samples.groupBy(*series).agg(F.max(time).alias("last"))
    grid = anchors.join(last, series).select(
        *series,
        F.col("anchor"),
        F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"),
        F.col("last"),
    )
    end = F.least(F.col("anchor") + F.lit(float(horizon)), F.col("last"))
    grid = grid.withColumn("at", F.col("anchor") + F.col("k") * (end - F.col("anchor")) / F.lit(float(steps))).drop("last")
    tagged = samples.select(*series, F.col(time).alias("at"), F.lit(None).cast("double").alias("anchor"), F.lit(None).cast("int").alias("k"), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")).alias("s"))
    both = tagged.unionByName(grid.select(*series, "at", "anchor", "k", F.lit(None).cast("struct<t:double,v:double>").alias("s")))
    before = Window.partitionBy(*series).orderBy("at", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*series).orderBy(F.desc("at"), F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"lo": F.last("s", ignorenulls=True).over(before), "hi": F.last("s", ignorenulls=True).over(after)}).where("s is null")
    lo, hi = F.col("lo"), F.col("hi")
    mixed = F.when(lo["t"].isNull(), hi["v"]).when(hi["t"].isNull() | (hi["t"] == lo["t"]), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (F.col("at") - lo["t"]) / (hi["t"] - lo["t"]))
    return near.select(*series, "anchor", "k", "at", mixed.alias("value"))


def action_delta(resampled: DataFrame, series: list[str]) -> DataFrame:
    """Rows k >= 1 relative to row 0 of their anchor (the proprioceptive state)."""
    first = F.first("value").over(Window.partitionBy(*series, "anchor").orderBy("k"))
    return resampled.withColumn("delta", F.col("value") - first).where("k >= 1")


def static_anchors(resampled: DataFrame, series: list[str], threshold: float) -> DataFrame:
    """Anchors whose first two grid points differ by less than threshold."""
    two = resampled.where("k <= 1").groupBy(*series, "anchor").agg((F.max("value") - F.min("value")).alias("spread"))
    return two.where(F.col("spread") < threshold).select(*series, "anchor")


def candidates(indexed: DataFrame, series: list[str], index: str, margin: int, stride: int) -> DataFrame:
    """Rows at every stride-th index that leave margin rows to the end."""
    length = F.count("*").over(Window.partitionBy(*series))
    return indexed.withColumn("_length", length).where((F.col(index) < F.col("_length") - margin) & (F.col(index) % stride == 0)).drop("_length")


def oversample(candidates_: DataFrame, changes: DataFrame, series: list[str], index: str, reach: int) -> DataFrame:
    """Each candidate once, and once more for every change c with c - reach <= index < c + reach.

    A running count of changes per series answers each range by a difference, so
    candidates and changes are sorted together and never multiplied.
    """
    marks = changes.select(*series, F.col("change").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("who"), F.lit(0).alias("side"))
    asks = candidates_.select(*series, F.col(index).alias("who")).select(
        *series, "who", F.explode(F.array(F.struct((F.col("who") - reach).alias("at"), F.lit(-1).alias("side")), F.struct((F.col("who") + reach).alias("at"), F.lit(1).alias("side")))).alias("q")
    )
    both = marks.unionByName(asks.select(*series, F.col("q.at").alias("at"), F.lit(0).alias("one"), "who", F.col("q.side").alias("side")))
    # Changes up to and including `at`: c - reach <= i < c + reach is i - reach < c <= i + reach.
    run = Window.partitionBy(*series).orderBy("at", F.desc("one")).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("seen", F.sum("one").over(run)).where("who is not null")
    extra = counted.groupBy(*series, "who").agg(F.sum(F.col("seen") * F.col("side")).alias("extra"))
    return extra.select(*series, F.col("who").alias(index), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("extra"))).alias("copy"))


def future_index(index: Column, horizon_rows: int, length: Column) -> Column:
    return F.least(index + F.lit(horizon_rows), length - 1)


def substitute_rejected(rows: DataFrame, ok: Column, order: str, columns: list[str], block_rows: int = 100_000) -> DataFrame:
    """Every rejected row takes the columns of the next acceptable row; rejected rows after the last one go.

    Rows are dealt to blocks by order / block_rows, blocks to groups of BLOCKS;
    the first acceptable row of a block, and of a group, is all that those before it need to know.
    """
    block = F.floor(F.col(order) / block_rows)
    marked = rows.select(order, block.alias("_block"), F.when(ok, F.struct(F.col(order).alias("source"), *columns)).alias("_own"))
    later = lambda keys, by: Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = marked.groupBy("_block").agg(F.min("_own").alias("_first")).withColumn("_group", F.floor(F.col("_block") / BLOCKS))
    groups = firsts.groupBy("_group").agg(F.min("_first").alias("_of_group"))
    groups = groups.select("_group", F.last("_of_group", ignorenulls=True).over(later([], "_group")).alias("_after"))
    inside = firsts.withColumn("_inside", F.last("_first", ignorenulls=True).over(later(["_group"], "_block")))
    nexts = inside.join(groups, "_group").select("_block", F.coalesce("_inside", "_after").alias("_next"))
    within = Window.partitionBy("_block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("_near", F.last("_own", ignorenulls=True).over(within)).join(nexts, "_block").withColumn("_taken", F.coalesce("_near", "_next"))
    return filled.where("_taken is not null").select(order, "_taken.*")
