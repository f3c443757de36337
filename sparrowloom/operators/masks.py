"""Masks of images as spans: polygons by scanlines, unions by a sweep, tints by span.

A span is (start, stop) over an image's pixels numbered down its columns, as
in run lengths; no step makes a row for each pixel.

* Polygons: every edge gives one crossing for each column that it spans (the
  edge table); a column's crossings in order pair up by the even-odd rule.
* Union: starts count up and stops down; where the running count of an image
  leaves or reaches zero a span of the union begins or ends. Equal places are
  summed first, so an image has at most as many as it has pixels, however many instances it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polygon_spans(polygons: DataFrame, keys: list[str], corners: str, height: Column, width: Column) -> DataFrame:
    """(keys, start, stop) from polygons, each a flat list x1, y1, x2, y2, ... of corners: pixels whose middle lies inside.

    keys must name one polygon: parts of an instance are made one mask by union_spans() afterwards. Fewer than three
    corners enclose nothing; what lies beyond the image is cut off.
    """
    own = polygons.select(*keys, height.alias("_h"), width.alias("_w"), F.col(corners).alias("_c"), (F.size(corners) / 2).cast("int").alias("_n"))
    corner = lambda i: [F.get("_c", 2 * i + k).cast("double") for k in (0, 1)]
    edge = lambda i: F.struct(*[x.alias(n) for x, n in zip([*corner(i), *corner((i + 1) % F.col("_n"))], ("x1", "y1", "x2", "y2"), strict=True)])
    edges = own.where("_n > 2").select(*keys, "_h", "_w", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), edge)).alias("e")).select(*keys, "_h", "_w", "e.*")
    # Columns whose middle lies from the edge's left end on and before its right end.
    first, last = F.greatest(F.ceil(F.least("x1", "x2") - 0.5), F.lit(0)), F.least(F.ceil(F.greatest("x1", "x2") - 0.5), F.col("_w")) - 1
    columns = edges.withColumns({"_first": first.cast("int"), "_last": last.cast("int")}).where("_first <= _last")
    crossings = columns.select(*keys, "_h", "x1", "y1", "x2", "y2", F.explode(F.sequence("_first", "_last")).alias("_x"))
    at = F.col("y1") + (F.col("_x") + 0.5 - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    sorted_ = crossings.select(*keys, "_h", "_x", at.alias("_at")).groupBy(*keys, "_h", "_x").agg(F.array_sort(F.collect_list("_at")).alias("_at"))
    row = lambda i: F.least(F.greatest(F.ceil(F.get("_at", i) - 0.5), F.lit(0)), F.col("_h")).cast("bigint")
    base = F.col("_x").cast("bigint") * F.col("_h")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("_at") / 2).cast("int") - 1), lambda i: F.struct((base + row(2 * i)).alias("start"), (base + row(2 * i + 1)).alias("stop")))
    return sorted_.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.*").where("start < stop")


def run_spans(masks: DataFrame, keys: list[str], runs: str) -> DataFrame:
    """(keys, start, stop) from run lengths, off first."""
    ends = F.aggregate(F.col(runs), F.array(F.lit(0).cast("bigint")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    on = F.filter(F.transform(F.sequence(F.lit(0), F.size("_e") - 2), lambda i: F.struct(i.alias("i"), F.get("_e", i).alias("start"), F.get("_e", i + 1).alias("stop"))), lambda s: (s["i"] % 2 == 1) & (s["start"] < s["stop"]))
    return masks.where(F.size(runs) > 0).select(*keys, ends.alias("_e")).select(*keys, F.explode(on).alias("s")).select(*keys, "s.start", "s.stop")


def _changes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, change): by how much the number of spans over a place differs from the one before it."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("change")))).alias("e"))
    return ends.groupBy(*keys, "e.at").agg(F.sum("e.change").alias("change")).where("change <> 0")


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop): the spans that any of a key's spans covers, without touching or overlapping ones."""
    order = Window.partitionBy(*keys).orderBy("at")
    over = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = _changes(spans, keys).withColumn("over", over).withColumn("before", F.coalesce(F.lag("over").over(order), F.lit(0)))
    edges = counted.where("(over = 0) <> (before = 0)").withColumn("stop", F.lead("at").over(order))
    return edges.where("over > 0").select(*keys, F.col("at").alias("start"), "stop")


def runs_of(spans: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, runs): spans of a union as run lengths over size pixels, off first; a row of the result is one mask."""
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_s"), F.first(size).alias("_size"))
    steps = F.flatten(F.transform("_s", lambda s: F.array(s["start"], s["stop"])))
    return listed.select(*keys, F.array_append(steps, F.col("_size").cast("bigint")).alias("_p")).select(*keys, F.transform("_p", lambda p, i: p - F.when(i == 0, F.lit(0)).otherwise(F.get("_p", i - 1))).alias("runs"))


def tint_spans(pixels: DataFrame, mask: DataFrame, keys: list[str], values: list[str], color: list[int], weight: float = 0.7) -> DataFrame:
    """(keys, start, stop, values): an image's spans of equal pixels, those under the mask with weight times color added, at most 255.

    pixels: (keys, start, stop, values) that cover the image once; mask: a union's spans. Both
    are swept together, so the result has a span where either changes.
    """
    own = pixels.select(*keys, F.col("start").alias("at"), F.struct("stop", *values).alias("px"), F.lit(0).alias("change"))
    both = own.unionByName(_changes(mask, keys).select(*keys, "at", F.lit(None).cast(dict(own.dtypes)["px"]).alias("px"), "change"))
    placed = both.groupBy(*keys, "at").agg(F.max("px").alias("px"), F.sum("change").alias("change"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.select(*keys, F.col("at").alias("start"), F.last("px", ignorenulls=True).over(so_far).alias("px"), (F.sum("change").over(so_far) > 0).alias("on"), F.lead("at").over(order).alias("next"))
    cut = swept.withColumn("stop", F.least("px.stop", F.coalesce("next", F.col("px.stop")))).where("start < stop")
    tinted = [F.when(F.col("on"), F.least(F.lit(255), F.bround(F.col(f"px.{v}") + c * weight))).otherwise(F.col(f"px.{v}")).cast("int").alias(v) for v, c in zip(values, color, strict=True)]
    return cut.select(*keys, "start", "stop", *tinted)
