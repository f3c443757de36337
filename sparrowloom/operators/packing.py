"""Rows in order cut into shards of a limited size, greedily (next fit).

A row goes to the open shard, or opens the next one where it would pass the
limit; a row above the limit has a shard of its own and leaves the open one
open. Sequentially that is a loop; here:

* Sums before each row come from stretches of rows (lineage.sums_before).
* Where a shard that began at row i would end is the first row whose end passes
  i's start + limit. Ends and those bounds meet in cells of one limit's width, so
  a window holds about one shard's rows, never all.
* The shards' starts are the rows reachable from the first one by these
  pointers. They are found by stretches of about STRETCH rows: where a stretch
  can be entered, a pass within it tells where it is left and after how many
  shards; these hops are pointers for stretches of stretches, until one is left.
  Then each level's path tells the one below where its stretches are entered.
  A level holds a fraction of the rows below, so all of it is linear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import numbered, settle, sums_before

#: Rows of a stretch, about: at least two shards, however many rows these have.
STRETCH = 65_536
_POINTER = ["place", "at", "next", "next_at", "steps"]


def next_starts(small: DataFrame, most: int) -> DataFrame:
    """(place, at, next) of small (place, before, size): the first row beyond the shard that begins at place, of which at is what lies before."""
    points = small.select(F.expr(f"(before + size) div {most}").alias("cell"), (F.col("before") + F.col("size")).alias("at"), F.lit(1).alias("kind"), F.col("place").alias("point"), F.lit(None).cast("bigint").alias("place"))
    # What lies before a cell is known by the last row of the cell before, which holds at least the row before place.
    carried = points.groupBy("cell").agg(F.max("point").alias("point")).select((F.col("cell") + 1).alias("cell"), ((F.col("cell") + 1) * most).alias("at"), F.lit(0).alias("kind"), "point", F.lit(None).cast("bigint").alias("place"))
    bounds = small.select((F.expr(f"before div {most}") + 1).alias("cell"), (F.col("before") + most).alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("bigint").alias("point"), "place")
    within = Window.partitionBy("cell").orderBy("at", "kind", "point").rowsBetween(Window.unboundedPreceding, 0)
    # Ends grow with their places, so the greatest so far is the last.
    passed = points.unionByName(carried).unionByName(bounds).withColumn("last", F.max("point").over(within)).where("kind = 2")
    return passed.select("place", (F.col("at") - most).alias("at"), F.greatest(F.col("place") + 1, F.coalesce(F.col("last") + 1, F.lit(0))).alias("next"))


def _hops(rows: pd.DataFrame) -> pd.DataFrame:
    """From a stretch's pointers and its entries (next: -1), for each entry the first row beyond and the shards until there."""
    pointers = rows[rows["next"] >= 0].sort_values("place")
    place, to, to_at, steps = (pointers[c].to_numpy().copy() for c in ("place", "next", "next_at", "steps"))
    at = np.minimum(np.searchsorted(place, to), max(0, len(place) - 1))
    inside = place[at] == to if len(place) else at.astype(bool)
    for i in np.flatnonzero(inside)[::-1]:
        j = at[i]
        to[i], to_at[i], steps[i] = to[j], to_at[j], steps[i] + steps[j]
    held = np.isin(place, rows["place"][rows["next"] < 0].to_numpy())
    return pd.DataFrame({"place": place, "at": pointers["at"].to_numpy(), "next": to, "next_at": to_at, "steps": steps})[held]


def _paths(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """From a stretch's pointers and the row where it is entered (next: -1, steps: its k), the rows on the way with their k."""
    starts = rows[rows["next"] < 0].sort_values("place")
    if not len(starts):
        return pd.DataFrame({"place": [], "at": [], "k": []}, dtype="int64")
    place, at, k = (int(starts[c].iloc[0]) for c in ("place", "at", "steps"))
    pointers = rows[rows["next"] >= 0]
    onward = dict(zip(pointers["place"].tolist(), zip(*(pointers[c].tolist() for c in ("next", "next_at", "steps")), strict=True), strict=True))
    stretch, found = at // width, [(place, at, k)]
    while (step := onward.get(place)) and step[1] // width == stretch:
        place, at, k = step[0], step[1], k + step[2]
        found.append((place, at, k))
    return pd.DataFrame(found, columns=["place", "at", "k"])


def hops(pointers: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """pointers from where stretches of this width (in `at`) can be entered to the next stretch entered."""
    own, beyond = F.expr(f"at div {width}"), F.expr(f"next_at div {width}")
    none = [F.lit(-1).cast("bigint").alias(c) for c in ("next", "next_at", "steps")]
    entries = pointers.where(beyond > own).select(F.col("next").alias("place"), F.col("next_at").alias("at")).unionByName(first.select("place", "at")).select("place", "at", *none)
    schema = ", ".join(f"{c} bigint" for c in _POINTER)
    return pointers.unionByName(entries).groupBy(own.alias("stretch")).applyInPandas(_hops, schema).where(beyond > own)


def paths(pointers: DataFrame, entered: DataFrame, width: int) -> DataFrame:
    """(place, at, k): the rows on the way within each stretch that is entered; entered (place, at, k)."""
    none = [F.lit(-1).cast("bigint").alias(c) for c in ("next", "next_at")]
    marked = pointers.unionByName(entered.select("place", "at", *none, F.col("k").alias("steps")))
    return marked.groupBy(F.expr(f"at div {width}").alias("stretch")).applyInPandas(lambda rows: _paths(rows, width), "place bigint, at bigint, k bigint")


def reachable(pointers: DataFrame, first: DataFrame, shard: int, factor: int, end: int) -> DataFrame:
    """(place, k): the rows that `first` (place, at; one row) leads to by pointers (place, at, next, next_at), the k-th after k steps.

    at grows with place, is below end, and a pointer spans about shard of it; a
    level's stretches are factor times as wide as those of the level below.
    """
    levels, width = [(settle(pointers.select(*_POINTER[:-1], F.lit(1).cast("bigint").alias("steps"))), shard * factor)], shard * factor
    while width < end:
        levels.append((settle(hops(levels[-1][0], first, width)), width * factor))
        width *= factor
    found = first.select("place", "at", F.lit(0).cast("bigint").alias("k"))
    for own, width in reversed(levels):
        found = settle(paths(own, found, width))
    return found.select("place", "k")


def pack(rows: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """rows with shard (bigint, from 0, in the order in which shards are closed): no shard's size is above most unless it is one row.

    Null sizes count as 0; rows that are equal in order may come in any order among themselves.
    """
    if most < 1:
        raise ValueError(f"a shard's limit must be positive: {most}")
    placed = numbered(rows.drop("shard").withColumn("_size", F.coalesce(F.col(size).cast("bigint"), F.lit(0))), order)
    fits = F.col("_size") <= most
    summed = settle(sums_before(placed, {"_place": fits.cast("bigint"), "_before": F.when(fits, F.col("_size")).otherwise(0)}).withColumn("_fits", fits))
    small = summed.where("_fits").select(F.col("_place").alias("place"), F.col("_before").alias("before"), F.col("_size").alias("size"), "ordinal")
    pointers = next_starts(small, most).join(small.select(F.col("place").alias("next"), F.col("before").alias("next_at")), "next")
    whole = small.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    factor = max(2, min(STRETCH, STRETCH * whole["size"] // (max(1, whole["n"]) * most)))
    starts = reachable(pointers, small.where("place = 0").select("place", F.col("before").alias("at")), most, factor, whole["size"] + 1)
    # A shard closes where the next one's first row comes, the last one after all; one of a single large row at once.
    begun = starts.join(small.select("place", "ordinal"), "place")
    closing = begun.where("k > 0").select((F.col("k") - 1).alias("k"), F.col("ordinal").alias("close")).unionByName(starts.agg(F.max("k").alias("k")).where("k is not null").select("k", F.lit(2**63 - 1).alias("close")))
    large = summed.where("not _fits").select(F.lit(None).cast("bigint").alias("k"), F.col("ordinal").alias("close"))
    shards = settle(numbered(closing.unionByName(large), ["close"]).withColumnRenamed("ordinal", "shard"))
    # A row's shard began in the row's cell or in the one before.
    marked = small.join(starts, "place", "left").withColumn("cell", F.expr(f"before div {most}"))
    earlier = marked.groupBy("cell").agg(F.max("k").alias("earlier")).select((F.col("cell") + 1).alias("cell"), "earlier")
    so_far = F.max("k").over(Window.partitionBy("cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    own = marked.withColumn("so_far", so_far).join(earlier, "cell", "left").select("ordinal", F.coalesce("so_far", "earlier").alias("k"))
    of_small = own.join(shards, "k").select("ordinal", "shard")
    of_large = shards.where("k is null").select(F.col("close").alias("ordinal"), "shard")
    numbers = of_small.unionByName(of_large)
    return summed.join(numbers, "ordinal").select(*[c for c in rows.columns if c != "shard"], "shard")
