"""Trajectories of vectors: both arms on clocks of their own, looked ahead from anchors, as arrays of numbers.

A series' samples of both arms and the points asked for are sorted together
once in each direction; the samples before and after a point then come from
windows, so no point is paired with every sample. A series is an episode: it is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STILL = 1e-5


def look_ahead(anchors: DataFrame, keys: list[str], start: str, horizon: Column, last: Column, steps: int) -> DataFrame:
    """(keys, k, at): steps + 1 even points from start to horizon later, or to last if that comes first."""
    end = F.least(F.col(start) + horizon, last)
    return anchors.select(*keys, F.col(start).alias("_start"), end.alias("_end"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).select(*keys, "k", (F.col("_start") + F.col("k") * (F.col("_end") - F.col("_start")) / F.lit(float(steps))).alias("at"))


def between(lo: Column, hi: Column, at: Column) -> Column:
    """The vector at a time between two samples (t, v), of which one may be missing (then the other's holds)."""
    share = (at - lo["t"]) / (hi["t"] - lo["t"])
    mixed = F.zip_with(lo["v"], hi["v"], lambda a, b: a + (b - a) * share)
    return F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (hi["t"] == lo["t"]), lo["v"]).otherwise(mixed)


def interpolate(samples: DataFrame, points: DataFrame, series: list[str], arms: dict[str, str]) -> DataFrame:
    """points (series, at, ...) with a vector for each arm: linear between its samples, the first or last one's beyond them.

    arms: the column of each arm's vector, with that of its time. A sample with a null time or vector is left out.
    """
    own = [c for c in points.columns]
    empty = {a: F.lit(None).cast(f"struct<t:double,v:{dict(samples.dtypes)[a]}>").alias(f"_{a}") for a in arms}
    rest = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in (*series, "at")]
    both = points.select(*own, F.lit(True).alias("_asked"), *empty.values())
    for arm, time in arms.items():
        held = [F.struct(F.col(time).cast("double").alias("t"), F.col(arm).alias("v")).alias(f"_{a}") if a == arm else empty[a] for a in arms]
        both = both.unionByName(samples.where(F.col(time).isNotNull() & F.col(arm).isNotNull()).select(*series, F.col(time).cast("double").alias("at"), *rest, F.lit(False).alias("_asked"), *held))
    # Under a key of its own: rows that lie by series already would stay in tasks sized for what they were made of,
    # and here are several for each, with vectors. A shuffle of them lets Spark size the tasks by what these sort.
    both = both.withColumn("_series", F.struct(*series))
    # At equal times samples come first in both directions.
    upto = Window.partitionBy("_series").orderBy("at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("_series").orderBy(F.desc("at"), "_asked").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({f"{side}{a}": F.last(f"_{a}", ignorenulls=True).over(w) for a in arms for side, w in (("_lo_", upto), ("_hi_", since))})
    return near.where("_asked").select(*own, *[between(F.col(f"_lo_{a}"), F.col(f"_hi_{a}"), F.col("at")).alias(a) for a in arms])


def sequences(points: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns) with each column's values in order of k as an array."""
    listed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias("_p"))
    return listed.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in columns])


def still(sequence: Column, threshold: float = STILL) -> Column:
    """Whether the first two vectors differ by less than threshold in every number."""
    return F.forall(F.zip_with(sequence[0], sequence[1], lambda a, b: F.abs(a - b)), lambda d: d < threshold)


def action_slice(trajectory: Column, relative: Column) -> Column:
    """(proprio, action) of a trajectory of at least two vectors: the first one, and the others, with those numbers that `relative` lists taken from proprio."""
    first = trajectory[0]
    moved = F.transform(F.slice(trajectory, F.lit(2), F.size(trajectory) - 1), lambda v: F.transform(v, lambda x, i: F.when(F.array_contains(relative, i), x - F.get(first, i)).otherwise(x)))
    checked = F.when(F.size(trajectory) >= 2, moved).otherwise(F.raise_error(F.lit("a trajectory needs two vectors")))
    return F.struct(first.alias("proprio"), checked.alias("action"))
