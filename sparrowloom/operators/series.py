"""Filters and joins of series, stories and states, with the columns as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import samples as S


def placed(rows: DataFrame, keys: list[str], order: list[str], index: str = "idx", n: str | None = None) -> DataFrame:
    """rows with their place in their series (from 0) and, if named, the series' length."""
    found = rows.withColumn(index, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return found if n is None else found.withColumn(n, F.count("*").over(Window.partitionBy(*keys)))


def without_first(rows: DataFrame, index: str, first: int = 1) -> DataFrame:
    """rows without the first ones of each series, the others' places counted from 0 again."""
    return rows.where(F.col(index) >= first).withColumn(index, (F.col(index) - first).cast("bigint"))


def only_last(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], time: str, last_time: Column) -> DataFrame:
    """rows whose values are zero and whose time is 1, but for the last of each series, which keeps its values at last_time."""
    down = [F.desc(c) for c in order]
    marked = rows.withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(*down)) == 1)
    found = {name: F.when(F.col("_last"), c).otherwise(F.lit(0.0)) for name, c in values.items()}
    return marked.withColumns(found | {time: F.when(F.col("_last"), last_time).otherwise(F.lit(1.0))}).drop("_last")


def near_static(values: list[str], keys: list[str], order: list[str], limit: float) -> Column:
    """Whether every one of the columns moves by less than limit to the series' next row; false at its end and for nulls.

    For several arms or dimensions all must rest.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    still = [F.coalesce(F.abs(F.lead(v).over(w) - F.col(v)) < limit, F.lit(False)) for v in values]
    found = still[0]
    for s in still[1:]:
        found = found & s
    return found


def successful(rows: DataFrame, keys: list[str], order: str, state: str, wanted: str) -> DataFrame:
    """The series whose last row has the wanted state."""
    return rows.groupBy(*keys).agg((F.max_by(state, order) == wanted).alias("_done")).where("_done").select(*keys)


def in_chunks(rows: DataFrame, index: str, n: str, size: int) -> DataFrame:
    """rows with their chunk; rows after the last whole chunk are left out."""
    whole = F.floor((F.col(n) - 1) / size) * size
    return rows.where(F.col(index) <= whole).withColumn("chunk", S.chunk_of(F.col(index), size))


def halved(rows: DataFrame, index: str, n: str, size: int, kept: int = 2) -> DataFrame:
    """Two frames for each row of two channel halves, with whether the next chunk is given them."""
    both = rows.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.withColumn("frame", (F.col(index) * 2 + F.col("half")).cast("bigint")).withColumn("carried", S.carried(F.col(index), F.col(n), size, kept))


def with_default(rows: DataFrame, found: DataFrame, key: str, value: str, default: str, name: str) -> DataFrame:
    """rows with the value of their key, or the default where there is none (`missing` says so). Keys of found are distinct."""
    joined = rows.join(found.select(key, F.col(value).alias("_found")), key, "left")
    return joined.withColumns({name: F.coalesce("_found", F.lit(default)), "missing": F.col("_found").isNull()}).drop("_found")


def with_any(rows: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The groups with a row that is wanted, and the number of such rows. Counts only: no group is held as a list."""
    return rows.groupBy(*keys).agg(F.count(F.when(wanted, 1)).alias("n")).where("n > 0")


def merged_state(own: DataFrame, loaded: DataFrame, name: str, value: str, fresh: str) -> DataFrame:
    """own with the loaded value of its name; `fresh` marks those without, and one that the pattern fresh doesn't match fails."""
    merged = own.join(loaded.select(name, value), name, "left")
    missing = F.col(value).isNull()
    checked = F.when(~missing | F.col(name).rlike(fresh), missing).otherwise(F.raise_error(F.concat(F.lit("no value for "), F.col(name))).cast("boolean"))
    return merged.withColumn("fresh", checked)
