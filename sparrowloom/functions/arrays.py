"""Vector arithmetic on arrays of doubles, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def mean(c: Column) -> Column:
    return total(c) / F.size(c)


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return total(product(a, b))


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def log_sum_exp(c: Column) -> Column:
    """Stable: the largest element is taken out first."""
    return F.aggregate(c, F.struct(F.lit(0.0).alias("s"), F.array_max(c).alias("m")), lambda a, x: F.struct((a["s"] + F.exp(x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["m"] + F.log(a["s"]))


def softmax(c: Column) -> Column:
    return F.transform(F.arrays_zip(c.alias("x"), F.array_repeat(log_sum_exp(c), F.size(c)).alias("z")), lambda s: F.exp(s["x"] - s["z"]))
