"""Named parameters of a model: groups, counts, renaming and rates by group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds_any(name: Column, parts: list[str]) -> Column:
    """Whether the name holds one of the parts."""
    return F.exists(F.array(*[F.lit(p) for p in parts]).cast("array<string>"), lambda p: F.contains(name, p))


def grouped(rows: DataFrame, name: str, rates: Mapping[str, float]) -> DataFrame:
    """A row for each group whose part the name holds, with the group's rate; a name in no group has none."""
    known = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(float(r)).alias("rate")) for g, r in rates.items()])
    found = rows.withColumn("_g", F.explode(F.filter(known, lambda g: F.contains(F.col(name), g["grp"]))))
    return found.withColumns({"grp": F.col("_g.grp"), "rate": F.col("_g.rate")}).drop("_g")


def counted(rows: DataFrame, name: str, shape: str, frozen: list[str]) -> DataFrame:
    """Parameters and tensors, of those frozen (by parts of the name) and the others; an empty shape is one number."""
    size = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)
    return rows.groupBy(holds_any(F.col(name), frozen).alias("frozen")).agg(F.sum(size).alias("parameters"), F.count("*").alias("n"))


def renumbered(rows: DataFrame, name: str, prefix: str, to: str, first: int, without: list[str]) -> DataFrame:
    """Names `prefix.<layer>.<rest>` from layer `first` on, as `to.<layer - first>.<rest>` in renamed; those that hold a part of `without` are left out, as are all others."""
    rest = F.substring(F.col(name), len(prefix) + 2, 1 << 30)
    layer = F.substring_index(rest, ".", 1).try_cast("int")
    kept = rows.where(F.startswith(F.col(name), F.lit(f"{prefix}.")) & (layer >= first) & ~holds_any(F.col(name), without))
    return kept.withColumn("renamed", F.concat(F.lit(f"{to}."), (layer - first).cast("string"), F.substring(rest, F.length(F.substring_index(rest, ".", 1)) + 1, F.lit(1 << 30))))


def scaled(groups: DataFrame, name: str, rate: float, decay: float, rate_by: Mapping[str, float], decay_by: Mapping[str, float]) -> DataFrame:
    """groups with their learning rate and weight decay: the base, times the group's own factor."""
    times = lambda base, by: F.lit(base) * F.coalesce(F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[F.col(name)], F.lit(1.0)) if by else F.lit(base)
    return groups.withColumns({"rate": times(rate, rate_by), "decay": times(decay, decay_by)})
