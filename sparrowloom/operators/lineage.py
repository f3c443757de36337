"""Cutting lineage, and numbering rows in order without a window over all of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mixing import BLOCKS, global_ordinal


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in a local session without that setting."""
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (set_dir.get() if set_dir.isDefined() else None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparrowloom-")
    if not set_dir.isDefined():
        context.setCheckpointDir(found)
    return found


def settle(rows: DataFrame) -> DataFrame:
    """rows from a checkpoint in the shared folder, which lost executors don't take along."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ordinal from 0 in order (nulls first), for any columns: range partitions, then counts of stretches of each."""
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return global_ordinal(placed, [], [F.col("_at")], F.shiftright("_at", 16)).drop("_at")


def sums_before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """rows (ordinal, ...) with, for each name in sums, the sum of its column over the rows of smaller ordinal.

    Stretches of BLOCKS rows are summed first, then BLOCKS stretches at a time, as in global_ordinal().
    """
    named = rows.withColumns({f"_v_{n}": c for n, c in sums.items()}).withColumns({"_block": F.expr(f"ordinal div {BLOCKS}")}).withColumn("_group", F.expr(f"_block div {BLOCKS}"))
    ahead = lambda name, *w: F.coalesce(F.sum(name).over(Window.partitionBy(*w[:-1]).orderBy(w[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = named.groupBy("_group", "_block").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    groups = blocks.groupBy("_group").agg(*[F.sum(f"_b_{n}").alias(f"_g_{n}") for n in sums])
    groups = groups.select("_group", *[ahead(f"_g_{n}", "_group").alias(f"_g_{n}") for n in sums])
    blocks = blocks.select("_group", "_block", *[ahead(f"_b_{n}", "_group", "_block").alias(f"_b_{n}") for n in sums])
    offsets = blocks.join(groups, "_group").select("_block", *[(F.col(f"_b_{n}") + F.col(f"_g_{n}")).alias(f"_o_{n}") for n in sums])
    joined = named.join(offsets, "_block")
    return joined.select(*rows.columns, *[(F.col(f"_o_{n}") + ahead(f"_v_{n}", "_block", "ordinal")).cast("bigint").alias(n) for n in sums])
