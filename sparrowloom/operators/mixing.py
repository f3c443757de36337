"""Mixing and batching of data sets, reproducible: every choice follows from keys by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform

#: Blocks that are summed together before the next level's sums.
BLOCKS = 65_536
#: Sources, or entries of a table of weights, at most; more fail when they are read. What is broadcast has this bound.
MOST_SOURCES = 100_000


def at_most(rows: DataFrame, most: int, what: str) -> DataFrame:
    """rows, which fail when they are read if there are more than `most`; no job runs before."""
    placed = rows.limit(most + 1).withColumn("_place", F.row_number().over(Window.orderBy(F.lit(0))))
    checked = F.when(F.col("_place") > most, F.raise_error(F.lit(f"more than {most} {what}"))).otherwise(F.lit(True)).cast("boolean")
    return placed.where(checked).drop("_place")


def global_ordinal(rows: DataFrame, partition: list[str], order: list[Column], block: Column) -> DataFrame:
    """rows with ordinal, their place by (block, order) within partition; block, a whole number, must grow with order.

    Blocks are counted first, then BLOCKS of them at a time, so neither the rows
    nor the blocks of a large partition meet in one task.
    """
    marked = rows.withColumn("_block", block)
    counts = marked.groupBy(*partition, "_block").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_block") / BLOCKS))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy(*partition, "_group").agg(F.sum("_n").alias("_gn"))
    groups = groups.select(*partition, "_group", F.coalesce(F.sum("_gn").over(earlier(partition, "_group")), F.lit(0)).alias("_groups_ahead"))
    inside = counts.select(*partition, "_block", "_group", F.coalesce(F.sum("_n").over(earlier([*partition, "_group"], "_block")), F.lit(0)).alias("_inside"))
    offsets = inside.join(groups, [*partition, "_group"]).select(*partition, "_block", (F.col("_inside") + F.col("_groups_ahead")).alias("_ahead"))
    within = Window.partitionBy(*partition, "_block").orderBy(*order)
    return marked.join(offsets, [*partition, "_block"]).withColumn("ordinal", F.col("_ahead") + F.row_number().over(within) - 1).drop("_block", "_ahead")


def shuffled(rows: DataFrame, partition: list[str], key: str, salt: str, blocks: int = BLOCKS) -> DataFrame:
    """rows with ordinal in an order by hash, the same on every run."""
    u = uniform(F.col(key), salt)
    return global_ordinal(rows.withColumn("_u", u), partition, [F.col("_u"), F.col(key)], F.floor(F.col("_u") * blocks)).drop("_u")


def sharded(rows: DataFrame, world: int, batch: int) -> DataFrame:
    """rows (ordinal, ...) dealt round to `world` shards and cut into whole batches; incomplete ones go."""
    total = rows.agg(F.count("*").alias("_total"))
    per = F.floor(F.floor(F.col("_total") / world) / batch) * batch
    dealt = rows.withColumns({"shard": (F.col("ordinal") % world).cast("int"), "place": F.floor(F.col("ordinal") / world)})
    return dealt.join(F.broadcast(total)).where(F.col("place") < per).withColumn("batch", F.floor(F.col("place") / batch)).drop("_total")


def sizes(sources: DataFrame, source: str) -> DataFrame:
    """(source, size): a row for each source, MOST_SOURCES at most."""
    return at_most(sources.groupBy(source).agg(F.count("*").alias("size")), MOST_SOURCES, "sources")


def from_every_source(sources: DataFrame, source: str, steps: int | None = None, stop_at_shortest: bool = False) -> DataFrame:
    """sources (ordinal, ...) with step: each step takes the next row of each source; short ones start again, or all stop with the shortest.

    Without steps the longest source starts again once. A row knows from its
    ordinal and its source's size at which steps it comes, so steps and rows are not joined.
    """
    n = sizes(sources, source)
    ends = n.agg(F.min("size").alias("_least"), (F.max("size") + 1).alias("_most"))
    end = F.lit(steps).cast("bigint") if steps is not None else F.col("_most")
    if stop_at_shortest:
        end = F.least(F.col("_least"), F.lit(steps).cast("bigint"))
    sized = sources.join(F.broadcast(n), source).join(F.broadcast(ends))
    at = F.when(F.col("ordinal") < end, F.sequence("ordinal", end - 1, F.col("size")))
    return sized.withColumn("step", F.explode(at)).drop("size", "_least", "_most")


def in_turn(sources: DataFrame, source: str, per_step: int, steps: int | None = None) -> DataFrame:
    """sources (ordinal, ...) with step, place and epoch: each step makes per_step draws, each from the source after the last one's.

    Sources follow each other by name (null first), and the pointer goes on from
    step to step; an exhausted source starts a new epoch. Without steps the
    longest source starts again once. As in from_every_source() a row knows its draws.
    """
    n = sizes(sources, source)
    every = Window.orderBy(source)
    turns = n.select(F.col(source).alias("_name"), "size", (F.row_number().over(every) - 1).alias("_turn"), F.count("*").over(Window.partitionBy()).alias("_many"), F.max("size").over(Window.partitionBy()).alias("_most"))
    draws = F.lit(steps * per_step).cast("bigint") if steps is not None else F.ceil(F.col("_many") * (F.col("_most") + 1) / per_step) * per_step
    # The source's draws are those whose number is its turn, up to _many.
    last = F.floor((draws - 1 - F.col("_turn")) / F.col("_many"))
    sized = sources.join(F.broadcast(turns), F.col(source).eqNullSafe(F.col("_name")))
    own = sized.withColumn("_k", F.explode(F.when(F.col("ordinal") <= last, F.sequence("ordinal", last, F.col("size")))))
    draw = F.col("_k") * F.col("_many") + F.col("_turn")
    told = own.withColumns({"step": F.floor(draw / per_step), "place": F.pmod(draw, F.lit(per_step)).cast("int"), "epoch": F.floor(F.col("_k") / F.col("size"))})
    return told.drop("_name", "size", "_turn", "_many", "_most", "_k")


def pick_loader(step: Column, weights: dict[str, float], salt: str) -> Column:
    """A loader for a step by weight, by hash."""
    total = sum(weights.values())
    u = uniform(step, salt)
    pick, upto = F.lit(list(weights)[-1]), 0.0
    bounds = []
    for name, w in weights.items():
        upto += w / total
        bounds.append((name, upto))
    for name, bound in reversed(bounds[:-1]):
        pick = F.when(u <= bound, F.lit(name)).otherwise(pick)
    return pick


def weighted_draws(spark: SparkSession, weights: dict[str, float], steps: int, salt: str) -> DataFrame:
    """(step, loader, ordinal): a loader for each step by weight, and how often it was drawn before."""
    drawn = spark.range(steps).withColumnRenamed("id", "step").withColumn("loader", pick_loader(F.col("step"), weights, salt))
    return global_ordinal(drawn, ["loader"], [F.col("step")], F.floor(F.col("step") / 65536))


def cycled(draws: DataFrame, sources: DataFrame, source: str, stop_at_first_end: bool = False) -> DataFrame:
    """draws (step, loader, ordinal) with their rows; an exhausted loader starts a new epoch, or ends all.

    With stop_at_first_end steps from the first draw past a loader's end on are left out.
    """
    n = sizes(sources, source).withColumnRenamed(source, "loader")
    sized = draws.join(F.broadcast(n), "loader").withColumns({"epoch": F.floor(F.col("ordinal") / F.col("size")), "place": F.pmod("ordinal", "size")})
    if stop_at_first_end:
        first = sized.where("epoch > 0").agg(F.min("step").alias("_end"))
        sized = sized.join(F.broadcast(first)).where("_end is null or step < _end").drop("_end")
    rows = sources.withColumnRenamed(source, "loader").withColumnRenamed("ordinal", "place")
    return sized.drop("ordinal", "size").join(rows, ["loader", "place"])


def mix_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def collate(rows: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each batch, its columns as arrays in order."""
    gathered = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))
    return gathered.select(batch, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def unbatch(batches: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """The reverse of collate: rows with their place in the batch."""
    return batches.select(batch, F.posexplode(F.arrays_zip(*columns)).alias("place", "_r")).select(batch, "place", *[F.col(f"_r.{c}").alias(c) for c in columns])
