"""A weighted endless mix that starts anywhere: rank and select over hash blocks.

Step n of the mix draws a loader by weight (a hash of n); a loader's k-th draw
is row k % size of its epoch k // size. Each epoch has an order of its own: the
blocks of a loader (rows dealt by a hash of their key) are permuted, and so are the rows
of each block. Two small indexes, saved with the mix, replace replaying:

* rank: for every STRETCH steps, how often each loader was drawn before;
* select: how many rows each block of a loader has, so that a place of an epoch
  gives its block and the place in it.

To go on at step n, at most STRETCH draws are made again, and only blocks in
which wanted rows lie are read (partition columns of the stored rows). Rank r of w workers takes
the steps r, r + w, r + 2w, ...; its state is one number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .mixing import pick_loader

STRETCH = 65_536
BLOCKS = 256


@dataclass(frozen=True)
class Mix:
    """rows: (loader, block, key, ...); index: (loader, block, n); drawn: (stretch, loader, before), as far as it is saved."""

    rows: DataFrame
    index: DataFrame
    weights: dict[str, float]
    key: str
    salt: str
    drawn: DataFrame | None = None
    stretches: int = 0


def block_of(key: Column, blocks: int = BLOCKS) -> Column:
    return F.floor(uniform(key, "block") * blocks).cast("int")


def mix_of(rows: DataFrame, loader: str, key: str, weights: dict[str, float], salt: str, blocks: int = BLOCKS) -> Mix:
    """A mix of rows whose column loader names their loader; loaders without a weight are left out."""
    own = rows.withColumnRenamed(loader, "loader").where(F.col("loader").isin(*weights)).withColumn("block", block_of(F.col(key), blocks))
    return Mix(own, own.groupBy("loader", "block").agg(F.count("*").alias("n")), weights, key, salt)


def count_draws(mix: Mix, stretches: int) -> DataFrame:
    """(stretch, loader, before) for stretches 0 to `stretches`, going on from those that are saved."""
    spark = mix.rows.sparkSession
    if stretches < mix.stretches:
        return mix.drawn
    steps = spark.range(mix.stretches * STRETCH, stretches * STRETCH).select((F.expr(f"id div {STRETCH}") + 1).alias("stretch"), pick_loader(F.col("id"), mix.weights, mix.salt).alias("loader"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, mix.weights))).alias("loader"))
    spine = spark.range(mix.stretches, stretches + 1).withColumnRenamed("id", "stretch").join(F.broadcast(names))
    own = spine.join(steps.groupBy("stretch", "loader").agg(F.count("*").alias("n")), ["stretch", "loader"], "left")
    # A row for each STRETCH steps and loader.
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("loader").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    new = own.select("stretch", "loader", so_far.alias("before"))
    if mix.drawn is None:
        return new
    last = mix.drawn.where(F.col("stretch") == mix.stretches).select("loader", F.col("before").alias("base"))
    grown = new.where(F.col("stretch") > mix.stretches).join(F.broadcast(last), "loader").select("stretch", "loader", (F.col("before") + F.col("base")).alias("before"))
    return mix.drawn.unionByName(grown)


def draws(mix: Mix, rank: int, world: int, first: int, count: int) -> DataFrame:
    """(step, loader, epoch, block, offset) of the steps first, ..., first + count - 1 of a rank: step counts over all ranks."""
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} of {world}")
    spark = mix.rows.sparkSession
    begin, end = first * world + rank, max(first * world + rank, (first + count - 1) * world + rank + 1 if count else 0)
    stretch = begin // STRETCH
    steps = spark.range(stretch * STRETCH, end).select(F.col("id").alias("step"), F.expr(f"id div {STRETCH}").alias("stretch"), pick_loader(F.col("id"), mix.weights, mix.salt).alias("loader"))
    before = count_draws(mix, end // STRETCH).where(F.col("stretch") >= stretch)
    inside = F.row_number().over(Window.partitionBy("stretch", "loader").orderBy("step")) - 1
    numbered = steps.withColumn("inside", inside).join(F.broadcast(before), ["stretch", "loader"]).where((F.col("step") >= begin) & (F.pmod("step", F.lit(world)) == rank))
    sizes = mix.index.groupBy("loader").agg(F.sum("n").alias("size"))
    draw = F.col("before") + F.col("inside")
    drawn = numbered.join(F.broadcast(sizes), "loader").select("step", "loader", F.expr("(before + inside) div size").alias("epoch"), F.pmod(draw, F.col("size")).alias("place"))
    # BLOCKS rows for each loader and epoch that the steps touch, as one array.
    touched = drawn.select("loader", "epoch").distinct().join(mix.index, "loader")
    turn = Window.partitionBy("loader", "epoch").orderBy(uniform(F.concat_ws(":", "loader", "block", "epoch"), mix.salt), "block")
    starts = touched.withColumn("start", F.coalesce(F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lists = starts.groupBy("loader", "epoch").agg(F.array_sort(F.collect_list(F.struct("start", "block"))).alias("starts"))
    found = drawn.join(lists, ["loader", "epoch"]).withColumn("at", F.get("starts", F.size(F.filter("starts", lambda s: s["start"] <= F.col("place"))) - 1))
    return found.select("step", "loader", "epoch", F.col("at.block").alias("block"), (F.col("place") - F.col("at.start")).alias("offset"))


def read_from(mix: Mix, rank: int, world: int, first: int, count: int) -> DataFrame:
    """The rows that a rank's steps first, ..., first + count - 1 take: (step, epoch, loader, ...)."""
    wanted = draws(mix, rank, world, first, count)
    # At most BLOCKS numbers for each loader.
    needed = wanted.groupBy("loader").agg(F.collect_set("block").alias("blocks")).collect()
    pruned = F.lit(False)
    for r in needed:
        pruned = pruned | ((F.col("loader") == r.loader) & F.col("block").isin(*sorted(r.blocks)))
    epochs = wanted.select("loader", "block", "epoch").distinct()
    order = Window.partitionBy("loader", "block", "epoch").orderBy(uniform(F.concat_ws(":", F.col(mix.key), F.col("epoch")), mix.salt), mix.key)
    placed = mix.rows.where(pruned).join(epochs, ["loader", "block"]).withColumn("offset", (F.row_number().over(order) - 1).cast("bigint"))
    return wanted.join(placed, ["loader", "block", "epoch", "offset"]).drop("block", "offset")


def save_mix(mix: Mix, path: str, stretches: int = 1) -> Mix:
    """The mix with its indexes under path, rows in a folder for each loader and block."""
    spark = mix.rows.sparkSession
    mix.rows.repartition("loader", "block").write.mode("errorifexists").partitionBy("loader", "block").parquet(f"{path}/rows")
    mix.index.write.parquet(f"{path}/index")
    count_draws(mix, stretches).write.parquet(f"{path}/drawn")
    settings = {"weights": mix.weights, "key": mix.key, "salt": mix.salt, "stretches": stretches}
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.text(f"{path}/settings")
    return load_mix(spark, path)


def load_mix(spark: SparkSession, path: str) -> Mix:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    # Partition columns come back as text or numbers by their looks.
    rows = read("rows")
    rows = rows.withColumn("loader", F.col("loader").cast("string")) if dict(rows.dtypes)["loader"] != "string" else rows
    return replace(Mix(rows, read("index"), settings["weights"], settings["key"], settings["salt"]), drawn=read("drawn"), stretches=settings["stretches"])


def save_state(spark: SparkSession, path: str, rank: int, world: int, step: int) -> None:
    """Where a rank is to go on, beside those of other ranks."""
    spark.createDataFrame([(json.dumps({"rank": rank, "world": world, "step": step}),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/loader_{rank}")


def load_state(spark: SparkSession, path: str, rank: int) -> dict:
    return json.loads(spark.read.text(f"{path}/loader_{rank}").first()[0])
