"""Products with matrices that a row's domain picks, and separable resampling of grids.

domain_product: y = x W[domain] + b[domain]. Coefficients are rows (domain, i, o, w), so no
matrix must fit in one value. They are put in blocks of inputs and outputs; a vector
meets the blocks of its domain one input block at a time, and partial outputs are summed where
they are made before they are shuffled. Blocks are broadcast only where there are few
coefficients (counted); else a domain's blocks are dealt in SALTS copies, so that a domain with a
third of all rows is spread.

resample: a grid's new positions along an axis are weighted sums of old ones; the
weights are a sparse table of at most four rows for each new position, joined
to the grid once for each axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs and outputs of a block; coefficients that may be broadcast; copies of a domain's blocks beyond that.
INPUTS, OUTPUTS, BROADCAST_ROWS, SALTS = 256, 32, 1_000_000, 32


def _blocks(weights: DataFrame, bias: DataFrame | None) -> DataFrame:
    """(w_domain, ib, ob, n_out, columns): for each output of a block its (input, weight) pairs; the bias is the weight of an input that is always 1."""
    rows = weights.select("domain", (F.col("i") + 1).cast("bigint").alias("i"), F.col("o").cast("bigint").alias("o"), F.col("w").cast("double").alias("w"))
    if bias is not None:
        rows = rows.unionByName(bias.select("domain", F.lit(0).cast("bigint").alias("i"), F.col("o").cast("bigint").alias("o"), F.col("b").cast("double").alias("w")))
    sizes = rows.groupBy("domain").agg((F.max("o") + 1).alias("n_out")).withColumnRenamed("domain", "s_domain")
    columns = rows.groupBy("domain", F.expr(f"i div {INPUTS}").alias("ib"), "o").agg(F.collect_list(F.struct((F.col("i") % INPUTS).cast("int").alias("i"), "w")).alias("column"))
    blocks = columns.groupBy("domain", "ib", F.expr(f"o div {OUTPUTS}").alias("ob")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("o") % OUTPUTS).cast("int"), "column"))).alias("own"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(OUTPUTS - 1)), lambda j: F.element_at("own", j))
    return blocks.join(sizes, F.expr("domain <=> s_domain")).select(F.col("domain").alias("w_domain"), "ib", "ob", "n_out", dense.alias("columns"))


def domain_product(rows: DataFrame, keys: list[str], x: str, domain: str, weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """(keys, y): x W + b, W and b those of the row's domain; keys must name a row.

    weights: (domain, i, o, w), bias: (domain, o, b), both from 0; a missing coefficient is 0, numbers of x beyond
    the inputs don't count. y is null where x is null or the domain has no coefficients.
    """
    blocks = _blocks(weights, bias)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"size(_x) div {INPUTS}")), lambda b: F.slice("_x", b * INPUTS + 1, F.lit(INPUTS)))
    own = rows.select(*keys, F.col(domain).alias("_domain"), F.concat(F.array(F.lit(1.0)), F.transform(x, lambda v: v.cast("double"))).alias("_x"))
    pieces = own.select(*keys, "_domain", F.posexplode_outer(cut).alias("_ib", "_piece"))
    if weights.count() <= BROADCAST_ROWS:
        met = pieces.join(F.broadcast(blocks), F.expr("_domain <=> w_domain and _ib = ib"), "left")
    else:
        dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
        copies = blocks.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(copies, F.expr("_domain <=> w_domain and _ib = ib and _salt = w_salt"), "left")
    dots = F.transform("columns", lambda c: F.aggregate(c, F.lit(0.0), lambda a, p: a + p["w"] * F.coalesce(F.get("_piece", p["i"]), F.lit(0.0))))
    partial = met.withColumn("_y", dots)
    summed = partial.groupBy(*keys, "ob").agg(F.max("n_out").alias("n_out"), *[F.sum(F.get("_y", F.lit(j))).alias(f"_y{j}") for j in range(OUTPUTS)])
    part = F.slice(F.array(*[F.coalesce(f"_y{j}", F.lit(0.0)) for j in range(OUTPUTS)]), F.lit(1), F.least(F.col("n_out") - F.col("ob") * OUTPUTS, F.lit(OUTPUTS)).cast("int"))
    lined = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("ob").isNotNull(), F.struct("ob", part.alias("part"))))).alias("_parts"))
    return lined.select(*keys, F.when(F.size("_parts") > 0, F.flatten("_parts.part")).alias("y"))


def domain_sequences(rows: DataFrame, keys: list[str], x: str, domain: str, weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """domain_product() of each vector of a list of them: (keys, y), y a list in the same order (null where x is null)."""
    each = rows.select(*keys, F.col(domain).alias("_d"), F.posexplode_outer(x).alias("_t", "_v"))
    made = domain_product(each, [*keys, "_t"], "_v", "_d", weights, bias)
    listed = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "y")))).alias("_ys"))
    known = rows.select(*keys, F.col(x).isNotNull().alias("_known"))
    joined = listed.join(known, [listed[k].eqNullSafe(known[k]) for k in keys])
    return joined.select(*[listed[k] for k in keys], F.when(F.col("_known"), F.col("_ys.y")).alias("y"))


def cubic(distance: Column, a: float = -0.75) -> Column:
    """Keys' kernel: the weight of a point at a distance below 2."""
    d = F.abs(distance)
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    far = ((d - 5) * d + 8) * d * a - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def axis_weights(spark: SparkSession, old: int, new: int, a: float = -0.75) -> DataFrame:
    """(out, in, weight): the four nearest old positions of each new one, those beyond the edge at the edge; middles keep their relative place."""
    source = (F.col("out") + 0.5) * (old / new) - 0.5
    taps = spark.range(new).withColumnRenamed("id", "out").select("out", source.alias("at"), F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1, 2)])).alias("tap"))
    place = F.floor("at") + F.col("tap")
    kept = taps.select("out", F.greatest(F.lit(0), F.least(F.lit(old - 1), place)).cast("bigint").alias("in"), cubic(F.col("at") - place, a).alias("weight"))
    return kept.groupBy("out", "in").agg(F.sum("weight").alias("weight"))


def resample(grid: DataFrame, keys: list[str], value: str, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """(keys, y, x, value): grids of rows (keys, y, x, value), of old (height, width), resampled bicubically to new ones.

    keys name a grid (and a channel); positions without a row count as 0.
    """
    spark = grid.sparkSession
    out = grid.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col(value).cast("double").alias("value"))
    for axis, before, after in (("x", old[1], new[1]), ("y", old[0], new[0])):
        taps = axis_weights(spark, before, after)
        other = "y" if axis == "x" else "x"
        # At most four rows for each new position.
        met = out.join(F.broadcast(taps), F.col(axis) == F.col("in"))
        out = met.groupBy(*keys, other, F.col("out").alias("_new")).agg(F.sum(F.col("value") * F.col("weight")).alias("value")).withColumnRenamed("_new", axis)
    return out.select(*keys, "y", "x", F.col("value").alias(value))
