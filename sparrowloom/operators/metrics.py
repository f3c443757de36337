"""Losses, meters and rates as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as V

# Fixed values of the action loss: dimensions of the two arms and the weights of position and rotation.
POSITION = (0, 1, 2, 10, 11, 12)
ROTATION = (3, 4, 5, 6, 7, 8, 13, 14, 15, 16, 17, 18)
GRIPPER = (9, 19)
POSITION_SCALE, ROTATION_SCALE = 500.0, 10.0


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """The mean of value by weight, the last value, and the weight, for each key."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("avg"), F.max_by(value, order).alias("val"), F.sum(weight).alias("count"))


def running_mean(value: str, weight: str, keys: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w)


def success_rates(episodes: DataFrame, suite: str, task: str, success: str) -> DataFrame:
    """Rates by suite and task, by suite, and over all, in one pass of grouping sets."""
    return episodes.rollup(suite, task).agg(F.count("*").alias("episodes"), F.sum(success).cast("bigint").alias("successes"), (F.sum(success) / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def masked_mse(prediction: Column, target: Column, mask: Column) -> Column:
    return F.avg(F.when(mask, (prediction - target) * (prediction - target)))


def action_loss_terms(prediction: Column, target: Column) -> Column:
    """Position, rotation and gripper terms of one row's 20 dimensions."""
    square = lambda dims: sum(((F.get(prediction, F.lit(i)) - F.get(target, F.lit(i))) * (F.get(prediction, F.lit(i)) - F.get(target, F.lit(i))) for i in dims), F.lit(0.0)) / len(dims)
    grip = sum((bce_with_logits(F.get(prediction, F.lit(i)), F.get(target, F.lit(i))) for i in GRIPPER), F.lit(0.0)) / len(GRIPPER)
    return F.struct((square(POSITION) * POSITION_SCALE).alias("position"), (square(ROTATION) * ROTATION_SCALE).alias("rotation"), grip.alias("gripper"))


def cosine_distillation(a: Column, b: Column) -> Column:
    similarity = V.dot(a, b) / (V.norm(a) * V.norm(b))
    return -F.log(F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), similarity)))


def prior_log_density(z: Column) -> Column:
    return F.lit(-0.5 * 1.8378770664093453) * F.size(z) - V.dot(z, z) / 2


def mean_over_ranks(local: DataFrame, rank: str, value: str) -> DataFrame:
    """The mean of the ranks' means: for ranks of equal size that of all."""
    return local.groupBy(rank).agg(F.avg(value).alias("mean")).agg(F.avg("mean").alias("mean"))


def weighted_loss(flow: Column, terms: list[Column], flow_weight: float, action_weight: float) -> Column:
    return flow * flow_weight + sum(terms[1:], terms[0]) * action_weight


def balance_loss(routed: DataFrame, experts: int, k: int, used: Column | None = None) -> DataFrame:
    """sum over expert of (share of tokens sent) * (mean probability) * experts; routed has probs and picks arrays.

    used: which tokens count; padding does not.
    """
    routed = routed if used is None else routed.where(used)
    n = routed.agg(F.count("*").alias("n"))
    sent = routed.select(F.explode("picks").alias("expert")).groupBy("expert").agg(F.count("*").alias("sent"))
    mean = routed.select(F.posexplode("probs").alias("expert", "p")).groupBy("expert").agg(F.avg("p").alias("p"))
    # n is one row; sent and mean have a row for each expert.
    return mean.join(sent, "expert", "left").join(F.broadcast(n)).agg((F.sum(F.coalesce("sent", F.lit(0)) / F.col("n") * F.col("p")) * experts).alias("loss"))
