"""Matrices by domain and resampled grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear as N
from ..session import table
from .registry import query


def _coefficients(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ten matrices of 16 by 8 and their biases, from the first 80 vectors: output o of domain k is vector 8 k + o."""
    first = table(spark, d, "embeddings").where("vec_id < 80").select(F.expr("cast(vec_id div 8 as int)").alias("domain"), F.expr("vec_id % 8").alias("o"), "embedding")
    weights = first.select("domain", "o", F.posexplode(F.slice("embedding", 1, 16)).alias("i", "w"))
    return weights, first.select("domain", "o", F.col("embedding")[32].alias("b"))


_M = "WITH m AS (SELECT vec_id // 8 AS domain, vec_id % 8 AS o, embedding[1:16]::DOUBLE[] AS w, embedding[33]::DOUBLE AS b FROM embeddings WHERE vec_id < 80)"


@query(_M + " SELECT vec_id, o::INT AS o, round(list_dot_product(embedding[17:32]::DOUBLE[], w) + b, 6) AS y FROM embeddings JOIN m ON m.domain = label")
def domain_matrices(spark: SparkSession, d: str) -> DataFrame:
    """A vector times the matrix of its label, plus its bias."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 17, 16).alias("x"))
    made = N.domain_product(rows, ["vec_id"], "x", "label", *_coefficients(spark, d))
    return made.select("vec_id", F.posexplode("y").alias("o", "y")).select("vec_id", "o", F.round("y", 6).alias("y"))


@query(_M + " SELECT vec_id, t::INT AS t, round(sum((list_dot_product(embedding[17 + 16 * t:32 + 16 * t]::DOUBLE[], w) + b) * (o + 1)), 5) AS y FROM embeddings JOIN m ON m.domain = label, range(0, 2) r(t) GROUP BY vec_id, t")
def domain_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of two vectors times the matrix of their label; outputs weighed by their place."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.array(F.slice("embedding", 17, 16), F.slice("embedding", 33, 16)).alias("x"))
    made = N.domain_sequences(rows, ["vec_id"], "x", "label", *_coefficients(spark, d))
    weighed = F.aggregate(F.transform("y", lambda v, o: v * (o + 1)), F.lit(0.0), lambda a, v: a + v)
    return made.select("vec_id", F.posexplode("y").alias("t", "y")).select("vec_id", "t", F.round(weighed, 5).alias("y"))


_CUBIC = "CASE WHEN abs({0}) <= 1 THEN (1.25 * abs({0}) - 2.25) * abs({0}) * abs({0}) + 1 WHEN abs({0}) < 2 THEN -0.75 * (((abs({0}) - 5) * abs({0}) + 8) * abs({0}) - 4) ELSE 0 END"


def _resampled_sql(height: int, width: int) -> str:
    return f"""
WITH o AS (SELECT y, x, (y + 0.5::DOUBLE) * (8.0::DOUBLE / {height}) - 0.5 AS sy, (x + 0.5::DOUBLE) * (8.0::DOUBLE / {width}) - 0.5 AS sx FROM range(0, {height}) a(y), range(0, {width}) b(x)),
k AS (SELECT y, x, greatest(0, least(7, floor(sy) + i))::INT AS iy, greatest(0, least(7, floor(sx) + j))::INT AS ix, sy - floor(sy) - i AS dy, sx - floor(sx) - j AS dx FROM o, range(-1, 3) c(i), range(-1, 3) d(j)),
w AS (SELECT y, x, iy * 8 + ix + 1 AS place, ({_CUBIC.format("dy")}) * ({_CUBIC.format("dx")}) AS w FROM k)
SELECT vec_id, y, x, round(sum(embedding[place]::DOUBLE * w), 6) AS value FROM embeddings, w GROUP BY ALL"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "value"))
    return cells.select("vec_id", F.expr("place div 8").alias("y"), (F.col("place") % 8).alias("x"), "value")


@query(_resampled_sql(11, 5))
def grid_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grids of 8 by 8, made 11 high and 5 wide."""
    return N.resample(_grid(spark, d), ["vec_id"], "value", (8, 8), (11, 5)).select("vec_id", "y", "x", F.round("value", 6).alias("value"))
