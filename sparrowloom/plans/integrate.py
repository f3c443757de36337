"""Adaptive integration of flows and likelihoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import integrate as I
from ..session import table
from .registry import query


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.doubles(F.slice("embedding", 1, 8)).alias("x"))


def _pulled(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Towards 0 at a rate that grows with time and with the place in the vector."""
    return -(1 + np.arange(x.shape[1])) * t[:, None] * x


@query("SELECT vec_id, round(list_sum([embedding[i]::DOUBLE * exp(-i / 2.0) * i FOR i IN range(1, 9)]), 5) AS total, true AS finished, true AS adapted FROM embeddings")
def flow_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Vectors carried from time 0 to 1; the closed form is x exp(-i / 2)."""
    ends = I.adaptive_ode(_vectors(spark, d), "x", _pulled, rtol=1e-10, atol=1e-12)
    weighed = V.total(F.transform("end", lambda v, i: v * (i + 1)))
    return ends.select("vec_id", F.round(weighed, 5).alias("total"), "finished", (F.col("taken") > 5).alias("adapted"))


@query("WITH v AS (SELECT vec_id, [embedding[i]::DOUBLE * exp(i / 2.0) FOR i IN range(1, 9)] AS z FROM embeddings) SELECT vec_id, round(-0.5 * list_sum([x * x FOR x IN z]) - 4 * ln(2 * pi()) + 18.0, 3) AS logp FROM v")
def flow_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """The likelihood of data that this flow makes of noise: the noise is x exp(i / 2), the divergence's integral -18."""
    found = I.flow_likelihood(_vectors(spark, d), "x", "vec_id", _pulled, rtol=1e-9, atol=1e-11)
    return found.select("vec_id", F.round("logp", 3).alias("logp"))
