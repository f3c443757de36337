"""Shards of limited size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packing import pack
from ..session import table
from .registry import query


@query("""
WITH RECURSIVE p AS (SELECT p_partkey, p_brand, p_size * p_size AS size, row_number() OVER (ORDER BY p_brand, p_partkey) AS ordinal FROM part),
small AS (SELECT *, sum(size) OVER (ORDER BY ordinal) AS upto FROM p WHERE size <= 2000),
starts AS (
  SELECT 0 AS k, min(ordinal) AS ordinal, 0::HUGEINT AS before FROM small
  UNION ALL
  SELECT k + 1, min(m.ordinal), min(m.upto - m.size) FROM starts s JOIN small m ON m.upto > s.before + 2000 GROUP BY k
), shards AS (
  SELECT k, coalesce(lead(ordinal) OVER (ORDER BY k), 9223372036854775807) AS close FROM starts
  UNION ALL SELECT NULL, ordinal FROM p WHERE size > 2000
), named AS (SELECT *, row_number() OVER (ORDER BY close) - 1 AS shard FROM shards),
own AS (
  SELECT m.p_partkey, m.size, (SELECT max(k) FROM starts s WHERE s.ordinal <= m.ordinal) AS k, NULL::BIGINT AS close FROM small m
  UNION ALL SELECT p_partkey, size, NULL, ordinal FROM p WHERE size > 2000
)
SELECT p_partkey, size::BIGINT AS size, shard FROM own JOIN named n ON own.k = n.k OR own.close = n.close AND n.k IS NULL
""")
def shards_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Parts in order of brand, cut into shards of at most 2,000 by size; some are larger and stand alone."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * F.col("p_size")).cast("bigint").alias("size"))
    return pack(rows, ["p_brand", "p_partkey"], "size", 2000).select("p_partkey", "size", "shard")
