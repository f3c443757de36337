"""Annotation ETL on orders (images), line items (annotations) and parts (categories)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..session import table
from .registry import query

PIXELS = F.col


def _named(spark: SparkSession, d: str, category: str = "p_brand") -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return A.name_categories(lines, table(spark, d, "part").select("p_partkey", category), "p_partkey")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    grouped = A.group_annotations(_named(spark, d), "l_orderkey", "p_brand", "l_quantity")
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return A.keep_categories(grouped.join(images, "l_orderkey"), F.col("o_totalprice"), 3, 0.0002)


_KEPT = """
WITH grouped AS (
  SELECT l_orderkey, p_brand, count(*) AS n_instances, sum(l_quantity) AS area_sum
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), kept AS (
  SELECT g.* FROM grouped g JOIN orders ON l_orderkey = o_orderkey
  WHERE n_instances < 3 AND area_sum / o_totalprice >= 0.0002
)
"""


@query(_KEPT + "SELECT l_orderkey, p_brand, n_instances, round(area_sum, 6) AS area_sum FROM kept")
def ann_category_filter(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("l_orderkey", "p_brand", "n_instances", F.round("area_sum", 6).alias("area_sum"))


@query(_KEPT + "SELECT l_orderkey, count(*) AS n_categories, string_agg(p_brand || '=' || n_instances, ',' ORDER BY p_brand) AS anns FROM kept GROUP BY l_orderkey")
def ann_image_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = A.image_documents(_kept(spark, d), "l_orderkey", "p_brand")
    return docs.select("l_orderkey", "n_categories", F.array_join(F.transform(F.map_entries("anns"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("anns"))


@query(_KEPT + ", paths AS (SELECT DISTINCT printf('%09d.json', l_orderkey) AS path FROM kept) SELECT 'orders' AS dataset_name, (SELECT count(*) FROM paths) AS num_images, path FROM paths")
def ann_manifest(spark: SparkSession, d: str) -> DataFrame:
    images = _kept(spark, d).select("l_orderkey").distinct()
    return A.manifest(images, "orders", F.format_string("%09d.json", "l_orderkey"))


@query("SELECT p_partkey, p_type, count(l_orderkey) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def ann_category_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return A.name_categories(lines, table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey", strict=True).groupBy("p_partkey", "p_type").agg(F.count("l_orderkey").alias("n_lines"))


@query("""
SELECT l_orderkey, l_returnflag, count(*) AS n_boxes, 0 AS any_crowd, max(CASE WHEN l_tax > 0.07 THEN 2 ELSE 1 END) AS most_polygons
FROM lineitem GROUP BY ALL HAVING count(*) <= 8 AND bool_and(l_discount <= 0.09) AND bool_and(l_tax <= 0.07)
""")
def ann_eligible_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Crowds are instances of a high discount, those of a high tax have two polygons."""
    return A.eligible_boxes(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], F.col("l_discount") > 0.09, F.when(F.col("l_tax") > 0.07, 2).otherwise(1))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount * 1000 AS y, l_quantity / 5 AS w, l_tax * 100 AS h FROM lineitem),
r AS (SELECT *, CAST(round_even(x, 0) AS INT) AS x0, CAST(round_even(y, 0) AS INT) AS y0, CAST(round_even(x + w, 0) AS INT) AS x1, CAST(round_even(y + h, 0) AS INT) AS y1 FROM c)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN x1 - x0 < 6 THEN greatest(0, x0 - 3) ELSE x0 END AS x0, CASE WHEN y1 - y0 < 6 THEN greatest(0, y0 - 3) ELSE y0 END AS y0,
  CASE WHEN x1 - x0 < 6 THEN least(50, x1 + 3) ELSE x1 END AS x1, CASE WHEN y1 - y0 < 6 THEN least(100, y1 + 3) ELSE y1 END AS y1
FROM r
""")
def ann_box_corners(spark: SparkSession, d: str) -> DataFrame:
    box = A.widen_box(F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_quantity") / 5, F.col("l_tax") * 100, F.lit(50), F.lit(100))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")
