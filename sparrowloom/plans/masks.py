"""Masks as spans: polygons, their union by image, and its tint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks as M
from ..session import table
from .registry import query

SIDE = 24


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """Instances of two polygons each, six and four corners from a vector, five or so to an image."""
    e = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 5").alias("image"), F.transform("embedding", lambda x: x.cast("double") * 40 + SIDE / 2).alias("c"))
    parts = F.array(F.slice("c", 1, 12), F.slice("c", 13, 8))
    return e.select("vec_id", "image", F.posexplode(parts).alias("part", "corners"))


_PIXELS = f"""
WITH p AS (SELECT vec_id, vec_id // 5 AS image, part, [embedding[part * 12 + i]::DOUBLE * 40 + {SIDE / 2} FOR i IN range(1, CASE part WHEN 0 THEN 13 ELSE 9 END)] AS c FROM embeddings, range(0, 2) t(part)),
g AS (SELECT vec_id, image, part, c[2 * i + 1] AS x1, c[2 * i + 2] AS y1, c[2 * ((i + 1) % (len(c) // 2)) + 1] AS x2, c[2 * ((i + 1) % (len(c) // 2)) + 2] AS y2 FROM (SELECT *, unnest(range(0, len(c) // 2)) AS i FROM p)),
t AS (SELECT g.*, x, x + 0.5::DOUBLE AS cx FROM g, range(0, {SIDE}) r(x) WHERE (x1 <= x + 0.5 AND x + 0.5 < x2) OR (x2 <= x + 0.5 AND x + 0.5 < x1)),
k AS (SELECT vec_id, image, part, x, y, count(*) FILTER (WHERE y1 + (cx - x1) * (y2 - y1) / (x2 - x1) <= y + 0.5::DOUBLE) AS n FROM t, range(0, {SIDE}) r(y) GROUP BY ALL),
px AS (SELECT DISTINCT vec_id, image, x * {SIDE} + y AS pos FROM k WHERE n % 2 = 1)
"""


def _islands(key: str) -> str:
    return f"SELECT {key}, min(pos) AS start, max(pos) + 1 AS stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS island FROM (SELECT DISTINCT {key}, pos FROM px)) GROUP BY {key}, island"


@query(_PIXELS + _islands("vec_id"))
def polygon_spans(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of two parts as one mask for each instance."""
    spans = M.polygon_spans(_polygons(spark, d), ["vec_id", "part"], "corners", F.lit(SIDE), F.lit(SIDE))
    return M.union_spans(spans, ["vec_id"])


@query(_PIXELS + _islands("image"))
def mask_union_spans(spark: SparkSession, d: str) -> DataFrame:
    """The union of all instances of an image, over their run lengths."""
    spans = M.polygon_spans(_polygons(spark, d), ["image", "vec_id", "part"], "corners", F.lit(SIDE), F.lit(SIDE))
    runs = M.runs_of(M.union_spans(spans, ["image", "vec_id"]), ["image", "vec_id"], F.lit(SIDE * SIDE))
    return M.union_spans(M.run_spans(runs, ["image", "vec_id"], "runs"), ["image"])


@query(_PIXELS + f""", i AS (SELECT DISTINCT vec_id // 5 AS image FROM embeddings), a AS (SELECT image, pos, (pos // 30 * 40 + image) % 256 AS base, EXISTS (SELECT 1 FROM px WHERE px.image = i.image AND px.pos = r.pos) AS "on" FROM i, range(0, {SIDE * SIDE}) r(pos))
SELECT image, sum(CASE WHEN "on" THEN least(255, round_even(base + 178.5::DOUBLE, 0)) ELSE base END)::BIGINT AS red, sum(CASE WHEN "on" THEN least(255, round_even(base + 28.0::DOUBLE, 0)) ELSE base END)::BIGINT AS green, count(*) AS pixels FROM a GROUP BY image""")
def mask_tint_spans(spark: SparkSession, d: str) -> DataFrame:
    """Images of equal stretches, tinted under their instances' union; the sums of all pixels."""
    polygons = _polygons(spark, d)
    mask = M.union_spans(M.polygon_spans(polygons, ["image", "vec_id", "part"], "corners", F.lit(SIDE), F.lit(SIDE)), ["image"])
    starts = polygons.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SIDE * SIDE - 1).cast("bigint"), F.lit(30).cast("bigint"))).alias("start"))
    base = (F.expr("start div 30") * 40 + F.col("image")) % 256
    pixels = starts.select("image", "start", F.least(F.col("start") + 30, F.lit(SIDE * SIDE)).alias("stop"), base.cast("int").alias("red"), base.cast("int").alias("green"))
    tinted = M.tint_spans(pixels, mask, ["image"], ["red", "green"], [255, 40])
    size = F.col("stop") - F.col("start")
    return tinted.groupBy("image").agg(F.sum(F.col("red") * size).alias("red"), F.sum(F.col("green") * size).alias("green"), F.sum(size).alias("pixels"))
