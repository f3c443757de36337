"""Annotation ETL: grouped annotations of images, filtered by category, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the category filter and of box eligibility.
MAX_INSTANCES = 8
MIN_AREA_RATIO = 0.0043
MAX_BOXES = 8
MIN_BOX, BOX_PAD = 6, 3


def name_categories(annotations: DataFrame, categories: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Inner lookup of category names; strict raises on an unknown category instead of dropping it.

    Spark picks the join from the categories' size.
    """
    if not strict:
        return annotations.join(categories, key)
    known = categories.withColumn("_known", F.lit(True))
    joined = annotations.join(known, key, "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")
    return joined.where(checked).drop("_known")


def group_annotations(annotations: DataFrame, image: str, category: str, area: str) -> DataFrame:
    """COUNT and SUM(area) of each image's categories, in one aggregation with partial sums."""
    return annotations.groupBy(image, category).agg(F.count("*").alias("n_instances"), F.sum(area).alias("area_sum"))


def keep_categories(grouped: DataFrame, pixels: Column, max_instances: int = MAX_INSTANCES, min_ratio: float = MIN_AREA_RATIO) -> DataFrame:
    """Categories with fewer than max_instances instances that cover at least min_ratio of the image."""
    return grouped.where((F.col("n_instances") < max_instances) & (F.col("area_sum") / pixels >= min_ratio))


def image_documents(kept: DataFrame, image: str, category: str) -> DataFrame:
    """One row for each image that has a surviving category, its categories as a map."""
    return kept.groupBy(image).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category), F.col("n_instances"))))).alias("anns"), F.count("*").alias("n_categories"))


def manifest(images: DataFrame, dataset: str, path: Column) -> DataFrame:
    """(dataset_name, num_images, path): a row for each image, with the count that all share."""
    count = images.agg(F.count("*").alias("num_images"))
    return images.select(path.alias("path")).join(F.broadcast(count)).select(F.lit(dataset).alias("dataset_name"), "num_images", "path")


def manifest_row(images: DataFrame, dataset: str, path: Column, most: int = 1_000_000) -> DataFrame:
    """One row with the sorted list of all paths, for sets of at most `most` images; a larger one fails."""
    listed = F.array_sort(F.collect_list("path"))
    counted = manifest(images, dataset, path).groupBy("dataset_name", "num_images")
    checked = counted.agg(listed.alias("datalist")) if images.limit(most + 1).count() <= most else None
    if checked is None:
        raise ValueError(f"more than {most} images: write the manifest as rows")
    return checked


def widen_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Integer corners of an xywh box; a side below MIN_BOX is widened by BOX_PAD each way and clamped to the image."""
    x0, y0, x1, y1 = (F.bround(v).cast("int") for v in (x, y, x + w, y + h))
    thin, low = (x1 - x0) < MIN_BOX, (y1 - y0) < MIN_BOX
    return F.struct(
        F.when(thin, F.greatest(F.lit(0), x0 - BOX_PAD)).otherwise(x0).alias("x0"),
        F.when(low, F.greatest(F.lit(0), y0 - BOX_PAD)).otherwise(y0).alias("y0"),
        F.when(thin, F.least(width.cast("int"), x1 + BOX_PAD)).otherwise(x1).alias("x1"),
        F.when(low, F.least(height.cast("int"), y1 + BOX_PAD)).otherwise(y1).alias("y1"),
    )


def eligible_boxes(annotations: DataFrame, keys: list[str], crowd: Column, polygons: Column) -> DataFrame:
    """Groups without a crowd instance, each instance of one polygon at most, and MAX_BOXES instances at most."""
    return annotations.groupBy(*keys).agg(F.count("*").alias("n_boxes"), F.max(crowd.cast("int")).alias("any_crowd"), F.max(polygons).alias("most_polygons")).where(f"any_crowd = 0 and most_polygons <= 1 and n_boxes <= {MAX_BOXES}")
