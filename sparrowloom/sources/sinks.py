"""Sinks: per-image documents, manifests, configurations, metric logs and sharded snapshots."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import settle
from ..operators.packing import pack


def write_documents(rows: DataFrame, path: str, by: list[str] | None = None, per_file: int = 10_000) -> None:
    """JSON documents, per_file to a file, in a folder for each value of the columns by."""
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", per_file)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest's rows as JSON, in as many files as they take."""
    manifest.write.mode("overwrite").json(path)


def write_config(spark: SparkSession, settings: dict, path: str) -> None:
    """A run's resolved settings as one JSON row beside its output."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").text(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def shard_plan(parameters: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """parameters with shard: cut in order so that no shard is above most, unless it is one parameter (operators/packing)."""
    return pack(parameters, [order], size, most)


def write_snapshot(rows: DataFrame, path: str, step: int) -> str:
    """A snapshot beside others, named by its step."""
    target = f"{path}/checkpoint-{step}"
    rows.write.mode("overwrite").parquet(target)
    return target


def write_shards(parameters: DataFrame, path: str, order: str, size: str, most: int) -> DataFrame:
    """A snapshot in shards of at most `most` by size, and its index: (name, file) for each row, as JSON under index.

    One job writes all shards, a task for each; their numbers are in the names.
    What an earlier snapshot left in the folder goes.
    """
    planned = settle(shard_plan(parameters, order, size, most))
    count = planned.agg(F.coalesce(F.max("shard") + 1, F.lit(0)).cast("bigint").alias("_count"))
    named = planned.join(F.broadcast(count)).withColumn("file", F.format_string("model-%05d-of-%05d", F.col("shard") + 1, "_count"))
    named.drop("shard", "_count").repartition("file").write.mode("overwrite").partitionBy("file").parquet(path)
    index = named.select(order, F.concat(F.lit("file="), F.col("file")).alias("file"))
    index.write.mode("overwrite").json(f"{path}/index")
    return index


def write_run(rows: DataFrame, path: str, step: int, limit: int | None = None) -> str:
    """A snapshot with metadata.json's content (its step) under metadata; of a run's snapshots the newest `limit` stay."""
    target = write_snapshot(rows, path, step)
    write_config(rows.sparkSession, {"global_step": step}, f"{target}/metadata")
    if limit:
        own = sorted((int(m[1]) for n in _names(rows.sparkSession, path) if (m := re.fullmatch(r"checkpoint-(\d+)", n))), reverse=True)
        _remove(rows.sparkSession, path, lambda found: (m := re.fullmatch(r"checkpoint-(\d+)", found)) and int(m[1]) in own[limit:])
    return target


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, system = _folder(spark, path)
    return [f.getPath().getName() for f in system.listStatus(at)]


def _remove(spark: SparkSession, path: str, which) -> None:
    """Remove what lies in a folder by name, through the file system of the path."""
    at, system = _folder(spark, path)
    for name in _names(spark, path):
        if which(name):
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(at, name), True)
