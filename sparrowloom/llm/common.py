"""Helpers that the text operators share: tables, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters per Python step: bounds the words that a worker holds at once,
#: whatever the size of the Arrow batch.
CHUNK_CHARS = 1_000_000


#: Rows in a batch that goes to a Python worker: with whole texts Spark's own 10,000 take tens of MB in the JVM and in the worker.
BATCH_ROWS, _DEFAULT_ROWS = "1000", "10000"


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, in whose session batches for Python have BATCH_ROWS rows at most, unless that is set already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if conf.get(name) == _DEFAULT_ROWS:
        conf.set(name, BATCH_ROWS)
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparrowloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    The files outlive the call, since the result is read lazily; drop_cut()
    removes a table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def chunks(texts: list, size: int = CHUNK_CHARS):
    """Index ranges of texts that hold about size characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def _is_stars(edges: DataFrame) -> bool:
    """Whether no leaf u has two centres v, and no centre is a leaf."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    bad = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).agg(F.max((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("centre") > 0))).alias("bad"))
    return not bad.first().bad


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star steps until stars are left. Each round
    is a few grouped aggregations over the edges, written to the shared folder,
    so neither the edges nor the labels ever meet in one task or on the driver;
    a group only passes its minimum on.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(rounds):
        if _is_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        # Large star: every larger neighbour of u is linked to the least of u's neighbours and u.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_min.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "cc")
        drop_cut(e)
        e = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
