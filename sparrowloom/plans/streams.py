"""Stateful streams over whole tables: all that is there is run through, then read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..session import table
from ..streaming import jobs
from ..streaming import stateful as S
from .registry import query


def _streamed(spark: SparkSession, d: str, name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made() of a table as a stream. A session of its own has the state store that it needs, so the caller's settings stay."""
    own = spark.newSession()
    own.conf.set(S.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for setting in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(setting, spark.conf.get(setting))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folders = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # A stream reads folders: of one with a file for each table it takes the table's file.
    reader = own.readStream.schema(table(spark, d, name).schema)
    rows = reader.parquet(f"{d}/{name}.parquet") if folders else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    jobs.store(made(rows), f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/rows")


_N = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(_N + ", s AS (SELECT *, min(idx) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS stop FROM e) SELECT event_id, user_id, idx AS step, idx = coalesce(stop, 19) OR idx = 19 AS ends, event_type = 'purchase' AS won FROM s WHERE idx < 20 AND (stop IS NULL OR idx <= stop)")
def stream_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that end with their first purchase or after 20 steps."""
    made = lambda e: S.rollouts(e.select("user_id", "event_id", (F.col("event_type") == "purchase").alias("done")), "user_id", "event_id", "done", 20)
    return _streamed(spark, d, "events", made).select("event_id", "user_id", "step", "ends", "won")


@query(_N + """, c AS (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE 1 + (idx - 1) // 4 END AS chunk FROM e WHERE idx <= 4 * ((n - 1) // 4))
SELECT user_id, chunk, string_agg(event_id, ' ' ORDER BY idx) AS frames,
  CASE WHEN chunk = 0 THEN '' WHEN chunk = 1 THEN (SELECT event_id::VARCHAR FROM e x WHERE x.user_id = c.user_id AND x.idx = 0)
    ELSE (SELECT string_agg(event_id, ' ' ORDER BY idx) FROM e x WHERE x.user_id = c.user_id AND x.idx IN (4 * c.chunk - 5, 4 * c.chunk - 4)) END AS cache
FROM c GROUP BY user_id, chunk""")
def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole chunks of 1, 4, 4, ... events, each with the two before it."""
    found = _streamed(spark, d, "events", lambda e: S.chunk_frames(e.withColumn("frame", F.col("event_id")), "user_id", "event_id", "frame"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return found.select("user_id", "chunk", text("frames").alias("frames"), text("cache").alias("cache"))
