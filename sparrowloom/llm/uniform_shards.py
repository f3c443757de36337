"""Sharding: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniform random permutation of n rows, how many rows of each part of the
input come to each shard is a random matrix whose margins are fixed: the parts'
counts and the shards' sizes. Drawing that matrix first lets every part be
permuted and dealt on its own, with exact shard sizes and no global sort:

1. Rows get numbers (partition and place), written once to the shared folder.
   Stretches of 2^BLOCK_BITS numbers are the parts (blocks).
2. The matrix is drawn in two levels. The driver draws how many rows of each
   group of blocks (1,024 partitions) go to each shard; then a task for each group draws
   the same for its blocks, from the group's own seed. Each draw is a multivariate hypergeometric
   one, shard by shard, from what is left: exact counts, whatever the sizes.
3. A block's rows are permuted by a hash; the first go to shard 0, the next to
   shard 1, as its row of the matrix says.
4. Each shard's rows are permuted by another hash, numbered in two levels so that
   a shard never meets in one task.

The law is `rows`: shard sizes are at most one apart. Equal texts are rows like any
others and spread over the shards. Draws depend on the seed and on the
numbers, so lost tasks and reruns over the same splits give the same shards;
other splits (another spark.sql.files.maxPartitionBytes) give another permutation.

Defined results: a null text has size 8 and the checksum of no bytes, as an
empty one; null and repeated doc_ids are rows like any others; fewer rows than
shards leave the last shards empty; an empty table gives no rows; long texts are
only measured; further columns are ignored, and kept by write_shards() but for those named
shard and slot, which it sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.mixing import shuffled
from .common import cut, drop_cut, table

SHARDS, SEED = 24, 20_240_229
#: Rows (as a power of two) of a block; bits of a row's number that tell its group (partitions have 33 bits of places).
BLOCK_BITS, GROUP_BITS = 16, 43


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are among the good ones.

    By inversion over the counts within 40 deviations of the mode, from the ratios of
    neighbouring probabilities, for populations of any size.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = int(40 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 60
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), last - first)


def deal(rng: np.random.Generator, counts: list[int], sizes: list[int]) -> list[list[int]]:
    """The matrix of parts (counts) by shards (sizes), with those margins, as a uniform permutation has it."""
    left, rest, out = list(sizes), sum(sizes), []
    for n in counts:
        row, open_, pool = [], n, rest
        for size in left:
            got = hypergeometric(rng, size, pool - size, open_)
            row.append(got)
            open_ -= got
            pool -= size
        out.append(row)
        left = [a - b for a, b in zip(left, row, strict=True)]
        rest -= n
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def block_dealer(by_group: dict[int, list[int]], seed: int) -> Callable:
    """(group, blocks of (block, n)) to (block, upto): upto is the running sum of the block's row of the matrix."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, bounds = [], []
            for group, own in zip(batch.column("group").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                rows = deal(np.random.default_rng([seed, 1, group]), [b["n"] for b in own], by_group[group])
                blocks += [b["block"] for b in own]
                bounds += [np.cumsum(r).tolist() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(bounds, pa.list_(pa.int64()))], names=["block", "upto"])

    return draw


def matrix(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(block, upto) for the blocks of rows (row_id)."""
    counts = rows.groupBy(F.shiftright("row_id", BLOCK_BITS).alias("block")).agg(F.count("*").alias("n")).withColumn("group", F.shiftright("block", GROUP_BITS - BLOCK_BITS))
    # A row for each 1,024 partitions of the input.
    groups = sorted((r.group, r.n) for r in counts.groupBy("group").agg(F.sum("n").alias("n")).collect())
    drawn = deal(np.random.default_rng([seed, 0]), [n for _, n in groups], shard_sizes(sum(n for _, n in groups), shards))
    by_group = {g: row for (g, _), row in zip(groups, drawn, strict=True)}
    whole = counts.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks"))
    return whole.mapInArrow(block_dealer(by_group, seed), "block bigint, upto array<bigint>")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id, in the shared folder: numbers stay the same for all that read them."""
    return cut(docs.withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def place(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows (row_id, ...) with shard and slot."""
    bounds = matrix(rows, shards, seed)
    order = F.xxhash64(F.lit(seed), F.lit("block"), "row_id")
    local = Window.partitionBy("block").orderBy(order, "row_id")
    dealt = rows.withColumn("block", F.shiftright("row_id", BLOCK_BITS)).withColumn("place", F.row_number().over(local)).join(bounds, "block")
    shard = F.size(F.filter("upto", lambda b: b < F.col("place")))
    return shuffled(dealt.withColumn("shard", shard.cast("int")).drop("block", "place", "upto"), ["shard"], "row_id", f"slots {seed}").withColumnRenamed("ordinal", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """docs as Parquet in path/shard=N, files in order of slot; each shard has its rows' exact number."""
    packed = numbered(docs.select(F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("row")))
    placed = place(packed.select("row_id"), shards, seed)
    whole = packed.join(placed, "row_id").select("shard", "slot", "row.*")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop_cut(packed)


def op13_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"))
    return place(numbered(slim)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
