"""Mixing sources to target weights by weighted fair queueing.

Each source has a target number of words. Its documents are shuffled by a hash
of their ids and queue up, twice over (the second time in another order): a
document's virtual finish time is the words of its source up to its own end,
divided by the source's target. All queues are sorted by finish time into one,
and the queue is cut where the words taken reach the total budget, so sources
run out in step with their targets.

Targets share BUDGET times all words by weight; none may exceed PASSES times the
source's words, and what that frees goes to the others by weight (water
filling, solved exactly over the sources, sorted by the level at which each one
fills up).

Running sums are two-level everywhere: documents are dealt to BLOCKS hash blocks
of each source's queue, and all entries to slots of finish time; block and slot
totals are summed first, then only entries of one block are summed in order, so
a source with a third of all rows is spread over many tasks. Texts are only
read for their sizes; the sums run on slim rows.

Defined results: a null or empty text has size 0 and is never taken for more
than 0 words; a long text is one entry like any other, and the one that the
budget ends in is left out whole; a null source is a source, last in order; documents of equal id
and size are taken in turn, each on its own; reruns agree, since order comes
from hashes of ids; an empty table gives an empty one; further columns are
ignored (kept as they are by mix()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
PASSES = 2
#: Hex digits of the hash that make a block of a source's queue: 16^3 blocks.
BLOCK_DIGITS = 3
SLOTS = 65536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources fill up in order of passes * size / weight. With the first k full,
    the others' level is (budget - their caps) / their weights; the level is
    right for the first k whose next source it does not fill.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.lit(float(passes)) * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", "place")
    every = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = capped.withColumn("own_level", level).withColumn("level", F.min(F.when(F.col("own_level") <= F.col("fills_at"), F.struct(F.col("fills_at"), F.col("place"), F.col("own_level").alias("value")))).over(every)["value"])
    return leveled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def queue(sized: DataFrame, passes: int = PASSES) -> DataFrame:
    """(doc_id, source, source_size, target, size, pass, finish) from (doc_id, source, size): the queue entries of all sources."""
    by_source = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    entries = sized.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    entries = entries.withColumn("place", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("pass").cast("string"), F.lit("fair-mix"))))
    entries = entries.withColumn("block", F.substring("place", 1, BLOCK_DIGITS))
    blocks = entries.groupBy("source", "pass", "block").agg(F.sum("size").alias("block_size"))
    offsets = blocks.select(
        F.col("source").alias("o_source"),
        F.col("pass").alias("o_pass"),
        F.col("block").alias("o_block"),
        F.coalesce(F.sum("block_size").over(Window.partitionBy("source").orderBy("pass", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    aims = targets(by_source).select(F.col("source").alias("t_source"), "source_size", "target")
    offsets = offsets.join(aims, F.expr("o_source <=> t_source")).drop("t_source")
    # The block is part of every key, so a large source is spread over its blocks.
    placed = entries.join(offsets, F.expr("block = o_block and pass = o_pass and source <=> o_source"))
    within = Window.partitionBy("block", "pass", "source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("ahead") + F.sum("size").over(within)
    return placed.withColumn("finish", F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.when(done > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))).select("doc_id", "source", "source_size", "target", "size", "pass", "place", "finish")


def take(entries: DataFrame, budget: float = BUDGET) -> DataFrame:
    """entries with taken: true up to where the global order by finish time reaches the budget of words."""
    # A finish time at most 2 * passes / budget matters; slots are equal stretches of it, the last one is open.
    slotted = entries.withColumn("slot", F.least(F.lit(SLOTS - 1), F.floor(F.least(F.col("finish"), F.lit(4.0)) * (SLOTS / 4))))
    totals = slotted.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    total = slotted.where("pass = 0").agg(F.sum("size").alias("all_size"))
    # At most SLOTS rows.
    ahead = totals.select("slot", F.coalesce(F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "slot_size").join(F.broadcast(total))
    limit = budget * F.col("all_size")
    whole = ahead.withColumn("state", F.when(F.col("before") + F.col("slot_size") <= limit, 1).when(F.col("before") >= limit, -1).otherwise(0))
    joined = slotted.join(F.broadcast(whole), "slot")
    # Only the slot that the budget ends in is summed entry by entry.
    edge = joined.where("state = 0").withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "place", "doc_id", "size", "source").rowsBetween(Window.unboundedPreceding, 0)))
    columns = [*entries.columns]
    return joined.where("state <> 0").select(*columns, (F.col("state") == 1).alias("taken")).unionByName(edge.select(*columns, (F.col("upto") <= limit).alias("taken")))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The taken or left entries of all documents (PASSES rows for each)."""
    return take(queue(cut(sizes(docs), "sizes")))


def mix(docs: DataFrame) -> DataFrame:
    """The mix: a row of docs with a further column epoch (in place of one of that name) for each time that a document is taken.

    Documents taken on some pass are looked up by id, once, with all their
    passes; rows that repeat an id are told apart by their sizes and counted
    off in order.
    """
    wins = cut(mixed(docs).where("taken").select("doc_id", "source", "size", "pass", "finish"), "mix")
    order = Window.partitionBy("doc_id", "source", "size", "pass").orderBy("finish")
    numbered = wins.withColumn("copy", F.row_number().over(order)).groupBy("doc_id", "source", "size", "copy").agg(F.sort_array(F.collect_list("pass")).alias("epochs"))
    # Plain keys without nulls, so that texts are shuffled once for both the counting off and the join.
    key = lambda i, source, size: (F.xxhash64(i, source, size), F.coalesce(i, F.lit(0)))
    k1, k2 = key(F.col("doc_id"), F.col("source"), F.col("size"))
    lists = numbered.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.array_sort(F.collect_list(F.struct("copy", "epochs"))).alias("copies"))
    d1, d2 = key(F.col("doc_id").cast("bigint"), F.col("source"), n_words(F.col("text")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), d1.alias("k1"), d2.alias("k2"))
    packed = packed.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64("row.text"))))
    found = packed.join(lists, ["k1", "k2"])
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "epoch"], F.explode(F.get("copies", F.col("copy") - 1)["epochs"]).alias("epoch"))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = mixed(table(spark, sf_dir, "documents"))
    # Both passes of a document, and repeats of its id, are told apart by their place among equals.
    order = Window.partitionBy("doc_id", "source", "size", "pass").orderBy("finish")
    return (
        entries.withColumn("copy", F.row_number().over(order))
        .groupBy("doc_id", "source", "size", "copy")
        .agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).cast("bigint").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, cap / weight AS fills_at,
    (1.5 * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed
), level AS (
  SELECT own_level AS value FROM levels WHERE own_level <= fills_at ORDER BY fills_at, place LIMIT 1
), aims AS (
  SELECT source, source_size, least(cap, coalesce((SELECT value FROM level) * weight, cap)) AS target FROM levels
), entries AS (
  SELECT doc_id, source, size, pass, md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), pass::VARCHAR, 'fair-mix')) AS spot FROM docs, (SELECT unnest([0, 1]) AS pass)
), queued AS (
  SELECT e.*, a.source_size, a.target,
    (sum(size) OVER (PARTITION BY e.source ORDER BY pass, spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / a.target AS finish
  FROM entries e JOIN aims a ON e.source IS NOT DISTINCT FROM a.source
), taken AS (
  SELECT *, sum(size) OVER (ORDER BY finish, spot, doc_id, size, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1.5 * (SELECT sum(size) FROM docs) AS taken FROM queued
)
SELECT doc_id, size, source_size, target, coalesce(sum(size) FILTER (WHERE taken), 0)::BIGINT AS taken
FROM taken GROUP BY doc_id, size, source_size, target
"""
