"""Mixing, sampling and batching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import choice, uniform, uniform_sql
from ..operators import mixing as X
from ..operators import resume as R
from ..session import table
from .registry import query

# Sampling weights of trajectory sets (others have 1) and domain ids by set (others have 0).
DATA_WEIGHTS = {
    "robomind-franka": 0.1,
    "robomind-ur": 0.1,
    "Droid-Left": 0.15,
    "Droid-Right": 0.15,
    "AGIBOT": 0.4,
    "robomind-agilex": 0.07,
    "robomind-franka-dual": 0.03,
    "agiworld-on-site-pack": 0.8,
    "agiworld-on-site-pack-extra": 0.2,
    "agiworld-on-site-conveyor": 0.8,
    "agiworld-on-site-conveyor-extra": 0.2,
    "agiworld-on-site-restock": 1.0,
    "agiworld-on-site-pour": 1.0,
    "agiworld-on-site-microwave": 1.2,
    "agiworld-on-site-cloth": 1.2,
    "agiworld-on-site-cloth-2": 0.1,
}
DATA_DOMAIN_ID = {
    "libero_spatial": 3,
    "libero_object": 3,
    "libero_goal": 3,
    "libero_10": 3,
    "libero_90": 3,
    "Bridge": 0,
    "RT1": 1,
    "Calvin": 2,
    "libero": 3,
    "widowx-air": 4,
    "AIR-AGILEX-HQ": 5,
    "robotwin2_abs_ee": 6,
    "robotwin2_clean": 6,
    "robocasa-human": 7,
    "VLABench": 8,
    "AGIBOT-challenge": 9,
    "AIR-AGILEX": 10,
    "AIRBOT": 18,
    "robomind-franka": 11,
    "robomind-ur": 12,
    "Droid-Left": 13,
    "Droid-Right": 14,
    "AGIBOT": 15,
    "robomind-agilex": 16,
    "robomind-franka-dual": 17,
    "agiworld-on-site-pack": 0,
    "agiworld-on-site-pack-extra": 0,
    "agiworld-on-site-conveyor": 0,
    "agiworld-on-site-conveyor-extra": 0,
    "agiworld-on-site-restock": 0,
    "agiworld-on-site-pour": 0,
    "agiworld-on-site-microwave": 0,
    "agiworld-on-site-cloth": 0,
    "agiworld-on-site-cloth-2": 0,
}


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Events as loaders by type, numbered from 0 in each."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("loader"), "event_id")
    return X.global_ordinal(rows, ["loader"], [F.col("event_id")], F.floor(F.col("event_id") / 4096))


_S = "WITH s AS (SELECT event_type AS loader, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ordinal FROM events), n AS (SELECT loader, count(*) AS size FROM s GROUP BY loader)"


@query(_S + ", t AS (SELECT unnest(range(0, (SELECT max(size) + 1 FROM n))) AS step) SELECT t.step, loader, event_id FROM t, n JOIN s USING (loader) WHERE s.ordinal = t.step % n.size")
def mix_concat_cycle(spark: SparkSession, d: str) -> DataFrame:
    """So many steps that the longest loader starts again."""
    return X.from_every_source(_sources(spark, d), "loader").select("step", "loader", "event_id")


@query(_S + " SELECT s.ordinal AS step, loader, event_id FROM s WHERE s.ordinal < (SELECT min(size) FROM n)")
def mix_concat_min(spark: SparkSession, d: str) -> DataFrame:
    """All steps of the shortest loader."""
    return X.from_every_source(_sources(spark, d), "loader", stop_at_shortest=True).select("step", "loader", "event_id")


@query(_S + """, l AS (SELECT loader, size, row_number() OVER (ORDER BY loader) - 1 AS turn, count(*) OVER () AS many, max(size) OVER () AS most FROM n),
t AS (SELECT unnest(range(0, (SELECT (ceil(max(many * (most + 1)) / 2.0) * 2)::BIGINT FROM l))) AS draw)
SELECT draw // 2 AS step, (draw % 2)::INT AS place, loader, (draw // many) // size AS epoch, event_id FROM t, l JOIN s USING (loader) WHERE l.turn = draw % many AND s.ordinal = (draw // many) % size""")
def mix_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Two draws a step, each from the next loader; short loaders start again until the longest has."""
    return X.in_turn(_sources(spark, d), "loader", 2).select("step", "place", "loader", "epoch", "event_id")


def _draw_sql(types: list[str], weights: list[float]) -> str:
    upto, parts, total = 0.0, [], sum(weights)
    for t, w in list(zip(types, weights, strict=True))[:-1]:
        upto += w / total
        parts.append(f"WHEN u <= {upto!r}::DOUBLE THEN '{t}'")
    return f"CASE {' '.join(parts)} ELSE '{types[-1]}' END"


def _draws(sources: DataFrame) -> int:
    """So many draws that a loader of the mix ends for sure: one more than they have rows."""
    return 1 + sources.where(F.col("loader").isin(*_MIX)).count()


_MIX = {"click": 3.0, "view": 2.0, "purchase": 1.0}
_D = _S + f", w AS (SELECT step, {_draw_sql(list(_MIX), list(_MIX.values()))} AS loader FROM (SELECT step, {uniform_sql('step', 'mix')} AS u FROM (SELECT unnest(range(0, (SELECT count(*) + 1 FROM s WHERE loader IN ('click', 'view', 'purchase')))) AS step))), d AS (SELECT *, row_number() OVER (PARTITION BY loader ORDER BY step) - 1 AS k FROM w), z AS (SELECT d.step, loader, k // size AS epoch, event_id FROM d JOIN n USING (loader) JOIN s USING (loader) WHERE s.ordinal = k % size)"


@query(_D + " SELECT * FROM z")
def mix_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Draws by weight; an exhausted loader starts again."""
    sources = _sources(spark, d)
    draws = X.weighted_draws(spark, _MIX, _draws(sources), "mix")
    return X.cycled(draws, sources, "loader").select("step", "loader", F.col("epoch").cast("bigint").alias("epoch"), "event_id")


@query(_D + " SELECT * FROM z WHERE step < coalesce((SELECT min(step) FROM z WHERE epoch > 0), 1000000000000)")
def mix_weighted_min(spark: SparkSession, d: str) -> DataFrame:
    """Draws by weight up to the first exhaustion."""
    sources = _sources(spark, d)
    draws = X.weighted_draws(spark, _MIX, _draws(sources), "mix")
    return X.cycled(draws, sources, "loader", stop_at_first_end=True).select("step", "loader", F.col("epoch").cast("bigint").alias("epoch"), "event_id")


@query("""
WITH names AS (SELECT ['AGIBOT', 'libero', 'other', 'widowx-air', 'libero_90', 'agiworld-on-site-cloth', 'robomind-franka-dual', 'Droid-Left', 'agiworld-on-site-pack-extra', 'AIRBOT', 'robotwin2_clean', 'VLABench'] AS n)
SELECT doc_id, name,
  CASE name WHEN 'AGIBOT' THEN 0.4 WHEN 'agiworld-on-site-cloth' THEN 1.2 WHEN 'robomind-franka-dual' THEN 0.03 WHEN 'Droid-Left' THEN 0.15 WHEN 'agiworld-on-site-pack-extra' THEN 0.2 ELSE 1.0 END::DOUBLE AS weight,
  CASE name WHEN 'AGIBOT' THEN 15 WHEN 'libero' THEN 3 WHEN 'widowx-air' THEN 4 WHEN 'libero_90' THEN 3 WHEN 'robomind-franka-dual' THEN 17 WHEN 'Droid-Left' THEN 13 WHEN 'AIRBOT' THEN 18 WHEN 'robotwin2_clean' THEN 6 WHEN 'VLABench' THEN 8 ELSE 0 END::INT AS domain
FROM (SELECT doc_id, n[doc_id % 12 + 1] AS name FROM documents, names)
""")
def domain_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weight and domain by set name from fixed parameter tables (a few dozen rows, broadcast)."""
    weights = spark.createDataFrame(list(DATA_WEIGHTS.items()), "name string, w double")
    domains = spark.createDataFrame(list(DATA_DOMAIN_ID.items()), "name string, dom int")
    names = ("AGIBOT", "libero", "other", "widowx-air", "libero_90", "agiworld-on-site-cloth", "robomind-franka-dual", "Droid-Left", "agiworld-on-site-pack-extra", "AIRBOT", "robotwin2_clean", "VLABench")
    rows = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int")).alias("name"))
    return rows.join(F.broadcast(weights), "name", "left").join(F.broadcast(domains), "name", "left").select("doc_id", "name", F.coalesce("w", F.lit(1.0)).alias("weight"), F.coalesce("dom", F.lit(0)).alias("domain"))


@query("SELECT count(*) AS n_weights, round(sum(w), 6) AS sum_weights, 34::BIGINT AS n_domains, 192::BIGINT AS sum_domains FROM (VALUES (0.1::DOUBLE), (0.1), (0.15), (0.15), (0.4), (0.07), (0.03), (0.8), (0.2), (0.8), (0.2), (1.0), (1.0), (1.2), (1.2), (0.1)) t(w)")
def domain_tables(spark: SparkSession, d: str) -> DataFrame:
    """The whole parameter tables, in sums."""
    weights = spark.createDataFrame([(float(w),) for w in DATA_WEIGHTS.values()], "w double").agg(F.count("*").alias("n_weights"), F.round(F.sum("w"), 6).alias("sum_weights"))
    domains = spark.createDataFrame([(v,) for v in DATA_DOMAIN_ID.values()], "v int").agg(F.count("*").alias("n_domains"), F.sum("v").alias("sum_domains"))
    return weights.crossJoin(domains)


_SHUFFLED = f"WITH u AS (SELECT event_id, {uniform_sql('event_id', 'epoch0')} AS u FROM events), o AS (SELECT event_id, row_number() OVER (ORDER BY u, event_id) - 1 AS ordinal FROM u)"


@query(_SHUFFLED + " SELECT event_id, ordinal FROM o")
def shuffle_epoch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.lit(0).alias("all"))
    return X.shuffled(rows, ["all"], "event_id", "epoch0").select("event_id", "ordinal")


@query(_SHUFFLED + ", c AS (SELECT (count(*) // 4 // 16) * 16 AS per FROM o) SELECT event_id, (ordinal % 4)::INT AS shard, (ordinal // 4) // 16 AS batch FROM o, c WHERE ordinal // 4 < per")
def shard_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.lit(0).alias("all"))
    return X.sharded(X.shuffled(rows, ["all"], "event_id", "epoch0"), 4, 16).select("event_id", "shard", F.col("batch").cast("bigint").alias("batch"))


@query("SELECT event_id // 32 AS batch, string_agg(user_id::VARCHAR, ' ' ORDER BY event_id) AS users, count(*) AS n FROM events GROUP BY 1")
def batch_collate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.expr("event_id div 32").alias("batch"), "event_id", "user_id")
    made = X.collate(rows, "batch", "event_id", ["user_id"])
    return made.select("batch", F.array_join(F.transform("user_id", lambda v: v.cast("string")), " ").alias("users"), F.size("user_id").cast("bigint").alias("n"))


@query("SELECT event_id // 32 AS batch, (row_number() OVER (PARTITION BY event_id // 32 ORDER BY event_id) - 1)::INT AS place, user_id, event_type FROM events")
def batch_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.expr("event_id div 32").alias("batch"), "event_id", "user_id", "event_type")
    return X.unbatch(X.collate(rows, "batch", "event_id", ["user_id", "event_type"]), "batch", ["user_id", "event_type"])


@query("SELECT doc_id AS id, source, NULL AS url FROM documents UNION ALL BY NAME SELECT page_id AS id, NULL AS source, url FROM pages")
def mix_columns(spark: SparkSession, d: str) -> DataFrame:
    return X.mix_columns(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"))


@query(f"SELECT conv_id, ['pick', 'place', 'push', 'pull'][floor({uniform_sql('conv_id', 'aug')} * 4)::INT + 1] AS instruction FROM (SELECT DISTINCT conv_id FROM conversations)")
def language_augmentation(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("pick", "place", "push", "pull")])
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.element_at(words, choice(F.col("conv_id"), "aug", 4) + 1).alias("instruction"))


@query(f"WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1), s AS (SELECT conv_id, turns, floor({uniform_sql('conv_id', 'window')} * greatest(1, len(turns) - 2 - 1 + 1))::INT AS start FROM c) SELECT conv_id, array_to_string(turns[start + 1:start + 2], ' ') AS kept FROM s")
def story_window(spark: SparkSession, d: str) -> DataFrame:
    """A contiguous part of at most two turns; its start is uniform over 0 .. n - 3 (the last start is never drawn)."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.floor(uniform(F.col("conv_id"), "window") * F.greatest(F.lit(1), F.size("turns") - 2)).cast("int")
    return c.select("conv_id", F.array_join(F.transform(F.slice("turns", start + 1, F.lit(2)), lambda t: t.cast("string")), " ").alias("kept"))


@query(f"""
WITH e AS (SELECT event_type AS loader, event_id, floor({uniform_sql('event_id', 'block')} * 256)::INT AS block FROM events WHERE event_type IN ('click', 'view', 'purchase')),
n AS (SELECT loader, count(*) AS size FROM e GROUP BY loader), total AS (SELECT sum(size)::BIGINT AS n FROM n),
w AS (SELECT step, {_draw_sql(list(_MIX), list(_MIX.values()))} AS loader FROM (SELECT step, {uniform_sql('step', 'resumed')} AS u FROM (SELECT unnest(range(0, (SELECT 2 * n FROM total))) AS step))),
d AS (SELECT step, loader, row_number() OVER (PARTITION BY loader ORDER BY step) - 1 AS k FROM w),
z AS (SELECT step, d.loader, k // size AS epoch, k % size AS place FROM d JOIN n USING (loader)),
o AS (
  SELECT loader, epoch, event_id, row_number() OVER (PARTITION BY loader, epoch ORDER BY
    {uniform_sql("loader || ':' || block || ':' || epoch", 'resumed')}, block, {uniform_sql("event_id || ':' || epoch", 'resumed')}, event_id) - 1 AS place
  FROM e JOIN (SELECT DISTINCT loader, epoch FROM z) USING (loader)
)
SELECT step, loader, epoch, event_id FROM z JOIN o USING (loader, epoch, place), total WHERE step % 3 = 1 AND step // 3 >= n // 3
""")
def mix_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Worker 1 of 3 goes on after a third of all rows' number of its steps, to twice all rows' number of steps in total."""
    rows = table(spark, d, "events").select("event_type", "event_id")
    mix = R.mix_of(rows, "event_type", "event_id", _MIX, "resumed")
    total = rows.where(F.col("event_type").isin(*_MIX)).count()
    first = total // 3
    return R.read_from(mix, 1, 3, first, max(0, (2 * total - 1 - 1) // 3 + 1 - first)).select("step", "loader", "epoch", "event_id")
