"""Smaller operators: filters, schedules of samples, normalisations and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import flow as L
from ..functions import samples as S
from ..functions.hashing import uniform, uniform_sql
from ..operators import parameters as N
from ..operators import series as R
from ..session import table
from .registry import query

# The bundles of evaluation suites, the steps of an episode, and colours by name.
SUITES = {
    "libero_goal": ["libero_goal"],
    "libero_object": ["libero_object"],
    "libero_spatial": ["libero_spatial"],
    "libero_10": ["libero_10"],
    "libero_90": ["libero_90"],
    "libero30": ["libero_goal", "libero_object", "libero_spatial"],
    "libero130": ["libero_goal", "libero_object", "libero_spatial", "libero_10", "libero_90"],
}
HORIZONS = {"libero_goal": 800, "libero_object": 800, "libero_spatial": 800, "libero_10": 900, "libero_90": 800, "libero30": 800, "libero130": 800}
BOX_COLORS = {"red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255)}
MASK_COLORS = {
    "red": (255, 0, 0),
    "green": (0, 255, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "purple": (128, 0, 128),
    "orange": (255, 165, 0),
    "cyan": (0, 240, 240),
    "magenta": (255, 0, 255),
    "lime": (0, 255, 128),
    "pink": (255, 105, 180),
    "indigo": (75, 0, 130),
    "gold": (255, 215, 0),
    "olive": (128, 128, 0),
    "violet": (148, 0, 211),
    "coral": (255, 127, 80),
    "khaki": (240, 230, 140),
}


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))


_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'flatten' WHEN 1 THEN 'flatten' WHEN 2 THEN 'keep' WHEN 3 THEN 'repeat' END AS action FROM part WHERE p_size % 5 <> 4 AND p_size * 20 >= 256 AND p_partkey % 700 >= 100")
def image_modes(spark: SparkSession, d: str) -> DataFrame:
    """Images of at least a size, by mode: transparent ones flattened, grey ones repeated, unknown modes rejected."""
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(m) for m in ("RGBA", "P", "RGB", "L", "CMYK")]), (F.col("p_size") % 5 + 1).cast("int")).alias("mode"), (F.col("p_size") * 20).alias("height"), (F.col("p_partkey") % 700).alias("width"))
    large = rows.where(S.large_enough(F.col("height"), F.col("width"), 256, 100))
    return large.select("p_partkey", S.mode_action(F.col("mode")).alias("action")).where("action is not null")


@query("WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, value FROM events) SELECT event_id, CASE WHEN j = n - 1 THEN value ELSE 0 END AS velocity, CASE WHEN j = n - 1 THEN 0.25 ELSE 1.0 END::DOUBLE AS time FROM n")
def keep_only_last(spark: SparkSession, d: str) -> DataFrame:
    """Velocities of all images of a series but the last are zero, and their times are 1."""
    rows = R.only_last(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"velocity": F.col("value")}, "time", F.lit(0.25))
    return rows.select("event_id", "velocity", "time")


@query("WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type FROM events) SELECT event_id, idx - 1 AS idx FROM e WHERE idx >= 1")
def drop_first_frame(spark: SparkSession, d: str) -> DataFrame:
    return R.without_first(R.placed(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]), "idx").select("event_id", "idx")


@query(_V + " SELECT vec_id, round(list_avg([(e[i] - e[i + 32]) ** 2 FOR i IN range(1, 33)]), 6) AS loss FROM v")
def velocity_loss(spark: SparkSession, d: str) -> DataFrame:
    """The mean squared difference over all dimensions of a row."""
    gap = F.zip_with(F.slice("e", 1, 32), F.slice("e", 33, 32), lambda a, b: (a - b) * (a - b))
    return _vectors(spark, d).select("vec_id", F.round(V.mean(gap), 6).alias("loss"))


@query("SELECT l_orderkey, l_linestatus, bit_or(1 << (l_linenumber % 8))::INT AS mask FROM lineitem GROUP BY ALL")
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of the instances' rasters, eight cells to an integer."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.bit_or(F.expr("shiftleft(1, cast(l_linenumber % 8 as int))")).alias("mask"))


@query(_V + f", s AS (SELECT vec_id, e[1:8] AS x, {uniform_sql('vec_id', 'draw')} AS u FROM v), p AS (SELECT vec_id, u, unnest(range(0, 8)) AS i, unnest([exp(a) FOR a IN x]) AS w FROM s), c AS (SELECT vec_id, u, i, sum(w) OVER (PARTITION BY vec_id ORDER BY i) / sum(w) OVER (PARTITION BY vec_id) AS cum FROM p) SELECT vec_id, min(i)::INT AS token FROM c WHERE cum >= u GROUP BY vec_id")
def multinomial_draw(spark: SparkSession, d: str) -> DataFrame:
    """One token for each row by inverse cumulative probability, within the row."""
    p = _vectors(spark, d).select("vec_id", V.softmax(F.slice("e", 1, 8)).alias("p"))
    return p.select("vec_id", S.multinomial(F.col("p"), uniform(F.col("vec_id"), "draw")).alias("token"))


@query("SELECT conv_id, (conv_id % 20)::INT AS state, 7 + conv_id + 100 AS seed FROM (SELECT DISTINCT conv_id FROM conversations)")
def cyclic_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", S.cyclic_state(F.col("conv_id"), 20).alias("state"), (F.lit(7) + F.col("conv_id") + 100).alias("seed"))


@query("""
SELECT * FROM (VALUES ('libero_goal', 'libero_goal', 800), ('libero_object', 'libero_object', 800), ('libero_spatial', 'libero_spatial', 800), ('libero_10', 'libero_10', 900), ('libero_90', 'libero_90', 800), ('libero30', 'libero_goal', 800), ('libero30', 'libero_object', 800), ('libero30', 'libero_spatial', 800),
  ('libero130', 'libero_goal', 800), ('libero130', 'libero_object', 800), ('libero130', 'libero_spatial', 800), ('libero130', 'libero_10', 800), ('libero130', 'libero_90', 800)) t(bundle, suite, horizon)
""")
def suite_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Suites of each bundle, with the bundle's steps of an episode."""
    return spark.createDataFrame([(k, v, HORIZONS[k]) for k, v in SUITES.items()], "bundle string, suites array<string>, horizon int").select("bundle", F.explode("suites").alias("suite"), "horizon")


@query("SELECT doc_id, [255, 0, 0, 128, 255, 0, 255, 0, 255, 75, 255, 128, 148, 255, 240, 0][doc_id % 15 + 1]::INT AS red, [0, 255, 0, 0, 165, 240, 0, 255, 105, 0, 215, 128, 0, 127, 230, 255][doc_id % 15 + 1]::INT AS green, [0, 0, 255, 128, 0, 240, 255, 128, 180, 130, 0, 0, 211, 80, 140, NULL][doc_id % 15 + 1]::INT AS blue FROM documents")
def color_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Colours by name from a small broadcast table."""
    names = ("red", "green", "blue", "purple", "orange", "cyan", "magenta", "lime", "pink", "indigo", "gold", "olive", "violet", "coral", "khaki")
    colors = spark.createDataFrame([(k, *v) for k, v in MASK_COLORS.items()], "name string, red int, green int, blue int")
    rows = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 15 + 1).cast("int")).alias("name"))
    return rows.join(F.broadcast(colors), "name").select("doc_id", "red", "green", "blue")


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def sampled_moments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_samp("c_acctbal"), 4).alias("spread"))


@query(_V + ", s AS (SELECT vec_id, e[1] AS a, e[2] AS n, e[3] AS g, ((vec_id % 97) + 1) / 99.0::DOUBLE AS t FROM v) SELECT vec_id, round(n * t + a * (1 - t), 6) AS noisy, 0.0::DOUBLE AS grip, round((t + (vec_id % 16) / 16.0::DOUBLE) % (1 - 1e-5), 6) AS drawn FROM s")
def noisy_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions blended with given noise (the gripper is zero), and stratified times."""
    e, t = F.col("e"), (F.col("vec_id") % 97 + 1) / F.lit(99.0)
    blended = S.noisy(F.array(e[0], e[2]), F.array(e[1], e[1]), t, (1,))
    return _vectors(spark, d).select("vec_id", F.round(blended[0], 6).alias("noisy"), blended[1].alias("grip"), F.round(L.stratified_time(t, F.col("vec_id") % 16, 16), 6).alias("drawn"))


@query(_V + ", r AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e]) / 64 + 1e-6::DOUBLE) AS rms FROM v) SELECT vec_id, round(list_sum([(e[i + 1] / rms * (1 + 0.5) + 0.25) * (i + 1) FOR i IN range(0, 64)]), 5) AS modulated, round(list_sum([(e[i + 1] - 0.1 * i) / (1.0::DOUBLE + i) FOR i IN range(0, 16)]), 5) AS latent FROM r")
def normalised_rows(spark: SparkSession, d: str) -> DataFrame:
    """Root-mean-square norm with scale and shift, and latents by channel mean and deviation."""
    e = F.col("e")
    modulated = F.transform(S.rms_modulated(e, 0.5, 0.25), lambda x, i: x * (i + 1))
    channels = F.sequence(F.lit(0), F.lit(15))
    latent = S.standardised(F.slice(e, 1, 16), F.transform(channels, lambda i: i * 0.1), F.transform(channels, lambda i: i + 1.0))
    return _vectors(spark, d).select("vec_id", F.round(V.total(modulated), 5).alias("modulated"), F.round(V.total(latent), 5).alias("latent"))


@query(_V + " SELECT vec_id, round(e[1] * cos(label * 0.1) - e[2] * sin(label * 0.1), 6) AS x, round(e[1] * sin(label * 0.1) + e[2] * cos(label * 0.1), 6) AS y FROM v")
def rotary_pairs(spark: SparkSession, d: str) -> DataFrame:
    angle, e = F.col("label") * 0.1, F.col("e")
    return _vectors(spark, d).select("vec_id", F.round(e[0] * F.cos(angle) - e[1] * F.sin(angle), 6).alias("x"), F.round(e[0] * F.sin(angle) + e[1] * F.cos(angle), 6).alias("y"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type = 'click' THEN 3.0 WHEN event_id % 2 = 0 THEN 17.0 WHEN event_type = 'click' THEN 3.0 ELSE 7.0 END::DOUBLE AS factor FROM events")
def flag_settings(spark: SparkSession, d: str) -> DataFrame:
    """A setting by two flags."""
    high, video = F.col("event_type") == "click", F.col("event_id") % 2 == 0
    return table(spark, d, "events").select("event_id", F.when(video & high, 3.0).when(video, 17.0).when(high, 3.0).otherwise(7.0).alias("factor"))


@query("WITH g AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'gate' ELSE 'base' END AS grp FROM part) SELECT grp, count(*) AS n, CASE grp WHEN 'action' THEN 1e-4 * 0.3 ELSE 1e-4 END::DOUBLE AS rate, CASE grp WHEN 'gate' THEN 0.01 * 3.0 ELSE 0.01 END::DOUBLE AS decay FROM g GROUP BY grp")
def group_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Learning rate and weight decay of parameter groups."""
    grp = F.when(F.col("p_partkey") % 3 == 0, "action").when(F.col("p_partkey") % 3 == 1, "gate").otherwise("base")
    groups = table(spark, d, "part").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))
    return N.scaled(groups, "grp", 1e-4, 0.01, {"action": 0.3}, {"gate": 3.0})


@query(_V + ", s AS (SELECT vec_id, unnest(range(0, 6)) AS j, unnest(e[1:6]) AS x, unnest(e[7:12]) AS z FROM v) SELECT vec_id, j::INT AS j, CASE WHEN j < 2 THEN x ELSE z END AS latent, CASE WHEN j < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS time FROM s")
def initial_latents(spark: SparkSession, d: str) -> DataFrame:
    """Observed latents are kept at time 1, future ones start from noise at time 0."""
    rows = _vectors(spark, d).select("vec_id", F.posexplode(S.initial_latents(F.slice("e", 1, 6), F.slice("e", 7, 6), 2)).alias("j", "s"))
    return rows.select("vec_id", "j", "s.latent", "s.time")


@query(_V + ", w AS (SELECT vec_id, label + 5 AS n, e FROM v), g AS (SELECT vec_id, n, e, unnest(range(0, 9)) AS k FROM w), f AS (SELECT *, k * (n - 1) / 8.0::DOUBLE AS pos FROM g) SELECT vec_id, k::INT AS k, round(e[floor(pos)::INT + 1] + (e[ceil(pos)::INT + 1] - e[floor(pos)::INT + 1]) * (pos - floor(pos)), 6) AS value FROM f")
def resample_slice(spark: SparkSession, d: str) -> DataFrame:
    """A slice of a row's series resampled to nine points at equal distances."""
    at = F.col("k") * (F.col("label") + 4) / F.lit(8.0)
    rows = _vectors(spark, d).select("vec_id", "label", "e", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    return rows.select("vec_id", "k", F.round(S.sampled_at(F.col("e"), at), 6).alias("value"))
