"""The feed from end to end: frames of all data sets to training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import text as X
from ..operators import feed as E
from ..operators import vectors as T
from ..session import table
from .handlers import _TABLE, _arm_sql, _set_of, _ORDER
from .mixing import DATA_DOMAIN_ID
from .registry import query
from .trajectory import _E, _events

ACTIONS, IMAGE, LENGTH = 5, 4, 40
# What some sets do their own way here: other candidates, actions relative to the first pose.
OWN = {"Calvin": E.Generator(candidate=lambda: F.col("index") % 7 == 3), "libero": E.Generator(relative=(0, 1, 2)), "AGIBOT": E.Generator(relative=(0, 1, 2, 10, 11, 12))}


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames: a user is a series of one of the sets, the arms' numbers come from the vector of the event's number."""
    e = _events(spark, d).select("event_id", "user_id", F.col("idx").alias("index"), _set_of(F.col("user_id")).alias("name"), (F.col("event_id") % 500).alias("vec_id"))
    v = table(spark, d, "embeddings").where("vec_id < 500").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    arm = lambda at: F.struct(F.slice("v", at, 3).alias("position"), F.slice("v", at + 3, 6).alias("rotation"), F.col("v")[at + 8].alias("gripper"))
    clock = lambda shift: F.col("index") / F.lit(30.0) + F.col("event_id") % 3 * F.lit(0.005) + F.lit(shift)
    said = F.concat(F.lit("move block "), F.char(F.lit(97) + F.col("user_id") % 26))
    return e.join(v, "vec_id").select("name", "user_id", "index", arm(1).alias("left"), arm(11).alias("right"), clock(0.0).alias("left_time"), clock(0.01).alias("right_time"), F.lit(30).alias("hertz"), F.lit(4).alias("horizon"), said.alias("instruction"))


_SEQUENCES = _E + f""", h AS (SELECT name, coalesce(frequency, 30)::DOUBLE AS hertz, coalesce(duration, 4)::DOUBLE AS horizon, rotation, gripper, arms, margin, stride FROM {_TABLE}),
f AS (SELECT event_id, user_id, idx, count(*) OVER (PARTITION BY user_id) AS n, {_ORDER}[user_id % 18 + 1] AS name, event_id % 500 AS vec_id FROM e),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT f.*, h.*, {_arm_sql(1)} AS l, CASE WHEN arms = 2 THEN {_arm_sql(11)} ELSE [0.0::DOUBLE FOR i IN range(0, 10)] END AS r,
  CASE name WHEN 'AIR-AGILEX-HQ' THEN idx / 30.0::DOUBLE + event_id % 3 * 0.005::DOUBLE + 0.0::DOUBLE ELSE idx / hertz END AS lt,
  CASE name WHEN 'AIR-AGILEX-HQ' THEN idx / 30.0::DOUBLE + event_id % 3 * 0.005::DOUBLE + 0.01::DOUBLE ELSE idx / hertz END AS rt FROM f JOIN h USING (name) JOIN v USING (vec_id)),
w AS (SELECT *, (lt + rt) / 2 AS ref, max((lt + rt) / 2) OVER (PARTITION BY user_id) AS last FROM m),
p AS (SELECT name, user_id, idx, ref, last, hertz, horizon, k, ref + k * (least(ref + horizon, last) - ref) / {float(ACTIONS)}::DOUBLE AS pos FROM w, range(0, {ACTIONS + 1}) r(k)
  WHERE CASE name WHEN 'Calvin' THEN idx % 7 = 3 ELSE idx < n - margin AND idx % stride = 0 END),
i AS (SELECT p.*, a.lt AS t1, a.l AS v1, b.lt AS t2, b.l AS v2, c.rt AS t3, c.r AS v3, d.rt AS t4, d.r AS v4 FROM p
  ASOF LEFT JOIN w a ON p.user_id = a.user_id AND p.pos >= a.lt ASOF LEFT JOIN w b ON p.user_id = b.user_id AND p.pos <= b.lt
  ASOF LEFT JOIN w c ON p.user_id = c.user_id AND p.pos >= c.rt ASOF LEFT JOIN w d ON p.user_id = d.user_id AND p.pos <= d.rt),
q AS (SELECT name, user_id, idx, ref, last, hertz, horizon, k,
  CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL OR t1 = t2 THEN v1 ELSE [v1[j] + (v2[j] - v1[j]) * (pos - t1) / (t2 - t1) FOR j IN range(1, 11)] END AS l,
  CASE WHEN t3 IS NULL THEN v4 WHEN t4 IS NULL OR t3 = t4 THEN v3 ELSE [v3[j] + (v4[j] - v3[j]) * (pos - t3) / (t4 - t3) FOR j IN range(1, 11)] END AS r FROM i),
z AS (SELECT name, user_id, idx, least(idx + horizon * hertz, last * hertz)::DOUBLE AS ahead, list(l || r ORDER BY k) AS path FROM q GROUP BY ALL),
x AS (SELECT name, user_id, idx, floor(ahead)::BIGINT AS future_index, path FROM z WHERE list_max([abs(path[2][j] - path[1][j]) FOR j IN range(1, 21)]) >= 1e-5)
"""
_DELTA = "path[s + 1][j] - CASE WHEN name = 'libero' AND j <= 3 OR name = 'AGIBOT' AND j IN (1, 2, 3, 11, 12, 13) THEN path[1][j] ELSE 0 END"


@query(_SEQUENCES + f"SELECT name AS \"set\", user_id, idx, future_index, CASE name {' '.join(f'WHEN {n!r} THEN {i}' for n, i in DATA_DOMAIN_ID.items())} ELSE 0 END::INT AS domain, round(list_sum([path[1][j] * j FOR j IN range(1, 21)]), 4) AS proprio, round(list_sum([list_sum([({_DELTA}) * j * s FOR j IN range(1, 21)]) FOR s IN range(1, {ACTIONS + 1})]), 3) AS action, {3 + IMAGE + 5 + 2 + IMAGE + 2 + ACTIONS + 1}::BIGINT AS used, '104 105 102 106 106' AS words FROM x")
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of all 18 sets: poses and actions in sums, the layout's length, and the words' tokens."""
    domains = spark.createDataFrame(list(DATA_DOMAIN_ID.items()), "name string, domain int")
    tokens = lambda text: F.transform(X.words(text), lambda w: (F.length(w) + 100).cast("int"))
    rows = E.training_rows(_frames(spark, d), "name", ["user_id"], domains, tokens, ACTIONS, IMAGE, LENGTH, generators=OWN)
    weighed = lambda c: V.total(F.transform(c, lambda x, j: x * (j + 1)))
    action = V.total(F.transform("action", lambda v, s: weighed(v) * (s + 1)))
    words = F.array_join(F.transform(F.filter("tokens", lambda t: t > 100), lambda t: t.cast("string")), " ")
    return rows.select("set", "user_id", F.col("index").alias("idx"), "future_index", "domain", F.round(weighed(F.col("proprio")), 4).alias("proprio"), F.round(action, 3).alias("action"), F.col("used").cast("bigint").alias("used"), words.alias("words"))


@query(_E + f""", v AS (SELECT vec_id, embedding[1:20]::DOUBLE[] AS v FROM embeddings), w AS (SELECT user_id, idx, sec, v FROM e JOIN v ON vec_id = event_id % 500),
p AS (SELECT user_id, idx, k, sec + k * (least(sec + 86400.0::DOUBLE, max(sec) OVER (PARTITION BY user_id)) - sec) / 4.0::DOUBLE AS pos FROM w, range(0, 5) r(k) QUALIFY idx % 25 = 0),
q AS (SELECT p.user_id, p.idx, k, CASE WHEN b.sec IS NULL OR a.sec = b.sec THEN a.v ELSE [a.v[j] + (b.v[j] - a.v[j]) * (pos - a.sec) / (b.sec - a.sec) FOR j IN range(1, 21)] END AS y
  FROM p ASOF LEFT JOIN w a ON p.user_id = a.user_id AND p.pos >= a.sec ASOF LEFT JOIN w b ON p.user_id = b.user_id AND p.pos <= b.sec)
SELECT user_id, idx, k::INT AS k, round(list_sum([y[j] * j FOR j IN range(1, 21)]), 4) AS total FROM q""")
def traj_resample_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Twenty numbers at once, looked ahead a day from every 25th event."""
    v = table(spark, d, "embeddings").where("vec_id < 500").select("vec_id", V.doubles(F.slice("embedding", 1, 20)).alias("v"))
    e = _events(spark, d).withColumn("vec_id", F.col("event_id") % 500).join(v, "vec_id").select("user_id", "idx", "sec", "v")
    last = e.groupBy("user_id").agg(F.max("sec").alias("last"))
    points = T.look_ahead(e.where("idx % 25 = 0").join(last, "user_id"), ["user_id", "idx"], "sec", F.lit(86400.0), F.col("last"), 4)
    found = T.interpolate(e, points, ["user_id"], {"v": "sec"})
    return found.select("user_id", "idx", "k", F.round(V.total(F.transform("v", lambda x, j: x * (j + 1))), 4).alias("total"))
