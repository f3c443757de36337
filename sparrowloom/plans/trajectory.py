"""Trajectory operators on events: a user is a series, value the signal, event_type the grip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import series as R
from ..operators import trajectories as T
from ..session import table
from .registry import query

KEY, ORDER = ["user_id"], ["ts", "event_id"]
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their place in the series and seconds since a fixed day (in microseconds first, so they stay exact)."""
    seconds = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / F.lit(1e6)
    place = (F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)) - 1).cast("bigint")
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value").withColumns({"sec": seconds, "idx": place})


_E = """
WITH e AS (
  SELECT event_id, user_id, ts, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS sec,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events
)
"""


@query(_E + """, m AS (
  SELECT *, value < 5.0 AS small, lag(event_type) OVER w AS before,
    coalesce(bool_or(NOT (value < 5.0)) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS moved
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY idx)
) SELECT event_id, user_id, coalesce(small AND (NOT moved OR event_type = before), false) AS dropped FROM m""")
def traj_noop_drop(spark: SparkSession, d: str) -> DataFrame:
    flag = T.noop_flag(F.col("value") < 5.0, F.col("event_type"), KEY, ["idx"])
    return _events(spark, d).select("event_id", "user_id", F.coalesce(flag, F.lit(False)).alias("dropped"))


@query(_E + "SELECT event_id, idx, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY idx) <> event_type, false) AS changes FROM e")
def traj_change_points(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", "idx", T.change_flag([F.col("event_type")], KEY, ["idx"]).alias("changes"))


@query(_E + "SELECT event_id, idx / 30.0::DOUBLE AS at FROM e")
def traj_time_axis(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", T.time_axis(KEY, ["idx"], 30).alias("at"))


@query(_E + """, b AS (
  SELECT user_id, 0 AS bound FROM e UNION SELECT user_id, max(idx) + 1 FROM e GROUP BY user_id UNION SELECT user_id, idx FROM e WHERE event_type = 'purchase'
), s AS (
  SELECT user_id, row_number() OVER w - 1 AS segment, bound AS "start", lead(bound) OVER w AS "end" FROM b WINDOW w AS (PARTITION BY user_id ORDER BY bound)
) SELECT * FROM s WHERE "end" IS NOT NULL""")
def traj_segments(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "idx", "event_type")
    return T.segments(e, KEY, "idx", e.where("event_type = 'purchase'").select("user_id", F.col("idx").alias("split"))).select("user_id", F.col("segment").cast("bigint").alias("segment"), "start", "end")


_GRID = _E + """, a AS (SELECT user_id, sec AS anchor FROM e WHERE idx % 20 = 0), l AS (SELECT user_id, max(sec) AS last FROM e GROUP BY user_id),
g AS (
  SELECT a.user_id, anchor, k, anchor + k * (least(anchor + 86400.0::DOUBLE, last) - anchor) / 10.0::DOUBLE AS at
  FROM a JOIN l USING (user_id), range(0, 11) r(k)
), r AS (
  SELECT g.user_id, anchor, k::INT AS k, g.at AS at, CASE WHEN lo.sec IS NULL THEN hi.value WHEN hi.sec IS NULL OR hi.sec = lo.sec THEN lo.value
    ELSE lo.value + (hi.value - lo.value) * (g.at - lo.sec) / (hi.sec - lo.sec) END AS value
  FROM g ASOF LEFT JOIN e lo ON g.user_id = lo.user_id AND g.at >= lo.sec ASOF LEFT JOIN e hi ON g.user_id = hi.user_id AND g.at <= hi.sec
)
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return T.resample_lookahead(e, e.where("idx % 20 = 0").select("user_id", F.col("sec").alias("anchor")), KEY, "sec", "value", 86400, 10)


@query(_GRID + "SELECT user_id, round(anchor, 3) AS anchor, k, round(\"at\", 3) AS \"at\", round(value, 6) AS value FROM r")
def traj_resample_lookahead(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("user_id", F.round("anchor", 3).alias("anchor"), "k", F.round("at", 3).alias("at"), F.round("value", 6).alias("value"))


@query(_GRID + ", f AS (SELECT *, value - first_value(value) OVER (PARTITION BY user_id, anchor ORDER BY k) AS delta FROM r) SELECT user_id, round(anchor, 3) AS anchor, k, round(delta, 6) AS delta FROM f WHERE k >= 1")
def traj_action_delta(spark: SparkSession, d: str) -> DataFrame:
    return T.action_delta(_grid(spark, d), KEY).select("user_id", F.round("anchor", 3).alias("anchor"), "k", F.round("delta", 6).alias("delta"))


@query(_GRID + "SELECT user_id, round(anchor, 3) AS anchor FROM r WHERE k <= 1 GROUP BY user_id, r.anchor HAVING max(value) - min(value) < 0.5")
def traj_static_skip(spark: SparkSession, d: str) -> DataFrame:
    return T.static_anchors(_grid(spark, d), KEY, 0.5).select("user_id", F.round("anchor", 3).alias("anchor"))


@query(_E + ", n AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY idx) AS ahead FROM e) SELECT event_id, coalesce(abs(ahead - value) < 0.5, false) AS still FROM n")
def traj_near_static(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", R.near_static(["value"], KEY, ["idx"], 0.5).alias("still"))


@query(_E + ", n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, user_id, idx FROM n WHERE idx < n - 10 AND idx % 2 = 0")
def traj_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.candidates(_events(spark, d).select("event_id", "user_id", "idx"), KEY, "idx", 10, 2)


@query(_E + """, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY idx) <> event_type, false) AS ch FROM e),
c AS (SELECT user_id, idx FROM n WHERE idx < n - 3 AND idx % 2 = 0), x AS (
  SELECT c.user_id, c.idx, count(h.idx) AS extra FROM c LEFT JOIN n h ON h.user_id = c.user_id AND h.ch AND h.idx - 2 <= c.idx AND c.idx < h.idx + 2 GROUP BY ALL
) SELECT user_id, idx, unnest(range(0, extra + 1)) AS copy FROM x""")
def traj_oversample(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("ch", T.change_flag([F.col("event_type")], KEY, ["idx"]))
    picked = T.candidates(e.select("user_id", "idx"), KEY, "idx", 3, 2)
    return T.oversample(picked, e.where("ch").select("user_id", F.col("idx").alias("change")), KEY, "idx", 2)


@query(_E + "SELECT event_id, least(idx + 15, count(*) OVER (PARTITION BY user_id) - 1) AS future FROM e")
def traj_future_index(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", T.future_index(F.col("idx"), 15, F.count("*").over(W.partitionBy(*KEY))).alias("future"))


@query("""
WITH t AS (SELECT event_id, user_id, value, value < 50 AS ok FROM events),
f AS (SELECT event_id, first_value(CASE WHEN ok THEN {'s': event_id, 'u': user_id, 'v': value} END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM t)
SELECT event_id, x.s AS source, x.u AS user_id, x.v AS value FROM f WHERE x IS NOT NULL
""")
def reject_by_substitution(spark: SparkSession, d: str) -> DataFrame:
    return T.substitute_rejected(table(spark, d, "events").select("event_id", "user_id", "value"), F.col("value") < 50, "event_id", ["user_id", "value"], block_rows=1000)


@query(_E + ", m AS (SELECT user_id, min(idx) FILTER (WHERE event_type = 'purchase') AS stop FROM e GROUP BY user_id) SELECT event_id FROM e JOIN m USING (user_id) WHERE stop IS NULL OR idx <= stop")
def traj_rollout_stop(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    stop = F.min(F.when(F.col("event_type") == "purchase", F.col("idx"))).over(W.partitionBy(*KEY))
    return e.withColumn("stop", stop).where("stop is null or idx <= stop").select("event_id")


@query(_E + ", s AS (SELECT user_id, arg_max(event_type, idx) = 'purchase' AS done FROM e GROUP BY user_id) SELECT user_id FROM s WHERE done")
def traj_success_only(spark: SparkSession, d: str) -> DataFrame:
    return R.successful(_events(spark, d), ["user_id"], "idx", "event_type", "purchase")


@query(_E + ", n AS (SELECT event_id, user_id, idx, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, CASE WHEN idx = 0 THEN 0 ELSE 1 + (idx - 1) // 4 END AS chunk FROM n WHERE idx <= 4 * ((n - 1) // 4)")
def vae_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("n", F.count("*").over(W.partitionBy(*KEY)))
    return R.in_chunks(e, "idx", "n", 4).select("event_id", "chunk")


@query(_E + "SELECT event_id, idx // 8 AS plan, (idx % 8)::INT AS step FROM e")
def plan_queue(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", F.expr("idx div 8").alias("plan"), F.expr("cast(idx % 8 as int)").alias("step"))
