"""Queries of the data set parameters, on embeddings as frames and events as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import handlers as H
from ..operators import trajectories as T
from ..session import table
from .registry import query
from .trajectory import _E, _events

_NAMES = tuple(H.HANDLERS)
# The rules once more, for the SQL side.
_TABLE = """(VALUES ('Calvin', 30, 1, 'euler', 'below 0', 1, 20, 1), ('RT1', 3, 10, 'quaternion', 'raw', 1, 6, 1), ('Bridge', 5, 5, 'euler', 'inverted', 1, 10, 1), ('libero', 30, 1, 'six', 'above 0', 1, 10, 1), ('VLABench', 30, 1, 'euler', 'raw', 1, 15, 1),
  ('robotwin2_clean', 30, 1, 'quaternion', 'inverted', 2, 10, 1), ('robocasa-human', 30, 1, 'six', 'above 0', 1, 30, 1), ('AIR-AGILEX', 30, 2, 'quaternion', 'scaled below 1', 2, 30, 2), ('AIR-AGILEX-HQ', 30, 2, 'six', 'scaled below 1', 2, 60, 1), ('AIRBOT', 10, 3, 'six', 'below half', 1, 10, 1),
  ('widowx-air', 5, 5, 'six', 'below half', 1, 15, 1), ('atecup', 30, 1, 'six', 'raw', 1, 10, 1), ('Droid-Left', 15, 4, 'euler', 'raw', 1, 30, 1), ('robomind-franka', 30, 4, 'euler', 'raw', 1, 30, 1), ('robomind-agilex', 30, 4, 'euler', 'above 2.5', 2, 30, 1), ('robomind-franka-dual', 30, 4, 'euler', 'raw', 2, 30, 1),
  ('AGIBOT', 30, 4, 'quaternion', 'raw', 2, 30, 4), ('agiworld-on-site-pack', NULL, NULL, 'quaternion', 'raw', 2, 0, 1)) h(name, frequency, duration, rotation, gripper, arms, margin, stride)"""
_ORDER = "['Calvin', 'RT1', 'Bridge', 'libero', 'VLABench', 'robotwin2_clean', 'robocasa-human', 'AIR-AGILEX', 'AIR-AGILEX-HQ', 'AIRBOT', 'widowx-air', 'atecup', 'Droid-Left', 'robomind-franka', 'robomind-agilex', 'robomind-franka-dual', 'AGIBOT', 'agiworld-on-site-pack']"


def _set_of(key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, _NAMES)), (F.pmod(key, F.lit(len(_NAMES))) + 1).cast("int"))


@query(f"SELECT name, frequency, duration, rotation, gripper, arms, margin, stride FROM {_TABLE}")
def handler_parameters(spark: SparkSession, d: str) -> DataFrame:
    return H.parameters(spark).select("name", "frequency", "duration", "rotation", "gripper", "arms", "margin", "stride")


def _six_sql(at: int) -> list[str]:
    e = lambda i: f"e[{at + i}]"
    a, b, c = e(0), e(1), e(2)
    euler = [f"cos({c}) * cos({b})", f"cos({c}) * sin({b}) * sin({a}) - sin({c}) * cos({a})", f"sin({c}) * cos({b})", f"sin({c}) * sin({b}) * sin({a}) + cos({c}) * cos({a})", f"-sin({b})", f"cos({b}) * sin({a})"]
    x, y, z, w = (e(i) for i in range(4))
    n = f"({x} ** 2 + {y} ** 2 + {z} ** 2 + {w} ** 2)"
    quaternion = [f"1 - 2 * ({y} * {y} + {z} * {z}) / {n}", f"2 * ({x} * {y} - {z} * {w}) / {n}", f"2 * ({x} * {y} + {z} * {w}) / {n}", f"1 - 2 * ({x} * {x} + {z} * {z}) / {n}", f"2 * ({x} * {z} - {y} * {w}) / {n}", f"2 * ({y} * {z} + {x} * {w}) / {n}"]
    return [f"CASE rotation WHEN 'euler' THEN {euler[i]} WHEN 'quaternion' THEN {quaternion[i]} ELSE {e(i)} END" for i in range(6)]


def _closed_sql(g: str) -> str:
    return f"CASE gripper WHEN 'raw' THEN {g} WHEN 'inverted' THEN 1 - {g} WHEN 'below 0' THEN ({g} < 0)::INT WHEN 'above 0' THEN ({g} > 0)::INT WHEN 'below half' THEN ({g} < 0.5)::INT WHEN 'above 2.5' THEN ({g} > 2.5)::INT ELSE ({g} * 50 < 1)::INT END"


def _arm_sql(at: int) -> str:
    return f"[e[{at}], e[{at + 1}], e[{at + 2}], {', '.join(_six_sql(at + 3))}, {_closed_sql(f'e[{at + 9}]')}]"


@query(f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_ORDER}[vec_id % 18 + 1] AS name FROM embeddings),
a AS (SELECT vec_id, name, {_arm_sql(1)} || CASE WHEN arms = 2 THEN {_arm_sql(11)} ELSE [0.0::DOUBLE FOR i IN range(0, 10)] END AS arms FROM v JOIN {_TABLE} USING (name))
SELECT vec_id, name, array_to_string([printf('%.4f', round(x, 4) + 0.0) FOR x IN arms], ' ') AS arms FROM a
""")
def handler_arms(spark: SparkSession, d: str) -> DataFrame:
    """Position, rotation and gripper of one or two arms by the set's rules: twenty numbers."""
    rows = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("e"), _set_of(F.col("vec_id")).alias("name"))
    arm = lambda at: H.arm_vector(F.slice("e", at, 3), F.slice("e", at + 3, 6), F.col("e")[at + 8])
    made = H.with_parameters(rows, "name").select("vec_id", "name", H.both_arms(arm(1), arm(11)).alias("arms"))
    return made.select("vec_id", "name", F.array_join(F.transform("arms", lambda x: F.format_string("%.4f", F.round(x, 4) + F.lit(0.0))), " ").alias("arms"))


@query(_E + f", s AS (SELECT event_id, user_id, idx, count(*) OVER (PARTITION BY user_id) AS n, {_ORDER}[user_id % 18 + 1] AS name FROM e) SELECT event_id, name, idx FROM s JOIN {_TABLE} USING (name) WHERE idx < n - margin AND idx % stride = 0")
def handler_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate rows by each set's margin and stride."""
    rows = _events(spark, d).select("event_id", "user_id", "idx", _set_of(F.col("user_id")).alias("name"))
    return H.candidate_rows(H.with_parameters(rows, "name"), ["user_id"], "idx").select("event_id", "name", "idx")


_CLOCK = """s{n} AS (SELECT user_id, sec + {shift} AS t, value AS v FROM e), z{n} AS (SELECT user_id, max(t) AS last FROM s{n} GROUP BY 1),
g{n} AS (SELECT a.user_id, anchor, k, anchor + k * (least(anchor + 60, last) - anchor) / 2.0 AS pos FROM a JOIN z{n} USING (user_id), range(0, 3) r(k)),
i{n} AS (SELECT g.user_id, anchor, k, pos, (SELECT max_by(struct_pack(t := t, v := v), t) FROM s{n} s WHERE s.user_id = g.user_id AND s.t <= pos) AS lo, (SELECT min_by(struct_pack(t := t, v := v), t) FROM s{n} s WHERE s.user_id = g.user_id AND s.t >= pos) AS hi FROM g{n} g),
r{n} AS (SELECT user_id, anchor, k, pos, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR hi.t = lo.t THEN lo.v ELSE lo.v + (hi.v - lo.v) * (pos - lo.t) / (hi.t - lo.t) END AS value FROM i{n})"""


@query(_E + ", a AS (SELECT user_id, min(sec) + 10.0 AS anchor FROM e GROUP BY 1), " + _CLOCK.format(n=1, shift="0.0") + ", " + _CLOCK.format(n=2, shift="4.0") + " SELECT user_id, k::INT AS k, round((r1.pos + r2.pos) / 2, 4) AS \"at\", round(r1.value, 4) AS \"left\", round(r2.value, 4) AS \"right\" FROM r1 JOIN r2 USING (user_id, anchor, k)")
def handler_two_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Two arms on clocks four seconds apart, resampled from one anchor a series and merged on the mean time."""
    e = _events(spark, d).select("user_id", "sec", "value")
    anchors = e.groupBy("user_id").agg((F.min("sec") + 10.0).alias("anchor"))
    arm = lambda shift: T.resample_lookahead(e.withColumn("t", F.col("sec") + shift), anchors, ["user_id"], "t", "value", 60.0, 2)
    both = H.merge_clocks(arm(0.0), arm(4.0), ["user_id"])
    return both.select("user_id", "k", F.round("at", 4).alias("at"), F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))
