"""Rotations, image geometry, flow paths, schedules and parameter groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import flow as L
from ..functions import geometry as G
from ..operators import parameters as N
from ..session import table
from .registry import query

_Q = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id, e, e[1] / sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) AS x, e[2] / sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) AS y, e[3] / sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) AS z, e[4] / sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) AS w FROM v)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))


def _columns(c, n: int, digits: int = 6):
    return [F.round(F.element_at(c, i + 1), digits).alias(f"r{i}") for i in range(n)]


@query(_Q + " SELECT vec_id, round(1 - 2 * (y * y + z * z), 6) AS r0, round(2 * (x * y - z * w), 6) AS r1, round(2 * (x * y + z * w), 6) AS r2, round(1 - 2 * (x * x + z * z), 6) AS r3, round(2 * (x * z - y * w), 6) AS r4, round(2 * (y * z + x * w), 6) AS r5 FROM q")
def rot6d_quat(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    six = G.six_numbers(G.quaternion_matrix(*[F.col("e")[i] for i in range(4)]))
    return e.select("vec_id", six.alias("six")).select("vec_id", *_columns(F.col("six"), 6))


@query(_Q + ", a AS (SELECT vec_id, e[1] AS a, e[2] AS b, e[3] AS c FROM v) SELECT vec_id, round(cos(c) * cos(b), 6) AS r0, round(cos(c) * sin(b) * sin(a) - sin(c) * cos(a), 6) AS r1, round(sin(c) * cos(b), 6) AS r2, round(sin(c) * sin(b) * sin(a) + cos(c) * cos(a), 6) AS r3, round(-sin(b), 6) AS r4, round(cos(b) * sin(a), 6) AS r5 FROM a")
def rot6d_euler(spark: SparkSession, d: str) -> DataFrame:
    six = G.six_numbers(G.euler_matrix(*[F.col("e")[i] for i in range(3)]))
    return _vectors(spark, d).select("vec_id", six.alias("six")).select("vec_id", *_columns(F.col("six"), 6))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(((e[1] + 20) % 2.0) - 1.0, 6) AS r0, round(((e[2] + 20) % 2.0) - 1.0, 6) AS r1, round(((e[3] + 20) % 2.0) - 1.0, 6) AS r2 FROM v")
def rot6d_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Angles to six numbers and back: the angles again."""
    angle = lambda i: (F.col("e")[i] + 20) % 2.0 - 1.0
    six = _vectors(spark, d).select("vec_id", G.six_numbers(G.euler_matrix(angle(0), angle(1), angle(2))).alias("six"))
    back = six.select("vec_id", G.euler_of_matrix(G.matrix_of_six(F.col("six"))).alias("back"))
    return back.select("vec_id", *_columns(F.col("back"), 3))


@query(_Q + " SELECT vec_id, round(CASE WHEN w < 0 THEN -x ELSE x END, 6) AS r0, round(CASE WHEN w < 0 THEN -y ELSE y END, 6) AS r1, round(CASE WHEN w < 0 THEN -z ELSE z END, 6) AS r2, round(abs(w), 6) AS r3 FROM q")
def quat_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A quaternion to six numbers and back, up to its sign."""
    six = _vectors(spark, d).select("vec_id", G.six_numbers(G.quaternion_matrix(*[F.col("e")[i] for i in range(4)])).alias("six"))
    back = six.select("vec_id", G.quaternion_of_matrix(G.matrix_of_six(F.col("six"))).alias("back"))
    return back.select("vec_id", *_columns(F.col("back"), 4))


@query("SELECT vec_id, CASE WHEN embedding[10] > 0.5 THEN 1.0 ELSE -1.0 END::DOUBLE AS grip, 20::BIGINT AS n, round(embedding[3]::DOUBLE + embedding[12]::DOUBLE, 6) AS rolled FROM embeddings")
def proprio_vector(spark: SparkSession, d: str) -> DataFrame:
    """Pose, two arms, and the roll-forward: the first nine numbers from the last plan, the rest kept."""
    e = F.col("e")
    plan, now = F.slice(e, 1, 20), F.slice(e, 2, 20)
    rolled = F.concat(F.slice(plan, 1, 9), F.slice(now, 10, 11))
    pose = G.two_arms(G.pose_vector(F.slice(e, 1, 3), F.slice(e, 4, 6), F.lit(0.0)))
    return _vectors(spark, d).select("vec_id", G.closed_grip(e[9]).alias("grip"), F.size(pose).cast("bigint").alias("n"), F.round(rolled[2] + rolled[10], 6).alias("rolled"))


@query("""
WITH d AS (SELECT p_partkey, p_size * 20 + 13 AS w, (p_partkey % 37) * 15 + 9 AS h FROM part), s AS (SELECT *, least(336.0::DOUBLE / w, 320.0::DOUBLE / h) AS k FROM d), f AS (SELECT *, least(336, ceil(w * k))::INT AS fw, least(320, ceil(h * k))::INT AS fh FROM s)
SELECT p_partkey, fw AS width, fh AS height, ((336 - fw) // 2)::INT AS "left", ((320 - fh) // 2)::INT AS top FROM f
""")
def fit_and_pad(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20 + 13).alias("w"), (F.col("p_partkey") % 37 * 15 + 9).alias("h"))
    return sizes.select("p_partkey", G.fit_and_pad(F.col("w"), F.col("h"), 336, 320).alias("f")).select("p_partkey", "f.*")


@query("WITH p AS (SELECT i, i // 32 AS y, i % 32 AS x FROM range(0, 1024) t(i)) SELECT i, ((y // 4) * 8 + x // 4)::INT AS patch, ((y % 4) * 4 + x % 4)::INT AS place, (1023 - i)::INT AS flipped FROM p")
def patch_index(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return spark.range(1024).withColumnRenamed("id", "i").select("i", G.patch_index(i, 32, 32, 4).alias("p"), G.flipped(i, 32, 32).alias("flipped")).select("i", "p.*", "flipped")


@query("SELECT vec_id, floor(greatest(0, least(1, (embedding[1]::DOUBLE + 1) / 2)) * 255)::INT AS pixel, least(255, floor((vec_id % 256) + (label * 20) * 0.7::DOUBLE))::INT AS tint FROM embeddings")
def pixel_values(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", G.denormalized(F.col("e")[0]).alias("pixel"), G.tinted(F.col("vec_id") % 256, F.col("label") * 20).alias("tint"))


@query("""
WITH r AS (SELECT vec_id, [label + 2, 5, label * 3, 7, 1, 2] AS runs FROM embeddings), s AS (SELECT vec_id, unnest(range(0, 6)) AS i, unnest(runs) AS n FROM r),
e AS (SELECT vec_id, i, n, sum(n) OVER (PARTITION BY vec_id ORDER BY i) AS upto FROM s), c AS (SELECT vec_id, unnest(range((upto - n)::BIGINT, upto::BIGINT)) AS c FROM e WHERE i % 2 = 1)
SELECT vec_id, (c // 11)::INT AS x, (c % 11)::INT AS y FROM c
""")
def run_length_mask(spark: SparkSession, d: str) -> DataFrame:
    runs = F.array(*[c.cast("bigint") for c in (F.col("label") + 2, F.lit(5), F.col("label") * 3, F.lit(7), F.lit(1), F.lit(2))])
    cells = table(spark, d, "embeddings").select("vec_id", runs.alias("runs")).select("vec_id", F.explode(G.run_lengths_to_cells(F.col("runs"), F.lit(11))).alias("c"))
    return cells.select("vec_id", "c.*")


_T = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, ((vec_id % 97) + 1) / 99.0::DOUBLE AS t FROM embeddings)"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).withColumn("t", (F.col("vec_id") % 97 + 1) / F.lit(99.0))


def _path(spark: SparkSession, d: str, path: str) -> DataFrame:
    x0, x1 = F.slice("e", 1, 8), F.slice("e", 9, 8)
    point, velocity = L.plan(path, F.col("t"), x0, x1)
    return _timed(spark, d).select("vec_id", F.round(V.total(point), 6).alias("x"), F.round(V.total(velocity), 6).alias("u"))


_SUMS = ", s AS (SELECT vec_id, t, list_sum(e[1:8]) AS x0, list_sum(e[9:16]) AS x1 FROM v)"


@query(_T + _SUMS + " SELECT vec_id, round(t * x1 + (1 - t) * x0, 6) AS x, round(x1 - x0, 6) AS u FROM s")
def flow_linear(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d, "linear")


@query(_T + _SUMS + " SELECT vec_id, round(sin(t * pi() / 2) * x1 + cos(t * pi() / 2) * x0, 6) AS x, round(pi() / 2 * (cos(t * pi() / 2) * x1 - sin(t * pi() / 2) * x0), 6) AS u FROM s")
def flow_gvp(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d, "gvp")


@query(_T + _SUMS + ", c AS (SELECT *, -0.25::DOUBLE * (1 - t) ** 2 * 19.9::DOUBLE - 0.5::DOUBLE * (1 - t) * 0.1::DOUBLE AS l, 0.5::DOUBLE * (1 - t) * 19.9::DOUBLE + 0.05::DOUBLE AS dl FROM s) SELECT vec_id, round(exp(l) * x1 + sqrt(1 - exp(2 * l)) * x0, 6) AS x, round(exp(l) * dl * x1 + exp(2 * l) * 2 * dl / (-2 * sqrt(1 - exp(2 * l))) * x0, 6) AS u FROM c")
def flow_vp(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d, "vp")


@query(_T + ", s AS (SELECT vec_id, t, e[1] AS v, e[2] AS x FROM v), z AS (SELECT *, (t * v - x) / ((1 - t) ** 2 + t * (1 - t)) AS sc FROM s) SELECT vec_id, round(sc, 5) AS score, round((t * v - x) / (-t - (1 - t)), 6) AS noise, round(v, 5) AS velocity FROM z")
def flow_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Velocity to score and noise, and the score back to the velocity."""
    t, v, x = F.col("t"), F.col("e")[0], F.col("e")[1]
    score = L.score_from_velocity("linear", v, x, t)
    return _timed(spark, d).select("vec_id", F.round(score, 5).alias("score"), F.round(L.noise_from_velocity("linear", v, x, t), 6).alias("noise"), F.round(L.velocity_from_score("linear", score, x, t), 5).alias("velocity"))


_FORMS = {"constant": "1.0", "SBDM": "(1 - t) ** 2 / t + (1 - t)", "sigma": "1 - t", "linear": "1 - t", "decreasing": "0.25 * (cos(pi() * t) + 1) ** 2", "increasing-decreasing": "sin(pi() * t) ** 2"}


@query(_T + " " + " UNION ALL ".join(f"SELECT vec_id, '{k}' AS form, round(({v})::DOUBLE, 6) AS value FROM v" for k, v in _FORMS.items()))
def flow_diffusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _timed(spark, d)
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.round(L.diffusion(k, "linear", F.col("t")), 6).alias("value")) for k in _FORMS]))
    return rows.select("vec_id", forms.alias("f")).select("vec_id", "f.*")


@query(_T + ", m AS (SELECT *, exp(0.5::DOUBLE + (1024 - 256) * (1.15::DOUBLE - 0.5) / (4096 - 256)) AS mu FROM v) SELECT vec_id, round(1 - mu / (mu + (1 / (1 - t) - 1)), 6) AS shifted, round(t / (t + 3 - 3 * t), 6) AS warped, round(1 / (1 + exp(-e[1])), 6) AS drawn FROM m")
def time_shift(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _timed(spark, d).select("vec_id", F.round(L.time_shift(t, 1024), 6).alias("shifted"), F.round(L.grid_warp(t, 3), 6).alias("warped"), F.round(L.logistic_normal(F.col("e")[0]), 6).alias("drawn"))


@query(_T + " SELECT vec_id, round(list_sum([cos(t * exp(-ln(100) * k / 16)) * (k + 1) FOR k IN range(0, 16)]), 6) AS c, round(list_sum([sin(t * exp(-ln(100) * k / 16)) * (k + 1) FOR k IN range(0, 16)]), 6) AS s FROM v")
def sinusoid(spark: SparkSession, d: str) -> DataFrame:
    waves = _timed(spark, d).select("vec_id", L.sinusoid(F.col("t"), 32, 100.0).alias("w"))
    weigh = lambda part: F.round(V.total(F.transform(part, lambda x, i: x * (i + 1))), 6)
    return waves.select("vec_id", weigh(F.slice("w", 1, 16)).alias("c"), weigh(F.slice("w", 17, 16)).alias("s"))


@query(_T + " SELECT vec_id, round(list_sum([e[i + 8] + 5 * (e[i] - e[i + 8]) FOR i IN range(1, 9)]), 6) AS guided, round(e[1] * (1 - 1 / 50.0::DOUBLE) ** 50, 6) AS decayed FROM v")
def guidance(spark: SparkSession, d: str) -> DataFrame:
    """Guided velocities, and fifty Euler steps of dx = -x dt."""
    e = _timed(spark, d)
    return e.select("vec_id", F.round(V.total(L.guided(F.slice("e", 1, 8), F.slice("e", 9, 8), 5.0)), 6).alias("guided"), F.round(L.euler(F.col("e")[0], 50, lambda x, t: -x), 6).alias("decayed"))


_PROGRESS = "(step - 100) / 900.0::DOUBLE"
_KINDS = {
    "constant": "1.0",
    "constant_with_warmup": "CASE WHEN step < 100 THEN 0.1 + 0.9 * step / 100.0::DOUBLE ELSE 1.0 END",
    "linear": f"CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE greatest(0, 1 - {_PROGRESS}) END",
    "cosine": f"CASE WHEN step < 100 THEN 0.1 + 0.9 * step / 100.0::DOUBLE ELSE greatest(0.1, 0.5 * (1 + cos(pi() * {_PROGRESS}))) END",
    "cosine_with_restarts": f"CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN {_PROGRESS} >= 1 THEN 0 ELSE greatest(0, 0.5 * (1 + cos(pi() * ((3 * {_PROGRESS}) % 1.0)))) END",
    "polynomial": f"CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step > 1000 THEN 1e-7 / 1e-3 ELSE ((1e-3 - 1e-7) * (1 - {_PROGRESS}) ** 2 + 1e-7) / 1e-3 END",
}


@query(" UNION ALL ".join(f"SELECT step, '{k}' AS kind, round(({v})::DOUBLE, 6) AS factor FROM range(0, 1000, 7) t(step)" for k, v in _KINDS.items()))
def lr_schedules(spark: SparkSession, d: str) -> DataFrame:
    extra = {"cosine_with_restarts": {"cycles": 3.0}, "polynomial": {"power": 2.0}}
    rows = spark.range(0, 1000, 7).withColumnRenamed("id", "step")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.round(L.learning_rate(k, F.col("step"), 100, 1000, **extra.get(k, {})), 6).alias("factor")) for k in _KINDS]))
    return rows.select("step", kinds.alias("k")).select("step", "k.*")


_NAMES = "WITH p AS (SELECT 'model.layers.' || (p_partkey % 24) || '.' || CASE p_partkey % 5 WHEN 0 THEN 'mlp.weight' WHEN 1 THEN 'attn.bias' WHEN 2 THEN 'action_head.weight' WHEN 3 THEN 'norm.weight' ELSE 'gate.weight' END AS name, p_partkey, p_size AS a, p_partkey % 7 + 1 AS b FROM part)"


def _parameters(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("mlp.weight", "attn.bias", "action_head.weight", "norm.weight", "gate.weight")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("model.layers."), (F.col("p_partkey") % 24).cast("string"), F.lit("."), kind)
    return table(spark, d, "part").select(name.alias("name"), "p_partkey", F.array(F.col("p_size").cast("bigint"), (F.col("p_partkey") % 7 + 1).cast("bigint")).alias("shape"))


@query(_NAMES + ", g AS (SELECT p_partkey, unnest(list_filter(['action', 'head', 'norm'], lambda s: contains(name, s))) AS grp FROM p) SELECT p_partkey, grp, CASE grp WHEN 'action' THEN 3e-4 ELSE 1e-3 END::DOUBLE AS rate FROM g")
def param_groups(spark: SparkSession, d: str) -> DataFrame:
    """A parameter belongs to every group whose substring its name holds; one group has a lower rate."""
    return N.grouped(_parameters(spark, d), "name", {"action": 3e-4, "head": 1e-3, "norm": 1e-3}).select("p_partkey", "grp", "rate")


@query(_NAMES + " SELECT contains(name, 'norm') OR contains(name, 'gate') AS frozen, sum(a * b)::BIGINT AS parameters, count(*) AS n FROM p GROUP BY 1")
def param_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.counted(_parameters(spark, d), "name", "shape", ["norm", "gate"])


@query(_NAMES + " SELECT p_partkey, 'layers.' || (split_part(name, '.', 3)::INT - 12) || substr(name, length('model.layers.') + length(split_part(name, '.', 3)) + 1) AS renamed FROM p WHERE starts_with(name, 'model.layers.') AND split_part(name, '.', 3)::INT >= 12 AND NOT contains(name, 'gate')")
def param_rename(spark: SparkSession, d: str) -> DataFrame:
    """Keys by prefix, without a blacklisted part, their layers numbered anew."""
    return N.renumbered(_parameters(spark, d), "name", "model.layers", "layers", 12, ["gate"]).select("p_partkey", "renamed")


@query("""
SELECT event_id, path, value FROM (SELECT event_id, unnest(['props.k', 'a.0', 'a.1.b.c.d.e.0', 'a.1.b.c.d.e.1', 'n']) AS path, unnest([json_extract_string(props, '$.k'), event_type, event_id::VARCHAR, 'x', user_id::VARCHAR]) AS value FROM events) WHERE value IS NOT NULL
""")
def config_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Trees of eight levels, with arrays, to dotted keys."""
    from ..operators.config import flatten_json

    deep = F.format_string('{"props": %s, "a": ["%s", {"b": {"c": {"d": {"e": [%d, "x"]}}}}], "n": %d}', F.coalesce("props", F.lit("null")), "event_type", "event_id", "user_id")
    return flatten_json(table(spark, d, "events").select("event_id", deep.alias("tree")), "tree", ["event_id"]).where("value is not null").select("event_id", "path", "value")


@query("""
SELECT event_id, unnest(['a', 'b', 'c', 'd.0', 'd.1', 'd.2.e']) AS path, unnest(['[x] not json', '{oops', '[' || event_id || ',2]', 'true', NULL, user_id || '.50']) AS value, unnest(['string', 'string', 'string', 'boolean', 'null', 'number']) AS kind FROM events
""")
def config_typed_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Strings that look like trees stay strings; numbers, truths and nulls keep their kind."""
    from ..operators.config import flatten_json

    tree = F.format_string('{"a": "[x] not json", "b": "{oops", "c": "[%d,2]", "d": [true, null, {"e": %d.50, "f": {}, "g": []}]}', "event_id", "user_id")
    return flatten_json(table(spark, d, "events").select("event_id", tree.alias("tree")), "tree", ["event_id"])


@query("""
SELECT event_id, event_type || '/' || event_id || '/' || user_id || '/' || event_type || '-${unknown}-' || event_type || event_type || event_type || event_type || event_type || event_type || event_type || event_type || event_type || event_type AS resolved FROM events
""")
def config_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Many references in one value, some to settings that refer on."""
    from ..operators.config import resolve

    settings = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("id"), F.concat(F.lit("${kind}/"), F.col("event_id").cast("string")), F.lit("path"), F.concat(F.lit("${id}/"), F.col("user_id").cast("string"), F.lit("/${kind}")))
    return table(spark, d, "events").select("event_id", resolve(F.lit("${path}-${unknown}-" + "${kind}" * 10), settings).alias("resolved"))


@query("SELECT o_orderkey, (o_orderkey % 8 + 1) * 12 * 8 AS batch, floor(o_totalprice * 0.03)::BIGINT AS warmup, ceil(o_totalprice / ((o_orderkey % 8 + 1) * 12))::BIGINT AS updates FROM orders")
def step_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    per = (F.col("o_orderkey") % 8 + 1) * 12
    return table(spark, d, "orders").select("o_orderkey", (per * 8).alias("batch"), F.floor(F.col("o_totalprice") * 0.03).alias("warmup"), F.ceil(F.col("o_totalprice") / per).alias("updates"))
