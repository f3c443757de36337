"""Smaller rules with a query each: image and action geometry, masks, samplers, losses and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import flow as L
from ..functions import geometry as G
from ..functions import masks as K
from ..functions import samples as P
from ..functions import text as X
from ..functions.hashing import uniform, uniform_sql
from ..operators import metrics as M
from ..operators import mixing as U
from ..operators import selection as S
from ..operators import series as R
from ..session import table
from .registry import query

_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))


_TURN = "sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2)"


@query(_V + f""", n AS (SELECT vec_id, e, {_TURN} AS n FROM v), a AS (SELECT vec_id, e[1] / n AS x, e[2] / n AS y, e[3] / n AS z, 2.5 * (label + 1) / 11 AS t, e, label FROM n JOIN (SELECT vec_id AS i, label FROM v) ON i = vec_id)
SELECT vec_id, true AS back, round(e[5], 6) AS grip, round(cos(t) + x * x * (1 - cos(t)), 5) AS first, round(x * y * (1 - cos(t)) + z * sin(t), 5) AS second FROM a""")
def action_axis_angle(spark: SparkSession, d: str) -> DataFrame:
    """A turn about an axis as a stacked pose of ten numbers, and back to axis times angle (to 1e-4: norms have a small term added)."""
    e = F.col("e")
    n = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    half = (F.col("label") + 1) * (2.5 / 11 / 2)
    matrix = G.quaternion_matrix(*[e[i] / n * F.sin(half) for i in range(3)], F.cos(half))
    pose = _vectors(spark, d).select("vec_id", G.stacked_pose(F.slice(e, 1, 3), matrix, e[4]).alias("pose"), F.array(*[e[i] / n * half * 2 for i in range(3)]).alias("turn"))
    back = pose.select("vec_id", "pose", "turn", G.with_axis_angle(G.checked_action(F.col("pose"))).alias("b"))
    near = F.forall(F.zip_with(F.slice("b", 4, 3), F.col("turn"), lambda x, y: F.abs(x - y) < 1e-4), lambda x: x)
    return back.select("vec_id", near.alias("back"), F.round(F.col("b")[6], 6).alias("grip"), F.round(F.col("pose")[3], 5).alias("first"), F.round(F.col("pose")[4], 5).alias("second"))


_SIZES = "WITH d AS (SELECT p_partkey, p_size * 20 + 13 AS w, (p_partkey % 37) * 15 + 9 AS h FROM part)"


def _image_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20 + 13).alias("w"), (F.col("p_partkey") % 37 * 15 + 9).alias("h"))


@query(_SIZES + f""", r AS (SELECT *, w / h::DOUBLE >= 336 / 320.0::DOUBLE AS wide, {uniform_sql('p_partkey', 'crop')} AS u FROM d),
s AS (SELECT *, CASE WHEN wide THEN round_even(320 * (w / h::DOUBLE), 0) ELSE 336 END::INT AS rw, CASE WHEN wide THEN 320 ELSE round_even(336 * (h / w::DOUBLE), 0) END::INT AS rh FROM r)
SELECT p_partkey, rw AS width, rh AS height, CASE WHEN wide THEN floor(u * (rw - 336 + 1)) ELSE 0 END::INT AS "left", CASE WHEN wide THEN 0 ELSE floor(u * (rh - 320 + 1)) END::INT AS top FROM s""")
def resize_and_crop(spark: SparkSession, d: str) -> DataFrame:
    made = G.resize_and_crop(F.col("w"), F.col("h"), 336, 320, uniform(F.col("p_partkey"), "crop"))
    return _image_sizes(spark, d).select("p_partkey", made.alias("f")).select("p_partkey", "f.*")


@query(_SIZES + """, r AS (SELECT p_partkey, (w * 256) // least(w, h) AS rw, (h * 256) // least(w, h) AS rh FROM d)
SELECT p_partkey, rw::INT AS width, rh::INT AS height, round_even((rw - 256) / 2.0, 0)::INT AS "left", round_even((rh - 256) / 2.0, 0)::INT AS top, 0 AS top_of_top, round((p_partkey % 256 / 255.0::DOUBLE - 0.5) / 0.5, 6) AS pixel FROM r""")
def square_crop(spark: SparkSession, d: str) -> DataFrame:
    """The middle or topmost square of an image, and a pixel standardized."""
    w, h = F.col("w"), F.col("h")
    pixel = G.standardized(F.col("p_partkey") % 256 / F.lit(255.0))
    return _image_sizes(spark, d).select("p_partkey", G.square_crop(w, h, 256).alias("f"), G.square_crop(w, h, 256, from_top=True)["top"].alias("top_of_top"), F.round(pixel, 6).alias("pixel")).select("p_partkey", "f.*", "top_of_top", "pixel")


@query("SELECT doc_id, (doc_id % 12 % 4 * 64)::INT AS x, (doc_id % 12 // 4 * 48)::INT AS y FROM documents")
def grid_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Places of a grid's images."""
    return table(spark, d, "documents").select("doc_id", G.grid_offset(F.col("doc_id") % 12, 4, 64, 48).alias("g")).select("doc_id", "g.*")


@query(f"SELECT event_id, pair, frame, round(0.8 + 0.4 * {uniform_sql('pair', 'jitter')}, 9) AS brightness FROM (SELECT event_id, event_id // 2 AS pair, (event_id % 2)::INT AS frame FROM events)")
def shared_jitter(spark: SparkSession, d: str) -> DataFrame:
    """A present and a future frame get one and the same draw."""
    rows = table(spark, d, "events").select("event_id", F.expr("event_id div 2").alias("pair"), (F.col("event_id") % 2).cast("int").alias("frame"))
    return rows.withColumn("brightness", F.round(uniform(F.col("pair"), "jitter") * 0.4 + 0.8, 9))


@query("""
WITH s AS (SELECT vec_id, label + 4 AS n, vec_id % 7 AS q, vec_id % 3 + 2 AS a FROM embeddings)
SELECT vec_id, len([1 FOR k IN range(0, n) IF k <= q AND k > q - 3 AND k < n - 2]) AS banded, len([1 FOR k IN range(0, n) IF k <= q OR (q >= 1 AND q < 1 + a AND k >= 1 AND k < 1 + a)]) AS mixed,
  len([1 FOR k IN range(0, n + 1) IF CASE WHEN k = n THEN q = n ELSE k <= least(q, n - 1) END]) AS grown FROM s
""")
def mask_builder(spark: SparkSession, d: str) -> DataFrame:
    """Predicates put together: a band without padding, causal or within a span, and a mask one position longer."""
    n, q = (F.col("label") + 4).cast("int"), (F.col("vec_id") % 7).cast("int")
    one = F.array(F.struct(F.lit(1).alias("offset"), (F.col("vec_id") % 3 + 2).alias("length")))
    band, mixed = K.all_of(K.banded(3), K.without_padding(n - 2)), K.any_of(K.causal(), K.spans(one))
    many = lambda mask, length: K.seen(mask, q, length).cast("bigint")
    return table(spark, d, "embeddings").select("vec_id", many(band, n).alias("banded"), many(mixed, n).alias("mixed"), many(K.grown(K.causal(), n), n + 1).alias("grown"))


@query(_V + ", s AS (SELECT vec_id, e[1] AS x, e[2] AS sc, ((vec_id % 97) + 1) / 99.0::DOUBLE AS t FROM v) SELECT vec_id, round(-x / t, 6) AS linear, round((1 - t) * (1 - t) / t + (1 - t), 6) AS variance, round(-(pi() / 2) * cos(pi() / 2 * t) / sin(pi() / 2 * t) * x, 5) AS gvp, round(((1 - t) * (1 - t) / t + (1 - t)) * sc + x / t, 6) AS velocity FROM s")
def flow_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift and variance of two paths, and the velocity that they give to a score."""
    x, t = F.col("e")[0], (F.col("vec_id") % 97 + 1) / F.lit(99.0)
    (one, var), (two, _) = L.drift("linear", x, t), L.drift("gvp", x, t)
    return _vectors(spark, d).select("vec_id", F.round(one, 6).alias("linear"), F.round(var, 6).alias("variance"), F.round(two, 5).alias("gvp"), F.round(L.velocity_from_score("linear", F.col("e")[1], x, t), 6).alias("velocity"))


@query("""
SELECT * FROM (VALUES ('vp', 'velocity', false, false, 0.0, 0.0::DOUBLE, 0.999::DOUBLE), ('vp', 'velocity', true, false, 0.04, 0.0, 0.96), ('linear', 'velocity', false, false, 0.0, 0.0, 1.0), ('linear', 'velocity', true, false, 0.04, 0.001, 0.96), ('linear', 'noise', false, false, 0.0, 0.001, 0.999), ('gvp', 'score', true, false, 0.04, 0.001, 0.96), ('gvp', 'velocity', false, true, 0.0, 1.0, 0.0), ('linear', 'noise', false, true, 0.0, 0.999, 0.001)) t(path, predicts, stochastic, reversed, last_step, "begin", "end")
""")
def flow_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The times of a path by what its model predicts."""
    asked = [("vp", "velocity", False, False, 0.0), ("vp", "velocity", True, False, 0.04), ("linear", "velocity", False, False, 0.0), ("linear", "velocity", True, False, 0.04), ("linear", "noise", False, False, 0.0), ("gvp", "score", True, False, 0.04), ("gvp", "velocity", False, True, 0.0), ("linear", "noise", False, True, 0.0)]
    rows = [(p, m, s, r, last, *(round(v, 9) for v in L.interval(p, m, 0.001, 0.001, stochastic=s, reverse=r, sampling=True, last_step=last))) for p, m, s, r, last in asked]
    return spark.createDataFrame(rows, "path string, predicts string, stochastic boolean, reversed boolean, last_step double, begin double, end double").withColumn("last_step", F.col("last_step").cast("decimal(3,2)"))


_STEP = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, e, 0.25::DOUBLE AS dt FROM v)"


def _maruyama_sql() -> str:
    x = "e[1]"
    for k in range(4):
        x = f"({x} + (-{x} * dt) + sqrt(2 * (1 - {k} * dt)) * e[{10 + k}] * sqrt(dt))"
    return x


@query(_STEP + f", m AS (SELECT vec_id, {_maruyama_sql()} AS m FROM s), h1 AS (SELECT vec_id, e, dt, e[1] + sqrt(2 * (1 - 0 * dt)) * e[10] * sqrt(dt) AS y FROM s), h2 AS (SELECT vec_id, e, dt, y + 0.5 * dt * (-y - (y - y * dt)) AS x FROM h1), h3 AS (SELECT vec_id, e, dt, x + sqrt(2 * (1 - 1 * dt)) * e[11] * sqrt(dt) AS y FROM h2), h4 AS (SELECT vec_id, y + 0.5 * dt * (-y - (y - y * dt)) AS x FROM h3) SELECT vec_id, round(m, 6) AS maruyama, round(x, 6) AS heun FROM m JOIN h4 USING (vec_id)")
def stochastic_steps(spark: SparkSession, d: str) -> DataFrame:
    """Four Euler-Maruyama steps, and two Heun steps (of the same length) of dx = -x dt with noise."""
    e = F.col("e")
    noise = F.slice(e, 10, 4)
    fall, spread = (lambda x, t: -x), (lambda t: 1 - t)
    two = L.heun(e[0], F.slice(e, 10, 2), 2, fall, spread, end=0.5)
    return _vectors(spark, d).select("vec_id", F.round(L.euler_maruyama(e[0], noise, 4, fall, spread), 6).alias("maruyama"), F.round(two, 6).alias("heun"))


@query(_V + ", s AS (SELECT vec_id, e[1] AS m, e[2] * 40 AS lv, e[3] AS z FROM v) SELECT vec_id, round(m + exp(0.5 * greatest(-30, least(20, lv))) * z, 4) AS drawn FROM s")
def reparameterized_latent(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    return _vectors(spark, d).select("vec_id", F.round(L.reparameterized(e[0], e[1] * 40, e[2]), 4).alias("drawn"))


@query(f"WITH u AS (SELECT vec_id, {uniform_sql('vec_id', 'gate')} AS u, embedding[1]::DOUBLE AS z FROM embeddings), m AS (SELECT avg(u) AS mu FROM u) SELECT vec_id, round(u, 6) AS rand, round(u - mu, 6) AS rand_mean0, round(0.02 * z, 6) AS normal_002, round(0.2886751345948129 * z, 6) AS normal_028, round((u - mu) * 0.02 * sqrt(12), 6) AS rand_002 FROM u, m")
def gate_initial_weights(spark: SparkSession, d: str) -> DataFrame:
    """Initial weights of a gate by method, from reproducible draws."""
    rows = _vectors(spark, d).select("vec_id", uniform(F.col("vec_id"), "gate").alias("u"), F.col("e")[0].alias("z"))
    both = rows.join(F.broadcast(rows.agg(F.avg("u").alias("mu"))))
    return both.select("vec_id", *[F.round(L.gate_weights(m, F.col("u"), F.col("mu"), F.col("z")), 6).alias(m) for m in ("rand", "rand_mean0", "normal_002", "normal_028", "rand_002")])


@query("SELECT doc_id, array_to_string(CASE WHEN len(range(0, n_chars, greatest(1, s))) > 8 THEN [floor(k * (n_chars - 1) / 7.0)::BIGINT FOR k IN range(0, 8)] ELSE range(0, n_chars, greatest(1, s)) END, ' ') AS frames FROM (SELECT doc_id, n_chars, round_even((doc_id % 60 * 10 + 5) / 2.0, 0)::BIGINT AS s FROM documents WHERE n_chars > 0)")
def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    """Frames at a stride by the rates, or eight at equal distances where those are fewer."""
    rows = table(spark, d, "documents").where("n_chars > 0").select("doc_id", S.sampled_frames(F.col("n_chars"), F.col("doc_id") % 60 * 10 + 5, 2.0, 8).alias("f"))
    return rows.select("doc_id", F.array_join(F.transform("f", lambda i: i.cast("string")), " ").alias("frames"))


@query("WITH r AS (SELECT user_id % 4 AS rank, value FROM events) SELECT round(avg(m), 6) AS mean FROM (SELECT rank, avg(value) AS m FROM r GROUP BY 1)")
def rank_mean(spark: SparkSession, d: str) -> DataFrame:
    local = table(spark, d, "events").select((F.col("user_id") % 4).alias("rank"), "value")
    return M.mean_over_ranks(local, "rank", "value").select(F.round("mean", 6).alias("mean"))


@query("SELECT event_id, round(0.5 * value + 2.0 * (value / 2 + 1 + user_id), 6) AS loss FROM events")
def weighted_losses(spark: SparkSession, d: str) -> DataFrame:
    loss = M.weighted_loss(F.col("value"), [F.col("value") / 2, F.lit(1.0), F.col("user_id").cast("double")], 0.5, 2.0)
    return table(spark, d, "events").select("event_id", F.round(loss, 6).alias("loss"))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 7), z AS (SELECT vec_id, [exp(x) FOR x IN e[1:8]] AS z FROM v), p AS (SELECT vec_id, [x / list_sum(z) FOR x IN z] AS p FROM z),
l AS (SELECT vec_id, unnest(range(0, 8)) AS expert, unnest(p) AS p FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rk FROM l),
g AS (SELECT expert, avg(p) AS p, sum((rk <= 2)::INT) / (SELECT count(*) FROM v)::DOUBLE AS sent FROM k GROUP BY expert) SELECT round(8 * sum(p * sent), 6) AS loss FROM g
""")
def moe_balance_masked(spark: SparkSession, d: str) -> DataFrame:
    """The balance loss over tokens that are no padding."""
    probs = _vectors(spark, d).select("label", V.softmax(F.slice("e", 1, 8)).alias("probs"))
    order = F.slice(F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("p"), i.alias("i")))), 1, 2)
    routed = probs.select("label", "probs", F.transform(order, lambda s: s["i"]).alias("picks"))
    return M.balance_loss(routed, 8, 2, used=F.col("label") < 7).select(F.round("loss", 6).alias("loss"))


@query(f"""
WITH m AS (SELECT * FROM (VALUES ('user', ['ask it', 'say it', 'put it']), ('system', ['be brief'])) t(key, others)), c AS (SELECT conv_id, turn, role, {uniform_sql('conv_id * 1000 + turn', 'words')} AS u FROM conversations WHERE turn IS NOT NULL)
SELECT conv_id, turn, CASE WHEN key IS NULL THEN role ELSE others[floor(u * len(others))::INT + 1] END AS instruction FROM c LEFT JOIN m ON key = role
""")
def augmentation_map(spark: SparkSession, d: str) -> DataFrame:
    """An instruction with an entry in the map becomes one of its others; one without stays."""
    others = spark.createDataFrame([("user", ["ask it", "say it", "put it"]), ("system", ["be brief"])], "key string, others array<string>")
    rows = table(spark, d, "conversations").where("turn is not null").select("conv_id", "turn", "role")
    return S.substituted(rows, others, "role", "key", "others", F.col("conv_id") * 1000 + F.col("turn"), "words").select("conv_id", "turn", F.col("role").alias("instruction"))


_W = "WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return R.placed(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], n="n").select("event_id", "user_id", "idx", "n")


@query(_W + f" SELECT event_id, CASE WHEN idx > 3 AND {uniform_sql('event_id', 'late')} < idx / n::DOUBLE THEN 'close and start it.' ELSE 'open it' END AS instruction, least(5, n - idx) AS upto FROM e")
def late_switch(spark: SparkSession, d: str) -> DataFrame:
    """An instruction that changes after a fixed row (the bound is a parameter), and the length of a window cut at the segment's end."""
    said = P.late_instruction(F.col("idx"), F.col("n"), F.lit(3), uniform(F.col("event_id"), "late"), "open it", "close and start it.")
    return _places(spark, d).select("event_id", said.alias("instruction"), F.least(F.lit(5), F.col("n") - F.col("idx")).alias("upto"))


@query(_W + ", t AS (SELECT event_id, user_id, idx, n, unnest([0, 1]) AS half FROM e) SELECT event_id, (2 * idx + half) AS frame, idx >= (idx // 4) * 4 + 2 OR idx >= n - 2 AS carried FROM t")
def temporal_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Each frame of two channel halves becomes two; the last two frames of a chunk of four are carried to the next."""
    return R.halved(_places(spark, d), "idx", "n", 4).select("event_id", "frame", "carried")


@query(f"WITH a AS (SELECT event_id, {uniform_sql('event_id', 'epoch0')} AS u FROM events), b AS (SELECT event_id, {uniform_sql('event_id', 'epoch1')} AS u FROM events) SELECT 0 AS epoch, event_id, row_number() OVER (ORDER BY u, event_id) - 1 AS ordinal FROM a UNION ALL SELECT 1, event_id, row_number() OVER (ORDER BY u, event_id) - 1 FROM b")
def shuffle_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Every epoch has an order of its own."""
    rows = table(spark, d, "events").select("event_id", F.lit(0).alias("all"))
    epoch = lambda e: U.shuffled(rows, ["all"], "event_id", f"epoch{e}").select(F.lit(e).alias("epoch"), "event_id", "ordinal")
    return epoch(0).unionByName(epoch(1))


@query("SELECT p_partkey, 'Mark all ' || p_name || ' in the image with ' || ['red', 'green', 'blue'][p_partkey % 3 + 1] || ' bounding box. Image with marked ' || p_name || ':' AS marked, 'Segment all ' || p_name || ' in the image with gold mask. Image with segmented ' || p_name || ':' AS segmented, p_type AS decoded FROM part")
def region_prompts(spark: SparkSession, d: str) -> DataFrame:
    color = F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.mark_prompt(F.col("p_name"), color).alias("marked"), X.segment_prompt(F.col("p_name"), F.lit("gold")).alias("segmented"), X.decoded(F.encode("p_type", "UTF-8")).alias("decoded"))


@query(r"WITH n AS (SELECT p_partkey, 'model.layers.' || p_partkey % 30 || ['.norm', '.gate_proj', '.action_encoder.0', '.head', '.pos_emb_2'][p_size % 5 + 1] AS name FROM part) SELECT p_partkey, ends_with(name, 'norm') OR ends_with(name, 'action_encoder') OR ends_with(name, 'pos_emb') OR ends_with(regexp_replace(name, '.[0-9]+$', ''), 'norm') OR ends_with(regexp_replace(name, '.[0-9]+$', ''), 'action_encoder') OR ends_with(regexp_replace(name, '.[0-9]+$', ''), 'pos_emb') AS saved FROM n")
def modules_to_save(spark: SparkSession, d: str) -> DataFrame:
    """Names by their endings, with or without trailing digits."""
    tail = F.element_at(F.array(*map(F.lit, (".norm", ".gate_proj", ".action_encoder.0", ".head", ".pos_emb_2"))), (F.col("p_size") % 5 + 1).cast("int"))
    name = F.concat(F.lit("model.layers."), (F.col("p_partkey") % 30).cast("string"), tail)
    return table(spark, d, "part").select("p_partkey", X.ends_with_any(name, ["norm", "action_encoder", "pos_emb"]).alias("saved"))


@query("SELECT conv_id, c.turn, coalesce(p.url, 'blank') AS image, p.url IS NULL AS missing FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id * 3 + c.turn WHERE c.turn IS NOT NULL")
def missing_images(spark: SparkSession, d: str) -> DataFrame:
    """A turn without an image keeps its row, with a blank one."""
    turns = table(spark, d, "conversations").where("turn is not null").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("page_id"))
    return R.with_default(turns, table(spark, d, "pages"), "page_id", "url", "blank", "image").select("conv_id", "turn", "image", "missing")


@query("SELECT conv_id, count(*) FILTER (WHERE turn % 3 = 2) AS n_images FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 3 = 2) > 0")
def stories_with_images(spark: SparkSession, d: str) -> DataFrame:
    """Stories whose list of images is not empty."""
    return R.with_any(table(spark, d, "conversations"), ["conv_id"], F.col("turn") % 3 == 2).withColumnRenamed("n", "n_images")


@query(_W + " SELECT event_id, CASE WHEN idx % ((n + 1) // 2) = (n + 1) // 2 - 1 OR idx = n - 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS last_of_half, CASE WHEN idx = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS after_first FROM e")
def keep_last_of_halves(spark: SparkSession, d: str) -> DataFrame:
    """Weights that keep the last image of the conditional and of the unconditional half, and all frames but the first."""
    return _places(spark, d).select("event_id", P.last_of_halves(F.col("idx"), F.col("n")).alias("last_of_half"), F.when(F.col("idx") == 0, 0.0).otherwise(1.0).alias("after_first"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ': ' || q, chr(10) ORDER BY l_linenumber::VARCHAR) AS state FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def state_dump(spark: SparkSession, d: str) -> DataFrame:
    """A state's entries by key, a line each."""
    from ..operators.config import sorted_state

    summed = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    state = summed.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), F.col("q").cast("string")))).alias("state"))
    return state.select("l_orderkey", sorted_state(F.col("state")).alias("state"))


@query("WITH o AS (SELECT p_partkey, 'layers.' || p_partkey || ['.weight', '.gate', '.expert'][p_partkey % 3 + 1] AS name FROM part), l AS (SELECT 'layers.' || p_partkey || '.weight' AS name, p_retailprice AS v FROM part WHERE p_partkey % 3 = 0) SELECT p_partkey, name, v AS value, v IS NULL AS fresh FROM o LEFT JOIN l USING (name)")
def state_merge(spark: SparkSession, d: str) -> DataFrame:
    """Parameters take the loaded value of their name; only gates and experts may be left fresh, another one fails."""
    part = table(spark, d, "part")
    kind = F.element_at(F.array(F.lit(".weight"), F.lit(".gate"), F.lit(".expert")), (F.col("p_partkey") % 3 + 1).cast("int"))
    own = part.select("p_partkey", F.concat(F.lit("layers."), F.col("p_partkey").cast("string"), kind).alias("name"))
    loaded = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("layers."), F.col("p_partkey").cast("string"), F.lit(".weight")).alias("name"), F.col("p_retailprice").alias("v"))
    return R.merged_state(own, loaded, "name", "v", "gate|expert").select("p_partkey", "name", F.col("v").alias("value"), "fresh")
