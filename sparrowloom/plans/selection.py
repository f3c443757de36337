"""Selection, routing, masks and losses on embeddings, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions.hashing import uniform, uniform_sql
from ..operators import metrics as M
from ..operators import selection as S
from ..operators.mixing import global_ordinal
from ..session import table
from .registry import query


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("x"))


_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


@query(_V + ", r AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(x) AS v FROM v), k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS rk FROM r) SELECT vec_id, string_agg(i::VARCHAR, ' ' ORDER BY i) AS kept FROM k WHERE rk <= 8 GROUP BY vec_id")
def topk_ties(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.array_join(F.transform(S.topk_keep(F.col("x"), 8), lambda i: i.cast("string")), " ").alias("kept"))


@query(_V + """, r AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(x) AS v FROM v),
w AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS w FROM r), p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w),
c AS (SELECT vec_id, i, p, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT vec_id, i::INT AS idx, round(p, 6) AS prob FROM c WHERE before <= 0.2""")
def topp_nucleus(spark: SparkSession, d: str) -> DataFrame:
    long = _vectors(spark, d).select("vec_id", F.posexplode("x").alias("idx", "v"))
    return S.nucleus(long, "vec_id", "idx", "v", 0.2).select("vec_id", "idx", F.round("prob", 6).alias("prob"))


_ROUTE = _V + """, s AS (SELECT vec_id, label, [exp(e) FOR e IN x[1:8]] AS w FROM v), q AS (SELECT vec_id, label, [e / list_sum(w) FOR e IN w] AS p FROM s),
r AS (SELECT vec_id, label, unnest(range(0, 8)) AS expert, unnest(p) AS p FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rk FROM r)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", "label", V.softmax(F.slice("x", 1, 8)).alias("probs")).withColumn("routes", S.route(F.col("probs"), 2))


@query(_ROUTE + " SELECT vec_id, expert::INT AS expert, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS weight FROM k WHERE rk <= 2")
def moe_route(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("vec_id", F.explode("routes").alias("r")).select("vec_id", "r.expert", F.round("r.weight", 6).alias("weight"))


@query(_ROUTE + ", n AS (SELECT count(*) AS n FROM v), c AS (SELECT expert, count(*) FILTER (WHERE rk <= 2) AS sent, avg(p) AS p FROM k GROUP BY expert) SELECT round(sum(sent / n::DOUBLE * p) * 8, 6) AS loss FROM c, n")
def moe_balance_loss(spark: SparkSession, d: str) -> DataFrame:
    routed = _routed(spark, d).select("probs", F.transform("routes", lambda r: r["expert"]).alias("picks"))
    return M.balance_loss(routed, 8, 2).select(F.round("loss", 6).alias("loss"))


@query(_ROUTE + ", w AS (SELECT vec_id, expert, p / sum(p) OVER (PARTITION BY vec_id) AS weight FROM k WHERE rk <= 2) SELECT vec_id, round(sum(weight * (expert + 1) * 0.5), 6) AS output FROM w GROUP BY vec_id")
def moe_combine(spark: SparkSession, d: str) -> DataFrame:
    """Tokens joined with their experts' parameters, and the weighted outputs summed."""
    experts = spark.range(8).select(F.col("id").cast("int").alias("expert"), ((F.col("id") + 1) * 0.5).alias("gain"))
    routes = _routed(spark, d).select("vec_id", F.explode("routes").alias("r")).select("vec_id", "r.expert", "r.weight")
    return S.combined(routes, experts, "vec_id", "expert", "weight", "gain").select("vec_id", F.round("output", 6).alias("output"))


@query(_V + ", w AS (SELECT label, [0.1 * (label + i) FOR i IN range(0, 64)] AS w, label * 0.5 AS b FROM (SELECT DISTINCT label FROM v)) SELECT vec_id, round(list_dot_product(x, w::DOUBLE[]) + b, 6) AS y FROM v JOIN w USING (label)")
def domain_linear(spark: SparkSession, d: str) -> DataFrame:
    """A weight vector for each domain, joined by domain id: x . W + b."""
    x = _vectors(spark, d)
    domains = x.select("label").distinct().select("label", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("label") + i) * 0.1).alias("w"), (F.col("label") * 0.5).alias("b"))
    return x.join(domains, "label").select("vec_id", F.round(V.dot(F.col("x"), F.col("w")) + F.col("b"), 6).alias("y"))


_C = "WITH c AS (SELECT user_id, 'checkpoint-' || (event_id * 37 % 100000) AS name, event_id * 37 % 100000 AS step FROM events)"


def _checkpoints(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("event_id") * 37 % 100000
    return table(spark, d, "events").select("user_id", F.concat(F.lit("checkpoint-"), step.cast("string")).alias("name"), step.alias("step"))


@query(_C + " SELECT user_id, arg_max(name, step) AS latest, max(step) AS step FROM c GROUP BY user_id")
def ckpt_latest(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_step(_checkpoints(spark, d), ["user_id"], "name")


@query(_C + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS rk FROM c) SELECT user_id, name, step FROM r WHERE rk > 4")
def ckpt_retention(spark: SparkSession, d: str) -> DataFrame:
    return S.retire(_checkpoints(spark, d), ["user_id"], "step", 5)


@query(_C + ", m AS (SELECT 'layer' || (step % 50) AS k, step / 3.0::DOUBLE AS v, name FROM c) SELECT k, arg_max(v, name) AS v FROM (SELECT k, max(v) AS v, name FROM m GROUP BY k, name) GROUP BY k")
def ckpt_merge_last_file(spark: SparkSession, d: str) -> DataFrame:
    """Of a parameter in several files the one of the last file by name."""
    rows = _checkpoints(spark, d).select(F.concat(F.lit("layer"), (F.col("step") % 50).cast("string")).alias("k"), (F.col("step") / F.lit(3.0)).alias("v"), "name")
    return rows.groupBy("k").agg(F.max_by("v", F.struct("name", "v")).alias("v"))


@query("SELECT doc_id, array_to_string([floor(k * (n_chars - 1) / 3)::INT FOR k IN range(0, 4)], ' ') AS frames FROM documents")
def frame_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(S.frame_indices(F.col("n_chars"), 4), lambda i: i.cast("string")), " ").alias("frames"))


@query("WITH t AS (SELECT doc_id, [CASE WHEN length(w) < 4 THEN 0 ELSE length(w) END FOR w IN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')] AS k FROM documents) SELECT doc_id, coalesce(list_max([i FOR i IN range(0, len(k)) IF k[i + 1] <> 0]), 0)::INT AS last, len(k[1:least(16, coalesce(list_min([i + 1 FOR i IN range(0, len(k)) IF k[i + 1] IN (9, 11)]), 16))]) AS n_until FROM t")
def sequence_ends(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import words

    k = F.transform(words(F.col("text")), lambda w: F.when(F.length(w) < 4, 0).otherwise(F.length(w)))
    return table(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", S.last_real_token(F.col("k"), 0).alias("last"), F.size(S.until_stop(F.col("k"), [9, 11], 16)).cast("bigint").alias("n_until"))


@query(f"""
WITH w AS (SELECT c_mktsegment AS name, sum(greatest(c_acctbal, 0)) AS weight FROM customer GROUP BY 1), c AS (SELECT name, sum(weight) OVER (ORDER BY name) / sum(weight) OVER () AS cum FROM w),
u AS (SELECT doc_id, {uniform_sql('doc_id', 'pick')} AS u FROM documents)
SELECT doc_id, arg_min(name, cum) AS name FROM u JOIN c ON cum >= u GROUP BY doc_id
""")
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("weight"))
    draws = table(spark, d, "documents").select("doc_id", uniform(F.col("doc_id"), "pick").alias("u"))
    return S.weighted_choice(draws, weights, "u", "name", "weight").select("doc_id", "name")


@query("SELECT event_type, round(sum(value * (1 + event_id % 4)) / sum(1 + event_id % 4), 6) AS avg, round(arg_max(value, event_id), 6) AS val, sum(1 + event_id % 4)::BIGINT AS count FROM events GROUP BY 1")
def meter_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "value", (1 + F.col("event_id") % 4).alias("n"))
    m = M.weighted_mean(rows, ["event_type"], "value", "n", "event_id")
    return m.select("event_type", F.round("avg", 6).alias("avg"), F.round("val", 6).alias("val"), F.col("count").cast("bigint").alias("count"))


@query("SELECT event_id, sum(round(value * 100)::BIGINT * (1 + event_id % 4)) OVER w::DOUBLE / sum(1 + event_id % 4) OVER w::DOUBLE AS avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def meter_running_mean(spark: SparkSession, d: str) -> DataFrame:
    """Over whole hundredths, whose sums are exact in any order."""
    rows = table(spark, d, "events").withColumns({"n": 1 + F.col("event_id") % 4, "cents": F.round(F.col("value") * 100).cast("bigint")})
    return rows.select("event_id", M.running_mean("cents", "n", ["user_id"], ["ts", "event_id"]).alias("avg"))


@query("SELECT event_id // 100 AS log_step, round(avg(value), 6) AS avg, count(*) AS n FROM events GROUP BY 1")
def meter_log_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.expr("event_id div 100").alias("log_step")).agg(F.round(F.avg("value"), 6).alias("avg"), F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS episodes, sum(quality)::BIGINT AS successes, round(sum(quality) / greatest(count(*), 1)::DOUBLE, 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source, lang)")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    episodes = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return M.success_rates(episodes, "source", "lang", "quality").withColumn("rate", F.round("rate", 6))


_PAIR = _V + ", o AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM v), p AS (SELECT a.vec_id, a.label, a.x, b.x AS y FROM o a JOIN o b ON b.o = (a.o + 1) % (SELECT count(*) FROM v))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one (the last with the first), by an equi-join on the shifted place."""
    v = _placed(spark, d)
    n = v.agg(F.count("*").alias("n"))
    keyed = v.join(F.broadcast(n)).withColumn("other", (F.col("ordinal") + 1) % F.col("n")).drop("n")
    return keyed.join(v.select(F.col("ordinal").alias("other"), F.col("x").alias("y")), "other").select("vec_id", "label", "x", "y")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors numbered by id without gaps."""
    return global_ordinal(_vectors(spark, d).withColumn("all", F.lit(0)), ["all"], [F.col("vec_id")], F.floor(F.col("vec_id") / 4096)).drop("all")


@query(_PAIR + ", r AS (SELECT label, unnest(x) AS a, unnest(y) AS b, unnest(range(0, 64)) AS i FROM p) SELECT label, round(avg((a - b) * (a - b)) FILTER (WHERE i % 3 <> 0), 6) AS mse FROM r GROUP BY label")
def masked_mse(spark: SparkSession, d: str) -> DataFrame:
    long = _pairs(spark, d).select("label", F.posexplode(F.arrays_zip("x", "y")).alias("i", "s"))
    return long.groupBy("label").agg(F.round(M.masked_mse(F.col("s.x"), F.col("s.y"), F.col("i") % 3 != 0), 6).alias("mse"))


@query(_PAIR + " SELECT vec_id, round(-ln(greatest(1e-4, least(0.9999, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))))), 6) AS loss FROM p")
def cosine_distill(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(M.cosine_distillation(F.col("x"), F.col("y")), 6).alias("loss"))


@query(_PAIR + """, q AS (SELECT vec_id, x, [CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END FOR e IN y]::DOUBLE[] AS b, y FROM p)
SELECT vec_id, round(list_avg([(x[i + 1] - y[i + 1]) ** 2 FOR i IN [0, 1, 2, 10, 11, 12]]) * 500, 6) AS "position", round(list_avg([(x[i + 1] - y[i + 1]) ** 2 FOR i IN [3, 4, 5, 6, 7, 8, 13, 14, 15, 16, 17, 18]]) * 10, 6) AS rotation,
  round(list_avg([greatest(x[i + 1], 0) - x[i + 1] * b[i + 1] + ln(1 + exp(-abs(x[i + 1]))) FOR i IN [9, 19]]), 6) AS gripper FROM q""")
def action_loss(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    target = F.transform("y", lambda e, i: F.when(i.isin(9, 19), (e > 0).cast("double")).otherwise(e))
    terms = p.select("vec_id", M.action_loss_terms(F.col("x"), target).alias("t"))
    return terms.select("vec_id", *[F.round(f"t.{c}", 6).alias(c) for c in ("position", "rotation", "gripper")])


@query(_V + " SELECT vec_id, round(-0.5::DOUBLE * 1.8378770664093453::DOUBLE * 64 - list_dot_product(x, x) / 2, 6) AS logp, round(ln(list_sum([exp(e) FOR e IN x])), 6) AS lse, round(list_avg(x), 6) AS mean FROM v")
def prior_logp(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, d).select("vec_id", F.round(M.prior_log_density(x), 6).alias("logp"), F.round(V.log_sum_exp(x), 6).alias("lse"), F.round(V.mean(x), 6).alias("mean"))


@query(_V + ", t AS (SELECT vec_id, x, lead(label) OVER (ORDER BY vec_id) AS nxt FROM v WHERE vec_id // 50 >= 0), u AS (SELECT vec_id, x[1:10] AS x, CASE WHEN nxt % 4 = 0 THEN -100 ELSE nxt END AS nxt FROM t) SELECT round(avg(ln(list_sum([exp(e) FOR e IN x])) - x[nxt + 1]), 6) AS loss, count(*) AS n FROM u WHERE nxt IS NOT NULL AND nxt <> -100")
def next_token_ce(spark: SparkSession, d: str) -> DataFrame:
    """Labels shifted by one, -100 ignored; the neighbour comes by an equi-join on the place, not a global window."""
    v = _placed(spark, d)
    nxt = v.select((F.col("ordinal") - 1).alias("ordinal"), F.when(F.col("label") % 4 == 0, -100).otherwise(F.col("label")).alias("nxt"))
    kept = v.select("ordinal", F.slice("x", 1, 10).alias("x")).join(nxt, "ordinal").where("nxt <> -100")
    return kept.agg(F.round(F.avg(V.log_sum_exp(F.col("x")) - F.element_at("x", F.col("nxt") + 1)), 6).alias("loss"), F.count("*").alias("n"))


_SPANS = "WITH s AS (SELECT vec_id, label + 3 AS a, 8 AS n, label * 2 + 20 AS b, 15 AS m FROM embeddings), q AS (SELECT *, unnest(range(0, 48)) AS q FROM s)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(F.struct((F.col("label") + 3).alias("offset"), F.lit(8).alias("length")), F.struct((F.col("label") * 2 + 20).alias("offset"), F.lit(15).alias("length")))
    return table(spark, d, "embeddings").select("vec_id", spans.alias("spans"))


@query(_SPANS + ", k AS (SELECT *, unnest(range(0, 48)) AS k FROM q) SELECT vec_id, q::INT AS q, count(*) AS allowed FROM k WHERE k <= q OR (q BETWEEN a AND a + n - 1 AND k BETWEEN a AND a + n - 1) OR (q BETWEEN b AND b + m - 1 AND k BETWEEN b AND b + m - 1) GROUP BY ALL")
def mask_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Keys that each position may see: those up to itself, and the rest of the span it lies in (clipped).

    Counted from the spans' ends, in the row: no product of positions.
    """
    q = _spans(spark, d).select("vec_id", "spans", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("q"))
    reach = F.transform("spans", lambda s: F.when((F.col("q") >= s["offset"]) & (F.col("q") < s["offset"] + s["length"]), F.least(s["offset"] + s["length"], F.lit(48)) - 1).otherwise(F.col("q")))
    return q.select("vec_id", "q", (F.greatest(F.array_max(reach), F.col("q")) + 1).cast("bigint").alias("allowed"))


@query("WITH q AS (SELECT vec_id, unnest(range(0, 20)) AS q FROM embeddings), k AS (SELECT *, unnest(range(0, 20)) AS k FROM q) SELECT vec_id, q::INT AS q, count(*) FILTER (WHERE k <= q) AS causal, count(*) FILTER (WHERE k BETWEEN q - 4 AND q) AS banded FROM k GROUP BY ALL")
def mask_causal(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("q"))
    return q.select("vec_id", "q", (F.col("q") + 1).cast("bigint").alias("causal"), F.least(F.col("q") + 1, F.lit(5)).cast("bigint").alias("banded"))


@query(_SPANS + " SELECT vec_id, q::INT AS q, CASE WHEN q BETWEEN b AND b + m - 1 THEN 2 WHEN q BETWEEN a AND a + n - 1 THEN 1 END AS span, CASE WHEN q BETWEEN b AND b + m - 1 THEN q - b WHEN q BETWEEN a AND a + n - 1 THEN q - a END::INT AS place FROM q WHERE q BETWEEN a AND a + n - 1 OR q BETWEEN b AND b + m - 1")
def span_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Span values written to their positions; of overlapping spans the later one wins."""
    return _spans(spark, d).select("vec_id", F.explode(S.scattered(F.col("spans"), 48)).alias("s")).select("vec_id", "s.q", "s.span", "s.place")


@query("SELECT l.doc_id, count(*) AS n FROM labels l JOIN documents USING (doc_id) GROUP BY 1 HAVING count(*) >= 1")
def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT event_id // 4 AS step, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1")
def accumulate_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.expr("event_id div 4").alias("step")).agg(F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, ts, event_id, value < 1 AS noop, event_type = 'purchase' AS done FROM events) SELECT user_id, count(*) AS replays, count(*) FILTER (WHERE noop) AS noops, count(*) FILTER (WHERE done) AS successes, round(100.0::DOUBLE * count(*) FILTER (WHERE done) / count(*), 6) AS percent FROM e GROUP BY 1")
def replay_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    noops, done = F.count(F.when(F.col("value") < 1, 1)), F.count(F.when(F.col("event_type") == "purchase", 1))
    return e.groupBy("user_id").agg(F.count("*").alias("replays"), noops.alias("noops"), done.alias("successes"), F.round(F.lit(100.0) * done / F.count("*"), 6).alias("percent"))


