"""Series, story and state operators and sample expressions against plain Python."""

import pytest
from pyspark.sql import functions as F

from sparrowloom.functions import samples as S
from sparrowloom.operators import selection as C
from sparrowloom.operators import series as R

SERIES = [("a", i, float(v), float(w)) for i, (v, w) in enumerate([(1, 1), (1.1, 1), (3, 1), (3, 9), (3, 9), (3.2, 9.1)])] + [("b", 0, 5.0, 5.0), (None, 0, 1.0, 1.0), (None, 1, None, 1.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(SERIES, "k string, t int, x double, y double")


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_places_start_again_without_the_first_rows(rows):
    got = R.without_first(R.placed(rows, ["k"], ["t"], n="n"), "idx", 2).collect()
    assert sorted((r.k, r.t, r.idx, r.n) for r in got) == [("a", t, t - 2, 6) for t in range(2, 6)]


def test_only_the_last_row_keeps_its_values(rows):
    got = {(r.k, r.t): (r.vx, r.vy, r.time) for r in R.only_last(rows, ["k"], ["t"], {"vx": F.col("x"), "vy": F.col("y")}, "time", F.lit(0.5)).collect()}
    last = {"a": 5, "b": 0, None: 1}
    assert got == {(k, t): (x, y, 0.5) if t == last[k] else (0.0, 0.0, 1.0) for k, t, x, y in SERIES}


def test_static_only_where_every_column_rests(rows):
    got = {(r.k, r.t): r.still for r in rows.withColumn("still", R.near_static(["x", "y"], ["k"], ["t"], 0.5)).collect()}
    assert {k for k, still in got.items() if still} == {("a", 0), ("a", 3), ("a", 4)}
    single = {(r.k, r.t) for r in rows.withColumn("still", R.near_static(["x"], ["k"], ["t"], 0.5)).where("still").collect()}
    assert single == {("a", 0), ("a", 2), ("a", 3), ("a", 4)}


def test_success_is_read_from_the_last_row(spark):
    made = spark.createDataFrame([(1, 0, "done"), (1, 1, "open"), (2, 0, "open"), (2, 1, "done"), (3, 0, None)], "k int, t int, s string")
    assert [r.k for r in R.successful(made, ["k"], "t", "s", "done").collect()] == [2]


@pytest.mark.parametrize("size", [2, 4, 5])
def test_chunks_and_halves(spark, size):
    for n in (1, 2, 9, 12):
        rows = spark.range(n).select(F.col("id").alias("idx"), F.lit(n).alias("n"))
        whole = size * ((n - 1) // size)
        assert sorted((r.idx, r.chunk) for r in R.in_chunks(rows, "idx", "n", size).collect()) == [(i, 0 if i == 0 else 1 + (i - 1) // size) for i in range(n) if i <= whole]
        halves = sorted((r.frame, r.carried) for r in R.halved(rows, "idx", "n", size).collect())
        assert halves == [(f, f // 2 % size >= size - 2 or f // 2 >= n - 2) for f in range(2 * n)]


def test_defaults_and_groups(spark):
    turns = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "turn int, page int")
    pages = spark.createDataFrame([(7, "u", 1), (9, "v", 2)], "page int, url string, turn int")
    got = R.with_default(turns, pages, "page", "url", "none", "image").collect()
    assert sorted((r.turn, r.image, r.missing) for r in got) == [(1, "u", False), (2, "none", True), (3, "none", True)]
    assert [(r.page, r.n) for r in R.with_any(turns, ["page"], F.col("turn") >= 3).collect()] == [(None, 1)]
    assert R.with_any(turns.limit(0), ["page"], F.lit(True)).count() == 0


def test_states_take_loaded_values_and_only_some_may_be_fresh(spark):
    own = spark.createDataFrame([("a.w",), ("b.gate",)], "name string")
    loaded = spark.createDataFrame([("a.w", 1.5), ("c.w", 2.0)], "name string, v double")
    assert sorted((r.name, r.v, r.fresh) for r in R.merged_state(own, loaded, "name", "v", "gate").collect()) == [("a.w", 1.5, False), ("b.gate", None, True)]
    with pytest.raises(Exception, match="no value for b.gate"):
        R.merged_state(own, loaded, "name", "v", "expert").collect()


def test_images(spark):
    modes = spark.createDataFrame([("RGBA", 10, 10), ("P", 9, 10), ("L", 10, None), ("CMYK", 10, 10), (None, 10, 10)], "m string, h int, w int")
    got = [(r.a, r.b) for r in modes.select(S.mode_action(F.col("m")).alias("a"), S.large_enough(F.col("h"), F.col("w"), 10, 10).alias("b")).collect()]
    assert got == [("flatten", True), ("flatten", False), ("repeat", False), (None, True), (None, True)]


def test_draws(spark):
    p = F.array(F.lit(0.25), F.lit(0.0), F.lit(0.5), F.lit(0.25))
    assert list(one(spark, *[S.multinomial(p, F.lit(u)) for u in (0.0, 0.25, 0.26, 0.75, 0.9, 1.0, 1.1)])) == [0, 0, 2, 2, 3, 3, 3]
    assert list(one(spark, S.dropped_condition(F.lit("x"), F.lit(0.1), 0.1), S.dropped_condition(F.lit("x"), F.lit(0.09), 0.1), S.dropped_condition(F.lit(None).cast("string"), F.lit(0.5), 0.1))) == ["x", "", None]
    say = lambda i, u: S.late_instruction(F.lit(i), F.lit(10), F.lit(3), F.lit(u), "a", "b")
    assert list(one(spark, say(3, 0.0), say(4, 0.39), say(4, 0.4), say(9, 0.89))) == ["a", "b", "a", "b"]
    assert list(one(spark, S.cyclic_state(F.lit(43), 20), S.cyclic_state(F.lit(-1), 20))) == [3, 19]


def test_vectors(spark):
    x = F.array(*[F.lit(v) for v in (3.0, 4.0, 0.0)])
    z = F.array(*[F.lit(v) for v in (1.0, 2.0, 8.0)])
    got = one(spark, S.noisy(x, z, F.lit(0.25), (1,)), S.rms_modulated(x, 1.0, 0.5, 0.0), S.standardised(x, z, z), S.initial_latents(x, z, 1), S.sampled_at(x, F.lit(0.5)), S.sampled_at(x, F.lit(2.0)), S.sampled_at(x, F.lit(2.5)))
    rms = (25 / 3) ** 0.5
    assert got.c0 == [2.5, 0.0, 2.0]
    assert got.c1 == pytest.approx([3 / rms * 2 + 0.5, 4 / rms * 2 + 0.5, 0.5])
    assert got.c2 == [2.0, 1.0, -1.0]
    assert [(s.latent, s.time) for s in got.c3] == [(3.0, 1.0), (2.0, 0.0), (8.0, 0.0)]
    assert [got.c4, got.c5, got.c6] == [3.5, 0.0, None]
    for n in (1, 2, 5, 6):
        half = (n + 1) // 2
        marks = [r[0] for r in spark.range(n).select(S.last_of_halves(F.col("id"), F.lit(n))).collect()]
        assert marks == [float(i % half == half - 1 or i == n - 1) for i in range(n)]


def test_substitutes_by_name(spark):
    rows = spark.createDataFrame([(i, name) for i in range(300) for name in ("say", "keep", None, "none")], "i int, name string")
    others = spark.createDataFrame([("say", ["x", "y", "z"]), ("none", [])], "name string, to array<string>")
    got = C.substituted(rows, others, "name", "name", "to", F.col("i"), "s").collect()
    assert len(got) == 1200 and {r.name for r in got} == {"x", "y", "z", "keep", None, "none"}
    assert all(60 < sum(r.name == v for r in got) < 140 for v in "xyz")
