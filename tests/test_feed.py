import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowloom.operators import feed as E
from sparrowloom.operators import vectors as V

ARM = "struct<position: array<double>, rotation: array<double>, gripper: double>"
FRAMES = f"name string, ep int, index bigint, left {ARM}, right {ARM}, left_time double, right_time double, hertz int, horizon int, instruction string"


def episode(name, ep, n, seed, own_clock=False, still=()):
    rng = np.random.default_rng(seed)
    arms = rng.normal(size=(n, 2, 10))
    for i in still:
        arms[i + 1 :] = arms[i]
    arm = lambda v: (v[:3].tolist(), v[3:9].tolist(), float(v[9]))
    lt = np.cumsum(rng.uniform(0.02, 0.05, n)) if own_clock else np.arange(n) / 30
    rt = np.cumsum(rng.uniform(0.02, 0.05, n)) if own_clock else np.arange(n) / 30
    rows = [(name, ep, i, arm(arms[i, 0]), arm(arms[i, 1]), float(lt[i]) if own_clock else None, float(rt[i]) if own_clock else None, None, None, "pick it up") for i in range(n)]
    return rows, arms, lt, rt


@pytest.fixture(scope="module")
def sets(spark):
    made = {1: episode("atecup", 1, 40, 1, still=(20,)), 2: episode("AIR-AGILEX-HQ", 2, 90, 2, own_clock=True), 3: episode("robomind-agilex", 3, 150, 3)}
    frames = spark.createDataFrame([r for rows, *_ in made.values() for r in rows], FRAMES)
    return made, frames


def test_rows_equal_interpolation(sets):
    """Both arms at their own clocks, against numpy's interpolation."""
    made, frames = sets
    own = {"AIR-AGILEX-HQ": E.Generator(relative=(0, 12)), "robomind-agilex": E.Generator(left=lambda: F.concat(F.col("left.position"), F.col("left.rotation"), F.array(F.col("left.gripper"))), candidate=lambda: F.col("index") % 50 == 10)}
    whole = E.frames_of(frames, "name", ["ep"], own)
    got = {(r.ep, r["index"]): r for r in E.sample_rows(whole, ["ep"], 4, own).collect()}
    arms = {}
    for r in whole.collect():
        arms.setdefault(r.ep, []).append((r["index"], r.left, r.right))
    for ep, (_, _, lt, rt) in made.items():
        own_arms = sorted(arms[ep])
        left, right = (np.array([a[i] for a in own_arms]) for i in (1, 2))
        n, hertz, horizon = len(lt), 30, {1: 1, 2: 2, 3: 4}[ep]
        ref = (lt + rt) / 2
        picked = {1: range(0, n - 10), 2: range(0, n - 60), 3: range(10, n, 50)}[ep]
        kept = set()
        for i in picked:
            q = np.linspace(ref[i], min(ref[i] + horizon, ref.max()), 5)
            path = np.stack([np.interp(q, t, v[:, j]) for t, v in ((lt, left), (rt, right)) for j in range(10)], axis=1)
            if np.abs(path[1] - path[0]).max() < 1e-5:
                continue
            kept.add(i)
            r = got[ep, i]
            action = path[1:].copy()
            if ep == 2:
                action[:, [0, 12]] -= path[0, [0, 12]]
            assert np.allclose(r.proprio, path[0]) and np.allclose(r.action, action)
            assert r.future_index == int(min(i + horizon * hertz, ref.max() * hertz) + 1e-9)
        assert {i for e, i in got if e == ep} == kept and kept
    assert not any(e == 1 and i > 20 for e, i in got)


def test_registry_and_collation(spark, sets, monkeypatch):
    _, frames = sets
    monkeypatch.setattr(E, "GENERATORS", {})
    E.register_generator("atecup", E.Generator(instruction=lambda: F.concat(F.col("instruction"), F.lit(" now"))))
    for bad in (("no such set", E.Generator()), ("atecup", E.Generator(collate={"tokens": "sum"}))):
        with pytest.raises(KeyError):
            E.register_generator(*bad)
    domains = spark.createDataFrame([("atecup", 7)], "name string, domain int")
    rows = E.training_rows(frames, "name", ["ep"], domains, lambda t: F.transform(F.split(t, " "), lambda w: F.length(w)), 4, 3, 40, seed="s")
    got = rows.collect()
    assert {r.instruction for r in got if r.set == "atecup"} == {"pick it up now"} and {r.domain for r in got} == {0, 7}
    assert all(len(r.tokens) == len(r.labels) == 40 and len(r.proprio) == 20 and len(r.action) == 4 for r in got)
    assert sorted(r.place for r in got) != [r.place for r in sorted(got, key=lambda r: (r.ep, r["index"]))]
    batches = E.collate_by(rows.withColumn("b", F.col("index") % 3), "b", "place").collect()
    assert sum(len(b.tokens) for b in batches) == len(got) and all(len(b.instruction) == len(b.proprio) for b in batches)
    ragged = spark.createDataFrame([(0, 1, [1]), (0, 2, [1, 2])], "b int, o int, v array<int>")
    assert E.collate_by(ragged, "b", "o", {"v": "list"}).first().v == [[1], [1, 2]]
    with pytest.raises(Exception, match="differ in size"):
        E.collate_by(ragged, "b", "o", {"v": "stack"}).collect()


def test_slices_and_stillness(spark):
    one = spark.range(1).select(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(2.000001))).alias("t"), F.array(F.array(F.lit(1.0))).alias("short"))
    assert one.select(V.still(F.col("t")).alias("s")).first().s is False
    r = one.select(V.action_slice(F.col("t"), F.array(F.lit(0))).alias("a")).first().a
    assert r.proprio == [1.0, 2.0] and r.action == [[3.0, 2.000001]]
    with pytest.raises(Exception, match="two vectors"):
        one.select(V.action_slice(F.col("short"), F.array(F.lit(0)))).collect()


def test_points_are_dealt_by_their_own_size(spark):
    """Points and samples that lie by series already are shuffled once more, so that tasks are sized by what they sort."""
    samples = spark.range(60).select((F.col("id") % 3).alias("ep"), F.col("id").cast("double").alias("t"), F.array(F.col("id").cast("double")).alias("v")).repartition("ep")
    points = V.look_ahead(samples.withColumn("last", F.max("t").over(Window.partitionBy("ep"))), ["ep"], "t", F.lit(1.5), F.col("last"), 2)
    found = V.interpolate(samples, points, ["ep"], {"v": "t"})
    plan = found._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert "Exchange" in plan and found.columns == [*points.columns, "v"]
    assert all(abs(r.v[0] - min(r["at"], 57.0 + r.ep)) < 1e-9 for r in found.collect())
