import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowloom.operators import linear as N


@pytest.mark.parametrize("broadcast", [True, False])
def test_products_of_many_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(N, "INPUTS", 5)
    monkeypatch.setattr(N, "OUTPUTS", 4)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 10**6 if broadcast else 0)
    rng = np.random.default_rng(1)
    sizes = {0: (13, 9), 1: (4, 4), None: (5, 1)}
    w = {k: rng.normal(size=s) for k, s in sizes.items()}
    b = {k: rng.normal(size=s[1]) for k, s in sizes.items()}
    weights = spark.createDataFrame([(k, i, o, float(m[i, o])) for k, m in w.items() for i in range(m.shape[0]) for o in range(m.shape[1])], "domain int, i int, o int, w double")
    bias = spark.createDataFrame([(k, o, float(v)) for k, m in b.items() for o, v in enumerate(m)], "domain int, o int, b double")
    x = {n: (k, rng.normal(size=sizes[k][0])) for n, k in enumerate([0, 0, 0, 1, None, 0])}
    rows = spark.createDataFrame([(n, k, v.tolist(), "clash") for n, (k, v) in x.items()] + [(90, 0, None, ""), (91, 7, [1.0], "")], "n int, kind int, x array<double>, y string")
    got = {r.n: r.y for r in N.domain_product(rows, ["n"], "x", "kind", weights, bias).collect()}
    for n, (k, v) in x.items():
        assert np.allclose(got[n], v @ w[k] + b[k])
    assert got[90] is None and got[91] is None and len(got) == 8
    plain = N.domain_product(rows.where("n = 3"), ["n"], "x", "kind", weights).first()
    assert np.allclose(plain.y, x[3][1] @ w[1])
    lists = spark.createDataFrame([(1, 0, [x[0][1].tolist(), x[1][1].tolist(), None]), (2, 1, []), (3, 1, None)], "n int, kind int, xs array<array<double>>")
    got = {r.n: r.y for r in N.domain_sequences(lists, ["n"], "xs", "kind", weights, bias).collect()}
    assert np.allclose(got[1][0], x[0][1] @ w[0] + b[0]) and np.allclose(got[1][1], x[1][1] @ w[0] + b[0]) and got[1][2] is None
    assert got[2] == [] and got[3] is None


def kernel(d, a=-0.75):
    d = abs(d)
    return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0.0


@pytest.mark.parametrize("new", [(7, 9), (3, 2), (4, 6), (1, 1)])
def test_resampling_equals_the_formula(spark, new):
    rng = np.random.default_rng(2)
    old = rng.normal(size=(4, 6))
    rows = spark.createDataFrame([("g", y, x, float(old[y, x])) for y in range(4) for x in range(6)], "k string, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in N.resample(rows, ["k"], "v", (4, 6), new).collect()}
    assert len(got) == new[0] * new[1]
    for (y, x), value in got.items():
        sy, sx = (y + 0.5) * 4 / new[0] - 0.5, (x + 0.5) * 6 / new[1] - 0.5
        want = 0.0
        for i in range(-1, 3):
            for j in range(-1, 3):
                py, px = int(np.floor(sy)) + i, int(np.floor(sx)) + j
                want += old[min(3, max(0, py)), min(5, max(0, px))] * kernel(sy - py) * kernel(sx - px)
        assert abs(value - want) < 1e-9


def test_weights_sum_to_one(spark):
    for old, new in ((8, 11), (16, 5), (3, 3)):
        sums = N.axis_weights(spark, old, new).groupBy("out").agg(F.sum("weight").alias("s"))
        assert sums.count() == new and sums.where("abs(s - 1) > 1e-12").count() == 0
