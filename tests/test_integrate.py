import math

import numpy as np

from sparrowloom.operators import integrate as I


def test_steps_adapt_and_failures_are_told(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "old"), (2, [3.0], "old"), (3, None, "old"), (4, [], "old"), (5, [0.5, None], "old"), (6, [float("nan")], "old")], "k int, x array<double>, end string")
    got = {r.k: r for r in I.adaptive_ode(rows, "x", lambda x, t: -x * np.cos(20 * t)[:, None], rtol=1e-9, atol=1e-12).collect()}
    factor = math.exp(-math.sin(20) / 20)
    assert all(abs(a - b * factor) < 1e-8 for a, b in zip(got[1].end, (1.0, 2.0), strict=True)) and abs(got[2].end[0] - 3 * factor) < 1e-8
    assert got[1].finished and got[1].rejected > 0 and got[1].taken > 20
    assert got[3].end is None and got[3].finished is None and got[5].end is None
    assert got[4].end == [] and got[4].finished
    assert not got[6].finished
    # Each row has its own step: a stiff row does not slow a smooth one.
    both = I.solve(np.array([[1.0, 1.0], [1.0, 200.0]]), lambda x, t: np.stack([-x[:, 0] * x[:, 1], 0 * x[:, 1]], axis=1), 0, 1, 1e-6, 1e-9, 1000)
    assert both[1][0] * 3 < both[1][1] and both[3].all()
    # dx = x^2 from 2 has no value at time 1.
    blown = {r.k: r for r in I.adaptive_ode(spark.createDataFrame([(1, [2.0]), (2, [0.5])], "k int, x array<double>"), "x", lambda x, t: x * x, tries=60).collect()}
    assert not blown[1].finished and blown[1].taken + blown[1].rejected == 60
    assert blown[2].finished and abs(blown[2].end[0] - 1) < 2e-3


def test_tolerances_bound_the_error():
    x = np.array([[1.0]])
    errors, steps = [], []
    for rtol in (1e-3, 1e-6, 1e-9):
        end, taken, _, _ = I.solve(x, lambda x, t: x * np.sin(5 * t)[:, None], 0, 2, rtol, rtol * 1e-2, 2000)
        errors.append(abs(end[0, 0] / math.exp((1 - math.cos(10)) / 5) - 1))
        steps.append(int(taken[0]))
    assert all(e < 10 * r for e, r in zip(errors, (1e-3, 1e-6, 1e-9), strict=True)) and steps == sorted(steps)
    backwards = I.solve(np.array([[math.e]]), lambda x, t: x, 1, 0, 1e-8, 1e-10, 500)[0]
    assert abs(backwards[0, 0] - 1) < 1e-6
    assert (I.solve(x, lambda x, t: x, 1, 1, 1e-3, 1e-6, 5)[0] == x).all()


def test_likelihood_of_a_coupled_flow(spark):
    """A Jacobian that is not diagonal: many probes come near the trace."""
    a = np.array([[0.3, 0.1], [-0.2, 0.5]])
    rows = spark.createDataFrame([(i, [0.1 * i, -0.2]) for i in range(3)], "k int, x array<double>")
    got = {r.k: r for r in I.flow_likelihood(rows, "x", "k", lambda x, t: x @ a.T, rtol=1e-8, atol=1e-10, probes=400).collect()}
    values, vectors = np.linalg.eig(-a)
    back = (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors)).real
    for i, r in got.items():
        z = back @ np.array([0.1 * i, -0.2])
        assert np.allclose(r.prior_end, z, atol=1e-6) and r.finished
        assert abs(r.logp - (-0.5 * z @ z - math.log(2 * math.pi) - 0.8)) < 0.03
