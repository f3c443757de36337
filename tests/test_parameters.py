"""Parameter groups, experts and spans against plain Python."""

from pyspark.sql import functions as F

from sparrowloom.operators import parameters as N
from sparrowloom.operators import selection as S

NAMES = [("m.l.12.norm", [3, 4]), ("m.l.3.head", [2]), ("m.l.20.a.head.norm", []), ("m.l.13.gate", [5]), ("m.l.x.norm", [7]), ("m.l.14", [1]), ("other", [9]), (None, [2, 2])]


def named(spark):
    return spark.createDataFrame(NAMES, "name string, shape array<bigint>")


def test_groups_and_counts(spark):
    got = sorted((r.name, r.grp, r.rate) for r in N.grouped(named(spark), "name", {"head": 0.5, "norm": 2}).collect())
    assert got == sorted((n, g, r) for n, _ in NAMES for g, r in (("head", 0.5), ("norm", 2.0)) if n and g in n)
    counts = {r.frozen: (r.parameters, r.n) for r in N.counted(named(spark), "name", "shape", ["norm"]).collect()}
    assert counts == {True: (12 + 1 + 7, 3), False: (2 + 5 + 1 + 9, 4), None: (4, 1)}
    assert N.counted(named(spark).limit(0), "name", "shape", ["norm"]).count() == 0


def test_layers_numbered_anew(spark):
    got = {r.name: r.renamed for r in N.renumbered(named(spark), "name", "m.l", "t", 12, ["gate"]).collect()}
    assert got == {"m.l.12.norm": "t.0.norm", "m.l.20.a.head.norm": "t.8.a.head.norm", "m.l.14": "t.2"}
    assert N.renumbered(named(spark), "name", "m.l", "t", 0, []).count() == 5


def test_rates_by_group(spark):
    groups = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    got = {r.g: (r.rate, r.decay) for r in N.scaled(groups, "g", 2.0, 1.0, {"a": 0.5}, {}).collect()}
    assert got == {"a": (1.0, 1.0), "b": (2.0, 1.0), None: (2.0, 1.0)}


def test_experts_and_spans(spark):
    routes = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 1, 1.0)], "row int, expert int, weight double")
    experts = spark.createDataFrame([(0, 4.0), (1, 8.0)], "expert int, gain double")
    assert sorted((r.row, r.output) for r in S.combined(routes, experts, "row", "expert", "weight", "gain").collect()) == [(1, 7.0), (2, 8.0)]
    for spans in ([], [(0, 3)], [(1, 4), (3, 4)], [(3, 4), (1, 4)], [(6, 5), (2, 0)]):
        wanted = {}
        for i, (a, n) in enumerate(spans):
            wanted |= {q: (i + 1, q - a) for q in range(a, min(a + n, 8))}
        made = spark.createDataFrame([(spans,)], "spans array<struct<offset int, length int>>")
        got = made.select(F.explode(S.scattered(F.col("spans"), 8)).alias("s")).select("s.*").collect()
        assert {r.q: (r.span, r.place) for r in got} == wanted and len(got) == len(wanted)
