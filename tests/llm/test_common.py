import random

from sparrowloom.llm.common import connected_components, cut, drop_cut


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(-5, 7), (7, 7), (900, 900)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_cut_and_drop(spark):
    made = cut(spark.range(5), "test")
    assert sorted(r.id for r in made.collect()) == list(range(5))
    drop_cut(made)
    drop_cut(spark.range(1))
