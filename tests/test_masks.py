import random

from pyspark.sql import functions as F

from sparrowloom.operators import masks as M


def inside(corners, x, y):
    """Even-odd by crossings above the middle of a pixel."""
    n, hits = len(corners) // 2, 0
    for i in range(n):
        x1, y1, x2, y2 = *corners[2 * i : 2 * i + 2], *corners[2 * ((i + 1) % n) : 2 * ((i + 1) % n) + 2]
        if (x1 <= x + 0.5) != (x2 <= x + 0.5):
            hits += y1 + (x + 0.5 - x1) * (y2 - y1) / (x2 - x1) <= y + 0.5
    return hits % 2 == 1


def cells(rows, keys):
    out = {}
    for r in rows:
        own = out.setdefault(tuple(r[k] for k in keys), set())
        assert r.start < r.stop and not own & set(range(r.start, r.stop))
        own |= set(range(r.start, r.stop))
    return out


def test_polygons_equal_pixels(spark):
    rng = random.Random(1)
    shapes = [[2.0, 2.0, 8.0, 2.0, 8.0, 6.0, 2.0, 6.0], [-5.0, -5.0, 30.0, -5.0, 30.0, 30.0, -5.0, 30.0], [1.0, 1.0, 5.0, 5.0], [], [3.0, 3.0, 3.0, 9.0, 3.0, 5.0], [0.0, 0.0, 9.0, 9.0, 9.0, 0.0, 0.0, 9.0]]
    shapes += [[rng.uniform(-3, 15) for _ in range(2 * rng.randrange(3, 9))] for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(shapes)) + [(99, None)], "i int, c array<double>")
    got = cells(M.polygon_spans(rows, ["i"], "c", F.lit(11), F.lit(9)).collect(), ["i"])
    want = {(i,): {x * 11 + y for x in range(9) for y in range(11) if inside(c, x, y)} for i, c in enumerate(shapes) if len(c) > 4}
    assert got == {k: v for k, v in want.items() if v}


def test_unions_and_runs(spark):
    rng = random.Random(2)
    spans = [(k, i, a := rng.randrange(0, 90), a + rng.randrange(1, 9)) for k in "ab" for i in range(12)] + [("c", 0, 4, 6), ("c", 1, 6, 9), ("c", 2, 6, 9)]
    df = spark.createDataFrame(spans, "image string, i int, start bigint, stop bigint")
    union = M.union_spans(df, ["image"])
    got = cells(union.collect(), ["image"])
    assert got == {(k,): {p for s in spans if s[0] == k for p in range(s[2], s[3])} for k in "abc"}
    assert [tuple(r) for r in union.where("image = 'c'").collect()] == [("c", 4, 9)]
    runs = M.runs_of(union, ["image"], F.lit(100))
    assert all(sum(r.runs) == 100 for r in runs.collect())
    assert cells(M.run_spans(runs, ["image"], "runs").collect(), ["image"]) == got
    assert M.union_spans(df.where("false"), ["image"]).count() == 0
    assert M.run_spans(spark.createDataFrame([(1, []), (2, None), (3, [0, 5, 0, 2])], "k int, r array<int>"), ["k"], "r").count() == 2


def test_tint_equals_pixels(spark):
    pixels = [(1, 0, 7, 10, 200), (1, 7, 20, 90, 5), (2, 0, 20, 1, 2)]
    mask = [(1, 5, 9), (1, 15, 20)]
    got = {}
    for r in M.tint_spans(spark.createDataFrame(pixels, "image int, start bigint, stop bigint, r int, g int"), spark.createDataFrame(mask, "image int, start bigint, stop bigint"), ["image"], ["r", "g"], [255, 101]).collect():
        got |= {(r.image, p): (r.r, r.g) for p in range(r.start, r.stop)}
    for image, start, stop, *own in pixels:
        for p in range(start, stop):
            on = any(image == m[0] and m[1] <= p < m[2] for m in mask)
            assert got.pop((image, p)) == tuple(min(255, round(v + 0.7 * c)) if on else v for v, c in zip(own, (255, 101), strict=True))
    assert not got
