import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from sparrowloom.llm import part_codes as P

ROWS = "vec_id bigint, embedding array<float>, label int"


def test_query_equals_sql(spark, sf_dir, duck):
    same(P.op12_part_codes(spark, sf_dir), duck, P.OP12_SQL)


def by_hand(rows):
    """(sorted (vec_id, code, error, label_error), codebooks_sha256) in Python's integers, every distance computed."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(r[1]) for r in kept) // 8))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in kept]
    parts = [[v[j * width : (j + 1) * width] for v in whole] for j in range(8)]
    books = [p[:16] for p in parts]

    def nearest(j):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[j])) for x in parts[j]]

    for _ in range(6):
        for j in range(8):
            groups = defaultdict(list)
            for x, (_, e) in zip(parts[j], nearest(j), strict=True):
                groups[e].append(x)
            books[j] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[j])]
    found = [nearest(j) for j in range(8)]
    total = defaultdict(int)
    out = []
    for i, r in enumerate(kept):
        error = min(sum(f[i][0] for f in found), P.LONGEST)
        total[r[2]] += error
        out.append((r[0], "".join(f"{f[i][1]:02x}" for f in found), error, r[2]))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((v, c, e, min(total[label], P.LONGEST)) for v, c, e, label in out), key=repr), sha


def result(spark, rows, tmp=None):
    df = spark.createDataFrame(rows, ROWS).withColumn("code", F.lit("clash")).withColumn("error", F.lit(1.5)).repartition(3)
    codes = P.train(df)
    got = P.with_label_errors(P.encode(codes))
    return sorted(((r.vec_id, r.code, min(int(r.error), P.LONGEST), min(int(r.label_error), P.LONGEST)) for r in got.collect()), key=repr), codes.sha256


def vectors(n, width, seed, scale=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (7, width))
    return [[float(np.float32(x)) for x in centres[rng.integers(7)] + rng.normal(0, scale / 6, width)] for _ in range(n)]


def test_odd_rows(spark):
    own = vectors(150, 24, 1)
    rows = [(i * 3 % 151, v, i % 4 if i % 9 else None) for i, v in enumerate(own)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 24, 2), (403, [float("inf")] * 24, None), (-5, [0.5] * 7, 3), (-6, [], None), (None, own[3], 2), (None, own[3], 2)]
    rows += [(7, own[0], 1)] * 90 + [(600 + i, own[1], 1) for i in range(80)]
    assert result(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("case", ["few", "ties", "large", "huge"])
def test_sizes_and_ties(spark, case):
    if case == "few":
        rows = [(i, v, None) for i, v in enumerate(vectors(5, 10, 2))]
    elif case == "ties":
        rows = [(i, [float((i * k) % 3) / 4096 for k in range(16)], 0) for i in range(120)]
    else:
        rows = [(i, [x * (1e9 if case == "large" else 1e37) for x in v], i % 2) for i, v in enumerate(vectors(60, 16, 3))]
    assert result(spark, rows) == by_hand(rows)


def test_tree_prunes_and_changes_nothing():
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (16, 8))
    points = (centres[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(np.int64)
    points[100:900] = points[0]
    for entries in (centres.astype(np.int64), points[:16].copy(), points[:1].copy(), np.repeat(points[:3], 5, axis=0)):
        tree = P.PartTree(points)
        codes, sums, counts, work = P.assign(tree, entries)
        want = P.squared(points[:, None, :] - entries).argmin(axis=1)
        got = np.zeros(len(points), dtype=np.int64)
        got[tree.order] = codes
        assert (got == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        assert (sums == np.stack([points[want == e].sum(axis=0) for e in range(len(entries))])).all()
        assert work["whole"] + work["single"] == len(points)
    assert P.assign(P.PartTree(points), centres.astype(np.int64))[3]["whole"] > 2000


def test_empty_table_and_salted_labels(spark, monkeypatch):
    none = spark.createDataFrame([], ROWS)
    assert P.train(none) is None and P.train(spark.createDataFrame([(1, None, 2)], ROWS)) is None
    coded = spark.createDataFrame([(1, "a", "0", 3), (2, None, "0", 4), (3, None, "1", 5), (4, "a", "2", 6)], "vec_id bigint, label string, code string, error bigint")
    want = sorted(map(tuple, P.with_label_errors(coded).collect()))
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, P.with_label_errors(coded).select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) == sorted(want, key=repr)
    assert {w[0]: int(w[4]) for w in want} == {1: 9, 2: 9, 3: 9, 4: 9}
