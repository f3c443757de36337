import random

import pytest
from pyspark.sql import functions as F

from sparrowloom.operators import packing
from sparrowloom.operators.packing import pack


def loop(sizes, most):
    """Shards by their rows, in the order in which a sequential loop closes them."""
    out, open_, held = [], [], 0
    for i, size in enumerate(sizes):
        size = size or 0
        if size > most:
            out.append([i])
            continue
        if held + size > most:
            out.append(open_)
            open_, held = [], 0
        open_.append(i)
        held += size
    return out + ([open_] if open_ else [])


@pytest.mark.parametrize("sizes, most", [([6, 6, 6, 6], 10), ([3, 100, 3, 100, 3], 10), ([0, 0, None, 10, 0, 1], 10), ([5, 5, 5, 5], 10), ([10, 10, 0, 10], 10), ([], 5)])
def test_small_cases(spark, sizes, most):
    assert shards(spark, sizes, most) == loop(sizes, most)


def shards(spark, sizes, most):
    rows = spark.createDataFrame([(f"p{i:05d}", s, "clash", "clash") for i, s in enumerate(sizes)], "name string, size int, ordinal_ string, shard string").repartition(3)
    got = {}
    for r in pack(rows, ["name"], "size", most).collect():
        got.setdefault(r.shard, []).append(int(r.name[1:]))
    assert sorted(got) == list(range(len(got)))
    return [sorted(got[k]) for k in sorted(got)]


def test_random_sizes_equal_a_loop(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 1, 2, 5, rng.randrange(1, 60), rng.randrange(1, 140)]) for _ in range(400)]
    assert shards(spark, sizes, 100) == loop(sizes, 100)


@pytest.mark.parametrize("stretch, most", [(1, 100), (8, 100), (40, 140), (8, 3000)])
def test_stretches_of_stretches(spark, monkeypatch, stretch, most):
    """With short stretches there are several levels, also where a shard has more rows than a stretch."""
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rng = random.Random(stretch + most)
    sizes = [rng.choice([0, 1, 2, 5, rng.randrange(1, 60), rng.randrange(1, 140)]) for _ in range(500)]
    assert shards(spark, sizes, most) == loop(sizes, most)


def test_jobs_do_not_grow_with_the_shards(spark):
    """A table of sixteen times the shards takes no further jobs."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (250, 4000):
        spark.sparkContext.setJobGroup(f"pack-{n}", "")
        rows = spark.range(n).select("id", (F.col("id") % 50 + 1).alias("size"))
        assert pack(rows, ["id"], "size", 100).agg(F.max("shard")).first()[0] > n / 5
        jobs.append(len(tracker.getJobIdsForGroup(f"pack-{n}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] <= jobs[0] + 2


def test_bad_limit(spark):
    with pytest.raises(ValueError):
        pack(spark.range(2), ["id"], "id", 0)
