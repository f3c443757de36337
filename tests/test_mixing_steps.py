"""The number of steps follows from the loaders' sizes: at sf0.1 each has far more rows than 3,000."""

import pytest
from pyspark.sql import functions as F

from sparrowloom.plans import mixing

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def sizes(spark):
    return {r.event_type: r["count"] for r in spark.read.parquet(f"{LARGE}/events.parquet").groupBy("event_type").count().collect()}


def test_all_steps_of_the_shortest(spark, sizes):
    got = mixing.mix_concat_min(spark, LARGE).groupBy("loader").agg(F.count("*").alias("n"), F.max("step").alias("last")).collect()
    assert {(r.loader, r.n, r.last) for r in got} == {(k, min(sizes.values()), min(sizes.values()) - 1) for k in sizes}


def test_the_longest_starts_again(spark, sizes):
    got = mixing.mix_concat_cycle(spark, LARGE).groupBy("loader").count().collect()
    assert {r.loader: r["count"] for r in got} == dict.fromkeys(sizes, max(sizes.values()) + 1)


def test_weighted_draws_reach_an_end(spark, sizes):
    assert mixing.mix_weighted(spark, LARGE).agg(F.max("epoch")).first()[0] >= 1
    got = {r.loader: r["count"] for r in mixing.mix_weighted_min(spark, LARGE).groupBy("loader").count().collect()}
    assert any(got[k] == sizes[k] for k in got) and all(got[k] <= sizes[k] for k in got)
