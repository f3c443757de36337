"""Loaders drawn in turn, bounds of small tables, substitutes over many blocks: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowloom.operators import mixing as X
from sparrowloom.operators import selection as S
from sparrowloom.operators import trajectories as T


def loaders(spark, counts):
    rows = [(name, i, f"{name}{i}") for name, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "loader string, ordinal bigint, what string")


def by_loop(counts, per_step, steps):
    """A pointer over loaders that are read on, and again from the start when they end."""
    names, at, drawn, out = sorted(counts), 0, dict.fromkeys(counts, 0), []
    for step in range(steps):
        for place in range(per_step):
            name = names[at]
            k = drawn[name]
            out.append((step, place, k // counts[name], f"{name}{k % counts[name]}"))
            drawn[name] += 1
            at = (at + 1) % len(names)
    return sorted(out)


@pytest.mark.parametrize("per_step,steps", [(1, 11), (2, 9), (3, 4), (5, 7), (2, 0)])
def test_in_turn_is_the_pointer_of_a_loop(spark, per_step, steps):
    counts = {"a": 3, "b": 1, "c": 7}
    got = X.in_turn(loaders(spark, counts), "loader", per_step, steps).select("step", "place", "epoch", "what").collect()
    assert sorted(map(tuple, got)) == by_loop(counts, per_step, steps)


def test_in_turn_ends_after_the_longest_starts_again(spark):
    counts = {"a": 3, "b": 4}
    got = X.in_turn(loaders(spark, counts), "loader", 3).select("step", "place", "epoch", "what").collect()
    assert sorted(map(tuple, got)) == by_loop(counts, 3, 4)
    assert X.in_turn(loaders(spark, {}), "loader", 3).count() == 0


@pytest.mark.parametrize("steps,shortest,end", [(None, False, 6), (13, False, 13), (None, True, 2), (1, True, 1), (0, False, 0)])
def test_a_row_of_each_source_a_step(spark, steps, shortest, end):
    counts = {"a": 2, "b": 5}
    got = X.from_every_source(loaders(spark, counts), "loader", steps, shortest).select("step", "what").collect()
    assert sorted(map(tuple, got)) == sorted((s, f"{n}{s % c}") for s in range(end) for n, c in counts.items())


def test_tables_above_their_bound_fail(spark, monkeypatch):
    assert X.at_most(spark.range(5), 5, "rows").count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        X.at_most(spark.range(5), 4, "rows").count()
    monkeypatch.setattr(S, "MOST_SOURCES", 1)
    weights = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "name string, weight double")
    with pytest.raises(Exception, match="more than 1 weights"):
        S.weighted_choice(spark.range(3).withColumn("u", F.lit(0.5)), weights, "u", "name", "weight").collect()


def test_substitutes_over_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCKS", 3)
    rng = random.Random(6)
    rows = [(i, rng.random() < 0.04) for i in range(400)]
    want, taken = [], None
    for i, ok in reversed(rows):
        taken = i if ok else taken
        if taken is not None:
            want.append((i, taken))
    frame = spark.createDataFrame(rows, "at bigint, ok boolean")
    got = T.substitute_rejected(frame, F.col("ok"), "at", [], block_rows=5).select("at", "source").collect()
    assert sorted(map(tuple, got)) == sorted(want)
