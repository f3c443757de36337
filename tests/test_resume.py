import pytest
from pyspark.sql import functions as F

from sparrowloom.operators import resume as R

WEIGHTS = {"a": 3.0, "b": 1.0, "c": 0.5}


@pytest.fixture
def mix(spark, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 50)
    rows = spark.range(90).select("id", F.when(F.col("id") < 60, "a").when(F.col("id") < 80, "b").when(F.col("id") < 85, "c").otherwise("other").alias("kind"))
    return R.mix_of(rows, "kind", "id", WEIGHTS, "test", blocks=8)


def taken(mix, rank, world, first, count):
    return sorted((r.step, r.loader, r.epoch, r.id) for r in R.read_from(mix, rank, world, first, count).collect())


def test_tail_after_a_resume(spark, mix, tmp_path):
    stored = R.save_mix(mix, str(tmp_path / "mix"), stretches=2)
    assert stored.rows.where("loader = 'other'").isEmpty()
    whole = taken(mix, 0, 1, 0, 331)
    assert [w[0] for w in whole] == list(range(331)) and max(w[2] for w in whole) > 3
    # Every loader's epoch holds each row once, in another order.
    for loader, size in (("a", 60), ("b", 20), ("c", 5)):
        own = [w for w in whole if w[1] == loader]
        assert [w[2] for w in own] == [k // size for k in range(len(own))]
        first, second = ([w[3] for w in own if w[2] == e] for e in (0, 1))
        assert len(set(first)) == size and first != second[:size]
    for rank in range(3):
        steps = len(range(rank, 331, 3))
        R.save_state(spark, str(tmp_path / "state"), rank, 3, 40 + rank)
        state = R.load_state(spark, str(tmp_path / "state"), rank)
        tail = taken(stored, state["rank"], state["world"], state["step"], steps - state["step"])
        assert tail == [w for w in whole if w[0] % 3 == rank and w[0] // 3 >= 40 + rank]
    assert taken(stored, 1, 3, 7, 0) == []


def test_only_blocks_needed_are_read(mix, tmp_path):
    stored = R.save_mix(mix, str(tmp_path / "mix"))
    want = taken(stored, 0, 1, 120, 3)
    plan = R.read_from(stored, 0, 1, 120, 3)._jdf.queryExecution().executedPlan().toString()
    assert any("block" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    wanted = {f"loader={r.loader}/block={r.block}" for r in R.draws(stored, 0, 1, 120, 3).collect()}
    spoilt = 0
    for file in (tmp_path / "mix/rows").rglob("*.parquet"):
        if str(file.parent.relative_to(tmp_path / "mix/rows")) not in wanted:
            file.write_bytes(b"x" * file.stat().st_size)
            spoilt += 1
    assert len(want) == 3 and spoilt > 10
    assert taken(stored, 0, 1, 120, 3) == want


def test_bad_rank(mix):
    with pytest.raises(ValueError):
        R.draws(mix, 3, 3, 0, 1)
