import pytest
from pyspark.sql import functions as F

from sparrowloom.plans.trajectory import _events, plan_queue, traj_noop_drop
from sparrowloom.streaming import jobs


@pytest.fixture(scope="module")
def stream(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream"))
    e = _events(spark, sf_dir).select("event_id", "user_id", "idx", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    # Three files in the order of each user's events, read one for each batch.
    third = F.least(F.lit(2), F.floor(F.col("idx") / 30))
    for i in range(3):
        e.where(third == i).coalesce(1).write.parquet(f"{folder}/{i}")
    return lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder), e


def ordered(stream):
    return stream[0]()


def test_noop_filter_equals_batch(spark, sf_dir, stream):
    got = jobs.drain(jobs.noop_filter(ordered(stream), "user_id", "idx", "value", "event_type", 5.0), "noops")
    want = {(r.event_id): r.dropped for r in traj_noop_drop(spark, sf_dir).collect()}
    ids = {(r.user_id, r.idx): r.event_id for r in stream[1].collect()}
    assert {ids[(r.user_id, r.idx)]: r.dropped for r in got.collect()} == want


def test_plan_steps_equal_batch(spark, sf_dir, stream):
    got = jobs.drain(jobs.plan_steps(ordered(stream), "user_id", "idx", 8), "plans")
    ids = {(r.user_id, r.idx): r.event_id for r in stream[1].collect()}
    want = {r.event_id: (r.plan, r.step) for r in plan_queue(spark, sf_dir).collect()}
    assert {ids[(r.user_id, r.idx)]: (r.plan, r.step) for r in got.collect()} == want


def test_log_windows(stream):
    got = jobs.drain(jobs.log_windows(ordered(stream), "event_id", "value", 100), "logs", mode="complete")
    want = stream[1].groupBy(F.floor(F.col("event_id") / 100).alias("w")).count()
    assert {r.window: r.n for r in got.collect()} == {r.w: r["count"] for r in want.collect()}


def test_late_windows_count_every_row_once(stream):
    got = jobs.drain(jobs.late_windows(ordered(stream), "ts", "event_type", "1 day", "3650 days"), "late", mode="append")
    assert got.count() == 0  # nothing is final before the watermark passes
    got = jobs.drain(jobs.late_windows(ordered(stream), "ts", "event_type", "1 day", "3650 days"), "late2", mode="update")
    last = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == stream[1].count()


def test_interleave(stream):
    got = jobs.drain(jobs.interleave({"a": ordered(stream), "b": ordered(stream).drop("value")}), "both")
    assert {(r.loader, r.n) for r in got.groupBy("loader").agg(F.count("*").alias("n")).collect()} == {("a", stream[1].count()), ("b", stream[1].count())}
    assert got.where("loader = 'b' and value is not null").count() == 0


def test_restart_goes_on_from_the_checkpoint(spark, sf_dir, stream, tmp_path):
    """Two runs over growing input give what the batch gives: state and place are kept between them."""
    e = stream[1]
    third = F.least(F.lit(2), F.floor(F.col("idx") / 30))
    read = lambda: spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for parts in ((0, 1), (2,)):
        for i in parts:
            e.where(third == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
            jobs.store(jobs.noop_filter(read(), "user_id", "idx", "value", "event_type", 5.0), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    ids = {(r.user_id, r.idx): r.event_id for r in e.collect()}
    want = {r.event_id: r.dropped for r in traj_noop_drop(spark, sf_dir).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(want) and {ids[(r.user_id, r.idx)]: r.dropped for r in got} == want
