"""Stateful streams against plain loops, over several batches and a restart between them."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparrowloom.plans.trajectory import _events, traj_rollout_stop, vae_chunks
from sparrowloom.streaming import jobs
from sparrowloom.streaming import stateful as S


def test_shares_of_every_prefix():
    rng = random.Random(1)
    for weights in ([1], [1, 1], [3, 2, 1], [0.4, 1.2, 0.03, 0.15, 1.0], *([rng.uniform(0.05, 1) for _ in range(7)] for _ in range(4))):
        total = sum(Fraction(str(w)) for w in weights)
        shares = [Fraction(str(w)) / total for w in weights]
        taken = [0] * len(weights)
        for n in range(1, 600):
            taken[S.next_source(taken, shares)] += 1
            assert all(abs(t - n * s) <= 1 for t, s in zip(taken, shares, strict=True))


class Feed:
    """A folder that grows by a file a batch; each run starts the query anew from its checkpoint."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, rows, folder="in"):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/{folder}/{self.n}")
        self.n += 1

    def read(self, folder="in"):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.path}/{folder}")

    def run(self, made):
        jobs.store(made, f"{self.path}/out", f"{self.path}/checkpoint")
        return self.spark.read.parquet(f"{self.path}/out").collect()


def test_weighted_interleave(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "n bigint, word string")
    sizes = {"a": 40, "b": 25, "c": 12}
    weights = {"a": 3.0, "b": 2.0, "c": 1.0}
    made = lambda: S.weighted_interleave({x: feed.read(x) for x in sizes}, weights, "n")
    rows = {x: [(i, f"{x}{i}") for i in range(n)] for x, n in sizes.items()}
    for part in range(2):
        for x, own in rows.items():
            half = len(own) // 3
            feed.add(own[:half] if part == 0 else own[half : 2 * half], x)
            if part:
                feed.add(own[2 * half :], x)
        got = sorted((r.place, r.loader, r.word) for r in feed.run(made()))
    # What a loop over whole queues gives, until the turn of an empty one.
    taken, want = [0, 0, 0], []
    shares = [Fraction(1, 2), Fraction(1, 3), Fraction(1, 6)]
    while taken[turn := S.next_source(taken, shares)] < list(sizes.values())[turn]:
        x = list(sizes)[turn]
        want.append((len(want), x, f"{x}{taken[turn]}"))
        taken[turn] += 1
    assert got == want and len(want) > 60
    with pytest.raises(ValueError):
        S.weighted_interleave({"a": feed.read("a")}, {"a": 0.0}, "n")


def test_action_plans(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "episode bigint, n bigint, plan array<array<double>>")
    rng = random.Random(2)
    want, log = [], []
    for episode in (1, 2):
        queue, waiting, pose = [], [], None
        own = []
        for n in range(60):
            if rng.random() < 0.2:
                plan = [[rng.random() for _ in range(10)] for _ in range(rng.choice([0, 1, 3, 5]))]
                own.append((episode, n, plan))
                queue += plan
                pose = plan[-1][:9] if plan else pose
                while queue and waiting:
                    want.append((episode, waiting.pop(0), False, queue.pop(0), pose))
                    if waiting and not queue:
                        want.append((episode, waiting[0], True, None, pose))
            else:
                own.append((episode, n, None))
                if queue:
                    want.append((episode, n, False, queue.pop(0), pose))
                else:
                    if not waiting:
                        want.append((episode, n, True, None, pose))
                    waiting.append(n)
        log += own
    for low, high in ((0, 7), (7, 8), (8, 41), (41, 60)):
        feed.add([r for r in log if low <= r[1] < high])
        got = feed.run(S.action_plans(feed.read(), "episode", "n"))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", F.col("idx").cast("bigint").alias("idx"), "value", "event_type")
    return [tuple(r) for r in e.collect()]


def test_chunks_equal_the_batch(spark, sf_dir, tmp_path, series):
    schema = "event_id bigint, user_id bigint, idx bigint, halves array<double>"
    rng = random.Random(3)
    cuts = {u: sorted(rng.choices(range(90), k=2)) for u in {r[1] for r in series}}
    feed = Feed(spark, str(tmp_path), schema)
    for part in range(3):
        feed.add([(r[0], r[1], r[2], [r[3], -r[3]]) for r in series if sum(r[2] >= c for c in cuts[r[1]]) == part])
        got = feed.run(S.chunk_frames(feed.read(), "user_id", "idx", "halves"))
    ids = {(r[1], r[2]): r[0] for r in series}
    value = {(r[1], r[2]): r[3] for r in series}
    want = {r.event_id: r.chunk for r in vae_chunks(spark, sf_dir).collect()}
    assert {ids[r.user_id, i]: r.chunk for r in got for i in r.places} == want
    for r in got:
        assert list(r.places) == ([0] if r.chunk == 0 else list(range(4 * r.chunk - 3, 4 * r.chunk + 1)))
        assert [f[0] for f in r.frames] == [value[r.user_id, i] for i in r.places]
        assert [c[0] for c in r.cache] == [value[r.user_id, i] for i in range(max(0, r.places[0] - 2), r.places[0])]
    doubled = S.doubled_frames(spark.read.parquet(f"{tmp_path}/out"), "user_id").collect()
    assert {(r.user_id, r.frame, r.value) for r in doubled} == {(r.user_id, 2 * i + h, f[h]) for r in got for i, f in zip(r.places, r.frames, strict=True) for h in (0, 1)}


def test_rollouts_stop(spark, sf_dir, tmp_path, series):
    schema = "event_id bigint, user_id bigint, idx bigint, value double, event_type string"
    feed = Feed(spark, str(tmp_path), schema)
    for low, high in ((0, 5), (5, 30), (30, 10**6)):
        feed.add([r for r in series if low <= r[2] < high])
        rows = feed.read().withColumn("done", F.col("event_type") == "purchase")
        got = feed.run(S.rollouts(rows, "user_id", "idx", "done", horizon=20))
    stop = {r.event_id for r in traj_rollout_stop(spark, sf_dir).collect()}
    want = {r[0] for r in series if r[0] in stop and r[2] < 20}
    assert {r.event_id for r in got} == want
    ends = [r for r in got if r.ends]
    assert len({r.user_id for r in ends}) == len(ends) and all(r.won or r.step == 19 for r in ends)
    assert {r.user_id for r in got if r.won} == {r[1] for r in series if r[0] in want and r[4] == "purchase"}


def test_other_state_stores_are_refused(spark):
    before = spark.conf.get(S.PROVIDER)
    spark.conf.set(S.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError):
            S.rocksdb(spark)
    finally:
        spark.conf.set(S.PROVIDER, before)
