import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparrowloom.llm import uniform_shards as U


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 4), (1, 1, 1), (30, 3, 20), (3, 40, 25)):
        seen = Counter(U.hypergeometric(rng, good, bad, n) for _ in range(20_000))
        want = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        assert set(seen) <= set(want)
        assert sum((seen[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in want.items() if p > 1e-3) < 40
    assert U.hypergeometric(rng, 0, 5, 3) == 0 and U.hypergeometric(rng, 4, 0, 3) == 3 and U.hypergeometric(rng, 3, 3, 0) == 0
    # Far beyond 2^31 rows: mean and deviation.
    got = np.array([U.hypergeometric(rng, 10**12, 23 * 10**12, 10**9) for _ in range(300)])
    deviation = math.sqrt(1e9 / 24 * 23 / 24)
    assert abs(got.mean() - 1e9 / 24) < 4 * deviation / math.sqrt(300) and 0.8 < got.std() / deviation < 1.2


def test_every_permutation_is_as_likely():
    rng = np.random.default_rng(2)
    seen = Counter()
    for _ in range(24_000):
        rows = U.deal(rng, [3, 1], [2, 2])
        shards = [[], []]
        for block, row in zip(([0, 1, 2], [3]), rows, strict=True):
            own = list(rng.permutation(block))
            for s, n in enumerate(row):
                shards[s] += [own.pop() for _ in range(n)]
        seen[tuple(int(x) for s in shards for x in rng.permutation(s))] += 1
    assert len(seen) == 24
    assert sum((n - 1000) ** 2 / 1000 for n in seen.values()) < 60


def test_matrix_margins(spark, monkeypatch):
    monkeypatch.setattr(U, "BLOCK_BITS", 4)
    monkeypatch.setattr(U, "GROUP_BITS", 6)
    for n in (0, 5, 500):
        rows = spark.range(n).withColumnRenamed("id", "row_id")
        got = {r.block: [a - b for a, b in zip(r.upto, [0, *r.upto], strict=False)] for r in U.matrix(rows, 7).collect()}
        assert {b: sum(r) for b, r in got.items()} == Counter(i >> 4 for i in range(n))
        assert [sum(c) for c in zip(*got.values(), strict=True)] == (U.shard_sizes(n, 7) if n else [])
        assert got == {r.block: [a - b for a, b in zip(r.upto, [0, *r.upto], strict=False)] for r in U.matrix(rows, 7).collect()}


def test_rows_go_where_the_matrix_says(spark, monkeypatch):
    monkeypatch.setattr(U, "BLOCK_BITS", 5)
    monkeypatch.setattr(U, "GROUP_BITS", 7)
    rows = spark.range(1000).withColumnRenamed("id", "row_id").withColumn("h", F.xxhash64(F.lit(U.SEED), F.lit("block"), "row_id"))
    want = {}
    bounds = {r.block: r.upto for r in U.matrix(rows).collect()}
    own = sorted((r.row_id >> 5, r.h, r.row_id) for r in rows.collect())
    for block, group in itertools.groupby(own, key=lambda r: r[0]):
        for place, (_, _, i) in enumerate(group):
            want[i] = sum(b <= place for b in bounds[block])
    got = U.place(rows).collect()
    assert {r.row_id: r.shard for r in got} == want
    by_shard = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(slots == list(range(size)) for slots, size in zip(by_shard.values(), U.shard_sizes(1000, 24), strict=True))


def check(rows, want):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in want)
    sizes = Counter(r.shard for r in rows)
    for s, size in enumerate(U.shard_sizes(len(want), 24)):
        assert sizes[s] == size and sorted(r.slot for r in rows if r.shard == s) == list(range(size))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_query(spark, sf_dir, documents, odd, odd_rows, empty, tmp_path):
    got = U.op13_uniform_shards(spark, sf_dir).collect()
    check(got, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert sorted(got) == sorted(U.op13_uniform_shards(spark, sf_dir).collect())
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    check(U.op13_uniform_shards(spark, f"{tmp_path}/odd").collect(), [(r[0], r[1]) for r in odd_rows])
    assert U.op13_uniform_shards(spark, f"{tmp_path}/empty").count() == 0


def test_written_shards_hold_all_rows(spark, documents, odd, tmp_path):
    docs = documents.unionByName(odd, allowMissingColumns=True).withColumn("slot", F.lit("old")).withColumn("row_id", F.lit("own"))
    U.write_shards(docs, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    names = [c for c in docs.columns if c != "slot"]
    assert sorted(map(repr, back.select(names).collect())) == sorted(map(repr, docs.select(names).collect()))
    total = docs.count()
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == dict(enumerate(U.shard_sizes(total, 5)))
    assert back.groupBy("shard").agg(F.max("slot").alias("m"), F.countDistinct("slot").alias("n")).where("m + 1 <> n").count() == 0
