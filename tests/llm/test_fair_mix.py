from collections import defaultdict

from oracle import same
from pyspark.sql import functions as F

from sparrowloom.llm import fair_mix as M


def test_query_equals_sql(spark, sf_dir, duck):
    same(M.op8_fair_mix(spark, sf_dir), duck, M.OP8_SQL)


def water(sizes):
    """Targets by giving the excess of full sources to the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = M.BUDGET * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, None: 30, "c": 0}, {"a": 5}, {"x": 100, "y": 1, "z": 1}, {"a": 0}):
        got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = water(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes), sizes


def test_mix_takes_what_the_query_says(spark, documents, odd, empty):
    docs = documents.unionByName(odd.select(*documents.columns)).withColumn("epoch", F.lit("old")).withColumn("size", F.lit("clash"))
    entries = M.mixed(docs).collect()
    want = defaultdict(int)
    by_source, target, largest = defaultdict(int), {}, defaultdict(int)
    for e in entries:
        if e.taken:
            want[e.doc_id, e.source, e.size] += 1
            by_source[e.source] += e.size
        target[e.source] = e.target
        largest[e.source] = max(largest[e.source], e.size)
    got = defaultdict(int)
    rows = M.mix(docs)
    for r in rows.collect():
        got[r.doc_id, r.source, len((r.text or "").encode().split())] += 1
    assert got == want and sorted(rows.columns) == sorted(docs.columns)
    for s in target:
        assert abs(by_source[s] - target[s]) <= 2 * largest[s]
    total = sum(e.size for e in entries) / 2
    assert sum(by_source.values()) <= 1.5 * total < sum(by_source.values()) + max(largest.values()) + 1
    assert sorted(map(repr, M.mixed(docs).collect())) == sorted(map(repr, entries))
    assert M.mix(empty).count() == 0 == M.mixed(empty).count()
