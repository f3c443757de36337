"""The pipeline on the smallest tables: its stages one after the other, against what each operator's own test establishes in plain Python."""

import pytest
from test_simhash_join import one_of_each_alike
from test_site_quality import brute as qualities
from test_template_leaks import brute as leaks

import corpus_pipeline as P
from sparrowloom.llm import context_pii, fair_mix


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_quality(spark, sf_dir, documents, stages):
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    want = {r[0] for r in qualities(documents.collect(), labels) if r[4] >= 0.5}
    assert {r.doc_id for r in stages[0].collect()} == want and len(want) < documents.count()


def test_near_duplicates(stages):
    assert sorted(r.doc_id for r in stages[1].collect()) == one_of_each_alike([(r.doc_id, r.text) for r in stages[0].collect()])


def test_decontaminated(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {d for d, _ in rows} - {d for d, _ in leaks(rows, items)}


def test_personal_data(stages):
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for r in stages[2].collect())
    left = context_pii.digest(stages[3].select("doc_id", "text"))
    assert left.where("n_email + n_card + n_phone > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_mixture(stages):
    taken = {(r.doc_id, r["pass"]) for r in fair_mix.mixed(stages[3]).where("taken").collect()}
    assert {(r.doc_id, r.epoch) for r in stages[4].collect()} == taken


def test_columns_and_run(spark, sf_dir, documents, stages):
    assert all(s.columns == documents.columns for s in stages[:-1])
    got = P.run(spark, sf_dir)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[-1].collect()))
