import json

import pytest
from pyspark.sql import functions as F

from sparrowloom.operators.annotations import manifest, manifest_row
from sparrowloom.operators.config import flatten_json, merge, resolve
from sparrowloom.sources import readers, sinks


def test_json_lines_are_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"path": "a", "prompt": "x"}\n{"path": "b", "prompt": "y"}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.PAIRS).count() == 2
    (tmp_path / "b.jsonl").write_text('{"path": "a", "prompt": "x"}\n{bad\n')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.PAIRS).collect()


def test_manifests_and_items(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, items in (("one", ["a", "b"]), ("deep/two", ["c"])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"dataset_name": name, "datalist": items}, indent=1))
    (tmp_path / "other.txt").write_text("no")
    found = readers.manifests(spark, str(tmp_path))
    assert {(r.dataset_name, r.path) for r in readers.manifest_items(found).collect()} == {("one", "a"), ("one", "b"), ("deep/two", "c")}
    assert readers.manifests(spark, str(tmp_path / "one.json")).count() == 1


def test_image_folder_and_labels(spark, tmp_path):
    for c in ("n1", "n2"):
        (tmp_path / "images" / c).mkdir(parents=True)
        for f in ("a.JPG", "b.png", "c.txt"):
            (tmp_path / "images" / c / f).write_bytes(b"123")
    assert sorted(r["class"] for r in readers.image_folder(spark, str(tmp_path / "images")).collect()) == ["n1", "n1", "n2", "n2"]
    (tmp_path / "labels").write_text("0: tench, Tinca\n1: ratio 3:4 print\n\n")
    assert [tuple(r) for r in readers.label_map(spark, str(tmp_path / "labels")).orderBy("num").collect()] == [(0, "tench, Tinca"), (1, "ratio 3:4 print")]


def test_raw_shapes(spark):
    rows = spark.createDataFrame([(bytearray(921600),), (bytearray(5),)], "content binary")
    assert [r.s and (r.s.height, r.s.width) for r in rows.select(readers.raw_image_shape(F.col("content")).alias("s")).collect()] == [(480, 640), None]


def test_annotation_tables(spark, tmp_path):
    doc = {"images": [{"id": 1, "height": 4, "width": 5}], "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "area": 3.5}], "categories": [{"id": 2, "name": "cat"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    images, annotations, categories = readers.annotation_tables(readers.json_documents(spark, str(tmp_path / "a.json"), readers.ANNOTATIONS))
    assert (images.count(), annotations.first().area, categories.first().name) == (1, 3.5, "cat")


def test_sinks(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("kind"))
    sinks.write_documents(rows, str(tmp_path / "docs"), by=["kind"])
    assert spark.read.json(str(tmp_path / "docs")).count() == 10
    for _ in range(2):
        sinks.append_metrics(rows.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    made = manifest(rows, "set", F.col("id").cast("string"))
    sinks.write_manifest(made, str(tmp_path / "m"))
    assert {(r.dataset_name, r.num_images) for r in spark.read.json(str(tmp_path / "m")).collect()} == {("set", 10)} and made.count() == 10
    assert manifest_row(rows, "set", F.col("id").cast("string")).first().datalist == [str(i) for i in range(10)]
    with pytest.raises(ValueError):
        manifest_row(rows, "set", F.col("id").cast("string"), most=9)
    assert spark.read.parquet(sinks.write_snapshot(rows, str(tmp_path), 5)).count() == 10
    plan = sinks.shard_plan(spark.createDataFrame([(i, 40) for i in range(5)], "i int, size int"), "i", "size", 100)
    assert [r.shard for r in plan.orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_shards_index_and_retention(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(f"p{i}", 40, i) for i in range(7)], "name string, size int, v int")
    first = {r.name: r.file for r in sinks.write_shards(rows, path, "name", "size", 100).collect()}
    assert set(first.values()) == {f"file=model-0000{i}-of-00004" for i in (1, 2, 3, 4)}
    index = {r.name: r.file for r in sinks.write_shards(rows.where("v < 4"), path, "name", "size", 100).collect()}
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_dir()) == ["file=model-00001-of-00002", "file=model-00002-of-00002", "index"]
    assert {r.name: r.file for r in spark.read.json(f"{path}/index").collect()} == index
    assert all(spark.read.parquet(f"{path}/{f}").where(F.col("name") == n).count() == 1 for n, f in index.items())
    for step in (5, 10, 100):
        sinks.write_run(rows, str(tmp_path / "run"), step, limit=2)
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["checkpoint-10", "checkpoint-100"]
    assert json.loads(spark.read.text(str(tmp_path / "run/checkpoint-100/metadata")).first()[0]) == {"global_step": 100}


def test_config(spark):
    deep = {"k": 1}
    for _ in range(12):
        deep = {"n": deep}
    nested = spark.createDataFrame([(2, json.dumps(deep)), (3, "{}"), (4, None)], "id int, j string")
    assert {(r.id, r.path, r.value) for r in flatten_json(nested, "j", ["id"]).collect()} == {(2, "n." * 12 + "k", "1"), (4, "", None)}
    tree = {"a": {"b": [1, {"c": "x"}]}, "d": None, "e": 2.5}
    rows = spark.createDataFrame([(1, json.dumps(tree))], "id int, j string")
    got = {r.path: r.value for r in flatten_json(rows, "j", ["id"]).collect()}
    assert got == {"a.b.0": "1", "a.b.1.c": "x", "d": None, "e": "2.5"}
    maps = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("${a}/x")).alias("base"), F.create_map(F.lit("a"), F.lit("9")).alias("cli"))
    merged = maps.select(merge(F.col("base"), F.col("cli")).alias("m"))
    assert merged.select(resolve(F.col("m")["b"], F.col("m")).alias("v")).first().v == "9/x"


def test_config_leaves_and_references(spark):
    texts = ['{"a": "[x] not json", "b": "{oops", "c": "[1,2]"}', "not json", "[1.50, true, [], {}, null]", '"text"', "7", '{"x.y": {"": "e"}}', "[" * 5000 + "]" * 5000]
    got = {}
    for r in flatten_json(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "j", ["id"]).collect():
        got.setdefault(r.id, []).append((r.path, r.value, r.kind))
    assert got[0] == [("a", "[x] not json", "string"), ("b", "{oops", "string"), ("c", "[1,2]", "string")]
    assert got[1] == [("", "not json", "string")] and got[2] == [("0", "1.50", "number"), ("1", "true", "boolean"), ("4", None, "null")]
    assert got[3] == [("", "text", "string")] and got[4] == [("", "7", "number")] and got[5] == [("x.y.", "e", "string")]
    settings = F.create_map(*[F.lit(x) for i in range(12) for x in (f"k{i}", str(i))], F.lit("deep"), F.lit("<${k1}${deeper}>"), F.lit("deeper"), F.lit("${k2}"), F.lit("odd"), F.lit("$1 \\ x"))
    of = lambda text, m=settings: spark.range(1).select(resolve(F.lit(text), m).alias("v")).first().v
    assert of("".join(f"${{k{i}}}" for i in range(12))) == "01234567891011"
    assert of("a ${deep} ${no} ${odd} b") == "a <12> ${no} $1 \\ x b" and of("plain") == "plain" and of("") == ""
    circle = F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("x${a}"))
    with pytest.raises(Exception, match="in a circle"):
        of("${a}", circle)
