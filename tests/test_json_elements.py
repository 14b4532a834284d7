"""JSON documents cut at any place and put together again."""

import json

import pytest
from pyspark.sql import functions as F

from diffspark.sources import files, geometry_files
from diffspark.sources.json_elements import json_elements

TRICKY = {"a,b": 1, 'q"uote': 0, "back\\slash\\": 1, "brace{[": 0, "]}": 1, "é漢🙂,": 0, 'all",\\"{': 1, "": 0, " spaced ": 1}


@pytest.fixture
def split_at(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def written(tmp_path, text):
    path = tmp_path / "doc.json"
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 1000])
def test_label_map_at_any_split(spark, tmp_path, split_at, size):
    path = written(tmp_path, json.dumps(TRICKY, indent=None if size % 2 else 2, ensure_ascii=size == 7) + "\n")
    split_at(size)
    got = files.read_label_map(spark, path).collect()
    assert {r["path"]: r["label"] for r in got} == TRICKY and len(got) == len(TRICKY)


def test_many_tasks_read_one_map(spark, tmp_path, split_at):
    labels = {f"/data/run{i}, part/{i}.h5": i % 2 for i in range(5000)}
    path = written(tmp_path, json.dumps(labels, indent=1))
    split_at(4096)
    source = spark.read.option("lineSep", ",").text(path)
    assert source.rdd.getNumPartitions() > 20
    assert {r["path"]: r["label"] for r in files.read_label_map(spark, path).collect()} == labels


def test_nested_elements_of_an_array(spark, tmp_path, split_at):
    panel = {"n_ss": 2, "n_fs": 3, "fs_vec": [1.0, 0, 0], "ss_vec": [0, 1.0, 0], "t_vec": [0, 0, 1], "parent_data_slice": [[0, 2, None], [3, 6, None]]}
    panels = [{"name": f"p[{i}],{{", **panel} for i in range(6)]
    path = written(tmp_path, json.dumps(panels))
    split_at(11)
    got = geometry_files.read_geometry_json(spark, path, "J").orderBy("panel_order").collect()
    assert [(r["panel"], r["panel_order"], r["ss1"], r["fs0"], list(r["fs_vec"])) for r in got] == [(p["name"], i, 2, 3, [1.0, 0.0, 0.0]) for i, p in enumerate(panels)]


@pytest.mark.parametrize("text", ["{}", " {\n} ", ""])
def test_documents_without_elements(spark, tmp_path, text):
    assert files.read_label_map(spark, written(tmp_path, text)).collect() == []


@pytest.mark.parametrize(
    "text", ['{"a": 1', '"a": 1}', '{"a": 1,, "b": 0}', '{"a": 1} x', '{"a": 1}, {"b": 0}', '{"a": "1}', '["a", 1]', '{"a": 1]', '{"a": one}', '{"a": 1, }', "null"]
)
def test_malformed_documents_fail(spark, tmp_path, text):
    with pytest.raises(Exception, match="JSON|MALFORMED|malformed"):
        files.read_label_map(spark, written(tmp_path, text)).collect()


def test_order_and_several_files(spark, tmp_path):
    for name, values in (("a", [1, [2, 3], {"x": [4, 5]}]), ("b", ["only"])):
        (tmp_path / f"{name}.json").write_text(json.dumps(values))
    got = json_elements(spark, str(tmp_path), "array").withColumn("name", F.regexp_extract("file", "([a-z]).json$", 1)).collect()
    assert {(r["name"], r["ordinal"]): json.loads(r["text"]) for r in got} == {("a", 0): 1, ("a", 1): [2, 3], ("a", 2): {"x": [4, 5]}, ("b", 0): "only"}
