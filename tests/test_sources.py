import json
import math
import os

import pytest
from pyspark.sql import functions as F

from diffspark.constants import DATA_KEYS
from diffspark.functions import labels, paths
from diffspark.operators import catalog, geometry, splits
from diffspark.plans import loaders
from diffspark.sources import files, geometry_files, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_discovery_is_sorted_and_reads_no_content(spark, tmp_path):
    for name in ("b.cxi", "a.cxi", "c.txt"):
        write(tmp_path / "d" / name, "x" * 10)
    found = files.discover(spark, str(tmp_path / "d"), "*.cxi")
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["a.cxi", "b.cxi"]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path / "d"), "*.h5")
    assert files.discover(spark, str(tmp_path / "d"), "*.h5", on_empty="empty").isEmpty()
    both = files.discover_detectors(spark, {"X": str(tmp_path / "d"), "Y": str(tmp_path / "d")}, "a*")
    assert both.count() == 2


def test_split_list_keeps_order_over_many_tasks(spark, tmp_path):
    wanted = [f"/data/run{i % 7}/f{i}.h5" for i in range(3000)]
    text = "\n".join(f"  {p} " if i % 3 else p + "\n" for i, p in enumerate(wanted))
    path = write(tmp_path / "list.txt", text + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert files.read_lines(spark, path).rdd.getNumPartitions() > 3
        got = files.read_split_list(spark, path).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["path"] for r in got] == wanted
    assert [r["ordinal"] for r in got] == list(range(3000))


def test_label_map(spark, tmp_path):
    path = write(tmp_path / "labels.json", json.dumps({"/a/1.h5": 1, "/a/2.h5": 0}, indent=2))
    assert {tuple(r) for r in files.read_label_map(spark, path).collect()} == {("/a/1.h5", 1), ("/a/2.h5", 0)}


def test_strict_label_join(spark):
    frames = spark.createDataFrame([("p1",), ("p2",)], "path string")
    some = spark.createDataFrame([("p1", 1)], "path string, label int")
    assert [r["path"] for r in catalog.unlabelled(frames, some).collect()] == ["p2"]
    with pytest.raises(Exception, match="no label for p2"):
        catalog.attach_labels(frames, some).collect()
    assert catalog.attach_labels(frames, some, strict=False).where("label IS NULL").count() == 1


def test_membership(spark):
    frames = spark.createDataFrame([("p1",), ("p2",)], "path string")
    hits = spark.createDataFrame([("p2",), ("p2",)], "path string")
    assert sorted(tuple(r) for r in catalog.membership_labels(frames, hits).collect()) == [("p1", 0), ("p2", 1)]


def test_suffixes_and_names(spark):
    rows = [("/d/a.h5",), ("/d/b.CXI",), ("/d/c.img",), ("/d/frame.tiff",), ("/d/.hidden",), ("/d/x.y.h5",)]
    df = spark.createDataFrame(rows, "path string")
    p = F.col("path")
    got = [tuple(r) for r in df.select(paths.suffix(p), paths.stem(p), paths.reader(p)).collect()]
    assert got == [
        (".h5", "a", "container"),
        (".cxi", "b", "container"),
        (".img", "c", "image"),
        (".tiff", "frame", None),
        ("", ".hidden", None),
        (".h5", "x.y", "container"),
    ]
    with pytest.raises(Exception, match="unsupported file format: /d/frame.tiff"):
        catalog.dispatch_by_suffix(df.where("path LIKE '%tiff'")).collect()
    name, target = paths.named_path(F.lit("AGIPD = /x/y=z.h5"))
    assert tuple(df.limit(1).select(name, target).first()) == ("AGIPD", "/x/y=z.h5")
    run = paths.run_name(F.lit("net18"), F.lit(3), F.lit(42))
    one = df.limit(1).select(run.alias("r"), paths.run_parts(run).alias("p")).first()
    assert one["r"] == "net18-lodo-fold3-seed42" and tuple(one["p"]) == ("net18", 3, 42)


def test_data_key_resolution(spark):
    rows = [("f1", DATA_KEYS[2]), ("f1", DATA_KEYS[0]), ("f1", "other"), ("f2", DATA_KEYS[3])]
    keys = spark.createDataFrame(rows, "path string, key string")
    got = {r["path"]: r["data_key"] for r in catalog.resolve_data_key(keys).collect()}
    assert got == {"f1": DATA_KEYS[0], "f2": DATA_KEYS[3]}
    none = spark.createDataFrame([("f3", "other")], "path string, key string")
    with pytest.raises(Exception, match="no known data key"):
        catalog.resolve_data_key(none).collect()


def test_key_audit(spark):
    keys = spark.createDataFrame([("f1", DATA_KEYS[0]), ("f2", "x")], "path string, key string")
    expected = spark.createDataFrame([("A", "f1"), ("B", "f2"), ("C", "absent")], "detector string, path string")
    got = {r["detector"]: r["status"] for r in catalog.audit_keys(expected, keys).collect()}
    assert got == {"A": "OK", "B": "ACTION REQUIRED", "C": "ACTION REQUIRED"}


def test_index_and_embedded_labels(spark):
    index = catalog.expand_frames(spark.createDataFrame([("f1", 2), ("f1", 2), ("f2", 0)], "path string, n_frames int"))
    assert [tuple(r)[::2] for r in index.orderBy("path", "frame_idx").collect()] == [("f1", 0), ("f1", 0), ("f1", 1), ("f1", 1)]
    stored = spark.createDataFrame([("f1", [1.0, 0.0, 0.5, 1.5, 2.5])], "path string, labels array<float>")
    got = [r["label"] for r in catalog.embedded_labels(stored).orderBy("frame_idx").collect()]
    assert got == [1, 0, 0, 2, 2]
    missing = spark.createDataFrame([("f9", None)], "path string, labels array<float>")
    with pytest.raises(Exception, match="no label array in f9"):
        catalog.embedded_labels(missing).collect()
    sizes = stored.withColumn("n_frames", F.lit(5)).unionByName(missing.withColumn("n_frames", F.lit(1)))
    assert [r["path"] for r in catalog.label_length_errors(sizes).collect()] == ["f9"]


def test_background_label(spark):
    rows = [([0.0, 1.0],), ([1.0, 0.0],), ([1.0, math.nan],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in df.select(labels.background_label(F.col("v"))).collect()] == [0, 1, 1]


def frame_rows(spark):
    rows = [(d, f"{d}/f{p}.cxi", i, 2, 2, [float(i)] * 4) for d in ("A", "B") for p in range(2) for i in range(5)]
    return spark.createDataFrame(rows, "detector string, path string, frame_idx int, h int, w int, pixels array<float>")


def test_reading_frames(spark):
    frames = frame_rows(spark)
    asked = spark.createDataFrame([("A/f0.cxi", 3)], "path string, frame_idx int")
    assert catalog.read_frames(asked, frames).first()["pixels"] == [3.0] * 4
    beyond = spark.createDataFrame([("A/f0.cxi", 5)], "path string, frame_idx int")
    with pytest.raises(Exception, match="frame out of range: A/f0.cxi 5"):
        catalog.read_frames(beyond, frames).collect()
    assert catalog.first_frames(frames, 2).count() == 8
    assert catalog.first_frames(frames, 99).count() == frames.count()


def test_frame_table_pushes_filters_down(spark, tmp_path):
    path = str(tmp_path / "frames")
    tables.write_frames(frame_rows(spark), path)
    back = tables.read_frame_table(spark, path).where("detector = 'B' AND path = 'B/f1.cxi' AND frame_idx = 4")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(detector" in plan and "EqualTo(frame_idx,4)" in plan
    assert back.first()["pixels"] == [4.0] * 4


def test_split_artifacts_round_trip(spark, tmp_path):
    rows = [("AGIPD" if i % 2 else "Eiger4M", f"s{i}", i) for i in range(50)]
    split = splits.session_split(spark.createDataFrame(rows, "detector string, session_id string, frame_count long"), fold_ids=[1, 4])
    path = str(tmp_path / "deep" / "er" / "split")
    tables.write_split(split, path)
    columns = ["fold_id", "variant", "test_detector", "session_id", "bucket"]
    assert {tuple(r) for r in tables.read_split(spark, path).select(columns).collect()} == {tuple(r) for r in split.select(columns).collect()}
    assert tables.pack_split(split).count() == 2
    assert spark.read.json(path).count() == split.count()
    one = {"fold": 2, "variant": None, "test_detector": "B", "splits": {"x": "train", "y": "val"}}
    single = write(tmp_path / "fold_2.json", json.dumps(one, indent=2))
    assert {(r["session_id"], r["bucket"]) for r in tables.read_split(spark, single).collect()} == {("x", "train"), ("y", "val")}


def test_result_files(spark, tmp_path):
    for seed, ap in ((1, 0.5), (2, float("nan"))):
        result = {
            "fold_id": 1,
            "test_detector": "AGIPD",
            "cross": {"ap": ap, "auc_roc": 0.6, "f1": 0.7, "threshold": 0.1},
            "in_domain": {"ap": 1.0, "auc_roc": 1.0, "f1": 1.0, "threshold": 0.9},
        }
        write(tmp_path / f"net-lodo-fold1-seed{seed}" / "results.json", json.dumps(result, indent=2))
    rows = tables.flat_results(tables.read_results(spark, f"{tmp_path}/*-lodo-fold*-seed*/results.json")).orderBy("seed").collect()
    assert [(r["backbone"], r["seed"], r["in_domain_ap"]) for r in rows] == [("net", 1, 1.0), ("net", 2, 1.0)]
    assert rows[0]["ap"] == 0.5 and math.isnan(rows[1]["ap"])


def test_epoch_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([("r", 1, 0.5, 0.4, 0.3, 0.2, 0.1)], "run string, epoch int, train_loss double, val_loss double, val_ap double, val_auc double, val_f1 double")
    tables.append_epochs(row, path)
    tables.append_epochs(row.withColumn("epoch", F.lit(2)), path)
    assert [r["epoch"] for r in tables.read_epochs(spark, path).orderBy("epoch").collect()] == [1, 2]


def epoch_rows(spark, *epochs):
    rows = [("r", e, 0.1, 0.2, 0.3, 0.4, 0.5) for e in epochs]
    return spark.createDataFrame(rows, "run string, epoch int, train_loss double, val_loss double, val_ap double, val_auc double, val_f1 double")


def test_repeated_append_adds_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert tables.read_epochs(spark, path).collect() == []
    tables.append_epochs(epoch_rows(spark, 1, 2), path)
    tables.append_epochs(epoch_rows(spark, 2, 1), path)
    tables.append_epochs(epoch_rows(spark, 3), path, attempt="r-3")
    tables.append_epochs(epoch_rows(spark, 3).withColumn("val_f1", F.lit(0.9)), path, attempt="r-3")
    assert sorted(r["epoch"] for r in tables.read_epochs(spark, path).collect()) == [1, 2, 3]


def test_append_that_failed_before_its_marker(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_epochs(epoch_rows(spark, 1), path)

    def fails(v):
        raise ValueError("lost")

    broken = epoch_rows(spark, 2, 3).withColumn("epoch", F.udf(fails, "int")("epoch"))
    with pytest.raises(Exception, match="lost"):
        tables.append_epochs(broken, path, attempt="second")
    # Rows that were written, and no marker: as if the driver had been lost in between.
    epoch_rows(spark, 2, 3).write.parquet(f"{path}/appends/left-over")
    assert [r["epoch"] for r in tables.read_epochs(spark, path).collect()] == [1]
    tables.append_epochs(epoch_rows(spark, 2, 3), path, attempt="second")
    assert sorted(r["epoch"] for r in tables.read_epochs(spark, path).collect()) == [1, 2, 3]


GEOMETRY = """; a comment = not read
clen = 0.1
res = 10000 ; pixels per metre
coffset = 0.01
rigid_group_q0 = p0a0,p0a1
badregion/min_fs = 1
badregion/max_fs = 2
p0a0/fs = +1.0x +0.0y
p0a0/ss = -0.0x +1.0y
p0a0/corner_x = -2.0
p0a0/corner_y = 1.5
p0a0/min_fs = 0
p0a0/max_fs = 3
p0a0/min_ss = 0
p0a0/max_ss = 1

p0a1/fs = -y
p0a1/ss = x
p0a1/res = 5000
p0a1/coffset = 0.02
p0a1/corner_x = 5
p0a1/corner_x = 6
p0a1/corner_y = 0
p0a1/min_fs = 4
p0a1/max_fs = 7
p0a1/min_ss = 0
p0a1/max_ss = 1
"""


def test_geometry_text(spark, tmp_path):
    panels = geometry_files.read_geometry_text(spark, write(tmp_path / "g.geom", GEOMETRY), "D")
    a, b = panels.orderBy("panel_order").collect()
    assert (a["panel"], a["n_ss"], a["n_fs"], a["ss0"], a["ss1"], a["fs0"], a["fs1"], a["module"]) == ("p0a0", 2, 4, 0, 2, 0, 4, 0)
    assert a["fs_vec"] == pytest.approx([1e-4, 0, 0]) and a["t_vec"] == pytest.approx([-2e-4, 1.5e-4, 0.11])
    assert b["fs_vec"] == pytest.approx([0, -2e-4, 0]) and b["ss_vec"] == pytest.approx([2e-4, 0, 0])
    assert b["t_vec"] == pytest.approx([12e-4, 0, 0.12])
    summary = geometry.geometry_summary(panels).first()
    assert (summary["panels"], summary["pixels"], summary["defines_slicing"]) == (2, 16, True)
    moved = geometry.geometry_summary(geometry.set_distance(panels, F.lit(0.5))).first()
    assert moved["distance"] == pytest.approx(0.5)


def test_geometry_json(spark, tmp_path):
    panel = {"name": "m0", "n_ss": 514, "n_fs": 1030, "fs_vec": [7.5e-05, 0, 0], "ss_vec": [0, 7.5e-05, 0], "t_vec": [0, 0, 0.1],
             "parent_data_shape": [2164, 2068], "parent_data_slice": [[0, 514, None], [1038, 2068, None]]}
    path = write(tmp_path / "g.json", json.dumps([panel, {**panel, "name": "m1"}], indent=1))
    rows = geometry_files.read_geometry_json(spark, path, "J").orderBy("panel_order").collect()
    assert [r["panel"] for r in rows] == ["m0", "m1"]
    assert (rows[0]["ss0"], rows[0]["ss1"], rows[0]["fs0"], rows[0]["fs1"]) == (0, 514, 1038, 2068)


def test_loaders(spark):
    frames = frame_rows(spark)
    session_files = spark.createDataFrame([("A_f0", "A/f0.cxi"), ("B_f1", "B/f1.cxi")], "session_id string, path string")
    label_files = spark.createDataFrame([("A/f0.cxi", [1.0, 0.0, 1.0]), ("B/f1.cxi", [0.0])], "path string, labels array<float>")
    rows = loaders.session_tensors(frames, label_files, session_files, session_files.where("session_id = 'A_f0'")).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["label"], r["c"], r["h"]) for r in rows] == [(0, 1, 1, 2), (1, 0, 1, 2), (2, 1, 1, 2)]
    listed = spark.createDataFrame([(0, "B/f0.cxi"), (1, "A/f1.cxi")], "ordinal int, path string")
    label_map = spark.createDataFrame([("B/f0.cxi", 1), ("A/f1.cxi", 0)], "path string, label int")
    rows = loaders.listed_tensors(frames, listed, label_map).orderBy("ordinal").collect()
    assert [(r["path"], r["label"]) for r in rows] == [("B/f0.cxi", 1), ("A/f1.cxi", 0)]
    rows = loaders.unlabelled_tensors(frames, listed).collect()
    assert len(rows) == 10 and all(r["label"] is None for r in rows)


def test_descriptions(spark):
    files_df = spark.createDataFrame([("f1",), ("f1",), ("f2",)], "path string")
    stored = spark.createDataFrame([("f1", bytearray(b"AGIPD 1M"))], "path string, description binary")
    got = catalog.attach_descriptions(files_df, stored, strict=False).orderBy("path").collect()
    assert [r["description"] for r in got] == ["AGIPD 1M", "AGIPD 1M", None]
    with pytest.raises(Exception, match="no description in f2"):
        catalog.attach_descriptions(files_df, stored).collect()


def test_geometry_by_name(spark, tmp_path):
    text = write(tmp_path / "g.geom", GEOMETRY)
    panel = {"name": "m0", "n_ss": 1, "n_fs": 1, "fs_vec": [1e-4, 0, 0], "ss_vec": [0, 1e-4, 0], "t_vec": [0, 0, 0.2],
             "parent_data_shape": [1, 1], "parent_data_slice": [[0, 1, None], [0, 1, None]]}
    known = {"Eiger4M": text, "JUNGFRAU_4M": write(tmp_path / "j.json", json.dumps([panel]))}
    distance = lambda p: geometry.geometry_summary(p).first()["distance"]
    assert distance(geometry_files.load_geometry(spark, "Eiger4M", known)) == pytest.approx(0.115)
    assert distance(geometry_files.load_geometry(spark, "Eiger4M", known, 0.3)) == pytest.approx(0.3)
    assert distance(geometry_files.load_geometry(spark, "JUNGFRAU_4M", known)) == pytest.approx(0.103)
    with pytest.raises(ValueError, match="AGIPD"):
        geometry_files.load_geometry(spark, "Pilatus", known)


def test_detector_names(spark):
    df = spark.createDataFrame([("AGIPD",), ("Pilatus",)], "detector string")
    with pytest.raises(Exception, match="unknown detector Pilatus; valid: A"):
        catalog.known_detectors(df, ("AGIPD", "Eiger4M")).collect()


@pytest.mark.parametrize("text", ['{"a": 1', '{"a": "one"}', "[1, 2]"])
def test_malformed_label_map_fails(spark, text):
    maps = spark.createDataFrame([('{"x": 1}',), (text,)], "value string")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.label_map_entries(maps).collect()


def test_malformed_geometry_fails(spark, tmp_path):
    texts = spark.createDataFrame([("D", '[{"name": "p0"')], "detector string, value string")
    with pytest.raises(Exception, match="(?i)malformed"):
        geometry_files.panels_from_json(texts).collect()
    lines = ["res = 1000", "p0/min_fs = 0", "p0/max_fs = oops", "p0/min_ss = 0", "p0/max_ss = 3", "p0/fs = x", "p0/ss = y", "p0/corner_x = 0", "p0/corner_y = 0"]
    path = write(tmp_path / "bad.geom", "\n".join(lines))
    with pytest.raises(Exception, match="no usable max_fs for panel D p0"):
        geometry_files.read_geometry_text(spark, path, "D").collect()


def test_one_frame_is_read_from_one_file(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = [("A", f"A/f{p:03}.cxi", i, 2, 2, [float(i)] * 4) for p in range(40) for i in range(5)]
    made = spark.createDataFrame(rows, "detector string, path string, frame_idx int, h int, w int, pixels array<float>").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keeps the small ranges apart
    try:
        tables.write_frames(made, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = tables.read_frame_table(spark, path)
    held = back.groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct("path", "frame_idx")).alias("a"), F.max(F.struct("path", "frame_idx")).alias("b"))
    spans = sorted((tuple(r["a"]), tuple(r["b"])) for r in held.collect())
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_axes_of_a_vector_are_cut_out_once(spark):
    rows = [("D", "p1", "fs", "-0.99x +0.004y", 1), ("D", "p1", "ss", "y - z", 2), ("D", "p1", "res", "10", 3), ("D", "p1", "clen", "1", 4)]
    rows += [("D", "p1", k, "3", i) for i, k in enumerate(("corner_x", "corner_y", "min_fs", "max_fs", "min_ss", "max_ss"), 5)]
    panels = geometry_files.panels_from_entries(spark.createDataFrame(rows, "detector string, panel string, key string, value string, line int"), "line")
    got = panels.first()
    assert got["fs_vec"] == pytest.approx([-0.099, 0.0004, 0.0]) and got["ss_vec"] == pytest.approx([0.0, 0.1, -0.1])
    # One pattern search for each axis of a line, however often its result is used.
    plan = panels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace(") == 3
    # Parsing and aggregation are compiled apart, as methods small enough for the JVM's compiler.
    assert plan.count("Repartition") >= 2
