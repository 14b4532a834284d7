import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from diffspark.functions import arrays
from diffspark.operators import catalog, geometry, normalize
from diffspark.operators.axis_weights import box_matrix, nonzero, resize_matrix
from diffspark.plans import preprocessing


def frames(spark, images, **columns):
    rows = [(i, *columns.values(), *a.shape, [float(v) for v in a.ravel()]) for i, a in enumerate(images)]
    extra = "".join(f"{k} string, " for k in columns)
    return spark.createDataFrame(rows, f"frame_id long, {extra}h int, w int, pixels array<float>")


def arrays_of(df):
    return {r["frame_id"]: np.array(r["pixels"]).reshape(r["h"], r["w"]) for r in df.collect()}


def brute_gcn(a):
    return (a - a.mean()) / (a.std() + 1e-6)


def brute_lcn(a, window):
    """Every pixel's window gathered one by one."""
    h, w = a.shape
    before, after = window // 2, window - window // 2 - 1
    mirror = lambda k, n: k % (2 * n) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
    out = np.empty_like(a)
    for y in range(h):
        for x in range(w):
            ys = [mirror(k, h) for k in range(y - before, y + after + 1)]
            xs = [mirror(k, w) for k in range(x - before, x + after + 1)]
            cut = a[np.ix_(ys, xs)]
            spread = np.sqrt(max((cut**2).mean() - cut.mean() ** 2, 0))
            out[y, x] = (a[y, x] - cut.mean()) / (spread + 1e-6)
    return out


def random_images(*shapes):
    rng = np.random.default_rng(0)
    return [rng.standard_normal(s).astype(np.float32).astype(np.float64) for s in shapes]


def test_gcn_properties(spark):
    image = random_images((64, 64))[0]
    done = arrays_of(normalize.gcn_frames(frames(spark, [image, np.full((64, 64), 5.0), 2 * image + 3])))
    assert abs(done[0].mean()) < 1e-10 and abs(done[0].std() - 1) < 1e-4
    assert np.isfinite(done[1]).all() and abs(done[1]).max() < 1e-6
    assert np.allclose(done[0], done[2], atol=1e-5)


@pytest.mark.parametrize("window", [1, 3, 4, 9, 31])
def test_lcn_against_brute_force(spark, window):
    images = random_images((8, 8), (5, 12), (70, 90))
    done = arrays_of(normalize.normalize_frames(frames(spark, images), None, window))
    for i, image in enumerate(images):
        assert np.allclose(done[i], brute_lcn(brute_gcn(image), window), atol=1e-5), i


def test_constant_image_is_finite(spark):
    done = arrays_of(normalize.normalize_frames(frames(spark, [np.full((64, 64), 500.0)]), (24, 24)))
    assert np.isfinite(done[0]).all()


def test_order_of_gcn_and_lcn_matters(spark):
    image = random_images((32, 32))[0] * 40 + 7
    first = arrays_of(normalize.normalize_frames(frames(spark, [image]), None, 9, lcn=True))[0]
    lcn_only = normalize.normalize_frames(frames(spark, [image]), None, 9, gcn=False)
    swapped = arrays_of(normalize.normalize_frames(lcn_only, None, lcn=False))[0]
    assert not np.allclose(first, swapped, atol=1e-4)


def test_resize_matrices_by_hand():
    up = resize_matrix(2, 4)  # centres -0.25, 0.25, 0.75, 1.25; reflected about the edge pixels
    assert np.allclose(up, [[0.75, 0.25], [0.75, 0.25], [0.25, 0.75], [0.25, 0.75]])
    assert np.allclose(resize_matrix(6, 6), np.eye(6))
    down = resize_matrix(4, 2)  # sigma 0.5, radius 2; centres 0.5 and 2.5
    g = np.exp(-2.0 * np.arange(-2, 3) ** 2)
    g /= g.sum()
    row0 = np.array([g[2], g[1] + g[3], g[0] + g[4], 0])  # smoothing around pixel 0
    row1 = np.array([g[1], g[2] + g[0] * 0, g[3], g[4]])
    row1 = np.array([g[1], g[2] + g[0], g[3], g[4]])  # position -1 reflects to 1
    assert np.allclose(down[0], (row0 + row1) / 2)
    for n_in, n_out in ((100, 7), (7, 100), (1687, 224)):
        assert np.allclose(resize_matrix(n_in, n_out).sum(axis=1), 1)


def test_resize_keeps_a_plane_inside(spark):
    y, x = np.mgrid[0:96, 0:96].astype(float)
    out = arrays_of(normalize.normalize_frames(frames(spark, [x + 2 * y]), (24, 24), gcn=False, lcn=False))[0]
    centre = (np.arange(24) + 0.5) * 4 - 0.5
    expected = centre[None, :] + 2 * centre[:, None]
    assert np.allclose(out[4:-4, 4:-4], expected[4:-4, 4:-4], atol=1e-3)


def test_pixel_and_arrow_forms_agree(spark):
    images = random_images((12, 9))
    df = frames(spark, images)
    arrow = arrays_of(normalize.normalize_frames(df, (5, 7), 3))[0]
    pixels = normalize.pixels_of(df, ["frame_id"], F.col("w"))
    rows = normalize.normalize_pixels(pixels, ["frame_id"], 12, 9, (5, 7), 3).collect()
    other = np.zeros((5, 7))
    for r in rows:
        other[r["y"], r["x"]] = r["v"]
    assert np.allclose(arrow, other, atol=1e-6)


def test_default_size_dtype_and_mixed_shapes(spark):
    df = frames(spark, random_images((40, 30), (64, 64), (300, 10)))
    done = preprocessing.preprocess_assembled(df)
    assert done.schema["pixels"].dataType.simpleString() == "array<float>"
    for a in arrays_of(done).values():
        assert a.shape == (224, 224) and np.isfinite(a).all()
    assert arrays_of(done)[1].tobytes() == arrays_of(preprocessing.preprocess_assembled(df.repartition(3)))[1].tobytes()


def test_wrong_pixel_count_fails(spark):
    df = frames(spark, random_images((4, 4))).withColumn("h", F.lit(5))
    with pytest.raises(Exception, match="does not hold"):
        normalize.normalize_frames(df, None).collect()


def test_box_weights_sum_to_one():
    for n, window in ((8, 9), (8, 31), (1, 3), (5, 4)):
        assert np.allclose(box_matrix(n, window).sum(axis=1), 1)
    assert len(nonzero(np.eye(3))) == 3


def test_shape_rules(spark):
    df = spark.createDataFrame([([100, 80],), ([16, 512, 128],), ([2068 * 2162],)], "shape array<int>")
    got = df.select(arrays.shape_2d(F.col("shape"), F.lit(2068), F.lit(2162)).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [(100, 80), (8192, 128), (2068, 2162)]
    with pytest.raises(Exception, match="1-D frame"):
        df.where("size(shape) = 1").select(arrays.shape_2d(F.col("shape"))).collect()
    four = spark.createDataFrame([([1, 2, 3, 4],)], "shape array<int>")
    with pytest.raises(Exception, match="dimensions"):
        four.select(arrays.shape_2d(F.col("shape"))).collect()


PANELS = (
    "detector string, panel string, panel_order long, n_ss int, n_fs int, fs_vec array<double>, ss_vec array<double>, "
    "t_vec array<double>, ss0 int, ss1 int, fs0 int, fs1 int, module int"
)


def panel(name, order, t, fs, ss, rect, shape=(2, 3), detector="D"):
    return (detector, name, order, *shape, [*fs, 0.0], [*ss, 0.0], [*t, 0.1], *rect, None)


def two_panels(spark, overlap=False):
    """A 4 x 3 frame of two 2 x 3 panels; the second is turned by 90 degrees (or lies on the first)."""
    first = panel("a", 0, (-3.0, -1.0), (1.0, 0.0), (0.0, 1.0), (0, 2, 0, 3))
    turned = panel("b", 1, (2.0, 1.0), (0.0, 1.0), (-1.0, 0.0), (2, 4, 0, 3))
    same = panel("b", 1, (-3.0, -1.0), (1.0, 0.0), (0.0, 1.0), (2, 4, 0, 3))
    return spark.createDataFrame([first, same if overlap else turned], PANELS)


def test_assembly_by_hand(spark):
    image = np.arange(1.0, 13.0).reshape(4, 3)
    df = frames(spark, [image], detector="D")
    lists = preprocessing.assembly_of(two_panels(spark), {"D": 3})
    out = arrays_of(geometry.assemble_frames(df, lists))[0]
    expected = np.zeros((7, 7))
    expected[2:4, 0:3] = image[:2]
    expected[4:7, 5] = image[2]  # fast axis along y, slow axis towards smaller x
    expected[4:7, 4] = image[3]
    assert np.array_equal(out, expected)
    kernel = normalize.normalize_frames(
        df.withColumn("_as", F.col("detector")), None, gcn=False, lcn=False, assembly=preprocessing.assembly_arrays(lists), assemble_as="_as"
    )
    assert np.array_equal(arrays_of(kernel)[0], expected)


def test_later_panel_wins(spark):
    image = np.arange(1.0, 13.0).reshape(4, 3)
    lists = preprocessing.assembly_of(two_panels(spark, overlap=True), {"D": 3})
    out = arrays_of(geometry.assemble_frames(frames(spark, [image], detector="D"), lists))[0]
    assert np.array_equal(out[2:4, 0:3], image[2:])


def test_panels_are_cut_out_and_keep_their_values(spark):
    image = np.arange(1.0, 13.0).reshape(4, 3)
    cut = geometry.cut_panels(frames(spark, [image], detector="D"), two_panels(spark))
    got = {r["panel"]: np.array(r["pixels"]).reshape(r["h"], r["w"]) for r in cut.collect()}
    assert np.array_equal(got["a"], image[:2]) and np.array_equal(got["b"], image[2:])
    bare = two_panels(spark).withColumn("ss0", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="does not define"):
        geometry.cut_panels(frames(spark, [image], detector="D"), bare).collect()


def test_large_lists_take_the_shuffled_path(spark, monkeypatch):
    from diffspark.operators import lookup

    image = np.arange(1.0, 13.0).reshape(4, 3)
    df = frames(spark, [image, image + 1, image + 2], detector="D")
    lists = preprocessing.assembly_of(two_panels(spark), {"D": 3})
    before = arrays_of(preprocessing.preprocess_panels(df, lists, 3, (4, 4)))
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(preprocessing, "BROADCAST_BYTES", 1)
    joined = geometry.assemble_frames(df, lists)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    after = arrays_of(preprocessing.preprocess_panels(df, lists, 3, (4, 4)))
    assert all(np.allclose(before[k], after[k]) for k in before)


def test_routing(spark):
    images = random_images((4, 3), (4, 3), (4, 3), (4, 3))
    rows = [
        (i, d, t, 4, 3, [float(v) for v in a.ravel()])
        for i, (a, d, t) in enumerate(zip(images, ("Eiger4M", "ePix10k", "JUNGFRAU_4M", "x"), ("EIGER 4M", "ePix10k 2.2M", "Jungfrau 4M", None), strict=True))
    ]
    df = spark.createDataFrame(rows, "frame_id long, detector string, description string, h int, w int, pixels array<float>")
    panels = two_panels(spark).withColumn("detector", F.lit("Eiger4M"))
    lists = preprocessing.assembly_of(panels, {"Eiger4M": 3})
    done = preprocessing.preprocess_routed(df, lists, 3, (6, 6))
    got = {r["frame_id"]: (r["route"], r["route_reason"]) for r in done.collect()}
    assert got == {
        0: ("canvas", "geometry"),
        1: ("assembled", "no geometry"),
        2: ("assembled", "pre-assembled"),
        3: ("assembled", "no description"),
    }
    assert catalog.quality_gate(done, (6, 6)).where("NOT passed").isEmpty()


def test_display_range(spark):
    values = np.concatenate([np.arange(-5, 0), np.arange(1, 1001)]).astype(float)
    df = frames(spark, [values.reshape(1, -1), np.full((2, 2), -1.0)])
    got = {r["frame_id"]: r["r"] for r in df.select("frame_id", arrays.display_range(F.col("pixels")).alias("r")).collect()}
    positive = values[values > 0]
    assert got[0]["vmin"] == pytest.approx(np.percentile(positive, 1))
    assert got[0]["vmax"] == pytest.approx(np.percentile(positive, 99.9))
    assert tuple(got[1]) == (0.0, 1.0)
    fixed = df.select(arrays.display_range(F.col("pixels"), 7.0).alias("r")).first()["r"]
    assert fixed["vmax"] == 7.0


def test_finite_flag(spark):
    df = frames(spark, [np.array([[1.0, np.nan]]), np.array([[1.0, -np.inf]]), np.array([[1.0, 2.0]])])
    got = [r["f"] for r in df.orderBy("frame_id").select(arrays.all_finite(F.col("pixels")).alias("f")).collect()]
    assert got == [False, False, True]


def test_runs_go_with_the_lines_of_panels(spark):
    panels = spark.createDataFrame([panel(f"p{i}", i, (600.0 * i, -50.0), (1.0, 0.0), (0.0, 1.0), (100 * i, 100 * (i + 1), 0, 500), (100, 500)) for i in range(4)], PANELS)
    lists = preprocessing.assembly_of(panels, {"D": 500})
    row = lists.select("side", "needs", F.size("runs").alias("n"), F.sum(F.lit(1)).over(Window.partitionBy("side")).alias("rows")).first()
    assert (row["needs"], row["n"], row["rows"]) == (200_000, 400, 1)
    image = np.random.default_rng(1).random((400, 500)).astype(np.float32)
    out = arrays_of(geometry.assemble_frames(frames(spark, [image], detector="D"), lists))[0]
    side, middle = row["side"], row["side"] // 2
    expected = np.zeros((side, side), np.float32)
    for i in range(4):
        expected[middle - 50 : middle + 50, middle + 600 * i : middle + 600 * i + 500] = image[100 * i : 100 * (i + 1)]
    assert np.array_equal(out, expected)


def test_panels_far_apart_fail(spark):
    panels = spark.createDataFrame([panel("a", 0, (1e6, 0.0), (1.0, 0.0), (0.0, 1.0), (0, 2, 0, 3))], PANELS)
    with pytest.raises(Exception, match="too far apart"):
        preprocessing.assembly_of(panels, {"D": 3})


def test_display_range_is_that_of_sorted_pixels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((0, 1, 2, 3, 10, 999, 1000, 1001))] + [(98, None), (99, [None, 2.0, float("nan"), 3.0])]
    df = spark.createDataFrame(rows, "i int, pixels array<double>")
    query = df.select("i", arrays.display_range(F.col("pixels")).alias("r"))
    assert "Sort" not in query._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: tuple(r["r"]) for r in query.collect()}
    for i, values in rows:
        lit = np.array([v for v in values or [] if v is not None and v > 0])
        want = tuple(np.percentile(lit, [1, 99.9])) if len(lit) else (0.0, 1.0)
        assert got[i] == pytest.approx(want)
