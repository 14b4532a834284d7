"""Images: reshape, contrast normalisation, resize, panels, routing, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffspark.functions.arrays import display_range as display_range_of
from diffspark.operators import catalog, geometry, normalize
from diffspark.plans import preprocessing
from registry.common import images, q6, r6, rounded

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ------------------------------------------------------------------ SQL of the image operators
# An image table is (id, n, y, x, v) with side n.

PX = """px AS (
  SELECT vec_id AS id, CAST(8 AS BIGINT) AS n, i // 8 AS y, i % 8 AS x, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)
)"""

EPS = "CAST('1e-6' AS DOUBLE)"


def gcn_cte(src, out):
    return f"""{out} AS (
  SELECT id, n, y, x, (v - avg(v) OVER (PARTITION BY id)) / (stddev_pop(v) OVER (PARTITION BY id) + {EPS}) AS v FROM {src}
)"""


def lcn_cte(src, out, windows):
    wins = ", ".join(f"({w})" for w in windows)
    return f"""{out}_idx AS (
  SELECT n, win, dst, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS src FROM (
    SELECT n, win, dst, (dst + o + 200 * n) % (2 * n) AS m FROM (
      SELECT n, win, dst, unnest(range(-(win // 2), win - win // 2)) AS o FROM (
        SELECT n, win, unnest(range(n)) AS dst FROM (SELECT DISTINCT n FROM {src}) a, (VALUES {wins}) w(win))))
),
{out}_y AS (
  SELECT p.id, p.n, i.win, i.dst AS y, p.x, avg(p.v) AS m, avg(p.v * p.v) AS q
  FROM {src} p JOIN {out}_idx i ON p.n = i.n AND p.y = i.src GROUP BY ALL
),
{out}_x AS (
  SELECT p.id, p.n, p.win, p.y, i.dst AS x, avg(p.m) AS m, avg(p.q) AS q
  FROM {out}_y p JOIN {out}_idx i ON p.n = i.n AND p.win = i.win AND p.x = i.src GROUP BY ALL
),
{out} AS (
  SELECT l.id, l.n, l.win, l.y, l.x, (p.v - l.m) / (sqrt(greatest(l.q - l.m * l.m, 0)) + {EPS}) AS v
  FROM {out}_x l JOIN {src} p ON l.id = p.id AND l.y = p.y AND l.x = p.x
)"""


def _mirror(k):
    """Position k reflected about the edge pixels of side n."""
    m = f"(({k} + 200 * (n - 1)) % (2 * n - 2))"
    return f"CASE WHEN {m} < n THEN {m} ELSE 2 * n - 2 - {m} END"


def resize_cte(src, out, side):
    return f"""{out}_s AS (
  SELECT n, greatest(CAST(0 AS DOUBLE), (n / CAST({side} AS DOUBLE) - 1) / 2) AS sigma FROM (SELECT DISTINCT n FROM {src})
),
{out}_g0 AS (
  SELECT n, o, CASE WHEN sigma > 0 THEN exp(-o * o / (2 * sigma * sigma)) ELSE CAST(1 AS DOUBLE) END AS g FROM (
    SELECT n, sigma, unnest(range(-CAST(floor(4 * sigma + 0.5) AS BIGINT), CAST(floor(4 * sigma + 0.5) AS BIGINT) + 1)) AS o FROM {out}_s)
),
{out}_g AS (
  SELECT n, mid, {_mirror('(mid + o)')} AS src, g / sum(g) OVER (PARTITION BY n, mid) AS w
  FROM (SELECT n, o, g, unnest(range(n)) AS mid FROM {out}_g0)
),
{out}_c AS (
  SELECT n, dst, (dst + CAST('0.5' AS DOUBLE)) * n / {side} - CAST('0.5' AS DOUBLE) AS c
  FROM (SELECT n, unnest(range({side})) AS dst FROM {out}_s)
),
{out}_l AS (
  SELECT n, dst, {_mirror('CAST(floor(c) AS BIGINT)')} AS mid, 1 - (c - floor(c)) AS w FROM {out}_c
  UNION ALL SELECT n, dst, {_mirror('(CAST(floor(c) AS BIGINT) + 1)')}, c - floor(c) FROM {out}_c
),
{out}_w AS (
  SELECT l.n, l.dst, g.src, sum(l.w * g.w) AS w FROM {out}_l l JOIN {out}_g g ON l.n = g.n AND l.mid = g.mid GROUP BY ALL
),
{out}_y AS (
  SELECT p.id, p.n, p.win, i.dst AS y, p.x, sum(p.v * i.w) AS v FROM {src} p JOIN {out}_w i ON p.n = i.n AND p.y = i.src GROUP BY ALL
),
{out} AS (
  SELECT p.id, p.win, p.y, i.dst AS x, sum(p.v * i.w) AS v FROM {out}_y p JOIN {out}_w i ON p.n = i.n AND p.x = i.src GROUP BY ALL
)"""


def chain(src, window, side):
    return ",\n".join([gcn_cte(src, "g"), lcn_cte("g", "l", [window]), resize_cte("l", "r", side)])


# ------------------------------------------------------------------ Spark side


def _pixels(spark, d):
    return normalize.pixels_of(images(spark, d), ["vec_id"], F.lit(8))


def _long(frames, keys=("vec_id",), pixels="pixels"):
    """Frames to pixel rows for comparison."""
    rows = normalize.pixels_of(frames.withColumn("_side", F.col("w")), list(keys), F.col("_side"), pixels)
    return rounded(_wide_index(rows), "v")


def _wide_index(rows):
    return rows.withColumns({"y": F.col("y").cast("long"), "x": F.col("x").cast("long")})


_OUT = f"id AS vec_id, y, x, {q6('v')} AS v"
_OUT32 = f"id AS vec_id, y, x, {q6('CAST(v AS FLOAT)')} AS v"


@query(f"WITH {PX} SELECT {_OUT} FROM px")
def pixels_long(spark, d):
    return rounded(_wide_index(_pixels(spark, d)), "v")


@query(
    """SELECT vec_id, 32 AS h, 2 AS w, i // 2 AS y, i % 2 AS x, round(CAST(v AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS v
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)"""
)
def to2d_rowstack(spark, d):
    from diffspark.functions.arrays import shape_2d

    shape = shape_2d(F.array(F.lit(4), F.lit(8), F.lit(2)))
    frames = images(spark, d).drop("h", "w").select("vec_id", "pixels", shape.alias("s")).select("vec_id", "pixels", "s.*")
    return _long(frames, ("vec_id", "h", "w"))


@query(f"WITH {PX}, {gcn_cte('px', 'g')} SELECT {_OUT} FROM g")
def gcn_pixels(spark, d):
    return rounded(_wide_index(normalize.gcn_pixels(_pixels(spark, d), ["vec_id"])), "v")


@query(f"WITH {PX}, {gcn_cte('px', 'g')} SELECT {_OUT} FROM g")
def gcn_frames(spark, d):
    return _long(normalize.gcn_frames(images(spark, d)))


@query(f"WITH {PX}, {lcn_cte('px', 'l', [3])} SELECT {_OUT} FROM l")
def lcn_pixels(spark, d):
    return rounded(_wide_index(normalize.lcn_pixels(_pixels(spark, d), ["vec_id"], 8, 8, 3)), "v")


@query(f"WITH {PX}, {lcn_cte('px', 'l', [4])} SELECT {_OUT32} FROM l")
def lcn_even_window(spark, d):
    return _long(normalize.normalize_frames(images(spark, d), None, 4, gcn=False))


@query(f"WITH {PX}, {gcn_cte('px', 'g')}, {lcn_cte('g', 'l', [9])} SELECT {_OUT32} FROM l")
def gcn_lcn_order(spark, d):
    return _long(normalize.normalize_frames(images(spark, d), None, 9))


# 81 neighbouring vectors as one frame of 72 x 72; where the last frame lacks vectors it is zero.
_TILED = """tiles AS (
  SELECT vec_id // 81 AS id, vec_id % 81 // 9 * 8 + i // 8 AS y, vec_id % 9 * 8 + i % 8 AS x, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)
), grid AS (SELECT id, unnest(range(5184)) AS cell FROM (SELECT DISTINCT id FROM tiles)),
px AS (
  SELECT g.id, CAST(72 AS BIGINT) AS n, cell // 72 AS y, cell % 72 AS x, coalesce(v, 0) AS v
  FROM grid g LEFT JOIN tiles t ON t.id = g.id AND t.y = cell // 72 AND t.x = cell % 72
)"""


@query(f"WITH {_TILED}, {gcn_cte('px', 'g')}, {lcn_cte('g', 'l', [9])} SELECT {_OUT32} FROM l")
def lcn_large_side(spark, d):
    """Frames with sides of 72."""
    k, i = F.col("vec_id") % 81, F.col("i")
    y, x = F.floor(k / 9) * 8 + F.floor(i / 8), k % 9 * 8 + i % 8
    vectors = images(spark, d).select("vec_id", F.posexplode("pixels").alias("i", "v"))
    tiles = vectors.select(F.floor(F.col("vec_id") / 81).alias("g"), (y * 72 + x).cast("int").alias("cell"), "v")
    grid = tiles.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(72 * 72 - 1))).alias("cell"))
    cells = grid.join(tiles, ["g", "cell"], "left").select("g", F.struct("cell", F.coalesce("v", F.lit(0.0)).cast("float").alias("v")).alias("c"))
    frames = cells.groupBy(F.col("g").alias("vec_id")).agg(F.sort_array(F.collect_list("c")).alias("c"))
    frames = frames.select("vec_id", F.lit(72).alias("h"), F.lit(72).alias("w"), F.col("c.v").alias("pixels"))
    return _long(normalize.normalize_frames(frames, None, 9))


@query(
    f"""WITH {PX}, {gcn_cte('px', 'g')}, {lcn_cte('g', 'l', [3, 9, 15, 31])}
SELECT id AS vec_id, CAST(win AS INTEGER) AS lcn_window, y, x, {q6('CAST(v AS FLOAT)')} AS v FROM l"""
)
def lcn_window_sweep(spark, d):
    return _long(preprocessing.window_sweep(images(spark, d), size=None), ("vec_id", "lcn_window"))


_SCALE = "min(CAST(CAST(v AS FLOAT) AS DOUBLE))", "max(CAST(CAST(v AS FLOAT) AS DOUBLE))"


@query(
    f"""WITH {PX}, {gcn_cte('px', 'g')}, {lcn_cte('g', 'l', [3, 9, 15, 31])}
SELECT label, {q6(_SCALE[0])} AS vmin, {q6(_SCALE[1])} AS vmax FROM l JOIN embeddings ON vec_id = id GROUP BY label"""
)
def ablation_scale(spark, d):
    swept = preprocessing.window_sweep(images(spark, d), size=None)
    return rounded(preprocessing.shared_scale(swept, ["label"]), "vmin", "vmax")


def _resized(side):
    return f"WITH {PX}, one AS (SELECT *, 1 AS win FROM px), {resize_cte('one', 'r', side)} SELECT {_OUT} FROM r"


@query(_resized(4))
def resize_4x4(spark, d):
    return rounded(_wide_index(normalize.resize_pixels(_pixels(spark, d), ["vec_id"], 8, 8, (4, 4))), "v")


@query(_resized(16))
def resize_16x16(spark, d):
    return rounded(_wide_index(normalize.resize_pixels(_pixels(spark, d), ["vec_id"], 8, 8, (16, 16))), "v")


@query(
    f"WITH {PX}, one AS (SELECT *, 1 AS win FROM px), {resize_cte('one', 'r', 3)} SELECT {_OUT32} FROM r"
)
def resize_arrow_3x3(spark, d):
    return _long(normalize.normalize_frames(images(spark, d), (3, 3), gcn=False, lcn=False))


@query(f"WITH {PX}, {chain('px', 3, 5)} SELECT {_OUT32} FROM r")
def normalize_pixels(spark, d):
    return rounded(_wide_index(normalize.normalize_pixels(_pixels(spark, d), ["vec_id"], 8, 8, (5, 5), 3).withColumn("v", F.col("v").cast("double"))), "v")


@query(f"WITH {PX}, {chain('px', 3, 5)} SELECT {_OUT32} FROM r")
def normalize_arrow(spark, d):
    return _long(preprocessing.preprocess_assembled(images(spark, d), window=3, size=(5, 5)))


_CANVAS = "detector string, panel string, panel_order long, n_ss int, n_fs int, fs_vec array<double>, ss_vec array<double>, t_vec array<double>, ss0 int, ss1 int, fs0 int, fs1 int, module int"
_PIXEL = 1e-4


def _canvas_panels(detector, turned):
    """Four 4 x 4 panels of an 8 x 8 canvas, a gap of one cell around the beam; optionally turned by 180 degrees."""
    step = -_PIXEL if turned else _PIXEL
    rows = []
    for i, (ss0, fs0) in enumerate(((0, 0), (0, 4), (4, 0), (4, 4))):
        corner = [(o + (1 if o else 0) - 4 + (3 if turned else 0)) * _PIXEL for o in (fs0, ss0)]
        rows.append(
            (detector, f"q{i}", i, 4, 4, [step, 0.0, 0.0], [0.0, step, 0.0], [*corner, 0.1], ss0, ss0 + 4, fs0, fs0 + 4, None)
        )
    return rows


def _module_panels(detector):
    """Two stacked modules of 4 x 8, each of two 2 x 8 panels restarting at row 0, a gap of one row between modules."""
    rows = []
    for m in range(2):
        for a in range(2):
            y = m * 4 + a * 2 + (1 if m else 0) - 4
            rows.append(
                (detector, f"p{m}a{a}", m * 2 + a, 2, 8, [_PIXEL, 0.0, 0.0], [0.0, _PIXEL, 0.0], [-4 * _PIXEL, y * _PIXEL, 0.1], a * 2, a * 2 + 2, 0, 8, m)
            )
    return rows


def _panels(spark, *rows):
    return spark.createDataFrame([r for part in rows for r in part], _CANVAS)


def _two_detectors(spark, d):
    name = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    frames = images(spark, d).withColumn("detector", name).drop("label")
    return frames, _panels(spark, _canvas_panels("even", False), _canvas_panels("odd", True))


@query(
    f"""WITH {PX} SELECT id AS vec_id, 'q' || (y // 4 * 2 + x // 4) AS panel, y % 4 AS y, x % 4 AS x, {q6('v')} AS v FROM px"""
)
def panel_slice(spark, d):
    frames, panels = _two_detectors(spark, d)
    return _long(geometry.cut_panels(frames, panels), ("vec_id", "panel"))


# Cells of the assembled 9 x 9 image: a gap row and column 4; odd labels turned inside each panel.
_ASSEMBLED = f"""{PX}, placed AS (
  SELECT id, CASE WHEN label % 2 = 0 THEN y ELSE y // 4 * 4 + 3 - y % 4 END + y // 4 AS y,
    CASE WHEN label % 2 = 0 THEN x ELSE x // 4 * 4 + 3 - x % 4 END + x // 4 AS x, v
  FROM px JOIN embeddings ON vec_id = id
), grid AS (SELECT vec_id AS id, unnest(range(81)) AS cell FROM embeddings),
image AS (
  SELECT g.id, CAST(9 AS BIGINT) AS n, cell // 9 AS y, cell % 9 AS x, coalesce(v, 0) AS v
  FROM grid g LEFT JOIN placed p ON p.id = g.id AND p.y = cell // 9 AND p.x = cell % 9
)"""


@query(f"WITH {_ASSEMBLED} SELECT {_OUT} FROM image")
def panel_assemble(spark, d):
    frames, panels = _two_detectors(spark, d)
    lists = preprocessing.assembly_of(panels, {"even": 8, "odd": 8})
    return _long(geometry.assemble_frames(frames, lists))


@query(
    """WITH c AS (SELECT 'even' AS detector, i // 8 AS a, i % 8 AS b, i FROM (SELECT unnest(range(64)) AS i)
  UNION ALL SELECT 'odd', i // 8, i % 8, i FROM (SELECT unnest(range(64)) AS i))
SELECT c.detector, 9 AS side, CASE WHEN c.detector = 'even' THEN a ELSE a // 4 * 4 + 3 - a % 4 END + a // 4 AS y,
  CASE WHEN c.detector = 'even' THEN b ELSE b // 4 * 4 + 3 - b % 4 END + b // 4 AS x, CAST(c.i AS INTEGER) AS source
FROM c WHERE c.detector IN (SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END FROM embeddings)"""
)
def frame_cells(spark, d):
    frames, panels = _two_detectors(spark, d)
    cells = geometry.assembly_cells(geometry.panel_pixels(panels, F.lit(8)))
    present = frames.select("detector").distinct()
    return _wide_index(cells.join(present, "detector", "left_semi").select("detector", "side", "y", "x", "source"))


@query(f"WITH {_ASSEMBLED}, {chain('image', 3, 6)} SELECT {_OUT32} FROM r")
def panels_preprocess(spark, d):
    frames, panels = _two_detectors(spark, d)
    lists = preprocessing.assembly_of(panels, {"even": 8, "odd": 8})
    return _long(preprocessing.preprocess_panels(frames, lists, window=3, size=(6, 6)))


@query(f"WITH {PX}, {gcn_cte('px', 'g')} SELECT {_OUT} FROM g")
def user_preprocess(spark, d):
    raw = preprocessing.apply_preprocess(images(spark, d), None)
    return _long(preprocessing.apply_preprocess(raw, normalize.gcn_frames))


_DESCRIPTION = {0: ("AGIPD", "AGIPD 1M"), 1: ("Eiger4M", "EIGER 4M"), 2: ("JUNGFRAU_4M", "Jungfrau 4M"), 3: ("ePix10k", "ePix10k 2.2M"), 4: ("other", None)}


def _mixed(spark, d):
    kind = (F.col("label") % 5).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(v[i]) for v in _DESCRIPTION.values()]), kind)
    frames = images(spark, d).select("vec_id", pick(0).alias("detector"), pick(1).alias("description"), "h", "w", "pixels")
    panels = _panels(spark, _module_panels("AGIPD"), _canvas_panels("Eiger4M", False))
    return frames, preprocessing.assembly_of(panels, {"AGIPD": 8, "Eiger4M": 8}, module_rows=4)


_MIXED = f"""{PX}, kind AS (SELECT vec_id AS id, label % 5 AS k FROM embeddings),
placed AS (
  SELECT id, y + y // 4 AS y, CASE WHEN k = 0 THEN x ELSE x + x // 4 END AS x, v FROM px JOIN kind USING (id) WHERE k < 2
), grid AS (SELECT id, unnest(range(81)) AS cell FROM kind WHERE k < 2),
image AS (
  SELECT g.id, CAST(9 AS BIGINT) AS n, cell // 9 AS y, cell % 9 AS x, coalesce(v, 0) AS v
  FROM grid g LEFT JOIN placed p ON p.id = g.id AND p.y = cell // 9 AND p.x = cell % 9
  UNION ALL SELECT px.* FROM px JOIN kind USING (id) WHERE k >= 2
)"""


@query(f"WITH {_MIXED}, {chain('image', 3, 6)} SELECT {_OUT32} FROM r")
def routed_preprocess(spark, d):
    frames, lists = _mixed(spark, d)
    return _long(preprocessing.preprocess_routed(frames, lists, window=3, size=(6, 6)))


@query(
    """SELECT vec_id, CASE WHEN label % 5 < 2 THEN 'geometry' WHEN label % 5 = 2 THEN 'pre-assembled' WHEN label % 5 = 3 THEN 'no geometry'
  ELSE 'no description' END AS route_reason, 6 AS h, 6 AS w, true AS passed FROM embeddings"""
)
def finite_gate(spark, d):
    frames, lists = _mixed(spark, d)
    done = preprocessing.preprocess_routed(frames, lists, window=3, size=(6, 6))
    return catalog.quality_gate(done, (6, 6)).select("vec_id", "route_reason", "h", "w", "passed")


@query(
    """SELECT vec_id, '8x8' AS raw_shape, CASE WHEN label % 5 < 2 THEN '9x9' WHEN label % 5 = 3 THEN '' ELSE '8x8' END AS assembled_shape,
  '224x224' AS output_shape, CASE WHEN label % 5 IN (2, 4) THEN 'assembled' ELSE 'geometry' END AS route,
  CASE WHEN label % 5 = 3 THEN 'FAIL' ELSE 'PASS' END AS result FROM embeddings"""
)
def shape_report(spark, d):
    frames, lists = _mixed(spark, d)
    return preprocessing.shape_report(frames.drop("pixels"), lists).drop("detector", "description")


@query(
    f"""WITH {PX}, {chain('px', 9, 4)}, raw AS (SELECT id, min(v) AS lo, max(v) AS hi FROM px GROUP BY id),
o AS (SELECT id, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM r)
SELECT o.id AS vec_id, {q6('max(lo)')} AS raw_min, {q6('max(hi)')} AS raw_max, {q6('min(v)')} AS norm_min, {q6('max(v)')} AS norm_max,
  {q6('avg(v)')} AS norm_mean, true AS finite FROM o JOIN raw ON raw.id = o.id GROUP BY o.id"""
)
def frame_stats(spark, d):
    stats = preprocessing.frame_stats(images(spark, d), ["vec_id"], 9, (4, 4))
    return rounded(stats, "raw_min", "raw_max", "norm_min", "norm_max", "norm_mean")


@query(
    f"""WITH {PX}, p AS (SELECT id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.999) AS hi FROM px WHERE v > 0 GROUP BY id)
SELECT vec_id, {q6('greatest(0, coalesce(lo, 0))')} AS vmin, {q6('coalesce(hi, 1)')} AS vmax FROM embeddings LEFT JOIN p ON id = vec_id"""
)
def display_range(spark, d):
    return images(spark, d).select("vec_id", display_range_of(F.col("pixels")).alias("r")).select(
        "vec_id", r6("r.vmin").alias("vmin"), r6("r.vmax").alias("vmax")
    )


@query(
    """SELECT vec_id, CASE WHEN label = 0 THEN 'nan' WHEN label = 1 THEN 'inf' ELSE 'ok' END AS kind, label > 1 AS finite FROM embeddings"""
)
def finite_flag(spark, d):
    from diffspark.functions.arrays import all_finite

    bad = F.when(F.col("label") == 0, float("nan")).when(F.col("label") == 1, float("inf")).otherwise(0.0).cast("float")
    rows = images(spark, d).withColumn("pixels", F.concat("pixels", F.array(bad)))
    kind = F.when(F.col("label") == 0, "nan").when(F.col("label") == 1, "inf").otherwise("ok")
    return rows.select("vec_id", kind.alias("kind"), all_finite(F.col("pixels")).alias("finite"))
