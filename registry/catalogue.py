"""Files, keys, frames, labels, geometry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffspark.constants import EXPECTED_KEY, LABEL_KEY
from diffspark.functions import arrays, labels, paths
from diffspark.operators import catalog, geometry
from diffspark.operators.sampling import seeded_shuffle
from diffspark.sources import files, geometry_files
from registry.common import FRAMES_SQL, frames, images, q6, r6, rounded, table

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _sessions(spark, d):
    return catalog.sessions(frames(spark, d), "detector", ("session_id",))


@query(
    f"""WITH {FRAMES_SQL}, s AS (SELECT session_id AS path, count(*) AS n FROM frames GROUP BY session_id)
SELECT path, CAST(unnest(range(n)) AS INTEGER) AS frame_idx FROM s"""
)
def frame_index_expand(spark, d):
    s = _sessions(spark, d).select(F.col("session_id").alias("path"), F.col("frame_count").alias("n_frames"))
    return catalog.expand_frames(s).select("path", "frame_idx")


@query(f"WITH {FRAMES_SQL} SELECT detector, session_id, count(*) AS frame_count FROM frames GROUP BY ALL")
def session_table(spark, d):
    return _sessions(spark, d)


@query(
    f"""WITH {FRAMES_SQL}, s AS (SELECT detector, session_id, count(*) AS n FROM frames GROUP BY ALL)
SELECT detector, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS frames FROM s GROUP BY detector
UNION ALL SELECT 'ALL', count(*), CAST(sum(n) AS BIGINT) FROM s"""
)
def session_rollup(spark, d):
    return catalog.session_totals(_sessions(spark, d))


@query("SELECT doc_id, n_chars, CAST(quality AS INTEGER) AS label FROM documents JOIN labels USING (doc_id)")
def label_strict_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    y = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return catalog.attach_labels(y, docs, ("doc_id",), label="n_chars", strict=True).select("doc_id", "n_chars", "label")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_missing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return catalog.unlabelled(docs, table(spark, d, "labels"), ("doc_id",))


@query(
    """SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS INTEGER) AS label FROM documents"""
)
def label_membership(spark, d):
    hits = table(spark, d, "labels").where("quality = 1")
    return catalog.membership_labels(table(spark, d, "documents").select("doc_id"), hits, ("doc_id",))


@query(
    """WITH p AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS frame_idx,
  CAST(round_even(floor(CAST(v AS DOUBLE) * 20) / CAST(2 AS DOUBLE), 0) AS INTEGER) AS label FROM p"""
)
def label_bround(spark, d):
    halves = F.transform("embedding", lambda v: (F.floor(v.cast("double") * 20) / 2.0).cast("float"))
    stored = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("path"), halves.alias("labels"))
    return catalog.embedded_labels(stored).select("vec_id", "frame_idx", "label")


@query("SELECT vec_id, CASE WHEN label < 3 THEN 0 ELSE 1 END AS label FROM embeddings")
def label_last_col(spark, d):
    row = F.concat("embedding", F.array((F.col("label") < 3).cast("int").cast("float")))
    return table(spark, d, "embeddings").select("vec_id", labels.background_label(row).alias("label"))


@query(
    f"""SELECT lang, count(quality) AS n, count(*) FILTER (WHERE quality = 1) AS hits,
  count(*) FILTER (WHERE quality <> 1) AS non_hits, {q6('count(*) FILTER (WHERE quality = 1) / CAST(count(quality) AS DOUBLE)')} AS hit_rate
FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
)
def label_balance(spark, d):
    y = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    joined = table(spark, d, "documents").select("doc_id", "lang").join(y, "doc_id")
    return rounded(catalog.label_balance(joined, ["lang"]), "hit_rate")


@query(
    """SELECT vec_id, 64 - label AS n_frames, 64 AS n_labels FROM embeddings WHERE label <> 0"""
)
def label_length_check(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (64 - F.col("label")).alias("n_frames"), F.col("embedding").alias("labels"))
    return catalog.label_length_errors(e).select("vec_id", "n_frames", "n_labels")


@query(
    """WITH f AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings WHERE label <> 9)
SELECT vec_id, CAST(i AS INTEGER) AS frame_idx, CAST(round_even(v * 3, 0) AS INTEGER) AS label FROM f"""
)
def label_key_lookup(spark, d):
    e = table(spark, d, "embeddings")
    values = F.transform("embedding", lambda v: v * 3)
    key = F.when(F.col("label") == 9, "elsewhere").otherwise(LABEL_KEY)
    datasets = e.select(F.col("vec_id").alias("path"), key.alias("key"), values.alias("values"))
    found = catalog.label_arrays(e.select(F.col("vec_id").alias("path")), datasets)
    return catalog.embedded_labels(found, strict=False).select(F.col("path").alias("vec_id"), "frame_idx", "label")


# Event types as container keys of one file per user, in an arbitrary order of preference.
_KEYS = ("purchase", "error", "signup")


@query(
    """WITH k AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 END AS p FROM events)
SELECT user_id, CAST(min(p) AS BIGINT) AS priority,
  CASE min(p) WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' END AS data_key FROM k GROUP BY user_id"""
)
def data_key_first_match(spark, d):
    keys = table(spark, d, "events").select("user_id", F.col("event_type").alias("key"))
    return catalog.resolve_data_key(keys, ("user_id",), candidates=_KEYS, strict=False).withColumn(
        "priority", F.col("priority").cast("long")
    )


@query(
    """WITH k AS (SELECT user_id, count(*) AS n_keys, bool_or(event_type = 'purchase' AND value > 20) AS found FROM events GROUP BY user_id),
x AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS detector FROM orders)
SELECT x.detector, x.user_id, coalesce(n_keys, 0) AS n_keys, coalesce(found, false) AS found,
  CASE WHEN coalesce(found, false) THEN 'OK' ELSE 'ACTION REQUIRED' END AS status
FROM x LEFT JOIN k ON x.user_id = k.user_id"""
)
def key_audit(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_orderpriority").alias("detector"), F.col("o_custkey").alias("path")).distinct()
    name = F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), EXPECTED_KEY).otherwise(F.col("event_type"))
    keys = table(spark, d, "events").select(F.col("user_id").alias("path"), name.alias("key"))
    return catalog.audit_keys(expected, keys).withColumnRenamed("path", "user_id")


@query(
    """SELECT page_id, len(url) - len(replace(url, '/', '')) AS depth, url LIKE '%/en/%' AS expected FROM pages"""
)
def key_listing(spark, d):
    key = F.when(F.col("url").contains("/en/"), EXPECTED_KEY).otherwise(F.col("url"))
    pages = table(spark, d, "pages").select("page_id", "url", key.alias("key"))
    depth = paths.key_depth(F.col("url")).cast("long").alias("depth")
    return catalog.key_listing(pages).select("page_id", depth, "expected")


@query(
    """WITH k AS (SELECT DISTINCT source, 'det ' || source AS description FROM documents WHERE source <> 'src7')
SELECT doc_id, description FROM documents d LEFT JOIN k ON d.source = k.source"""
)
def description_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("path"))
    text = F.encode(F.concat(F.lit("det "), F.col("path")), "UTF-8")
    stored = catalog.distinct_paths(docs.where("path <> 'src7'")).withColumn("description", text)
    return catalog.attach_descriptions(docs, stored, strict=False).select("doc_id", "description")


_PATH_SQL = """f AS (
  SELECT page_id, 'http://' || url
    || CASE page_id % 5 WHEN 0 THEN '.h5' WHEN 1 THEN '.CXI' WHEN 2 THEN '.part.img' WHEN 3 THEN '.tiff' ELSE '' END AS path FROM pages
), n AS (SELECT page_id, path, regexp_extract(path, '([^/]*)/*$', 1) AS name FROM f)"""


def _page_paths(spark, d):
    ends = F.element_at(F.array(*[F.lit(e) for e in (".h5", ".CXI", ".part.img", ".tiff", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("http://"), F.col("url"), ends).alias("path"))


@query(
    f"""WITH {_PATH_SQL}
SELECT page_id, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem,
  'det_' || regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS session_id, len(path) - len(replace(path, '/', '')) AS depth FROM n"""
)
def path_parts(spark, d):
    p = F.col("path")
    return _page_paths(spark, d).select(
        "page_id",
        paths.suffix(p).alias("ext"),
        paths.stem(p).alias("stem"),
        paths.session_id(F.lit("det"), p).alias("session_id"),
        paths.key_depth(p).cast("long").alias("depth"),
    )


@query(
    f"""WITH {_PATH_SQL}, e AS (SELECT page_id, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM n)
SELECT page_id, ext, CASE WHEN ext = '.img' THEN 'image' WHEN ext IN ('.h5', '.cxi') THEN 'container' END AS reader FROM e"""
)
def ext_dispatch(spark, d):
    return catalog.dispatch_by_suffix(_page_paths(spark, d), strict=False).select("page_id", "ext", "reader")


@query(
    """SELECT page_id, 'p' || page_id AS name, 'a=' || url AS target, replace(split_part(url, '/', 3), '.', '_') AS tag,
  'net-lodo-fold' || (page_id % 4 + 1) || '-seed' || page_id AS run, 'net' AS backbone, CAST(page_id % 4 + 1 AS INTEGER) AS fold,
  CAST(page_id AS INTEGER) AS seed, 'fold_' || (page_id % 4 + 1) AS fold_key FROM pages"""
)
def run_and_argument_names(spark, d):
    name, target = paths.named_path(F.concat(F.lit(" p"), F.col("page_id"), F.lit(" = a="), F.col("url"), F.lit(" ")))
    fold = F.col("page_id") % 4 + 1
    run = paths.run_name(F.lit("net"), fold, F.col("page_id"))
    tag = paths.file_tag(F.replace(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(" ")))
    rows = table(spark, d, "pages").select("page_id", name.alias("name"), target.alias("target"), tag.alias("tag"), run.alias("run"), paths.fold_key(fold).alias("fold_key"))
    return rows.select("*", paths.run_parts(F.col("run")).alias("_p")).select("*", "_p.*").drop("_p")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS ordinal, md5(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS line_md5 FROM l
WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''"""
)
def split_list_lines(spark, d):
    lines = files.list_entries(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return lines.select("doc_id", "ordinal", F.md5("path").alias("line_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(unnest([quality, toxic]) AS INTEGER) AS label, unnest(['', '/t']) AS kind FROM labels")
def label_map_entries(spark, d):
    key = F.col("doc_id").cast("string")
    text = F.to_json(F.create_map(key, F.col("quality"), F.concat(key, F.lit("/t")), F.col("toxic")))
    rows = files.label_map_entries(table(spark, d, "labels").select(text.alias("value")))
    return rows.select(
        F.regexp_replace("path", "/t$", "").alias("path"), "label", F.when(F.col("path").endswith("/t"), "/t").otherwise("").alias("kind")
    )


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN n_chars ELSE 1 END AS simple_count,
  CASE WHEN doc_id % 4 IN (1, 2) THEN n_chars ELSE 1 END AS native_count,
  CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 32 WHEN 3 THEN 32 ELSE NULL END AS h FROM documents"""
)
def frame_count_rule(spark, d):
    kind, n, side = F.col("doc_id") % 4, F.col("n_chars").cast("int"), F.lit(32)
    shape = (
        F.when(kind == 0, F.array(n, side))
        .when(kind == 1, F.array(n, side, side))
        .when(kind == 2, F.array(n, F.lit(16), side, side))
        .otherwise(F.array(side * side))
    )
    native = F.when(kind == 2, 3).when(kind == 3, 1).otherwise(2)
    docs = table(spark, d, "documents").select("doc_id", shape.alias("shape"), native.alias("native"), kind.alias("kind"))
    flat = F.when(F.col("kind") != 2, arrays.shape_2d(F.col("shape"), side, side)["h"])
    return docs.select(
        "doc_id",
        arrays.frame_count(F.col("shape")).cast("long").alias("simple_count"),
        arrays.frame_count(F.col("shape"), F.col("native")).cast("long").alias("native_count"),
        flat.cast("long").alias("h"),
    )


@query(
    f"""WITH {FRAMES_SQL}, i AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY doc_id) - 1 AS frame_idx, n_chars FROM frames)
SELECT session_id, frame_idx, n_chars FROM i WHERE frame_idx < 3"""
)
def frame_preview(spark, d):
    from diffspark.operators.ordered import number_rows

    numbered = number_rows(frames(spark, d), ["session_id"], [F.col("doc_id")], "position")
    index = numbered.select("session_id", (F.col("position") - 1).alias("frame_idx"), "n_chars")
    return catalog.first_frames(index, 3)


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def frame_requests(spark, d):
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return catalog.read_frames(asked, known, ("l_orderkey",))


_DESCRIPTIONS = ("AGIPD 1M", "ePix10k 2.2M", "EIGER 4M", "Jungfrau 4M", "other")


@query(
    """SELECT vec_id, CASE label % 6 WHEN 0 THEN 'flat' WHEN 1 THEN 'flat' WHEN 2 THEN 'canvas' ELSE 'assembled' END AS route,
  CASE label % 6 WHEN 3 THEN 'pre-assembled' WHEN 4 THEN 'unknown description' WHEN 5 THEN 'no description' ELSE 'geometry' END AS route_reason
FROM embeddings"""
)
def route_frames(spark, d):
    text = F.get(F.array(*[F.lit(x) for x in _DESCRIPTIONS]), F.col("label") % 6)
    e = table(spark, d, "embeddings").select("vec_id", text.alias("description"))
    return catalog.route_frames(e).select("vec_id", "route", "route_reason")


@query("SELECT lang, lang IN ('en', 'fr') AS known, count(*) AS n FROM documents GROUP BY ALL")
def detector_name_check(spark, d):
    checked = catalog.known_detectors(table(spark, d, "documents").select("lang"), ("en", "fr"), "lang", strict=False)
    return checked.groupBy("lang", F.col("known_detector").alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source AS path FROM documents")
def distinct_paths(spark, d):
    return catalog.distinct_paths(table(spark, d, "documents").withColumnRenamed("source", "path"))


@query(
    f"""SELECT p_partkey, {q6('p_retailprice * 1e-3')} AS distance_m, {q6('p_size * 1e-3')} AS pixel_m FROM part"""
)
def geometry_units(spark, d):
    matrix = F.array(F.col("p_retailprice"), F.lit(1.3), F.col("p_size").cast("double"))
    rows = geometry_files.geometry_matrix(table(spark, d, "part").select("p_partkey", matrix.alias("geometry")))
    return rows.select("p_partkey", r6("distance_m").alias("distance_m"), r6("pixel_m").alias("pixel_m"))


@query(
    """SELECT vec_id, unnest(range(64)) AS pixel, CAST(unnest(range(64)) // 32 * 2 + unnest(range(64)) % 32 // 16 AS INTEGER) AS panel FROM embeddings"""
)
def module_panels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pixel", "v"))
    panel = arrays.agipd_panel(F.col("pixel"), module_ss=4, module_fs=8, panel_ss=2)
    return e.select("vec_id", F.col("pixel").cast("long").alias("pixel"), panel.alias("panel"))


@query(
    """SELECT vec_id, label % 2 AS label, 1 AS c, 8 AS h, 8 AS w, len(embedding) AS n_pixels FROM embeddings"""
)
def frame_tensors(spark, d):
    rows = images(spark, d).withColumn("label", F.col("label") % 2)
    return catalog.frame_tensor(rows).select("vec_id", "label", "c", "h", "w", F.size("pixels").cast("long").alias("n_pixels"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), CAST(doc_id AS VARCHAR)) AS place FROM documents")
def seeded_order(spark, d):
    from diffspark.operators.ordered import number_rows
    from diffspark.operators.sampling import shuffle_key

    ids = table(spark, d, "documents").select("doc_id")
    shuffled = seeded_shuffle(ids, "doc_id", 7)
    return number_rows(shuffled, [], [shuffle_key(F.col("doc_id"), 7)], "place")


def _geometry_lines(spark, d):
    """Geometry text made from the parts: brand = detector, part = panel."""
    p = table(spark, d, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey"), F.lit("a0/"))
    size = F.col("p_size").cast("string")
    lines = [
        F.concat(F.lit("; note on "), F.col("p_name")),
        F.concat(F.lit("res = 5000.0 ; pixels per metre, "), F.col("p_name")),
        F.lit("clen = 0.25"),
        F.concat(F.lit("rigid_group_q0 = "), name),
        F.concat(F.lit("badregion/min_fs = "), size),
        F.concat(name, F.lit("fs = -0.5x +0."), size, F.lit("y")),
        F.concat(name, F.lit("ss =  +"), size, F.lit("x -y ; axis")),
        F.concat(name, F.lit("corner_x = "), F.col("p_retailprice").cast("string")),
        F.concat(name, F.lit("corner_y = -"), size, F.lit(".5")),
        F.concat(name, F.lit("coffset = 0.005")),
        F.concat(name, F.lit("min_fs = 0")),
        F.concat(name, F.lit("max_fs = "), size),
        F.concat(name, F.lit("min_ss = 10")),
        F.concat(name, F.lit("max_ss = 1"), size),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(name, F.lit("res = 10000"))).otherwise("no_index = 0"),
    ]
    return p.select(
        F.col("p_brand").alias("detector"),
        F.posexplode(F.array(*lines)).alias("_i", "value"),
        F.col("p_partkey"),
    ).withColumn("line", F.col("p_partkey") * 100 + F.col("_i")).drop("_i", "p_partkey")


def _text_panels(spark, d):
    entries = geometry_files.geometry_entries(_geometry_lines(spark, d))
    return geometry_files.panels_from_entries(entries, "line")


_PANEL_SQL = """p AS (
  SELECT p_brand AS detector, p_partkey, 'p' || p_partkey || 'a0' AS panel, p_size, p_retailprice,
    CASE WHEN p_partkey % 2 = 0 THEN 1 / CAST(10000 AS DOUBLE) ELSE 1 / CAST(5000 AS DOUBLE) END AS pixel,
    CAST('0.' || p_size AS DOUBLE) AS frac, CAST('1' || p_size AS INTEGER) AS max_ss FROM part
)"""


@query(
    f"""WITH {_PANEL_SQL}
SELECT detector, panel, p_partkey * 100 + 5 AS panel_order, max_ss - 9 AS n_ss, p_size + 1 AS n_fs,
  {q6('-0.5 * pixel * 1000')} AS fs_x, {q6('frac * pixel * 1000')} AS fs_y, {q6('p_size * pixel * 1000')} AS ss_x, {q6('-pixel * 1000')} AS ss_y,
  {q6('p_retailprice * pixel * 1000')} AS t_x, {q6("-CAST(p_size || '.5' AS DOUBLE) * pixel * 1000")} AS t_y, {q6('255')} AS t_z,
  10 AS ss0, max_ss + 1 AS ss1, 0 AS fs0, p_size + 1 AS fs1, CAST(p_partkey AS INTEGER) AS module FROM p"""
)
def geometry_text_panels(spark, d):
    mm = lambda v, i: r6(F.col(v)[i] * 1000)
    return _text_panels(spark, d).select(
        "detector",
        "panel",
        "panel_order",
        "n_ss",
        "n_fs",
        mm("fs_vec", 0).alias("fs_x"),
        mm("fs_vec", 1).alias("fs_y"),
        mm("ss_vec", 0).alias("ss_x"),
        mm("ss_vec", 1).alias("ss_y"),
        mm("t_vec", 0).alias("t_x"),
        mm("t_vec", 1).alias("t_y"),
        mm("t_vec", 2).alias("t_z"),
        "ss0",
        "ss1",
        "fs0",
        "fs1",
        "module",
    )


@query(
    f"""WITH {_PANEL_SQL}
SELECT detector, count(*) AS panels, CAST(sum((max_ss - 9) * (p_size + 1)) AS BIGINT) AS pixels, true AS defines_slicing,
  {q6('avg(0.255)')} AS distance FROM p GROUP BY detector"""
)
def geometry_summary(spark, d):
    return rounded(geometry.geometry_summary(_text_panels(spark, d)), "distance")


def _json_panels(spark, d):
    p = table(spark, d, "part")
    n = lambda v: F.lit(v).cast("int")
    null = F.lit(None).cast("int")
    panel = F.struct(
        F.concat(F.lit("m"), F.col("p_partkey")).alias("name"),
        n(4).alias("n_ss"),
        F.col("p_size").alias("n_fs"),
        F.array(F.lit(1e-4), F.lit(0.0), F.lit(0.0)).alias("fs_vec"),
        F.array(F.lit(0.0), F.lit(1e-4), F.lit(0.0)).alias("ss_vec"),
        F.array(F.lit(0.0), F.lit(0.0), F.col("p_retailprice") / 1000).alias("t_vec"),
        F.array(n(64), n(64)).alias("parent_data_shape"),
        F.array(F.array(n(3), n(7), null), F.array(n(5), F.col("p_size") + 5, null)).alias("parent_data_slice"),
    )
    text = F.to_json(F.array(panel))
    return geometry_files.panels_from_json(p.select(F.col("p_brand").alias("detector"), text.alias("value")))


@query(
    f"""SELECT p_brand AS detector, 'm' || p_partkey AS panel, 4 AS n_ss, p_size AS n_fs, {q6('p_retailprice / 1000')} AS t_z,
  3 AS ss0, 7 AS ss1, 5 AS fs0, p_size + 5 AS fs1 FROM part"""
)
def geometry_json_panels(spark, d):
    return _json_panels(spark, d).select(
        "detector", "panel", "n_ss", "n_fs", r6(F.col("t_vec")[2]).alias("t_z"), "ss0", "ss1", "fs0", "fs1"
    )


@query(
    f"""WITH a AS (SELECT p_brand, avg(p_retailprice / 1000) AS m FROM part GROUP BY p_brand)
SELECT part.p_brand AS detector, 'm' || p_partkey AS panel, {q6('p_retailprice / 1000 + (CAST(0.103 AS DOUBLE) - m)')} AS t_z
FROM part JOIN a ON part.p_brand = a.p_brand"""
)
def geometry_distance(spark, d):
    moved = geometry.set_distance(_json_panels(spark, d), F.lit(0.103))
    return moved.select("detector", "panel", r6(F.col("t_vec")[2]).alias("t_z"))


