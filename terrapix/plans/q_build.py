"""Queries over slab inventories, pyramid building, vector tables and slab lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid
from ..operators import pyramid
from ..operators.shared import Scratch
from ..sources.tables import table, view
from .q_grid import COMPATIBLE, _path_sql, compatible
from .registry import query

c = F.col
KEYS = ["lvl", "col", "row"]

# ---- joins ---------------------------------------------------------------------------------------------------------

COVER = "SELECT *, unnest(range(CAST(floor(xmin / 256) AS BIGINT), CAST(floor(xmax / 256) AS BIGINT) + 1)) AS col FROM f_img"


def covered(spark, d, size=256):
    i = view(spark, d, "f_img")
    f = lambda v: F.floor(c(v) / size)
    return pyramid.explode_keys(i, f("xmin"), f("xmax"), f("ymin"), f("ymax"))


_COVERED = f"SELECT *, unnest(range(CAST(floor(ymin / 256) AS BIGINT), CAST(floor(ymax / 256) AS BIGINT) + 1)) AS row FROM ({COVER}) c0"


@query("join_image_slab", f"SELECT col, row, count(*) AS n_images, min(img_id) AS first_img, max(img_id) AS last_img FROM ({_COVERED}) c1 GROUP BY col, row")
def join_image_slab(spark, d):
    return covered(spark, d).groupBy("col", "row").agg(F.count("*").alias("n_images"), F.min("img_id").alias("first_img"), F.max("img_id").alias("last_img"))


@query("join_extent_slab", f"SELECT DISTINCT col, row FROM ({_COVERED}) c1 WHERE channels = 2 AND xmax > col * 256 AND xmin < (col + 1) * 256 AND ymax > row * 256 AND ymin < (row + 1) * 256")
def join_extent_slab(spark, d):
    e = covered(spark, d).filter("channels = 2 AND xmax > col * 256 AND xmin < (col + 1) * 256 AND ymax > row * 256 AND ymin < (row + 1) * 256")
    return e.select("col", "row").distinct()


@query("join_tile_parent", "SELECT pyr, lvl + 1 AS lvl, col // 2 AS col, row // 2 AS row, count(*) AS n FROM f_slab GROUP BY 1, 2, 3, 4")
def join_tile_parent(spark, d):
    half = lambda v: F.floor(c(v) / 2).alias(v)
    return view(spark, d, "f_slab").groupBy("pyr", (c("lvl") + 1).alias("lvl"), half("col"), half("row")).agg(F.count("*").alias("n"))


@query("join_tile_children", "SELECT pyr, lvl, col // 2 AS col, row // 2 AS row, " + ", ".join(f"max(CASE WHEN col % 2 = {i} AND row % 2 = {j} THEN col * 100 + row END) AS c{i}{j}" for j in (0, 1) for i in (0, 1)) + " FROM f_slab GROUP BY 1, 2, 3, 4")
def join_tile_children(spark, d):
    half = lambda v: F.floor(c(v) / 2).alias(v)
    child = [F.max(F.when((c("col") % 2 == i) & (c("row") % 2 == j), c("col") * 100 + c("row"))).alias(f"c{i}{j}") for j in (0, 1) for i in (0, 1)]
    return view(spark, d, "f_slab").groupBy("pyr", "lvl", half("col"), half("row")).agg(*child)


TM_SOURCE = "SELECT a.ord AS target, max(b.ord) AS source FROM f_tm a JOIN f_tm b ON b.res < a.res AND a.res / b.res = floor(a.res / b.res) GROUP BY a.ord"


@query("join_tm_source", TM_SOURCE)
def join_tm_source(spark, d):
    tm = view(spark, d, "f_tm")
    a, b = tm.select(c("ord").alias("target"), c("res").alias("ra")), tm.select("ord", "res")
    ok = a.join(F.broadcast(b), (c("res") < c("ra")) & (c("ra") / c("res") == F.floor(c("ra") / c("res"))))
    return ok.groupBy("target").agg(F.max("ord").alias("source"))


# Slabs of 4 x 4 tiles of 16 pixels, as in the toolbox. Targets of a level are the levels made from it; a target slab is kept
# where it overlaps the images' extent, borders not counting.
NN_SQL = f"""WITH src AS ({TM_SOURCE}), lim AS (SELECT min(xmin) AS x1, min(ymin) AS y1, max(xmax) AS x2, max(ymax) AS y2 FROM f_img),
n AS (SELECT DISTINCT lvl, col, row FROM f_slab),
b AS (SELECT n.*, s.ord AS so, s.x0 + col * s.res * 64 AS xa, s.y0 - (row + 1) * s.res * 64 AS ya, s.x0 + (col + 1) * s.res * 64 AS xb, s.y0 - row * s.res * 64 AS yb FROM n JOIN f_tm s ON s.ord = n.lvl - 1),
t AS (SELECT b.*, f.ord, f.x0, f.y0, f.res * 64 AS side FROM b JOIN src ON src.source = b.so JOIN f_tm f ON f.ord = src.target),
c1 AS (SELECT *, unnest(range(CAST(trunc((xa - x0) / side) AS BIGINT), CAST(trunc((xb - x0) / side) AS BIGINT) + 1)) AS tcol FROM t),
c2 AS (SELECT *, unnest(range(CAST(trunc((y0 - yb) / side) AS BIGINT), CAST(trunc((y0 - ya) / side) AS BIGINT) + 1)) AS trow FROM c1)
SELECT lvl, col, row, ord, tcol, trow FROM c2, lim WHERE x0 + tcol * side < x2 AND x0 + (tcol + 1) * side > x1 AND y0 - (trow + 1) * side < y2 AND y0 - trow * side > y1"""


@query("join_nn_targets", NN_SQL)
def join_nn_targets(spark, d):
    """Every slab of the levels above that a slab's box reaches, all columns and rows, within the data's extent."""
    tm = view(spark, d, "f_tm")
    slab_box = lambda col, row: grid.indices_to_bbox(col, row, c("x0"), c("y0"), c("res"), c("tile_w"), c("tile_h"), 4, 4)
    nodes = view(spark, d, "f_slab").select(*KEYS).distinct().join(F.broadcast(tm), c("lvl") - 1 == c("ord"))
    nodes = nodes.select(*KEYS, c("ord").alias("source"), slab_box(c("col"), c("row")).alias("box"))
    targets = join_tm_source(spark, d).join(tm, c("target") == c("ord")).drop("target")
    ix = grid.bbox_to_indices(c("box"), c("x0"), c("y0"), c("res"), c("tile_w"), c("tile_h"), 4, 4)
    reached = nodes.join(F.broadcast(targets), "source").withColumn("ix", ix)
    reached = reached.select("*", F.explode(F.sequence("ix.col_min", "ix.col_max")).alias("tcol")).select("*", F.explode(F.sequence("ix.row_min", "ix.row_max")).alias("trow"))
    x1, y1, x2, y2 = view(spark, d, "f_img").agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()  # the extent: one row
    if x1 is None:
        return reached.filter("false").select(*KEYS, "ord", "tcol", "trow")
    b = reached.withColumn("t", slab_box(c("tcol"), c("trow")))
    return b.filter((c("t.xmin") < x2) & (c("t.xmax") > x1) & (c("t.ymin") < y2) & (c("t.ymax") > y1)).select(*KEYS, "ord", "tcol", "trow")


JOINED = "SELECT lvl, col, row, arg_min(pyr, prio) AS main, string_agg(pyr, ',' ORDER BY prio) AS sources, count(*) AS n FROM f_slab GROUP BY lvl, col, row"


@query("join_pyramids_priority", JOINED)
def join_pyramids_priority(spark, d):
    return pyramid.join_inventories(view(spark, d, "f_slab"))


@query("build_join_cache", "SELECT lvl, col, row, arg_min(pyr, prio) AS main, arg_min(pyr, prio) AS sources, CAST(1 AS BIGINT) AS n FROM f_slab GROUP BY lvl, col, row")
def build_join_cache(spark, d):
    return pyramid.join_inventories(view(spark, d, "f_slab"), "REPLACE")


@query("join_img_mask", "SELECT a.pyr, a.lvl, a.col, a.row, m.pyr IS NOT NULL AS has_mask FROM f_slab a LEFT JOIN f_slab m ON m.pyr = 'N' AND a.lvl = m.lvl AND a.col = m.col AND a.row = m.row WHERE a.pyr = 'A'")
def join_img_mask(spark, d):
    s = view(spark, d, "f_slab")
    m = s.filter("pyr = 'N'").select(*KEYS, F.lit(True).alias("m"))
    return s.filter("pyr = 'A'").join(m, KEYS, "left").select("pyr", *KEYS, F.coalesce("m", F.lit(False)).alias("has_mask"))


@query("join_slab_contains", "SELECT lvl, col, row FROM f_slab a WHERE pyr = 'A' AND EXISTS (SELECT 1 FROM f_slab b WHERE b.pyr = 'R' AND a.lvl = b.lvl AND a.col = b.col AND a.row = b.row)")
def join_slab_contains(spark, d):
    s = view(spark, d, "f_slab")
    return s.filter("pyr = 'A'").select(*KEYS).join(s.filter("pyr = 'R'"), KEYS, "left_semi")


# ---- aggregation ---------------------------------------------------------------------------------------------------


@query("agg_level_limits", "SELECT pyr, lvl, min(col) AS min_col, max(col) AS max_col, min(row) AS min_row, max(row) AS max_row FROM f_slab GROUP BY pyr, lvl")
def agg_level_limits(spark, d):
    return view(spark, d, "f_slab").groupBy("pyr", "lvl").agg(F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.min("row").alias("min_row"), F.max("row").alias("max_row"))


@query("agg_nodes_per_level", "SELECT lvl, count(*) AS n FROM (SELECT DISTINCT lvl, col, row FROM f_slab) q GROUP BY lvl")
def agg_nodes_per_level(spark, d):
    return view(spark, d, "f_slab").select(*KEYS).distinct().groupBy("lvl").agg(F.count("*").alias("n"))


@query("agg_slabs_count", f"SELECT count(*) AS n FROM (SELECT DISTINCT col, row FROM ({_COVERED}) c1) q")
def agg_slabs_count(spark, d):
    return covered(spark, d).select("col", "row").distinct().agg(F.count("*").alias("n"))


ATTS = {"orders": ["o_orderstatus", "o_orderpriority", "o_totalprice"], "part": ["p_brand", "p_size"]}
NUM = ["o_totalprice", "p_size"]


def profiles(spark, d):
    cols = [x for x in table(spark, d, "orders").columns if x in ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")]
    return pyramid.profile(table(spark, d, "orders"), cols, ["o_totalprice", "o_custkey"])


_PROFILE = " UNION ALL ".join(f"SELECT '{a}' AS attribute, count(*) AS count, {'min(v)::DOUBLE' if n else 'NULL::DOUBLE'} AS min, {'max(v)::DOUBLE' if n else 'NULL::DOUBLE'} AS max, {'NULL::VARCHAR' if n else 'CASE WHEN count(*) <= 50 THEN string_agg(v, chr(124) ORDER BY v) END'} AS values FROM (SELECT DISTINCT {a} AS v FROM orders) q" for a, n in (("o_orderstatus", 0), ("o_orderpriority", 0), ("o_totalprice", 1), ("o_custkey", 1)))


@query("agg_profile_table", _PROFILE)
def agg_profile_table(spark, d):
    return profiles(spark, d)


@query("agg_attr_distinct_count", "SELECT count(*) AS n FROM (SELECT DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS v FROM orders) q")
def agg_attr_distinct_count(spark, d):
    v = F.when(c("o_orderkey") % 7 != 0, c("o_custkey")).alias("v")
    return table(spark, d, "orders").select(v).distinct().agg(F.count("*").alias("n"))


@query("agg_attr_min_max", "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def agg_attr_min_max(spark, d):
    return table(spark, d, "orders").agg(F.min("o_totalprice").alias("min"), F.max("o_totalprice").alias("max"))


@query("agg_attr_values", "SELECT CASE WHEN count(*) <= 50 THEN string_agg(v, '|' ORDER BY v) END AS values FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) q")
def agg_attr_values(spark, d):
    few = table(spark, d, "orders").select(c("o_orderstatus").alias("v")).distinct().limit(51)  # one more than is listed: enough to tell
    return few.agg(F.when(F.count("*") <= 50, F.array_join(F.sort_array(F.collect_list("v")), "|")).alias("values"))


@query("agg_table_zoom_range", "SELECT pyr, arg_min(lvl, lvl * 100 + prio) AS min_zoom, max(lvl) AS max_zoom, arg_min(col, lvl * 100000000 + col * 10000 + row) AS first_col FROM f_slab GROUP BY pyr")
def agg_table_zoom_range(spark, d):
    return view(spark, d, "f_slab").groupBy("pyr").agg(F.min("lvl").alias("min_zoom"), F.max("lvl").alias("max_zoom"), F.min_by("col", F.struct("lvl", "col", "row")).alias("first_col"))


@query("agg_best_res_image", "SELECT channels, arg_min(img_id, res * 1000000 + img_id) AS img_id FROM f_img GROUP BY channels")
def agg_best_res_image(spark, d):
    return view(spark, d, "f_img").groupBy("channels").agg(F.min_by("img_id", F.struct("res", "img_id")).alias("img_id"))


@query("agg_ordered_levels", "SELECT id, res, row_number() OVER (ORDER BY res) AS up, row_number() OVER (ORDER BY res DESC) AS down FROM f_tm")
def agg_ordered_levels(spark, d):
    """Ranks by counting: a level table is small, and no window gathers it in one task."""
    tm = view(spark, d, "f_tm").select("id", "res")
    pairs = tm.join(F.broadcast(tm.select(c("res").alias("other"))), F.lit(True))
    return pairs.groupBy("id", "res").agg(F.sum((c("other") <= c("res")).cast("long")).alias("up"), F.sum((c("other") >= c("res")).cast("long")).alias("down"))


@query("agg_array_minmax", "SELECT vec_id, CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS at_min, list_max(embedding) AS top FROM embeddings")
def agg_array_minmax(spark, d):
    e = c("embedding")
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(e, F.array_min(e)) - 1).alias("at_min"), F.array_max(e).alias("top"))


# ---- building ------------------------------------------------------------------------------------------------------


@query("build_bottom_nodes", f"SELECT col, row FROM ({_COVERED}) c1 UNION SELECT user_id % 64, event_id % 64 FROM events")
def build_bottom_nodes(spark, d):
    """From images, and from a list of indices."""
    listed = table(spark, d, "events").select((c("user_id") % 64).alias("col"), (c("event_id") % 64).alias("row"))
    return covered(spark, d).select("col", "row").unionByName(listed).distinct()


ABOVE = "SELECT DISTINCT k AS lvl, col >> (k - lvl) AS col, row >> (k - lvl) AS row FROM (SELECT col, row, lvl, unnest(range(lvl, 8)) AS k FROM f_slab WHERE lvl = 1) q"


@query("build_above_nodes_qtree", f"SELECT CAST(lvl AS INT) AS lvl, col, row FROM ({ABOVE}) a")
def build_above_nodes_qtree(spark, d):
    return pyramid.all_ancestors(view(spark, d, "f_slab").filter("lvl = 1").select(*KEYS), 7)


@query("build_above_nodes_nngraph", "SELECT DISTINCT t.ord AS lvl, CAST(floor(col / t.res) AS BIGINT) AS col, CAST(floor(row / t.res) AS BIGINT) AS row FROM f_slab s, f_tm t WHERE s.lvl = 1")
def build_above_nodes_nngraph(spark, d):
    s = view(spark, d, "f_slab").filter("lvl = 1").select("col", "row").distinct().join(F.broadcast(view(spark, d, "f_tm")), F.lit(True))
    return s.select(c("ord").alias("lvl"), F.floor(c("col") / c("res")).alias("col"), F.floor(c("row") / c("res")).alias("row")).distinct()


@query("build_cut_level", f"SELECT max(lvl) AS cut FROM (SELECT lvl, count(*) AS n FROM ({ABOVE}) a GROUP BY lvl) q WHERE n >= 40")
def build_cut_level(spark, d):
    n = build_above_nodes_qtree(spark, d).groupBy("lvl").agg(F.count("*").alias("n"))
    return n.filter("n >= 5 * 8").agg(F.max("lvl").cast("long").alias("cut"))


@query("build_round_robin", "SELECT lvl, col, row, (row_number() OVER (PARTITION BY lvl ORDER BY col, row) - 1) % 6 AS script FROM (SELECT DISTINCT lvl, col, row FROM f_slab) q")
def build_round_robin(spark, d):
    n = pyramid.numbered(view(spark, d, "f_slab").select(*KEYS).distinct(), ["lvl"], ["col"], ["row"])
    return n.select(*KEYS, ((c("n") - 1) % 6).cast("long").alias("script"))


@query("build_qtree_test", "SELECT bool_and(n IS NULL OR (abs(n - 2 * res) < 0.01 AND tile_w = nw)) AS qtree FROM (SELECT *, lead(res) OVER (ORDER BY ord) AS n, lead(tile_w) OVER (ORDER BY ord) AS nw FROM f_tm) q")
def build_qtree_test(spark, d):
    tm = view(spark, d, "f_tm")
    nxt = tm.select((c("ord") - 1).alias("ord"), c("res").alias("n"), c("x0").alias("nx"), c("y0").alias("ny"), c("tile_w").alias("nw"))
    ok = (F.abs(c("n") - 2 * c("res")) < 0.01) & (c("x0") == c("nx")) & (c("y0") == c("ny")) & (c("tile_w") == c("nw"))
    return tm.join(F.broadcast(nxt), "ord").agg(F.bool_and(ok).alias("qtree"))


@query("build_datasource_levels", "SELECT c_nationkey AS src, bottom, coalesce(lead(bottom) OVER (ORDER BY bottom) - 1, 99) AS top FROM (SELECT c_nationkey, min(c_custkey) % 100000 AS bottom FROM customer GROUP BY c_nationkey) q")
def build_datasource_levels(spark, d):
    """Disjoint ranges of levels: each source ends below the next one's bottom."""
    s = table(spark, d, "customer").groupBy(c("c_nationkey").alias("src")).agg((F.min("c_custkey") % 100000).alias("bottom"))
    nxt = s.select(c("bottom").alias("b2"))
    return s.join(F.broadcast(nxt), c("b2") > c("bottom"), "left").groupBy("src", "bottom").agg(F.coalesce(F.min("b2") - 1, F.lit(99)).alias("top"))


@query("build_above_slab", "SELECT 2 AS lvl, col // 4 AS col, row // 4 AS row, round(avg(z), 6) AS z FROM (SELECT col, row, z FROM f_dem WHERE mask <> 0) q GROUP BY 2, 3")
def build_above_slab(spark, d):
    """Two levels up in one aggregation: sums and counts compose, so the level between need not be stored."""
    return view(spark, d, "f_dem").filter("mask <> 0").groupBy(F.lit(2).alias("lvl"), F.floor(c("col") / 4).alias("col"), F.floor(c("row") / 4).alias("row")).agg(F.round(F.avg("z"), 6).alias("z"))


@query("build_slab_action", f"SELECT lvl, col, row, CASE WHEN n > 1 THEN 'overlay' WHEN main IN ('A', 'N') THEN 'link' ELSE 'convert' END AS action FROM ({JOINED}) j")
def build_slab_action(spark, d):
    j = join_pyramids_priority(spark, d)
    return j.select(*KEYS, F.when(c("n") > 1, "overlay").when(c("main").isin("A", "N"), "link").otherwise("convert").alias("action"))


@query("build_compat", f"SELECT a.img_id, CASE WHEN {COMPATIBLE} THEN 2 WHEN a.res = b.res THEN 1 ELSE 0 END AS level FROM f_img a JOIN f_img b ON b.img_id = a.img_id + 1")
def build_compat(spark, d):
    i = view(spark, d, "f_img")
    p = i.alias("a").join(i.alias("b"), F.col("b.img_id") == F.col("a.img_id") + 1)
    return p.select(F.col("a.img_id").alias("img_id"), F.when(compatible("a", "b"), 2).when(F.col("a.res") == F.col("b.res"), 1).otherwise(0).alias("level"))


@query("build_head", "SELECT DISTINCT pyr, CAST(k AS INT) AS lvl, col >> (k - lvl) AS col, row >> (k - lvl) AS row FROM (SELECT pyr, col, row, lvl, unnest(range(lvl + 1, 8)) AS k FROM f_slab WHERE lvl = 3) q")
def build_head(spark, d):
    """The levels above a reference level, of every pyramid."""
    s = view(spark, d, "f_slab").filter("lvl = 3").select(*KEYS, "pyr")
    return pyramid.all_ancestors(s, 7).filter("lvl > 3")


@query("mosaic_canvas_extent", "SELECT pyr, lvl, (max(col) - min(col) + 1) * (max(row) - min(row) + 1) AS tiles FROM f_slab GROUP BY pyr, lvl")
def mosaic_canvas_extent(spark, d):
    s = agg_level_limits(spark, d)
    return s.select("pyr", "lvl", ((c("max_col") - c("min_col") + 1) * (c("max_row") - c("min_row") + 1)).alias("tiles"))


# ---- slab lists and sources ----------------------------------------------------------------------------------------

_mixed, _cut = _path_sql("col", "row", 3)
LISTED = f"SELECT pyr, lvl, col, row, prio || '/IMAGE/' || lvl || '/' || {_cut} || '.tif' AS path FROM (SELECT *, {_mixed} AS m FROM f_slab) q"


def listed(spark, d):
    s = view(spark, d, "f_slab")
    return s.select("pyr", *KEYS, F.concat_ws("/", c("prio").cast("string"), F.lit("IMAGE"), c("lvl").cast("string"), grid.b36_path(c("col"), c("row"), 3)).alias("p")).select("pyr", *KEYS, F.concat("p", F.lit(".tif")).alias("path"))


@query("sink_slab_list", LISTED)
def sink_slab_list(spark, d):
    return listed(spark, d)


@query("scan_slab_list", "SELECT pyr, lvl, col, row FROM f_slab")
def scan_slab_list(spark, d):
    """The list's lines, stored and parsed back: root, type, level and the indices of the path. Else what joins ask of a line would be asked of each row that its slab comes from."""
    roots = F.broadcast(spark.createDataFrame([("0", "A"), ("1", "N"), ("2", "R")], "root string, pyr string"))
    p = F.split(F.regexp_replace("path", r"\.tif$", ""), "/")
    lines = Scratch(spark, "list").write(listed(spark, d).select("path"))
    parsed = lines.select(F.get(p, 0).alias("root"), F.get(p, 2).cast("int").alias("lvl"), grid.b36_unpath(F.array_join(F.slice(p, 4, 10), "/")).alias("x"))
    return parsed.join(roots, "root").select("pyr", "lvl", "x.col", "x.row")


@query("scan_indices_list", "SELECT DISTINCT user_id % 64 AS col, event_id % 64 AS row FROM events")
def scan_indices_list(spark, d):
    lines = table(spark, d, "events").select(F.concat_ws(",", (c("user_id") % 64).cast("string"), (c("event_id") % 64).cast("string")).alias("line"))
    x = F.from_csv("line", "col long, row long").alias("x")
    return lines.select(x).select("x.*").dropDuplicates()


@query("scan_tile_crop", "SELECT x AS col, y AS row, coalesce(z, -99999.0) AS z FROM range(145, 155) t(x), range(0, 12) u(y) LEFT JOIN f_dem ON col = x AND row = y WHERE x >= 147 AND y < 11")
def scan_tile_crop(spark, d):
    asked = spark.range(8 * 11).select((c("id") % 8 + 147).alias("col"), F.floor(c("id") / 8).alias("row"))
    return asked.join(view(spark, d, "f_dem").select("col", "row", "z"), ["col", "row"], "left").select("col", "row", F.coalesce("z", F.lit(-99999.0)).alias("z"))


@query("scan_raw", "SELECT i % 16 AS col, i // 16 AS row, i * 3 % 256 AS v FROM range(0, 256) t(i)")
def scan_raw(spark, d):
    return spark.range(256).select((c("id") % 16).alias("col"), F.floor(c("id") / 16).alias("row"), (c("id") * 3 % 256).alias("v"))


@query("scan_empty", "SELECT i % 16 AS col, i // 16 AS row, 255 AS r, 0 AS g, 9 AS b FROM range(0, 256) t(i)")
def scan_empty(spark, d):
    return spark.range(256).select((c("id") % 16).alias("col"), F.floor(c("id") / 16).alias("row"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(9).alias("b"))


@query("scan_harvest", "SELECT i.img_id, x, y, printf('BBOX=%.2f,%.2f,%.2f,%.2f', xmin + x * (xmax - xmin) / 4, ymin + y * (ymax - ymin) / 4, xmin + (x + 1) * (xmax - xmin) / 4, ymin + (y + 1) * (ymax - ymin) / 4) AS params FROM f_img i, range(0, 4) a(x), range(0, 4) b(y)")
def scan_harvest(spark, d):
    four = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    i = view(spark, d, "f_img").select("*", F.explode(four).alias("x")).select("*", F.explode(four).alias("y"))
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    return i.select("img_id", "x", "y", F.format_string("BBOX=%.2f,%.2f,%.2f,%.2f", c("xmin") + c("x") * w / 4, c("ymin") + c("y") * h / 4, c("xmin") + (c("x") + 1) * w / 4, c("ymin") + (c("y") + 1) * h / 4).alias("params"))


# ---- sinks ---------------------------------------------------------------------------------------------------------


@query("sink_jpeg_crop", "SELECT col, row, CASE WHEN max(CASE WHEN r > 250 AND g > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY row // 16, col // 8) = 1 THEN 255 ELSE r END AS r FROM f_rgb")
def sink_jpeg_crop(spark, d):
    """A block that holds a white pixel becomes white; blocks are small, so a window over one is bounded."""
    block = Window.partitionBy(F.floor(c("row") / 16), F.floor(c("col") / 8))
    white = F.max(F.when((c("r") > 250) & (c("g") > 120), 1).otherwise(0)).over(block) == 1
    return view(spark, d, "f_rgb").select("col", "row", F.when(white, 255).otherwise(c("r")).alias("r"))


ASC_HEADER = "printf('ncols        %d' || chr(10) || 'nrows        %d' || chr(10) || 'xllcorner    %.8f' || chr(10) || 'yllcorner    %.8f' || chr(10) || 'cellsize     %.8f' || chr(10) || 'NODATA_value %.2f', max(col) + 1, max(row) + 1, 0.0, 0.0, 1.0, -99999.0)"


@query("sink_asc", f"SELECT -1::BIGINT AS row, {ASC_HEADER} AS line FROM f_dem UNION ALL SELECT row, string_agg(printf(' %.2f', CAST(CASE WHEN mask <> 0 THEN z ELSE -99999.0 END AS FLOAT)::DOUBLE), '' ORDER BY col) AS line FROM f_dem GROUP BY row")
def sink_asc(spark, d):
    """Lines of an ASCII grid: six of header (row -1), then one a row of samples, each a space and the 32-bit value with two decimals, ties to even."""
    value = F.when(c("mask") != 0, c("z")).otherwise(-99999.0).cast("float").cast("double")
    dem = view(spark, d, "f_dem")
    cells = dem.select("row", F.struct("col", F.format_string(" %.2f", F.bround(value, 2)).alias("s")).alias("x"))
    lines = cells.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("row", F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("line"))
    names = ["ncols        %d", "nrows        %d", "xllcorner    %.8f", "yllcorner    %.8f", "cellsize     %.8f", "NODATA_value %.2f"]
    size = [F.max("col") + 1, F.max("row") + 1]
    header = dem.agg(F.format_string("\n".join(names), *size, *[F.lit(x) for x in (0.0, 0.0, 1.0, -99999.0)]).alias("line"))
    return header.select(F.lit(-1).cast("long").alias("row"), "line").unionByName(lines)


@query("sink_cache2work", "SELECT (t % 10) * 15 + x AS col, (t // 10) * 10 + y AS row, z FROM (SELECT (row // 10) * 10 + col // 15 AS t, col % 15 AS x, row % 10 AS y, z FROM f_dem) q")
def sink_cache2work(spark, d):
    """Tiles back to cells."""
    e = sink_work2cache_tiles(spark, d).select("tile", F.explode("cells").alias("x"))
    return e.select(((c("tile") % 10) * 15 + c("x.x")).alias("col"), (F.floor(c("tile") / 10) * 10 + c("x.y")).alias("row"), c("x.z").alias("z"))


def sink_work2cache_tiles(spark, d):
    t = view(spark, d, "f_dem").select((F.floor(c("row") / 10) * 10 + F.floor(c("col") / 15)).alias("tile"), F.struct((c("row") % 10).alias("y"), (c("col") % 15).alias("x"), "z").alias("s"))
    return t.groupBy("tile").agg(F.sort_array(F.collect_list("s")).alias("cells"))


@query("sink_work2cache", "SELECT (row // 10) * 10 + col // 15 AS tile, count(*) AS n, string_agg(printf('%.4f', z), ' ' ORDER BY row % 10, col % 15) AS samples FROM f_dem GROUP BY 1")
def sink_work2cache(spark, d):
    """Cells to tiles, samples in order; a tile's cells are as many as its area."""
    return sink_work2cache_tiles(spark, d).select("tile", F.size("cells").cast("long").alias("n"), F.array_join(F.transform("cells", lambda x: F.format_string("%.4f", x["z"])), " ").alias("samples"))


@query("sink_geometry", "SELECT img_id, printf('POLYGON((%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f))', xmin, ymin, xmin, ymax, xmax, ymax, xmax, ymin, xmin, ymin) AS wkt FROM f_img")
def sink_geometry(spark, d):
    return view(spark, d, "f_img").select("img_id", grid.box_wkt(grid.box(c("xmin"), c("ymin"), c("xmax"), c("ymax"))).alias("wkt"))
