"""Queries over tile-matrix arithmetic, slab paths, boxes and coordinate systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs, grid
from ..sources.tables import view
from .registry import query

DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def slabs_tm(spark, d):
    tm = view(spark, d, "f_tm")
    return view(spark, d, "f_slab").join(F.broadcast(tm), F.col("lvl") - 1 == F.col("ord"))


SLAB_TM = "f_slab s JOIN f_tm t ON s.lvl - 1 = t.ord"


@query("tm_col_to_x", f"SELECT pyr, lvl, col, row, x0 + col * res * tile_w * 4 AS x, x0 + col * res * tile_w AS x1 FROM {SLAB_TM}")
def tm_col_to_x(spark, d):
    return slabs_tm(spark, d).select("pyr", "lvl", "col", "row", grid.col_to_x(F.col("col"), F.col("x0"), F.col("res"), F.col("tile_w"), 4).alias("x"), grid.col_to_x(F.col("col"), F.col("x0"), F.col("res"), F.col("tile_w")).alias("x1"))


@query("tm_row_to_y", f"SELECT pyr, lvl, col, row, y0 - row * res * tile_h * 4 AS y FROM {SLAB_TM}")
def tm_row_to_y(spark, d):
    return slabs_tm(spark, d).select("pyr", "lvl", "col", "row", grid.row_to_y(F.col("row"), F.col("y0"), F.col("res"), F.col("tile_h"), 4).alias("y"))


@query("tm_x_to_col", "SELECT img_id, ord, CAST(trunc((xmin - 1000 - x0) / (t.res * tile_w * 4)) AS BIGINT) AS col FROM f_img, f_tm t")
def tm_x_to_col(spark, d):
    both = view(spark, d, "f_img").drop("res").join(F.broadcast(view(spark, d, "f_tm")), F.lit(True))
    return both.select("img_id", "ord", grid.x_to_col(F.col("xmin") - 1000, F.col("x0"), F.col("res"), F.col("tile_w"), 4).alias("col"))


@query("tm_y_to_row", "SELECT img_id, ord, CAST(trunc((y0 - ymin) / (t.res * tile_h * 4)) AS BIGINT) AS row FROM f_img, f_tm t")
def tm_y_to_row(spark, d):
    both = view(spark, d, "f_img").drop("res").join(F.broadcast(view(spark, d, "f_tm")), F.lit(True))
    return both.select("img_id", "ord", grid.y_to_row(F.col("ymin"), F.col("y0"), F.col("res"), F.col("tile_h"), 4).alias("row"))


def _slab_box(tpw=4, tph=4):
    c = F.col
    return grid.indices_to_bbox(c("col"), c("row"), c("x0"), c("y0"), c("res"), c("tile_w"), c("tile_h"), tpw, tph)


@query("tm_indices_to_bbox", f"SELECT pyr, lvl, col, row, x0 + col * res * 64 AS xmin, y0 - (row + 1) * res * 64 AS ymin, x0 + (col + 1) * res * 64 AS xmax, y0 - row * res * 64 AS ymax FROM {SLAB_TM}")
def tm_indices_to_bbox(spark, d):
    return slabs_tm(spark, d).select("pyr", "lvl", "col", "row", _slab_box().alias("b")).select("pyr", "lvl", "col", "row", "b.*")


IMG_TM = "f_img i, f_tm t"
INDICES = "CAST(trunc((y0 - ymax) / (t.res * 16)) AS BIGINT) AS row_min, CAST(trunc((y0 - ymin) / (t.res * 16)) AS BIGINT) AS row_max, CAST(trunc((xmin - x0) / (t.res * 16)) AS BIGINT) AS col_min, CAST(trunc((xmax - x0) / (t.res * 16)) AS BIGINT) AS col_max"


def img_indices(spark, d, tpw=1, tph=1):
    c = F.col
    both = view(spark, d, "f_img").withColumnRenamed("res", "img_res").join(F.broadcast(view(spark, d, "f_tm")), F.lit(True))
    b = grid.box(c("xmin"), c("ymin"), c("xmax"), c("ymax"))
    return both.withColumn("ix", grid.bbox_to_indices(b, c("x0"), c("y0"), c("res"), c("tile_w"), c("tile_h"), tpw, tph))


@query("tm_bbox_to_indices", f"SELECT img_id, ord, {INDICES} FROM {IMG_TM}")
def tm_bbox_to_indices(spark, d):
    return img_indices(spark, d).select("img_id", "ord", "ix.*")


WKT = "printf('POLYGON((%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f))', xa, ya, xa, yb, xb, yb, xb, ya, xa, ya)"
SLAB_XY = f"SELECT *, x0 + col * res * 64 AS xa, y0 - (row + 1) * res * 64 AS ya, x0 + (col + 1) * res * 64 AS xb, y0 - row * res * 64 AS yb FROM {SLAB_TM}"


@query("tm_indices_to_geom", f"SELECT pyr, lvl, col, row, {WKT} AS wkt FROM ({SLAB_XY}) q")
def tm_indices_to_geom(spark, d):
    return slabs_tm(spark, d).select("pyr", "lvl", "col", "row", grid.box_wkt(_slab_box()).alias("wkt"))


@query("tm_indices_to_tfw", f"SELECT pyr, lvl, col, row, printf('%.4f 0 0 %.4f %.4f %.4f', res, -res, xa + res / 2, yb - res / 2) AS tfw FROM ({SLAB_XY}) q")
def tm_indices_to_tfw(spark, d):
    b, r = _slab_box(), F.col("res")
    return slabs_tm(spark, d).select("pyr", "lvl", "col", "row", F.format_string("%.4f 0 0 %.4f %.4f %.4f", r, -r, b["xmin"] + r / 2, b["ymax"] - r / 2).alias("tfw"))


@query("level_limits_bbox", f"SELECT pyr, lvl, min(x0 + col * res * 64) AS xmin, min(y0 - (row + 1) * res * 64) AS ymin, max(x0 + (col + 1) * res * 64) AS xmax, max(y0 - row * res * 64) AS ymax FROM {SLAB_TM} GROUP BY pyr, lvl")
def level_limits_bbox(spark, d):
    s = view(spark, d, "f_slab").groupBy("pyr", "lvl").agg(*[f(c).alias(f"{n}_{c}") for c in ("col", "row") for n, f in (("min", F.min), ("max", F.max))])
    c = F.col
    lim = s.join(F.broadcast(view(spark, d, "f_tm")), c("lvl") - 1 == c("ord"))
    return lim.select("pyr", "lvl", grid.col_to_x(c("min_col"), c("x0"), c("res"), 16, 4).alias("xmin"), grid.row_to_y(c("max_row") + 1, c("y0"), c("res"), 16, 4).alias("ymin"), grid.col_to_x(c("max_col") + 1, c("x0"), c("res"), 16, 4).alias("xmax"), grid.row_to_y(c("min_row"), c("y0"), c("res"), 16, 4).alias("ymax"))


@query("tile_to_slab", "SELECT col, row, lvl, pyr, CAST(floor((col - 32) / 4.0) AS BIGINT) AS slab_col, CAST(floor((row - 32) / 4.0) AS BIGINT) AS slab_row FROM f_slab")
def tile_to_slab(spark, d):
    return view(spark, d, "f_slab").select("col", "row", "lvl", "pyr", grid.euclid(F.col("col") - 32, 4).alias("slab_col"), grid.euclid(F.col("row") - 32, 4).alias("slab_row"))


@query("slab_ordinal", "SELECT col, row, lvl, pyr, (row % 4) * 4 + col % 4 AS n, 2048 + 4 * ((row % 4) * 4 + col % 4) AS offset_at, 2048 + 64 + 4 * ((row % 4) * 4 + col % 4) AS size_at FROM f_slab")
def slab_ordinal(spark, d):
    n = (F.col("row") % 4) * 4 + F.col("col") % 4
    return view(spark, d, "f_slab").select("col", "row", "lvl", "pyr", n.alias("n"), (2048 + 4 * n).alias("offset_at"), (2112 + 4 * n).alias("size_at"))


def _digit(n, k):
    return f"substr({DIGITS}, CAST(({n} // CAST(pow(36, {k}) AS BIGINT)) % 36 AS BIGINT) + 1, 1)"


def _b36_sql(n):
    whole = " || ".join(_digit(n, k) for k in range(6, -1, -1))
    return f"CASE WHEN {n} = 0 THEN '0' ELSE ltrim({whole}, '0') END"


@query("b36_encode", f"SELECT o_orderkey * 7919 AS n, {_b36_sql('(o_orderkey * 7919)')} AS b36 FROM orders")
def b36_encode(spark, d):
    n = F.col("o_orderkey") * 7919
    return spark.read.parquet(f"{d}/orders.parquet").select(n.alias("n"), grid.b36(n).alias("b36"))


@query("b36_decode", "SELECT o_orderkey * 7919 AS n FROM orders")
def b36_decode(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(grid.b36_value(grid.b36(F.col("o_orderkey") * 7919)).alias("n"))


def _path_sql(col, row, parts):
    n = f"greatest({parts}, CASE WHEN greatest({col}, {row}) < 36 THEN 1 WHEN greatest({col}, {row}) < 1296 THEN 2 WHEN greatest({col}, {row}) < 46656 THEN 3 ELSE 4 END)"
    mixed = f"array_to_string(list_transform(range(0, {n}), lambda k: {_digit(col, f'({n} - 1 - k)')} || {_digit(row, f'({n} - 1 - k)')}), '')"
    tail = "".join(f" || '/' || substr(m, len(m) - {2 * (parts - k)} + 1, 2)" for k in range(1, parts))
    return mixed, f"substr(m, 1, len(m) - {2 * (parts - 1)}){tail}"


BIG = "f_slab"
_mixed, _cut = _path_sql("c", "r", 3)


@query("b36_path", f"SELECT pyr, lvl, c AS col, r AS row, {_cut} AS path FROM (SELECT *, {_mixed} AS m FROM (SELECT pyr, lvl, col * 241 AS c, row * 1237 AS r FROM f_slab) q) q2")
def b36_path(spark, d):
    s = view(spark, d, "f_slab").select("pyr", "lvl", (F.col("col") * 241).alias("col"), (F.col("row") * 1237).alias("row"))
    return s.select("*", grid.b36_path(F.col("col"), F.col("row"), 3).alias("path"))


@query("b36_unpath", "SELECT pyr, lvl, col * 241 AS col, row * 1237 AS row FROM f_slab")
def b36_unpath(spark, d):
    return b36_path(spark, d).select("pyr", "lvl", grid.b36_unpath(F.col("path")).alias("p")).select("pyr", "lvl", "p.*")


PAIRS = "f_img a JOIN f_img b ON b.img_id = a.img_id + 1"


def pairs(spark, d):
    """Each image's box a with the next image's box b."""
    i = view(spark, d, "f_img")
    b = grid.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return i.select("img_id", b.alias("a"), "res").join(i.select((F.col("img_id") - 1).alias("img_id"), b.alias("b")), "img_id")


@query("bbox_intersects", f"SELECT a.img_id, a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AS hit FROM {PAIRS}")
def bbox_intersects(spark, d):
    return pairs(spark, d).select("img_id", grid.intersects(F.col("a"), F.col("b")).alias("hit"))


@query("bbox_contains", "SELECT img_id, 100 < xmin AND 3000 > xmax AND 100 < ymin AND 3000 > ymax AS hit FROM f_img")
def bbox_contains(spark, d):
    b = grid.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return view(spark, d, "f_img").select("img_id", grid.contains(grid.box(100, 100, 3000, 3000), b).alias("hit"))


@query("bbox_contains_inside", "SELECT img_id, 37 <= xmin AND 3000 >= xmax AND 53 <= ymin AND 3000 >= ymax AS hit FROM f_img")
def bbox_contains_inside(spark, d):
    b = grid.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return view(spark, d, "f_img").select("img_id", grid.contains_inside(grid.box(37, 53, 3000, 3000), b).alias("hit"))


CUT = "greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax"
HIT = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


@query("bbox_intersection", f"SELECT a.img_id, {CUT} FROM {PAIRS} WHERE {HIT}")
def bbox_intersection(spark, d):
    p = pairs(spark, d).filter(grid.intersects(F.col("a"), F.col("b")))
    return p.select("img_id", grid.intersection(F.col("a"), F.col("b")).alias("c")).select("img_id", "c.*")


@query("bbox_adapt", "SELECT img_id, CASE WHEN hit THEN greatest(xmin, 500) END AS xmin, CASE WHEN hit THEN greatest(ymin, 500) END AS ymin, CASE WHEN hit THEN least(xmax, 3500) END AS xmax, CASE WHEN hit THEN least(ymax, 3500) END AS ymax FROM (SELECT *, xmin <= 3500 AND 500 <= xmax AND ymin <= 3500 AND 500 <= ymax AS hit FROM f_img) q")
def bbox_adapt(spark, d):
    b = grid.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return view(spark, d, "f_img").select("img_id", grid.adapt(b, grid.box(500, 500, 3500, 3500)).alias("c")).select("img_id", "c.*")


@query("bbox_expand", "SELECT img_id, xmin - 3 * res AS xmin, ymin - 3 * res AS ymin, xmax + 3 * res AS xmax, ymax + 3 * res AS ymax FROM f_img")
def bbox_expand(spark, d):
    b = grid.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return view(spark, d, "f_img").select("img_id", grid.expand(b, F.col("res"), F.col("res"), 3).alias("c")).select("img_id", "c.*")


@query("bbox_equal", "SELECT a.img_id, b.img_id AS other FROM f_img a JOIN f_img b ON a.xmin = b.xmin AND a.ymin = b.ymin AND a.xmax = b.xmax AND a.ymax = b.ymax AND a.img_id < b.img_id")
def bbox_equal(spark, d):
    i = view(spark, d, "f_img")
    return i.alias("a").join(i.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).filter("a.img_id < b.img_id").select(F.col("a.img_id").alias("img_id"), F.col("b.img_id").alias("other"))


@query("bbox_is_null", "SELECT img_id, xmin = 0 AND ymin = 0 AND xmax = 0 AND ymax = 0 AS is_null FROM f_img")
def bbox_is_null(spark, d):
    return view(spark, d, "f_img").select("img_id", ((F.col("xmin") == 0) & (F.col("ymin") == 0) & (F.col("xmax") == 0) & (F.col("ymax") == 0)).alias("is_null"))


def _edge(steps):
    return f"SELECT pt_id, lon + s.sx * t.k / {steps}.0 AS lon, lat + s.sy * t.k / {steps}.0 + s.dy AS lat FROM f_point, range(0, {steps + 1}) t(k), (VALUES (1.0, 0.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, 0.0)) s(sx, sy, dy) UNION ALL SELECT pt_id, lon + 1.0, lat + t.k / {steps}.0 FROM f_point, range(0, {steps + 1}) t(k)"


def _reprojected(spark, d, steps):
    """Boxes of one degree at each point, their sides cut into steps, in metres."""
    p = view(spark, d, "f_point").select("pt_id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    t = F.col("k") / steps
    side = [F.struct((F.col("lon") + u).alias("lon"), (F.col("lat") + v).alias("lat")) for u, v in ((t, F.lit(0.0)), (t, F.lit(1.0)), (F.lit(0.0), t), (F.lit(1.0), t))]
    p = p.select("pt_id", F.explode(F.array(*side)).alias("s")).select("pt_id", crs.lon_to_x(F.col("s.lon")).alias("x"), crs.lat_to_y(F.col("s.lat")).alias("y"))
    return p.groupBy("pt_id").agg(*[(F.round(f(c), 3) + 0.0).alias(f"{c}{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def _reproject_sql(steps):
    return f"WITH e AS ({_edge(steps)}), m AS (SELECT pt_id, lon * ({crs.HALF!r} / 180) AS x, ln(tan(pi() / 4 + lat * (pi() / 360))) * {crs.RADIUS} AS y FROM e) SELECT pt_id, round(min(x), 3) + 0.0 AS xmin, round(max(x), 3) + 0.0 AS xmax, round(min(y), 3) + 0.0 AS ymin, round(max(y), 3) + 0.0 AS ymax FROM m GROUP BY pt_id"


@query("bbox_reproject", _reproject_sql(256))
def bbox_reproject(spark, d):
    return _reprojected(spark, d, 256)


@query("bbox_convert_build", _reproject_sql(10))
def bbox_convert_build(spark, d):
    return _reprojected(spark, d, 10)


AREA = (-60.0, -40.0, 60.0, 40.0)


def _point_box():
    return grid.box(F.col("lon"), F.col("lat"), F.col("lon") + 2, F.col("lat") + 1)


@query("crs_validate_bbox", "SELECT pt_id, lon >= -60 AND lon + 2 <= 60 AND lat >= -40 AND lat + 1 <= 40 AS valid FROM f_point")
def crs_validate_bbox(spark, d):
    return view(spark, d, "f_point").select("pt_id", grid.contains_inside(grid.box(*AREA), _point_box()).alias("valid"))


@query("crs_crop_bbox", "SELECT pt_id, CASE WHEN hit THEN greatest(lon, -60) ELSE 0.0 END AS xmin, CASE WHEN hit THEN greatest(lat, -40) ELSE 0.0 END AS ymin, CASE WHEN hit THEN least(lon + 2, 60) ELSE 0.0 END AS xmax, CASE WHEN hit THEN least(lat + 1, 40) ELSE 0.0 END AS ymax FROM (SELECT *, lon <= 60 AND lon + 2 >= -60 AND lat <= 40 AND lat + 1 >= -40 AS hit FROM f_point) q")
def crs_crop_bbox(spark, d):
    cropped = F.when(grid.intersects(_point_box(), grid.box(*AREA)), grid.intersection(_point_box(), grid.box(*AREA))).otherwise(grid.box(0, 0, 0, 0))
    return view(spark, d, "f_point").select("pt_id", cropped.alias("c")).select("pt_id", "c.*")


@query("crs_bbox_geo", f"SELECT pt_id, round(lon * ({crs.HALF!r} / 180), 3) AS x, round(ln(tan(pi() / 4 + lat * (pi() / 360))) * {crs.RADIUS}, 3) + 0.0 AS y, round(lon, 6) AS lon, round(lat, 6) + 0.0 AS lat FROM f_point")
def crs_bbox_geo(spark, d):
    p = view(spark, d, "f_point").select("pt_id", crs.lon_to_x(F.col("lon")).alias("x"), crs.lat_to_y(F.col("lat")).alias("y"))
    return p.select("pt_id", F.round("x", 3).alias("x"), (F.round("y", 3) + 0.0).alias("y"), F.round(crs.x_to_lon(F.col("x")), 6).alias("lon"), (F.round(crs.y_to_lat(F.col("y")), 6) + 0.0).alias("lat"))


#: Equivalent codes, one line a group.
SAME = ["EPSG:4326 CRS:84 IGNF:WGS84G", "EPSG:3857 EPSG:900913 IGNF:WGS84WM", "EPSG:2154 IGNF:LAMB93"]
CODES = [(k, c) for k, line in enumerate(SAME) for c in line.split()]
ASKED = ["epsg:4326", "IGNF:LAMB93", "EPSG:27572", "EPSG:900913", "CRS:84"]
CODES_SQL = ", ".join(f"({k}, '{c}')" for k, c in CODES)


def _codes(spark):
    return F.broadcast(spark.createDataFrame(CODES, "grp int, code string"))


@query("crs_equal", f"WITH g(grp, code) AS (VALUES {CODES_SQL}) SELECT a.code AS a, b.code AS b FROM g a JOIN g b ON a.grp = b.grp")
def crs_equal(spark, d):
    g = _codes(spark)
    return g.alias("x").join(g.alias("y"), F.col("x.grp") == F.col("y.grp")).select(F.col("x.code").alias("a"), F.col("y.code").alias("b"))


def _asked():
    return F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("event_id") % len(ASKED) + 1).cast("int"))


ASKED_SQL = f"list_extract([{', '.join(map(repr, ASKED))}], CAST(event_id % {len(ASKED)} + 1 AS BIGINT))"


@query("crs_equals_list", f"WITH g(grp, code) AS (VALUES {CODES_SQL}) SELECT event_id, g2.code AS same FROM (SELECT event_id, {ASKED_SQL} AS crs FROM events) e JOIN g g1 ON g1.code = upper(e.crs) JOIN g g2 ON g1.grp = g2.grp")
def crs_equals_list(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.upper(_asked()).alias("code"))
    g = _codes(spark)
    return e.join(g, "code").join(g.withColumnRenamed("code", "same"), "grp").select("event_id", "same")


@query("crs_allowed", f"WITH g(grp, code) AS (VALUES {CODES_SQL}) SELECT event_id FROM (SELECT event_id, upper({ASKED_SQL}) AS crs FROM events) e WHERE crs IN (SELECT b.code FROM g a JOIN g b ON a.grp = b.grp WHERE a.code IN ('EPSG:3857', 'EPSG:2154'))")
def crs_allowed(spark, d):
    g = _codes(spark)
    allowed = g.filter(F.col("code").isin("EPSG:3857", "EPSG:2154")).select("grp").join(g, "grp").select("code").distinct()
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.upper(_asked()).alias("code"))
    return e.join(F.broadcast(allowed), "code", "left_semi").select("event_id")


@query("crs_axis_swap", "SELECT pt_id, CASE WHEN pt_id % 2 = 0 THEN lat ELSE lon END AS c0, CASE WHEN pt_id % 2 = 0 THEN lon ELSE lat END AS c1 FROM f_point")
def crs_axis_swap(spark, d):
    swap = F.col("pt_id") % 2 == 0  # version 1.3.0 with a geographic EPSG code
    return view(spark, d, "f_point").select("pt_id", F.when(swap, F.col("lat")).otherwise(F.col("lon")).alias("c0"), F.when(swap, F.col("lon")).otherwise(F.col("lat")).alias("c1"))


for _name, _expr, _f in (
    ("img_x2c", "CAST(floor((1234.5 - xmin) / res) AS BIGINT)", lambda c: F.floor((1234.5 - c("xmin")) / c("res"))),
    ("img_y2l", "CAST(floor((ymax - 1234.5) / res) AS BIGINT)", lambda c: F.floor((c("ymax") - 1234.5) / c("res"))),
    ("img_c2x", "xmin + (img_id % 50) * res", lambda c: c("xmin") + (c("img_id") % 50) * c("res")),
    ("img_l2y", "ymax - (img_id % 50) * res", lambda c: c("ymax") - (c("img_id") % 50) * c("res")),
    ("img_mean_res", "round((res + res * 2) / 2, 6)", lambda c: F.round((c("res") + c("res") * 2) / 2, 6)),
    ("img_res_meter", f"round(CASE WHEN channels = 1 THEN res * {crs.METRES_PER_DEGREE!r} ELSE res END, 6)", lambda c: F.round(crs.to_metres(c("res"), c("channels") == 1), 6)),
    ("img_dims_consistent", "round((xmax - xmin) / res) = channels * 16", lambda c: F.round((c("xmax") - c("xmin")) / c("res")) == c("channels") * 16),
    ("img_set_dims", "abs((xmax - xmin) - 128 * res) < 0.01", lambda c: F.abs((c("xmax") - c("xmin")) - 128 * c("res")) < 0.01),
):
    query(_name, f"SELECT img_id, {_expr} AS v FROM f_img")(lambda spark, d, f=_f: view(spark, d, "f_img").select("img_id", f(F.col).alias("v")))


@query("img_phase", "SELECT img_id, round(xmin / 3 - floor(xmin / 3), 6) AS px, round(ymax / 3 - floor(ymax / 3), 6) AS py FROM f_img")
def img_phase(spark, d):
    return view(spark, d, "f_img").select("img_id", F.round(grid.phase(F.col("xmin"), 3), 6).alias("px"), F.round(grid.phase(F.col("ymax"), 3), 6).alias("py"))


def compatible(a, b):
    """Channels equal, resolutions within a thousandth, phases within a thousandth of a pixel modulo one."""
    def near(x, y):
        gap = F.abs(grid.phase(x, F.col(f"{a}.res")) - grid.phase(y, F.col(f"{b}.res")))
        return (gap < 0.001) | (gap > 0.999)

    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "channels") == c(b, "channels")) & (F.abs(c(a, "res") - c(b, "res")) < F.least(c(a, "res"), c(b, "res")) / 1000) & near(c(a, "xmin"), c(b, "xmin")) & near(c(a, "ymax"), c(b, "ymax"))


def _near_sql(v):
    g = f"abs((a.{v} / a.res - floor(a.{v} / a.res)) - (b.{v} / b.res - floor(b.{v} / b.res)))"
    return f"({g} < 0.001 OR {g} > 0.999)"


COMPATIBLE = f"a.channels = b.channels AND abs(a.res - b.res) < least(a.res, b.res) / 1000 AND {_near_sql('xmin')} AND {_near_sql('ymax')}"


@query("img_compatible", f"SELECT a.img_id, {COMPATIBLE} AS ok FROM {PAIRS}")
def img_compatible(spark, d):
    i = view(spark, d, "f_img")
    return i.alias("a").join(i.alias("b"), F.col("b.img_id") == F.col("a.img_id") + 1).select(F.col("a.img_id").alias("img_id"), compatible("a", "b").alias("ok"))


PH = 0.25


@query("bbox_make_phase", "SELECT img_id, (ceil(xmin / res - 0.25) + 0.25) * res AS xmin, (ceil(ymin / res - 0.25) + 0.25) * res AS ymin, (floor(xmax / res - 0.25) + 0.25) * res AS xmax, (floor(ymax / res - 0.25) + 0.25) * res AS ymax FROM f_img")
def bbox_make_phase(spark, d):
    up = lambda v: (F.ceil(F.col(v) / F.col("res") - PH) + PH) * F.col("res")
    down = lambda v: (F.floor(F.col(v) / F.col("res") - PH) + PH) * F.col("res")
    return view(spark, d, "f_img").select("img_id", up("xmin").alias("xmin"), up("ymin").alias("ymin"), down("xmax").alias("xmax"), down("ymax").alias("ymax"))


def best_render(asked, levels, keys):
    """The finest level whose ratio of asked to own resolution is at least 0.8, smallest first; else the largest ratio."""
    both = asked.join(F.broadcast(levels), F.lit(True)).withColumn("ratio", F.col("asked") / F.col("res"))
    fit, far = F.col("ratio") >= 0.8, F.col("ratio") < 0.8
    order = F.struct(F.when(fit, 0).otherwise(1), F.when(fit, F.col("ratio")).otherwise(-F.col("ratio")))
    return both.groupBy(*keys).agg(F.min_by("id", order).alias("level"))


@query("level_best_render", "SELECT img_id, id AS level FROM (SELECT img_id, id, row_number() OVER (PARTITION BY img_id ORDER BY CASE WHEN r >= 0.8 THEN 0 ELSE 1 END, CASE WHEN r >= 0.8 THEN r ELSE -r END) AS n FROM (SELECT img_id, id, (1 + img_id % 40) / 2.0 / t.res AS r FROM f_img, f_tm t) q) w WHERE n = 1")
def level_best_render(spark, d):
    asked = view(spark, d, "f_img").select("img_id", ((1 + F.col("img_id") % 40) / 2.0).alias("asked"))
    return best_render(asked, view(spark, d, "f_tm").select("id", "res"), ["img_id"])


@query("level_best_build", "SELECT img_id, arg_min(id, abs(r - 1)) AS level FROM (SELECT img_id, id, t.res / ((1 + img_id % 40) / 2.0) AS r FROM f_img, f_tm t) q WHERE r BETWEEN 0.8 AND 1.5 GROUP BY img_id")
def level_best_build(spark, d):
    asked = view(spark, d, "f_img").select("img_id", ((1 + F.col("img_id") % 40) / 2.0).alias("asked"))
    both = asked.join(F.broadcast(view(spark, d, "f_tm").select("id", "res")), F.lit(True)).withColumn("ratio", F.col("res") / F.col("asked"))
    return both.filter(F.col("ratio").between(0.8, 1.5)).groupBy("img_id").agg(F.min_by("id", F.abs(F.col("ratio") - 1)).alias("level"))


@query("level_dpi_scale", "SELECT img_id, round(res * (72 + img_id % 5 * 24) / 90.7, 6) AS res FROM f_img")
def level_dpi_scale(spark, d):
    return view(spark, d, "f_img").select("img_id", F.round(F.col("res") * (72 + F.col("img_id") % 5 * 24) / 90.7, 6).alias("res"))


@query("gfi_pixel_bbox", "SELECT img_id, xmin + i * rx AS xmin, ymax - (j + 1) * ry AS ymin, xmin + (i + 1) * rx AS xmax, ymax - j * ry AS ymax FROM (SELECT *, img_id % 64 AS i, img_id % 32 AS j, (xmax - xmin) / 64 AS rx, (ymax - ymin) / 32 AS ry FROM f_img) q")
def gfi_pixel_bbox(spark, d):
    c = F.col
    q = view(spark, d, "f_img").withColumns({"i": c("img_id") % 64, "j": c("img_id") % 32, "rx": (c("xmax") - c("xmin")) / 64, "ry": (c("ymax") - c("ymin")) / 32})
    return q.select("img_id", (c("xmin") + c("i") * c("rx")).alias("xmin"), (c("ymax") - (c("j") + 1) * c("ry")).alias("ymin"), (c("xmin") + (c("i") + 1) * c("rx")).alias("xmax"), (c("ymax") - c("j") * c("ry")).alias("ymax"))
