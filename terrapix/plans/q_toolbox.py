"""Queries of the toolbox: eighteen conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import toolbox as tb
from ..operators.pyramid import all_ancestors, numbered
from ..sources.tables import table, view
from .q_build import listed, scan_slab_list
from .q_grid import _path_sql
from .registry import query

c = F.col
MIXED, CUT = _path_sql("col", "row", 3)

# Slabs of 4 x 4 tiles: 64 x 64 pixels.
SQL_SLABS = """SELECT *, unnest(range(CAST(trunc((y0 - ymax) / (res * 64)) AS BIGINT), CAST(trunc((y0 - ymin) / (res * 64)) AS BIGINT) + 1)) AS row FROM (
SELECT *, unnest(range(CAST(trunc((xmin - x0) / (res * 64)) AS BIGINT), CAST(trunc((xmax - x0) / (res * 64)) AS BIGINT) + 1)) AS col FROM (SELECT i.img_id, xmin, ymin, xmax, ymax, t.* FROM f_img i, f_tm t) b) b1"""
SQL_GEOM = f"""SELECT DISTINCT id, col, row, x0, y0, res FROM ({SQL_SLABS}) g WHERE xmin <= x0 + (col + 1) * res * 64 AND xmax >= x0 + col * res * 64 AND ymin <= y0 - row * res * 64 AND ymax >= y0 - (row + 1) * res * 64"""
WKT = "printf('POLYGON((%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f))', xa, ya, xa, yb, xb, yb, xb, ya, xa, ya)"
XY = "x0 + col * res * 64 AS xa, y0 - (row + 1) * res * 64 AS ya, x0 + (col + 1) * res * 64 AS xb, y0 - row * res * 64 AS yb"
INSERT = f"'INSERT INTO slabs (level, col, row, geom) VALUES (' || id || ', ' || col || ', ' || row || ', ''' || {WKT} || ''');'"
GETTILE = "'LAYER=LAYER&TILEMATRIX=' || id || '&TILECOL=' || col || '&TILEROW=' || row"


def levels(spark, d):
    return view(spark, d, "f_tm")


def boxes(spark, d):
    b = grid.box(c("xmin"), c("ymin"), c("xmax"), c("ymax"))
    return view(spark, d, "f_img").select("img_id", b.alias("box"))


def slabs(spark, d):
    return tb.bbox_slabs(boxes(spark, d), levels(spark, d), 4, 4)


def geom(spark, d):
    return tb.geom_slabs(boxes(spark, d), levels(spark, d), 4, 4)


@query("tb_bbox_slabs", f"SELECT DISTINCT id, col, row FROM ({SQL_SLABS}) s")
def tb_bbox_slabs(spark, d):
    return slabs(spark, d).select("id", "col", "row").distinct()


@query("tb_bbox_gettile", f"SELECT DISTINCT {GETTILE} AS params FROM ({SQL_SLABS}) s")
def tb_bbox_gettile(spark, d):
    return slabs(spark, d).select("id", "col", "row").distinct().select(tb.gettile_params().alias("params"))


@query("tb_bbox_sql", f"SELECT DISTINCT {INSERT} AS stmt FROM (SELECT id, col, row, {XY} FROM ({SQL_SLABS}) s) q")
def tb_bbox_sql(spark, d):
    return slabs(spark, d).select("id", "col", "row", "x0", "y0", "res", "tile_w", "tile_h").distinct().select(tb.sql_insert(tb.slab_box(4, 4)).alias("stmt"))


@query("tb_bboxes_slabs", f"SELECT DISTINCT id, col, row FROM ({SQL_SLABS}) s")
def tb_bboxes_slabs(spark, d):
    """A list of boxes as text lines; lines that are no box are passed over."""
    written = boxes(spark, d).select(F.concat_ws(",", *[c(f"box.{n}").cast("string") for n in ("xmin", "ymin", "xmax", "ymax")]).alias("line"))
    b = written.unionByName(spark.createDataFrame([("xmin,ymin,xmax,ymax",), ("",), ("1,2,3",)], "line string"))
    ok = b.filter(c("line").rlike(r"^-?[0-9.]+(,-?[0-9.]+){3}$")).withColumn("p", F.split("line", ",").cast("array<double>"))
    parsed = ok.select(grid.box(*[c("p")[k] for k in range(4)]).alias("box"))
    return tb.bbox_slabs(parsed, levels(spark, d), 4, 4).select("id", "col", "row").distinct()


@query("tb_geom_slabs", f"SELECT id, col, row FROM ({SQL_GEOM}) g")
def tb_geom_slabs(spark, d):
    return geom(spark, d).select("id", "col", "row")


@query("tb_geom_gettile", f"SELECT {GETTILE} AS params FROM ({SQL_GEOM}) g")
def tb_geom_gettile(spark, d):
    return geom(spark, d).select(tb.gettile_params().alias("params"))


@query("tb_geom_count", f"SELECT count(*) AS n FROM ({SQL_GEOM}) g")
def tb_geom_count(spark, d):
    return geom(spark, d).agg(F.count("*").alias("n"))


@query("tb_geom_sql", f"SELECT {INSERT} AS stmt FROM (SELECT id, col, row, {XY} FROM ({SQL_GEOM}) g) q")
def tb_geom_sql(spark, d):
    return geom(spark, d).select(tb.sql_insert(tb.slab_box(4, 4)).alias("stmt"))


def points(spark, d):
    return view(spark, d, "f_point").select("pt_id", (c("lon") + 180).alias("x"), ((c("lat") + 85) * 20).alias("y"))


_POINT = "SELECT pt_id, id, CAST(trunc((lon + 180 - x0) / (res * {n})) AS BIGINT) AS col, CAST(trunc((y0 - (lat + 85) * 20) / (res * {n})) AS BIGINT) AS row FROM f_point, f_tm"


@query("tb_point_slab", f"SELECT pt_id, id, col, row, {CUT} AS path FROM (SELECT *, {MIXED} AS m FROM ({_POINT.format(n=64)}) p) q")
def tb_point_slab(spark, d):
    p = tb.point_indices(points(spark, d), view(spark, d, "f_tm"), 4, 4)
    return p.select("pt_id", "id", "col", "row", grid.b36_path(c("col"), c("row"), 3).alias("path"))


@query("tb_point_tile", _POINT.format(n=16))
def tb_point_tile(spark, d):
    return tb.point_indices(points(spark, d), view(spark, d, "f_tm"), 1, 1).select("pt_id", "id", "col", "row")


SLABS_TM = "f_slab s JOIN f_tm t ON s.lvl - 1 = t.ord"


def inventory(spark, d, from_list=False):
    s = scan_slab_list(spark, d) if from_list else view(spark, d, "f_slab")
    return s.join(F.broadcast(view(spark, d, "f_tm")), c("lvl") - 1 == c("ord"))


@query("tb_list_geom", f"SELECT id, min(xa) AS xmin, min(ya) AS ymin, max(xb) AS xmax, max(yb) AS ymax FROM (SELECT id, {XY} FROM {SLABS_TM}) q GROUP BY id")
def tb_list_geom(spark, d):
    b = tb.slab_box(4, 4)
    s = inventory(spark, d, from_list=True).select("id", b.alias("b"))
    return s.groupBy("id").agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


@query("tb_list_gettile", f"SELECT pyr, 'LAYER=LAYER&TILEMATRIX=' || id || '&TILECOL=' || (col * 4 + (col * 7 + row) % 4) || '&TILEROW=' || (row * 4 + (row * 5 + col) % 4) AS params FROM (SELECT *, row_number() OVER (PARTITION BY pyr, id ORDER BY col, row) AS n FROM {SLABS_TM}) q WHERE n % 10 = 0")
def tb_list_gettile(spark, d):
    """Every tenth slab of each level in order, and in it a tile chosen by its indices."""
    s = numbered(inventory(spark, d, from_list=True), ["pyr", "id"], ["col"], ["row"]).filter("n % 10 = 0")
    t = s.select("pyr", "id", (c("col") * 4 + (c("col") * 7 + c("row")) % 4).alias("col"), (c("row") * 4 + (c("row") * 5 + c("col")) % 4).alias("row"))
    return t.select("pyr", tb.gettile_params().alias("params"))


@query("tb_slab_tfw", f"SELECT pyr, lvl, col, row, printf('%.4f', res) || chr(10) || '0' || chr(10) || '0' || chr(10) || printf('%.4f', -res) || chr(10) || printf('%.4f', xa + res / 2) || chr(10) || printf('%.4f', yb - res / 2) AS tfw FROM (SELECT pyr, lvl, col, row, res, {XY} FROM {SLABS_TM}) q")
def tb_slab_tfw(spark, d):
    b, f = tb.slab_box(4, 4), lambda v: F.format_string("%.4f", v)
    s = inventory(spark, d)
    return s.select("pyr", "lvl", "col", "row", F.concat_ws("\n", f(c("res")), F.lit("0"), F.lit("0"), f(-c("res")), f(b["xmin"] + c("res") / 2), f(b["ymax"] - c("res") / 2)).alias("tfw"))


@query("tb_slab_geom", f"SELECT pyr, lvl, col, row, {WKT} AS wkt FROM (SELECT pyr, lvl, col, row, {XY} FROM {SLABS_TM}) q")
def tb_slab_geom(spark, d):
    return inventory(spark, d).select("pyr", "lvl", "col", "row", grid.box_wkt(tb.slab_box(4, 4)).alias("wkt"))


@query("tb_slabs_getmap", f"SELECT DISTINCT CASE WHEN id % 2 = 0 THEN printf('WIDTH=64&HEIGHT=64&BBOX=%.2f,%.2f,%.2f,%.2f', ya, xa, yb, xb) ELSE printf('WIDTH=64&HEIGHT=64&BBOX=%.2f,%.2f,%.2f,%.2f', xa, ya, xb, yb) END AS params FROM (SELECT id, {XY} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pyr, col, row) AS n FROM {SLABS_TM}) s WHERE n % 5 = 0) q")
def tb_slabs_getmap(spark, d):
    """Every fifth line, then distinct; axes are inverted for the systems that ask for it."""
    s = numbered(inventory(spark, d), ["id"], ["pyr", "col"], ["row"]).filter("n % 5 = 0")
    return s.select(tb.getmap_params(tb.slab_box(4, 4), c("id") % 2 == 0).alias("params")).distinct()


@query("tb_slabs_paths", f"SELECT lvl, col, row, {CUT} AS path FROM (SELECT *, {MIXED} AS m FROM (SELECT DISTINCT k AS lvl, col >> (k - lvl) AS col, row >> (k - lvl) AS row FROM (SELECT col, row, lvl, unnest(range(lvl, 8)) AS k FROM f_slab) a) b) e")
def tb_slabs_paths(spark, d):
    s = all_ancestors(view(spark, d, "f_slab").select("lvl", "col", "row"), 7)
    return s.select(c("lvl").cast("long").alias("lvl"), "col", "row", grid.b36_path(c("col"), c("row"), 3).alias("path"))


@query("tb_path_geom", f"SELECT pyr, lvl, {WKT} AS wkt FROM (SELECT pyr, lvl, {XY} FROM {SLABS_TM}) q")
def tb_path_geom(spark, d):
    p = F.element_at(F.split(F.regexp_replace("path", r"\.tif$", ""), "/IMAGE/[0-9]+/"), 2)
    s = listed(spark, d).select("pyr", "lvl", grid.b36_unpath(p).alias("x")).select("pyr", "lvl", "x.*")
    s = s.join(F.broadcast(view(spark, d, "f_tm")), c("lvl") - 1 == c("ord"))
    return s.select("pyr", "lvl", grid.box_wkt(tb.slab_box(4, 4)).alias("wkt"))


@query("tb_tile_slab", f"SELECT event_id, col, row, {CUT} AS path FROM (SELECT *, {MIXED} AS m FROM (SELECT event_id, user_id // 4 AS col, event_id // 4 AS row FROM events) a) b")
def tb_tile_slab(spark, d):
    e = table(spark, d, "events").select("event_id", grid.euclid(c("user_id"), 4).alias("col"), grid.euclid(c("event_id"), 4).alias("row"))
    return e.select("*", grid.b36_path(c("col"), c("row"), 3).alias("path"))
