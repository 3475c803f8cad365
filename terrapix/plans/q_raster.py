"""Queries over cells: samples, mosaics, pyramid aggregation, stencils, resampling, blending, styles and nodata."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.crs import HALF, RADIUS
from ..operators import raster, resample
from ..operators.shared import Scratch
from ..sources.tables import view
from .registry import query

c = F.col

# ---- samples -------------------------------------------------------------------------------------------------------

GRAY_SQL = "CAST(trunc(0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b) AS INT)"


@query("px_convert_channels", f"SELECT col, row, {GRAY_SQL} AS y1, {GRAY_SQL} AS y2, a AS a2, r AS r3, g AS g3, b AS b3, r AS r4, 255 AS a4 FROM f_rgb")
def px_convert_channels(spark, d):
    bands = [c(x) for x in "rgba"]
    one, two, three, four = (pixels.convert(bands, n) for n in (1, 2, 3, 4))
    plain = pixels.convert(bands[:3], 4)
    assert len(four) == 4
    return view(spark, d, "f_rgb").select("col", "row", one[0].alias("y1"), two[0].alias("y2"), two[1].alias("a2"), *[x.alias(f"{n}3") for x, n in zip(three, "rgb", strict=True)], plain[0].alias("r4"), plain[3].alias("a4"))


@query("px_convert_channels_od", "SELECT col, row, CAST(floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5) AS INT) AS y FROM f_rgb")
def px_convert_channels_od(spark, d):
    return view(spark, d, "f_rgb").select("col", "row", pixels.gray_rounded(c("r"), c("g"), c("b")).alias("y"))


@query("px_convertible", "SELECT col, row, (r % 3 = a % 3 AND g % 2 = b % 2) OR (r % 3 = 0 AND a % 3 = 0) AS ok FROM f_rgb")
def px_convertible(spark, d):
    """Formats are equal (sample format and channels), or both are 8-bit integers; format 0 stands for 8-bit."""
    same = (c("r") % 3 == c("a") % 3) & (c("g") % 2 == c("b") % 2)
    return view(spark, d, "f_rgb").select("col", "row", (same | ((c("r") % 3 == 0) & (c("a") % 3 == 0))).alias("ok"))


for _n, _top, _f in (("px_cast_u8", 255, pixels.to_u8), ("px_cast_u16", 65535, pixels.to_u16)):
    query(_n, f"SELECT line, x, least(greatest(CAST(trunc(s * {_top} + 0.5) AS INT), 0), {_top}) AS v FROM f_line")(lambda spark, d, f=_f, t=_top: view(spark, d, "f_line").select("line", "x", f(c("s") * t).alias("v")))


@query("px_onebit", "SELECT col, row, k, CAST(255 * ((r >> (7 - k)) & 1) AS INT) AS black, CAST(255 - 255 * ((r >> (7 - k)) & 1) AS INT) AS white FROM f_rgb, range(0, 8) t(k)")
def px_onebit(spark, d):
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    v = view(spark, d, "f_rgb").select("col", "row", "r", bits)
    bit = F.expr("shiftright(r, 7 - k) & 1")
    return v.select("col", "row", c("k").cast("long").alias("k"), (255 * bit).alias("black"), (255 - 255 * bit).alias("white"))


TARGET = "abs(r - 60) <= 40 AND abs(g - 60) <= 50 AND abs(b - 60) <= 60"


@query("px_equal_target", f"SELECT col, row, {TARGET} AS hit FROM f_rgb")
def px_equal_target(spark, d):
    return view(spark, d, "f_rgb").select("col", "row", F.expr(TARGET).alias("hit"))


def size_of(cells) -> tuple[int, int]:
    """Width and height of a raster that starts at (0, 0): its header, one row."""
    w, h = cells.agg(F.max("col") + 1, F.max("row") + 1).first()
    return w or 0, h or 0


SIZE_SQL = "SELECT max(col) + 1 AS w, max(row) + 1 AS h FROM f_dem"

# ---- mosaics -------------------------------------------------------------------------------------------------------

SRC_ORD = "CASE src WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"
STACK = f"SELECT col % 25 AS col, row % 40 AS row, r, g, b, a, CASE WHEN a < 60 THEN 0 ELSE a END AS mask, CAST((col // 25) * 1000 + row AS BIGINT) AS ord FROM f_rgb"


def stack(spark, d):
    """Several cells over each place, in a total order."""
    return view(spark, d, "f_rgb").select((c("col") % 25).alias("col"), (c("row") % 40).alias("row"), *"rgba", F.when(c("a") < 60, 0).otherwise(c("a")).alias("mask"), (F.floor(c("col") / 25) * 1000 + c("row")).cast("long").alias("ord"))


@query("mosaic_compound", f"SELECT col + w * g.x AS col, row + h * g.y AS row, z FROM f_dem, ({SIZE_SQL}) n, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) g(x, y)")
def mosaic_compound(spark, d):
    """Four images of one size side by side; each cell goes to its place in one pass."""
    dem = view(spark, d, "f_dem")
    w, h = size_of(dem)
    places = F.array(*[F.struct((c("col") + w * x).alias("col"), (c("row") + h * y).alias("row")) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))])
    return dem.select(F.explode(places).alias("p"), "z").select("p.*", "z")


@query("mosaic_extended", f"SELECT k.x AS col, k.y AS row, coalesce(r, 9) AS r, coalesce(g, 9) AS g, coalesce(b, 9) AS b FROM (SELECT x, y FROM range(0, 30) t(x), range(0, 45) u(y)) k LEFT JOIN (SELECT col, row, arg_max(r, ord) AS r, arg_max(g, ord) AS g, arg_max(b, ord) AS b FROM ({STACK}) s WHERE mask <> 0 GROUP BY col, row) m ON k.x = m.col AND k.y = m.row")
def mosaic_extended(spark, d):
    canvas = spark.range(30 * 45).select((c("id") % 30).alias("col"), F.floor(c("id") / 30).alias("row"))
    top = raster.top_wins(stack(spark, d).filter("mask <> 0"), ["col", "row"], "ord", ["r", "g", "b"])
    return canvas.join(top, ["col", "row"], "left").select("col", "row", *[F.coalesce(x, F.lit(9)).alias(x) for x in "rgb"])


@query("mosaic_mask", f"SELECT col, row, max(mask) AS mask FROM ({STACK}) s GROUP BY col, row")
def mosaic_mask(spark, d):
    return stack(spark, d).groupBy("col", "row").agg(F.max("mask").alias("mask"))


@query("mosaic_extend_bbox", "SELECT img_id, xmin - ceil(greatest(xmin - 700, 0) / res) * res AS xmin, xmax + ceil(greatest(3300 - xmax, 0) / res) * res AS xmax, CAST(round((xmax - xmin) / res) + ceil(greatest(xmin - 700, 0) / res) + ceil(greatest(3300 - xmax, 0) / res) AS BIGINT) AS width FROM f_img")
def mosaic_extend_bbox(spark, d):
    left, right = F.ceil(F.greatest(c("xmin") - 700, F.lit(0.0)) / c("res")), F.ceil(F.greatest(3300 - c("xmax"), F.lit(0.0)) / c("res"))
    return view(spark, d, "f_img").select("img_id", (c("xmin") - left * c("res")).alias("xmin"), (c("xmax") + right * c("res")).alias("xmax"), (F.round((c("xmax") - c("xmin")) / c("res")) + left + right).cast("long").alias("width"))


MIRROR = 5
SIDES = {"top": ("row < {n}", "col", "-1 - row"), "right": ("col >= w - {n}", "2 * w - 1 - col", "row"), "bottom": ("row >= h - {n}", "col", "2 * h - 1 - row"), "left": ("col < {n}", "-1 - col", "row")}
_MIRRORS = " UNION ALL ".join(f"SELECT '{k}' AS side, {x} AS col, {y} AS row, z FROM f_dem, ({SIZE_SQL}) n WHERE {w.format(n=MIRROR)}" for k, (w, x, y) in SIDES.items())


def mirrors(cells, size):
    """(side, col, row, z) of the mirror images along the four sides, size cells wide, in the image's own indices; corners have none."""
    w, h = size_of(cells)
    held = cells.withColumns({"w": F.lit(w), "h": F.lit(h)})
    places = F.array_compact(F.array(*[F.when(F.expr(on.format(n=size)), F.struct(F.lit(k).alias("side"), F.expr(x).alias("col"), F.expr(y).alias("row"))) for k, (on, x, y) in SIDES.items()]))
    return held.select(F.explode(places).alias("p"), "z").select("p.*", "z")


@query("mirror_image", _MIRRORS)
def mirror_image(spark, d):
    return mirrors(view(spark, d, "f_dem"), MIRROR)


@query("mosaic_mirrors", f"SELECT col, row, z FROM f_dem UNION ALL SELECT col, row, z FROM ({_MIRRORS}) m")
def mosaic_mirrors(spark, d):
    """An image with its mirrors around it."""
    dem = view(spark, d, "f_dem")
    return dem.select("col", "row", "z").unionByName(mirrors(dem, MIRROR).drop("side"))


@query("mosaic_based_slab", "SELECT img_id, CASE WHEN xmin = 1000 AND ymin = 1000 AND xmax = 1400 AND ymax = 1400 THEN 'equal' WHEN xmin <= 1000 AND ymin <= 1000 AND xmax >= 1400 AND ymax >= 1400 THEN 'data_covers' WHEN xmin >= 1000 AND ymin >= 1000 AND xmax <= 1400 AND ymax <= 1400 THEN 'asked_covers' WHEN xmin > 1400 OR xmax < 1000 OR ymin > 1400 OR ymax < 1000 THEN 'apart' ELSE 'cross' END AS relation FROM f_img")
def mosaic_based_slab(spark, d):
    from ..functions import grid

    data, asked = grid.box(c("xmin"), c("ymin"), c("xmax"), c("ymax")), grid.box(1000, 1000, 1400, 1400)
    relation = F.when(data == asked, "equal").when(grid.contains_inside(data, asked), "data_covers").when(grid.contains_inside(asked, data), "asked_covers").when(~grid.intersects(data, asked), "apart").otherwise("cross")
    return view(spark, d, "f_img").select("img_id", relation.alias("relation"))


@query("mosaic_group_compatible", "SELECT grp, img_id, CAST(sum(brk) OVER (PARTITION BY grp ORDER BY img_id) AS BIGINT) AS pack FROM (SELECT img_id // 50 AS grp, img_id, CASE WHEN lag(channels) OVER w = channels AND lag(res) OVER w = res THEN 0 ELSE 1 END AS brk FROM f_img WINDOW w AS (PARTITION BY img_id // 50 ORDER BY img_id)) q")
def mosaic_group_compatible(spark, d):
    """Gaps and islands: images of a list in order, a new pack where channels or resolution change."""
    order = Window.partitionBy("grp").orderBy("img_id")
    same = (F.lag("channels").over(order) == c("channels")) & (F.lag("res").over(order) == c("res"))
    q = view(spark, d, "f_img").select(F.floor(c("img_id") / 50).alias("grp"), "*").withColumn("brk", F.when(same, 0).otherwise(1))
    return q.select("grp", "img_id", F.sum("brk").over(order).alias("pack"))


@query("set_distinct_slabs", "SELECT DISTINCT lvl, col, row FROM f_slab")
def set_distinct_slabs(spark, d):
    return view(spark, d, "f_slab").select("lvl", "col", "row").dropDuplicates()


UNION_SQL = """WITH s AS (SELECT channels, unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS x, ymin, ymax FROM f_img),
m AS (SELECT *, CASE WHEN ymin <= max(ymax) OVER (PARTITION BY channels, x ORDER BY ymin, ymax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY channels, x ORDER BY ymin, ymax ROWS UNBOUNDED PRECEDING) AS part FROM m),
u AS (SELECT channels, x, part, min(ymin) AS y0, max(ymax) AS y1 FROM g GROUP BY 1, 2, 3)
SELECT channels, sum(y1 - y0) AS area, count(*) AS strips, min(x) AS xmin, min(y0) AS ymin, max(x) + 1 AS xmax, max(y1) AS ymax FROM u GROUP BY channels"""


@query("set_union_geom", UNION_SQL)
def set_union_geom(spark, d):
    """The union of footprints by number of channels, as strips one unit wide: in each, intervals that meet are one; told by area, strips and extent. Footprints that repeat are one, so no two intervals of a strip tie in order."""
    boxes = view(spark, d, "f_img").filter("xmax > xmin").select("channels", "xmin", "xmax", "ymin", "ymax").distinct()
    strips = boxes.select("channels", F.explode(F.sequence(c("xmin").cast("long"), c("xmax").cast("long") - 1)).alias("x"), "ymin", "ymax").distinct()
    order = Window.partitionBy("channels", "x").orderBy("ymin", "ymax")
    before = F.max("ymax").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = strips.withColumn("new", F.when(c("ymin") <= before, 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    union = parts.groupBy("channels", "x", "part").agg(F.min("ymin").alias("y0"), F.max("ymax").alias("y1"))
    return union.groupBy("channels").agg(F.sum(c("y1") - c("y0")).alias("area"), F.count("*").alias("strips"), F.min("x").alias("xmin"), F.min("y0").alias("ymin"), (F.max("x") + 1).alias("xmax"), F.max("y1").alias("ymax"))


@query("set_bbox_union", "SELECT res, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM f_img GROUP BY res")
def set_bbox_union(spark, d):
    return view(spark, d, "f_img").groupBy("res").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("set_intersect_limits", "SELECT pyr, lvl, greatest(min(col), 3) AS min_col, least(max(col), 50) AS max_col, greatest(min(row), 5) AS min_row, least(max(row), 40) AS max_row FROM f_slab GROUP BY pyr, lvl")
def set_intersect_limits(spark, d):
    g = view(spark, d, "f_slab").groupBy("pyr", "lvl")
    return g.agg(F.greatest(F.min("col"), F.lit(3)).alias("min_col"), F.least(F.max("col"), F.lit(50)).alias("max_col"), F.greatest(F.min("row"), F.lit(5)).alias("min_row"), F.least(F.max("row"), F.lit(40)).alias("max_row"))


# ---- pyramid aggregation -------------------------------------------------------------------------------------------


@query("agg_merge4", "SELECT col // 2 AS col, row // 2 AS row, CASE WHEN count(*) FILTER (WHERE mask <> 0) > 1 THEN round(avg(z) FILTER (WHERE mask <> 0), 6) ELSE -99999.0 END AS z, CASE WHEN count(*) FILTER (WHERE mask <> 0) > 1 THEN 255 ELSE 0 END AS mask FROM f_dem GROUP BY 1, 2")
def agg_merge4(spark, d):
    return raster.merge4(view(spark, d, "f_dem"), ["z"], -99999.0).withColumn("z", F.round("z", 6))


@query("agg_merge4_gamma", "SELECT col, row, CASE WHEN n > 1 THEN CAST(255 - floor(pow((1020 - CAST(trunc(s * 4.0 / n) AS INT)) / 1020.0, 1.4) * 255 + 0.5) AS INT) ELSE 0 END AS r, CASE WHEN n > 1 THEN 255 ELSE 0 END AS mask FROM (SELECT col // 2 AS col, row // 2 AS row, sum(CASE WHEN a >= 60 THEN r END)::BIGINT AS s, count(*) FILTER (WHERE a >= 60) AS n FROM f_rgb GROUP BY 1, 2) q")
def agg_merge4_gamma(spark, d):
    cells = view(spark, d, "f_rgb").select("col", "row", "r", F.when(c("a") < 60, 0).otherwise(255).alias("mask"))
    return raster.merge4(cells, ["r"], 0, integer=True, gamma=1.4)


@query("agg_merge4_bg", "SELECT m.col, m.row, coalesce(CASE WHEN n > 1 THEN round(m.z, 6) END, round(bg.z, 6), -99999.0) AS z FROM (SELECT col // 2 AS col, row // 2 AS row, avg(z) FILTER (WHERE mask <> 0) AS z, count(*) FILTER (WHERE mask <> 0) AS n FROM f_dem GROUP BY 1, 2) m LEFT JOIN (SELECT col, row, z FROM f_dem WHERE mask <> 0) bg ON bg.col = m.col AND bg.row = m.row")
def agg_merge4_bg(spark, d):
    dem = view(spark, d, "f_dem")
    m = raster.merge4(dem, ["z"], -99999.0)
    bg = dem.filter("mask <> 0").select("col", "row", c("z").alias("bg"))
    return m.join(bg, ["col", "row"], "left").select("col", "row", F.coalesce(F.when(c("mask") != 0, F.round("z", 6)), F.round("bg", 6), F.lit(-99999.0)).alias("z"))


DECIMATED = "SELECT (col - 1) // 3 AS col, (row - 1) // 3 AS row, CASE WHEN mask <> 0 THEN z ELSE -99999.0 END AS z, mask FROM f_dem WHERE col % 3 = 1 AND row % 3 = 1"


@query("agg_decimate", DECIMATED)
def agg_decimate(spark, d):
    return raster.decimate(view(spark, d, "f_dem"), 3, 1, ["z"], -99999.0)


@query("agg_decimate_pack", f"SELECT d.col, d.row, CASE WHEN d.mask <> 0 THEN d.z ELSE b.z END AS z FROM ({DECIMATED}) d JOIN f_dem b ON b.col = d.col AND b.row = d.row")
def agg_decimate_pack(spark, d):
    bg = view(spark, d, "f_dem").select("col", "row", c("z").alias("bg"))
    top = raster.decimate(view(spark, d, "f_dem"), 3, 1, ["z"], -99999.0)
    return top.join(bg, ["col", "row"]).select("col", "row", F.when(c("mask") != 0, c("z")).otherwise(c("bg")).alias("z"))


# ---- stencils ------------------------------------------------------------------------------------------------------

NB = "SELECT col, row, " + ", ".join(f"lag(v{k}) OVER w AS {n1}, v{k} AS {n2}, lead(v{k}) OVER w AS {n3}" for k, (n1, n2, n3) in enumerate((("a", "d", "g"), ("b", "e", "h"), ("c", "f", "i")))) + " FROM (SELECT col, row, lag(v) OVER l AS v0, v AS v1, lead(v) OVER l AS v2 FROM (SELECT col, row, CASE WHEN mask <> 0 THEN z END AS v FROM f_dem) q WINDOW l AS (PARTITION BY row ORDER BY col)) q2 WINDOW w AS (PARTITION BY col ORDER BY row)"
FULL = " AND ".join(f"{x} IS NOT NULL" for x in "abcdefghi")
DX, DY = "((c + 2 * f + i) - (a + 2 * d + g)) / (8 * 25.0)", "((g + 2 * h + i) - (a + 2 * b + c)) / (8 * 25.0)"


@query("win_slope", f"SELECT col, row, round(least(atan(sqrt(dx * dx + dy * dy)) * (180 / pi()), 90), 6) AS slope FROM (SELECT col, row, {DX} AS dx, {DY} AS dy FROM ({NB}) n WHERE {FULL}) q")
def win_slope(spark, d):
    return raster.slope(raster.stencil(view(spark, d, "f_dem")), 25.0).withColumn("slope", F.round("slope", 6))


@query("win_slope_z", f"SELECT col, row, round(least(sqrt(dx * dx + dy * dy) * 100, 255), 6) AS slope FROM (SELECT col, row, (f - d) / 50.0 AS dx, (h - b) / 50.0 AS dy FROM ({NB}) n WHERE {FULL}) q")
def win_slope_z(spark, d):
    return raster.slope(raster.stencil(view(spark, d, "f_dem")), 25.0, "Z", "pourcent", 255.0).withColumn("slope", F.round("slope", 6))


@query("win_aspect", f"SELECT col, row, CASE WHEN sqrt(v1 * v1 + v2 * v2) < 8 THEN -1.0 ELSE round((atan2(v1, v2) + pi()) * (180 / pi()), 6) END AS aspect FROM (SELECT col, row, {DX} AS v1, ((a + 2 * b + c) - (g + 2 * h + i)) / (8 * 25.0) AS v2 FROM ({NB}) n WHERE {FULL}) q")
def win_aspect(spark, d):
    return raster.aspect(raster.stencil(view(spark, d, "f_dem")), 25.0, 8.0).withColumn("aspect", F.round("aspect", 6))


#: The reference mixes units here: 90 minus the angle in radians. Kept, as its results depend on it.
ZENITH = 90.0 - 45.0 * math.pi / 180
AZIMUTH = (360.0 - 315.0) * math.pi / 180


@query("win_hillshade", f"SELECT col, row, round(greatest(255 * (cos({ZENITH!r}) * cos(s) + sin({ZENITH!r}) * sin(s) * cos({AZIMUTH!r} - asp)), 0), 4) AS light FROM (SELECT col, row, atan(2.0 * sqrt(dx * dx + dy * dy)) AS s, CASE WHEN dx <> 0 THEN (CASE WHEN atan2(dy, -dx) < 0 THEN atan2(dy, -dx) + 2 * pi() ELSE atan2(dy, -dx) END) WHEN dy > 0 THEN pi() / 2 WHEN dy < 0 THEN 3 * pi() / 2 ELSE 0 END AS asp FROM (SELECT col, row, {DX} AS dx, {DY} AS dy FROM ({NB}) n WHERE {FULL}) q) q2")
def win_hillshade(spark, d):
    return raster.hillshade(raster.stencil(view(spark, d, "f_dem")), 25.0, ZENITH, AZIMUTH, 2.0).withColumn("light", F.round("light", 4))


# ---- kernels -------------------------------------------------------------------------------------------------------

CENTRES = "SELECT e AS id, ratio, e * 0.37 - 0.5 AS x FROM range(0, 271) t(e), (VALUES (1.0), (2.5)) r(ratio)"
KERNEL_SQL = {
    "nn": "1.0",
    "linear": "greatest(1 - d, 0.0)",
    "bicubic": "CASE WHEN d <= 1 THEN 1 + d * d * (-2.5 + 1.5 * d) WHEN d <= 2 THEN 2 + d * (-4 + d * (2.5 - 0.5 * d)) ELSE 0 END",
    "lanczos_2": "CASE WHEN d < 1e-9 THEN 1.0 WHEN d >= 2 THEN 0.0 ELSE sin(d * pi()) * sin(d * pi() / 2) / ((d * pi()) * (d * pi()) / 2) END",
    "lanczos_3": "CASE WHEN d < 1e-9 THEN 1.0 WHEN d >= 3 THEN 0.0 ELSE sin(d * pi()) * sin(d * pi() / 3) / ((d * pi()) * (d * pi()) / 3) END",
}


def _weights_sql(name, centres=CENTRES, count=100, keep="id, ratio"):
    base = pixels.RADIUS[name]
    size = f"{base}" if name == "nn" else f"{base} * greatest(ratio, 1.0)"
    return f"""SELECT {keep}, x, i, w / sum(w) OVER (PARTITION BY {keep}) AS w FROM (SELECT {keep}, x, CAST(i AS INT) AS i, CASE WHEN n <= 1 THEN 1.0 ELSE {_in_d(KERNEL_SQL[name], base)} END AS w FROM (
SELECT *, unnest(CASE WHEN n <= 1 THEN [least(greatest(lo, 0), {count} - 1)] ELSE range(lo, lo + n) END) AS i FROM (
SELECT {keep}, x, CASE WHEN rt THEN r2 ELSE r1 END AS r, CAST(CASE WHEN rt THEN ceil(x - r2 - 1e-7) ELSE lo1 END AS BIGINT) AS lo, CAST(CASE WHEN rt THEN ceil(2 * r2 - 1e-7) ELSE n1 END AS BIGINT) AS n FROM (
SELECT *, lo1 + n1 > {count} AS rt, abs({count} - 1 - x) AS r2 FROM (
SELECT {keep}, x, CASE WHEN ceil(x - h - 1e-7) < 0 THEN abs(x) ELSE h END AS r1, greatest(ceil(x - h - 1e-7), 0) AS lo1, CASE WHEN ceil(x - h - 1e-7) < 0 THEN ceil(2 * abs(x) - 1e-7) ELSE 2 * h END AS n1 FROM (
SELECT *, ceil(2 * {size} - 1e-7) / 2 AS h FROM ({centres}) c0) c1) c2) c3) c4) c5 WHERE n <= 1 OR i < x + r) c7"""


def _in_d(text, base):
    import re

    return re.sub(r"\bd\b", f"(abs(x - i) * ({base} / r))", text)


def _weights(spark, name):
    at = spark.range(271).join(F.broadcast(spark.createDataFrame([(1.0,), (2.5,)], "ratio double")), F.lit(True)).withColumn("x", c("id") * 0.37 - 0.5)
    parts = [at.filter(c("ratio") == r).select("id", "ratio", F.explode(pixels.taps(name, c("x"), r, 100)).alias("t")) for r in (1.0, 2.5)]
    return parts[0].unionByName(parts[1]).select("id", "ratio", "t.i", (F.round("t.w", 10) + 0.0).alias("w"))


for _n, _k in (("win_kernel_weight", "bicubic"), ("win_kernel_nn", "nn"), ("win_kernel_linear", "linear"), ("win_kernel_cubic", "bicubic"), ("win_kernel_lanczos", "lanczos_3")):
    query(_n, f"SELECT id, ratio::DOUBLE AS ratio, i, round(w, 10) + 0.0 AS w FROM ({_weights_sql(_k)}) k")(lambda spark, d, k=_k: _weights(spark, k))

LINES = "SELECT e AS id, 2.0 AS ratio, 0.5 + e * 2.0 AS x FROM range(0, 32) t(e)"


@query("win_resample", f"SELECT line, CAST(k.id AS BIGINT) AS x, round(sum(k.w * s), 6) AS s FROM ({_weights_sql('lanczos_3', LINES, 64)}) k JOIN f_line l ON l.x = k.i GROUP BY line, k.id")
def win_resample(spark, d):
    out = resample.resample_axis(view(spark, d, "f_line"), "x", ["line"], "s", "lanczos_3", 2.0, 0.5, 32, 64)
    return out.select("line", "x", F.round("s", 6).alias("s"))


@query("win_resample_masked", f"SELECT line, CAST(k.id AS BIGINT) AS x, CASE WHEN abs(coalesce(sum(k.w) FILTER (WHERE m <> 0), 0)) > 1e-9 THEN round(sum(k.w * s) FILTER (WHERE m <> 0) / sum(k.w) FILTER (WHERE m <> 0), 6) ELSE 0.0 END AS s, CASE WHEN abs(coalesce(sum(k.w) FILTER (WHERE m <> 0), 0)) > 1e-9 THEN 255 ELSE 0 END AS mask FROM ({_weights_sql('linear', LINES, 64)}) k JOIN (SELECT *, CASE WHEN (line + x) % 5 < 3 THEN 0 ELSE 255 END AS m FROM f_line) l ON l.x = k.i GROUP BY line, k.id")
def win_resample_masked(spark, d):
    lines = view(spark, d, "f_line").withColumn("mask", F.when((c("line") + c("x")) % 5 < 3, 0).otherwise(255))
    out = resample.resample_axis(lines, "x", ["line"], "s", "linear", 2.0, 0.5, 32, 64, "mask")
    return out.select("line", "x", F.round("s", 6).alias("s"), "mask")


def _to_source(w, h):
    """A map of w x h pixels in EPSG:4326 (60 W to 60 E, 45 N to 45 S) over a raster of as many pixels in EPSG:3857."""

    def at(x, y):
        lon, lat = x * (120.0 / w) - 60, 45 - y * (90.0 / h)
        mx = lon * (HALF / 180)
        my = F.log(F.tan(F.lit(math.pi / 4) + lat * (math.pi / 360))) * RADIUS
        return (mx + 8000000.0) / (16000000.0 / w), (6000000.0 - my) / (12000000.0 / h)

    return at


GRID_SQL = f"""WITH d AS (SELECT w, h, 120.0::DOUBLE / w AS kx, 90.0::DOUBLE / h AS ky, 16000000.0::DOUBLE / w AS rx, 12000000.0::DOUBLE / h AS ry FROM ({SIZE_SQL}) n),
p AS (SELECT DISTINCT least(i * 16, w - 1) AS gx FROM (SELECT w, unnest(range(0, (w + 14) // 16 + 1)) AS i FROM d) a), q AS (SELECT DISTINCT least(i * 16, h - 1) AS gy FROM (SELECT h, unnest(range(0, (h + 14) // 16 + 1)) AS i FROM d) a),
g AS (SELECT gx, gy, ((gx * kx - 60) * ({HALF!r} / 180) + 8000000.0) / rx AS sx, (6000000.0 - ln(tan(pi() / 4 + (45 - gy * ky) * (pi() / 360))) * {RADIUS}) / ry AS sy FROM p, q, d),
px AS (SELECT col, row, w, h, least(col // 16 * 16, greatest(w - 2, 0) // 16 * 16) AS x0, least(row // 16 * 16, greatest(h - 2, 0) // 16 * 16) AS y0 FROM (SELECT w, h, unnest(range(0, w)) AS col FROM d) a, LATERAL (SELECT unnest(range(0, h)) AS row) b),
pp AS (SELECT *, least(x0 + 16, w - 1) AS x1, least(y0 + 16, h - 1) AS y1 FROM px),
uv AS (SELECT *, (col - x0) / greatest(x1 - x0, 1)::DOUBLE AS u, (row - y0) / greatest(y1 - y0, 1)::DOUBLE AS v FROM pp),
m AS (SELECT uv.col, uv.row, (a.sx * (1 - u) + b.sx * u) * (1 - v) + (e.sx * (1 - u) + f.sx * u) * v AS sx, (a.sy * (1 - u) + b.sy * u) * (1 - v) + (e.sy * (1 - u) + f.sy * u) * v AS sy
FROM uv JOIN g a ON a.gx = x0 AND a.gy = y0 JOIN g b ON b.gx = x1 AND b.gy = y0 JOIN g e ON e.gx = x0 AND e.gy = y1 JOIN g f ON f.gx = x1 AND f.gy = y1)"""


def _source_places(spark, dem):
    """Where each pixel of the map lies in the raster, and the raster's size."""
    w, h = size_of(dem)
    return resample.interpolated(spark, w, h, _to_source(w, h)), w, h


@query("win_reproject_grid", f"{GRID_SQL} SELECT col, row, round(sx, 6) AS sx, round(sy, 6) AS sy FROM m")
def win_reproject_grid(spark, d):
    return _source_places(spark, view(spark, d, "f_dem"))[0].select("col", "row", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("win_reproject", f"{GRID_SQL} SELECT m.col, m.row, z FROM m LEFT JOIN f_dem s ON s.col = floor(m.sx + 0.5) AND s.row = floor(m.sy + 0.5)")
def win_reproject(spark, d):
    dem = view(spark, d, "f_dem")
    return resample.reproject_nearest(_source_places(spark, dem)[0], dem, ["z"])


def _kernel_sql(name):
    """The cells of the map by a kernel in two dimensions."""
    axis = lambda v, n: _weights_sql(name, f"SELECT col, row, 1.0 AS ratio, {v} AS x FROM m", f"(SELECT {n} FROM d)", "col, row")
    return f"SELECT a.col, a.row, round(sum(a.w * b.w * z), 4) AS z FROM ({axis('sx', 'w')}) a JOIN ({axis('sy', 'h')}) b ON a.col = b.col AND a.row = b.row JOIN f_dem s ON s.col = a.i AND s.row = b.i GROUP BY a.col, a.row"


@query("win_level_reproject", f"{GRID_SQL} {_kernel_sql('lanczos_2')}")
def win_level_reproject(spark, d):
    dem = view(spark, d, "f_dem")
    grid, w, h = _source_places(spark, dem)
    return resample.reproject_kernel(grid, dem, "z", "lanczos_2", w, h).select("col", "row", F.round("z", 4).alias("z"))


@query("win_tool_resample", f"SELECT line, CAST(k.id AS BIGINT) AS x, round(sum(k.w * s), 6) AS s FROM ({_weights_sql('bicubic', 'SELECT e AS id, 2.0 AS ratio, 5.5 + e * 2.0 AS x FROM range(0, 32) t(e)', 74)}) k JOIN (SELECT line, x + 5 AS x, s FROM f_line UNION ALL SELECT line, 4 - x, s FROM f_line WHERE x < 5 UNION ALL SELECT line, 132 - x, s FROM f_line WHERE x >= 59) l ON l.x = k.i GROUP BY line, k.id")
def win_tool_resample(spark, d):
    """With mirrored borders of five samples, so that the kernel never shrinks at an edge."""
    x = c("x")
    places = F.array_compact(F.array(x + 5, F.when(x < 5, 4 - x), F.when(x >= 59, 132 - x)))
    lines = view(spark, d, "f_line").select("line", F.explode(places).alias("x"), "s")
    out = resample.resample_axis(lines, "x", ["line"], "s", "bicubic", 2.0, 5.5, 32, 74)
    return out.select("line", "x", F.round("s", 6).alias("s"))


@query("win_tool_reproject", f"{GRID_SQL} SELECT k.col, k.row, k.z, s.mask FROM ({_kernel_sql('linear')}) k JOIN m ON m.col = k.col AND m.row = k.row LEFT JOIN f_dem s ON s.col = floor(m.sx + 0.5) AND s.row = floor(m.sy + 0.5)")
def win_tool_reproject(spark, d):
    """Values by the linear kernel, masks by the nearest cell."""
    dem = view(spark, d, "f_dem")
    grid, w, h = _source_places(spark, dem)
    values = resample.reproject_kernel(grid, dem, "z", "linear", w, h).select("col", "row", F.round("z", 4).alias("z"))
    return values.join(resample.reproject_nearest(grid, dem, ["mask"]), ["col", "row"])


# ---- blending ------------------------------------------------------------------------------------------------------


@query("merge_top", f"SELECT col, row, arg_max(r, ord) FILTER (WHERE mask <> 0) AS r, arg_max(a, ord) FILTER (WHERE mask <> 0) AS a, max(mask) AS mask FROM ({STACK}) s GROUP BY col, row")
def merge_top(spark, d):
    return raster.top_wins(stack(spark, d), ["col", "row"], "ord", ["r", "a"])


def layers(spark, d):
    return stack(spark, d).select("col", "row", "ord", "mask", *[(c(x) / 255.0).alias(x) for x in "rgb"], F.when(c("mask") == 0, 0.0).otherwise(c("a") / 255.0).alias("a"))


def _bg(r=1.0, a=1.0):
    return F.struct(*[F.lit(r).alias(x) for x in "rgb"], F.lit(a).alias("a"))


def _flat(df, digits=6):
    return df.select("col", "row", *[F.round(f"px.{x}", digits).alias(x) for x in "rgba"])


LAYERS = f"SELECT col, row, ord, mask, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, CASE WHEN mask = 0 THEN 0.0 ELSE a / 255.0::DOUBLE END AS a FROM ({STACK}) s"


def _fold_sql(step, seed):
    """An ordered fold in SQL, one step a recursion."""
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY ord) AS n FROM ({LAYERS}) q),
f(col, row, n, r, g, b, a) AS (SELECT DISTINCT col, row, 0::BIGINT, {seed} FROM s UNION ALL SELECT f.col, f.row, f.n + 1, {step} FROM f JOIN s ON s.col = f.col AND s.row = f.row AND s.n = f.n + 1)
SELECT col, row, round(arg_max(r, n), 6) AS r, round(arg_max(g, n), 6) AS g, round(arg_max(b, n), 6) AS b, round(arg_max(a, n), 6) AS a FROM f GROUP BY col, row"""


_mul = ", ".join(f"CASE WHEN s.mask = 0 THEN f.{x} ELSE f.{x} * s.{x} END" for x in "rgba")
_alpha = "(s.a + f.a * (1 - s.a))"
_over = ", ".join(f"CASE WHEN s.a = 0 THEN f.{x} ELSE (s.a * s.{x} + f.a * f.{x} * (1 - s.a)) / {_alpha} END" for x in "rgb") + f", CASE WHEN s.a = 0 THEN f.a ELSE {_alpha} END"
ONE, NONE = "1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE", "0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"


@query("merge_multiply", _fold_sql(_mul, ONE))
def merge_multiply(spark, d):
    step = lambda acc, t: F.when(t["mask"] == 0, acc).otherwise(raster.multiply(acc, t))
    return _flat(raster.fold_layers(layers(spark, d), ["col", "row"], "ord", _bg(), step, [*"rgba", "mask"]))


@query("merge_alphatop", _fold_sql(_over, NONE))
def merge_alphatop(spark, d):
    return _flat(raster.fold_layers(layers(spark, d), ["col", "row"], "ord", _bg(0.0, 0.0), raster.over, [*"rgba"]))


@query("merge_layers", _fold_sql(_over, ONE))
def merge_layers(spark, d):
    return _flat(raster.fold_layers(layers(spark, d), ["col", "row"], "ord", _bg(), raster.over, [*"rgba"]))


@query("merge_overlay_tool", f"SELECT col, row, arg_max(r, ord) FILTER (WHERE a >= 120) AS r, max(CASE WHEN a >= 120 THEN 255 ELSE 0 END) AS mask FROM ({STACK}) s GROUP BY col, row")
def merge_overlay_tool(spark, d):
    """TOP over transparent cells taken as masked."""
    return raster.top_wins(stack(spark, d).withColumn("mask", F.when(c("a") >= 120, 255).otherwise(0)), ["col", "row"], "ord", ["r"])


@query("merge_store", "SELECT col, row, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, CASE WHEN r > 200 AND g > 100 THEN 0.0 ELSE a / 255.0::DOUBLE END AS a FROM f_rgb")
def merge_store(spark, d):
    return view(spark, d, "f_rgb").select("col", "row", *[(c(x) / 255.0).alias(x) for x in "rgb"], F.when((c("r") > 200) & (c("g") > 100), 0.0).otherwise(c("a") / 255.0).alias("a"))


@query("merge_write", "SELECT col, row, CAST(trunc(r * (a / 255.0::DOUBLE)) AS INT) AS r3, CAST(trunc(g * (a / 255.0::DOUBLE)) AS INT) AS g3, r AS r4, a AS a4, CAST(trunc((0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b) * (a / 255.0::DOUBLE)) AS INT) AS y1 FROM f_rgb")
def merge_write(spark, d):
    """One and three bands are multiplied by alpha, two and four keep it beside them."""
    al = c("a") / 255.0
    y = pixels.GRAY[0] * c("r") + pixels.GRAY[1] * c("g") + pixels.GRAY[2] * c("b")
    return view(spark, d, "f_rgb").select("col", "row", (c("r") * al).cast("int").alias("r3"), (c("g") * al).cast("int").alias("g3"), c("r").alias("r4"), c("a").alias("a4"), (y * al).cast("int").alias("y1"))


@query("merge_mask", f"SELECT col, row, max(CASE WHEN mask <> 0 THEN 255 ELSE 0 END) AS mask FROM ({STACK}) s GROUP BY col, row")
def merge_mask(spark, d):
    return stack(spark, d).groupBy("col", "row").agg(F.max(F.when(c("mask") != 0, 255).otherwise(0)).alias("mask"))


# ---- styles --------------------------------------------------------------------------------------------------------

STOPS = [(100.0, (0, 0, 60, 255)), (650.0, (0, 120, 0, 255)), (1750.0, (200, 180, 60, 128)), (3400.0, (255, 255, 255, 0))]


def _palette_sql(v, smooth):
    out = []
    for k, n in enumerate("rgba"):
        cases = f"WHEN {v} < {STOPS[0][0]} THEN {STOPS[0][1][k]}.0 "
        for (lo, a), (hi, b) in zip(STOPS, STOPS[1:], strict=False):
            cases += f"WHEN {v} < {hi} THEN {a[k]}.0 " + (f"+ ({v} - {lo}) / ({hi} - {lo}) * ({b[k]} - {a[k]}) " if smooth else "")
        out.append(f"round(CAST(CASE {cases} ELSE {STOPS[-1][1][k]}.0 END AS DOUBLE), 6) AS {n}")
    return ", ".join(out)


def styled(df, v, smooth):
    return df.select("col", "row", *[F.round(x, 6).alias(n) for x, n in zip(pixels.palette(v, STOPS, smooth), "rgba", strict=True)])


for _n, _smooth in (("style_palette", True), ("style_apply", False)):
    query(_n, f"SELECT col, row, {_palette_sql('z', _smooth)} FROM f_dem")(lambda spark, d, s=_smooth: styled(view(spark, d, "f_dem"), c("z"), s))


@query("join_palette", f"SELECT col, row, {_palette_sql('z', False)} FROM f_dem")
def join_palette(spark, d):
    """Each value with the stop at or below it: the stops are few and fixed, so the interval is found by comparison, without a join."""
    found = pixels.palette(c("z"), STOPS, False)
    return view(spark, d, "f_dem").select("col", "row", *[F.round(x, 6).alias(n) for x, n in zip(found, "rgba", strict=True)])


# A style a level: its stops are as many apart as the level's resolution says; levels of odd order give no alpha.
PNG_PALETTES = f"""SELECT id AS style, k, CAST(trunc(r + 0.5) AS INT) AS r, CAST(trunc(g + 0.5) AS INT) AS g, CAST(trunc(b + 0.5) AS INT) AS b, CAST(CASE WHEN ord % 2 = 1 THEN 255 - k ELSE trunc(a + 0.5) END AS INT) AS a
FROM (SELECT id, ord, k, {_palette_sql('z', True)} FROM (SELECT id, ord, k, k * 12.0 / res AS z, 0 AS col, 0 AS row FROM f_tm, range(0, 256) t(k)) q0) q"""


@query("style_palette_png", PNG_PALETTES)
def style_palette_png(spark, d):
    """The 256 colours of each style's PNG palette; where a style gives no alpha, entry k is as opaque as 255 - k."""
    k = view(spark, d, "f_tm").select("id", "ord", "res", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("k"))
    r, g, b, a = pixels.palette(c("k") * 12.0 / c("res"), STOPS, True)
    alpha = F.when(c("ord") % 2 == 1, 255 - c("k")).otherwise(pixels.to_u8(F.round(a, 6)))
    return k.select(c("id").alias("style"), c("k").cast("long").alias("k"), *[pixels.to_u8(F.round(x, 6)).alias(n) for x, n in zip((r, g, b), "rgb", strict=True)], alpha.alias("a"))


@query("style_pipeline", f"SELECT col, row, {_palette_sql('z', True)} FROM (SELECT col, row, least(atan(sqrt(dx * dx + dy * dy)) * (180 / pi()), 90) * 30 AS z FROM (SELECT col, row, {DX} AS dx, {DY} AS dy FROM ({NB}) n WHERE {FULL}) q) q2")
def style_pipeline(spark, d):
    """Slope, then the palette on it."""
    return styled(raster.slope(raster.stencil(view(spark, d, "f_dem")), 25.0), c("slope") * 30, True)


@query("style_parse", "SELECT img_id, CASE WHEN channels > 2 THEN 'estompage' WHEN res < 1 THEN 'pente' WHEN img_id % 2 = 0 THEN 'exposition' ELSE 'palette' END AS kind, CAST(CASE WHEN img_id % 3 = 0 THEN 255.0 ELSE 90.0 END AS DOUBLE) AS max_slope FROM f_img")
def style_parse(spark, d):
    """Precedence of what a style names, and the default slope limit by unit."""
    kind = F.when(c("channels") > 2, "estompage").when(c("res") < 1, "pente").when(c("img_id") % 2 == 0, "exposition").otherwise("palette")
    return view(spark, d, "f_img").select("img_id", kind.alias("kind"), F.when(c("img_id") % 3 == 0, 255.0).otherwise(90.0).alias("max_slope"))


# ---- nodata --------------------------------------------------------------------------------------------------------


@query("nodata_identify_all", f"SELECT col, row, CASE WHEN {TARGET} THEN 0 ELSE 255 END AS mask FROM f_rgb")
def nodata_identify_all(spark, d):
    return view(spark, d, "f_rgb").select("col", "row", F.when(F.expr(TARGET), 0).otherwise(255).alias("mask"))


@query("nodata_touch_edges", "WITH RECURSIVE t AS (SELECT col, row FROM f_rgb WHERE r < 150), z AS (SELECT min(col) AS c0, max(col) AS c1, min(row) AS r0, max(row) AS r1 FROM f_rgb), e AS (SELECT t.col, t.row FROM t, z WHERE col = c0 OR col = c1 OR row = r0 OR row = r1 UNION SELECT t.col, t.row FROM e, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(x, y), t WHERE t.col = e.col + v.x AND t.row = e.row + v.y) SELECT DISTINCT col, row FROM e")
def nodata_touch_edges(spark, d):
    return raster.flood_from_edges(view(spark, d, "f_rgb"), c("r") < 150, Scratch(spark, "flood"))


@query("nodata_change", f"SELECT col, row, CASE WHEN {TARGET} THEN 255 ELSE r END AS r FROM f_rgb")
def nodata_change(spark, d):
    return view(spark, d, "f_rgb").select("col", "row", F.when(F.expr(TARGET), 255).otherwise(c("r")).alias("r"))


@query("data_change", f"SELECT col, row, CASE WHEN r = 255 AND NOT ({TARGET}) THEN 254 ELSE r END AS r FROM f_rgb")
def data_change(spark, d):
    return view(spark, d, "f_rgb").select("col", "row", F.when((c("r") == 255) & ~F.expr(TARGET), 254).otherwise(c("r")).alias("r"))


@query("nodata_tool", f"SELECT col, row, CASE WHEN {TARGET} THEN 255 WHEN r = 255 THEN 254 ELSE r END AS r, CASE WHEN {TARGET} THEN 0 ELSE 255 END AS mask FROM f_rgb")
def nodata_tool(spark, d):
    """Identify, move data off the reserved value, then recolour nodata and give the mask."""
    hit = F.expr(TARGET)
    return view(spark, d, "f_rgb").select("col", "row", F.when(hit, 255).when(c("r") == 255, 254).otherwise(c("r")).alias("r"), F.when(hit, 0).otherwise(255).alias("mask"))
