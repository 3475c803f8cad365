"""Queries that make pixels from several steps: maps, windows at another resolution, cropped and merged mosaics, bottom slabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import raster, resample
from ..operators.shared import spread
from ..sources import slabs
from ..sources.tables import view
from .q_build import _COVERED, covered
from .q_grid import best_render
from .q_raster import GRID_SQL, SIZE_SQL, STOPS, _palette_sql, _source_places, _weights_sql, size_of
from .registry import query

c = F.col
NODATA = -99999.0


def _axis(kernel, ratio, size, count):
    """SQL of the taps of an axis: size samples of count, ratio apart, both grids starting at the same edge."""
    return _weights_sql(kernel, f"SELECT e AS id, {ratio}::DOUBLE AS ratio, (e + 0.5::DOUBLE) * {ratio}::DOUBLE - 0.5 AS x FROM (SELECT unnest(range(0, {size})) AS e FROM d) e0", f"(SELECT {count} FROM d)", "id")


def _masked(keys, axis, taps, source):
    """SQL of one pass of a masked resampling."""
    some = "abs(coalesce(sum(k.w) FILTER (WHERE mask <> 0), 0)) > 1e-9"
    return f"SELECT {keys}, k.id AS {axis}, CASE WHEN {some} THEN sum(k.w * z) FILTER (WHERE mask <> 0) / sum(k.w) FILTER (WHERE mask <> 0) ELSE 0.0 END AS z, CASE WHEN {some} THEN 255 ELSE 0 END AS mask FROM ({taps}) k JOIN ({source}) s ON s.{axis} = k.i GROUP BY {keys}, k.id"


def _twice(kernel, ratio, size_x, size_y, count_x, count_y, source):
    return _masked("col", "row", _axis(kernel, ratio, size_y, count_y), _masked("row", "col", _axis(kernel, ratio, size_x, count_x), source))


MERGE4 = f"SELECT col // 2 AS col, row // 2 AS row, CASE WHEN count(*) FILTER (WHERE mask <> 0) > 1 THEN avg(z) FILTER (WHERE mask <> 0) ELSE {NODATA} END AS z, CASE WHEN count(*) FILTER (WHERE mask <> 0) > 1 THEN 255 ELSE 0 END AS mask FROM f_dem GROUP BY 1, 2"

# ---- maps ----------------------------------------------------------------------------------------------------------

ASKED = 1.7
# Of the levels, those of resolution 1, 2, 4, ..., the one of resolution 2 is chosen.
_u8 = lambda x: f"CAST(trunc(round({x} * 255, 6) + 0.5) AS INT)"
_over = lambda n: f"CASE WHEN ta = 0 THEN b{n} ELSE (ta * t{n} + ba * b{n} * (1 - ta)) / (ta + ba * (1 - ta)) END"
GETMAP_SQL = f"""WITH d AS (SELECT w, h, CAST(floor(w / {ASKED}) AS BIGINT) AS mw, CAST(floor(h / {ASKED}) AS BIGINT) AS mh, (w + 1) // 2 AS lw, (h + 1) // 2 AS lh FROM ({SIZE_SQL}) n),
lv AS ({MERGE4}), rs AS ({_twice('linear', ASKED / 2, 'mw', 'mh', 'lw', 'lh', 'SELECT * FROM lv')}),
st AS (SELECT col, row, mask, {_palette_sql('z', True)} FROM rs),
px AS (SELECT x AS col, y AS row FROM (SELECT mh, unnest(range(0, mw)) AS x FROM d) a, LATERAL (SELECT unnest(range(0, mh)) AS y) b),
two AS (SELECT px.col, px.row, coalesce(CASE WHEN st.mask <> 0 THEN st.r / 255.0::DOUBLE END, 0) AS br, coalesce(CASE WHEN st.mask <> 0 THEN st.g / 255.0::DOUBLE END, 0) AS bg, coalesce(CASE WHEN st.mask <> 0 THEN st.b / 255.0::DOUBLE END, 0) AS bb, coalesce(CASE WHEN st.mask <> 0 THEN st.a / 255.0::DOUBLE END, 0) AS ba,
coalesce(t.r / 255.0::DOUBLE, 0) AS tr, coalesce(t.g / 255.0::DOUBLE, 0) AS tg, coalesce(t.b / 255.0::DOUBLE, 0) AS tb, coalesce(t.a / 255.0::DOUBLE, 0) AS ta
FROM px LEFT JOIN st ON st.col = px.col AND st.row = px.row LEFT JOIN f_rgb t ON t.col = CAST(floor((px.col + 0.5) * {ASKED}) AS BIGINT) AND t.row = CAST(floor((px.row + 0.5) * {ASKED}) AS BIGINT))
SELECT row AS line, col AS x, {_u8(_over('r'))} AS r, {_u8(_over('g'))} AS g, {_u8(_over('b'))} AS b, {_u8('(ta + ba * (1 - ta))')} AS a FROM two"""


def level_cells(dem, order):
    """The cells of a level: each is one grouped aggregation over the one below."""
    for _ in range(order):
        dem = raster.merge4(dem, ["z"], NODATA)
    return dem


@query("q_getmap", GETMAP_SQL)
def q_getmap(spark, d):
    """A whole request: the level that fits the asked resolution, resampled to the map's grid, styled, a second layer on top, encoded; here decoded again."""
    return getmap(spark, view(spark, d, "f_dem"), view(spark, d, "f_rgb"), view(spark, d, "f_tm"), ASKED)


def getmap(spark, dem, top, levels, asked):
    """The map of a raster's whole extent, one pixel for asked cells each way; an image is no larger than a service allows."""
    w, h = size_of(dem)
    mw, mh = int(w // asked), int(h // asked)
    wanted = spark.range(1).select(F.lit(asked).alias("asked"), "id").withColumnRenamed("id", "map")
    best = best_render(wanted, levels.select("id", "res"), ["map"]).join(F.broadcast(levels.select(c("id").alias("level"), "ord")), "level").first()
    order = best["ord"]
    cells, ratio = level_cells(dem, order), asked / 2**order
    lw, lh = -(-w // 2**order), -(-h // 2**order)
    out = resample.resample(cells, "z", "linear", ratio, 0.5 * ratio - 0.5, 0.5 * ratio - 0.5, mw, mh, lw, lh, "mask")
    styled = [F.round(x, 6) / 255.0 for x in pixels.palette(c("z"), STOPS, True)]
    base = out.filter("mask <> 0").select("col", "row", F.struct(*[x.alias(n) for x, n in zip(styled, "rgba", strict=True)]).alias("base"))
    at = lambda v: F.floor((c(v) + 0.5) * asked).cast("long")
    canvas = spark.range(mw * mh).select((c("id") % mw).alias("col"), F.floor(c("id") / mw).alias("row"))
    placed = canvas.select("col", "row", at("col").alias("tc"), at("row").alias("tr"))
    over = top.select(c("col").alias("tc"), c("row").alias("tr"), F.struct(*[(c(x) / 255.0).alias(x) for x in "rgba"]).alias("top"))
    none = F.struct(*[F.lit(0.0).alias(x) for x in "rgba"])
    both = placed.join(base, ["col", "row"], "left").join(over, ["tc", "tr"], "left")
    both = both.select("col", "row", F.coalesce("base", none).alias("base"), F.coalesce("top", none).alias("top")).select("col", "row", raster.over(c("base"), c("top")).alias("px"))
    image = both.select("col", "row", *[pixels.to_u8(F.round(c(f"px.{x}") * 255, 6)).alias(x) for x in "rgba"])
    coded = slabs.encode_tiles(slabs.tile_samples(image, list("rgba"), mw, mh, "uint8"), mw, mh, 4, "uint8", "png")
    return slabs.cells_of(slabs.decode_tiles(coded, mw, mh, 4, "uint8", "png"), list("rgba"), mw, mh).select(c("row").alias("line"), c("col").alias("x"), *"rgba")


FINER = 2.5
LEVEL_SQL = f"""WITH d AS (SELECT w, h, CAST(floor(w / {FINER}) AS BIGINT) AS mw, CAST(floor(h / {FINER}) AS BIGINT) AS mh FROM ({SIZE_SQL}) n)
SELECT kx.id AS col, ky.id AS row, round(sum(kx.w * ky.w * z), 4) AS z FROM ({_axis('lanczos_3', FINER, 'mw', 'w')}) kx JOIN f_dem s ON s.col = kx.i JOIN ({_axis('lanczos_3', FINER, 'mh', 'h')}) ky ON s.row = ky.i GROUP BY 1, 2"""


@query("win_level_resample", LEVEL_SQL)
def win_level_resample(spark, d):
    """A level that is not in phase with the asked grid, resampled in both directions."""
    dem = view(spark, d, "f_dem")
    w, h = size_of(dem)
    at = 0.5 * FINER - 0.5
    out = resample.resample(dem, "z", "lanczos_3", FINER, at, at, int(w // FINER), int(h // FINER), w, h)
    return out.select("col", "row", F.round("z", 4).alias("z"))


# ---- mosaics -------------------------------------------------------------------------------------------------------


@query("mosaic_crop_crs", f"WITH n AS ({SIZE_SQL}), k AS (SELECT w, h, x AS col, y AS row FROM (SELECT w, h, unnest(range(-20, w + 20)) AS x FROM n) a, LATERAL (SELECT unnest(range(-5, h + 5)) AS y) b) SELECT k.col, k.row, coalesce(z, {NODATA}) AS z FROM k LEFT JOIN f_dem s ON s.col = k.col AND s.row = k.row AND s.col >= 10 AND s.col < w - 10 AND s.row >= 2 AND s.row < h - 2")
def mosaic_crop_crs(spark, d):
    """A window that reaches beyond its coordinate system's area: what lies within the area, on a canvas of nodata."""
    dem = view(spark, d, "f_dem")
    w, h = size_of(dem)
    canvas = spark.range((w + 40) * (h + 10)).select((c("id") % (w + 40) - 20).alias("col"), (F.floor(c("id") / (w + 40)) - 5).alias("row"))
    inside = dem.filter(c("col").between(10, w - 11) & c("row").between(2, h - 3)).select("col", "row", "z")
    return canvas.join(inside, ["col", "row"], "left").select("col", "row", F.coalesce("z", F.lit(NODATA)).alias("z"))


_PACKS_HEAD = GRID_SQL.replace("WITH d AS (SELECT w, h,", "WITH d AS (SELECT w, h, (w + 1) // 2 AS lw, (h + 1) // 2 AS lh,", 1)
PACKS_SQL = f"""{_PACKS_HEAD}, lv AS ({MERGE4}),
packs AS (SELECT col, row, z, 0 AS ord FROM f_dem WHERE mask <> 0
UNION ALL SELECT col, row, z, 1 FROM ({_twice('linear', 0.5, 'w', 'h', 'lw', 'lh', 'SELECT * FROM lv')}) b, d WHERE mask <> 0 AND col >= w // 3 AND col < 2 * w // 3
UNION ALL SELECT m.col, m.row, z, 2 FROM m JOIN f_dem s ON s.col = floor(m.sx + 0.5) AND s.row = floor(m.sy + 0.5), d WHERE mask <> 0 AND m.col >= 2 * w // 3 AND m.row >= h // 2)
SELECT s.col, s.row, coalesce(p.z, {NODATA})::FLOAT::DOUBLE AS z FROM f_dem s LEFT JOIN (SELECT col, row, arg_max(z, ord) AS z FROM packs GROUP BY 1, 2) p ON p.col = s.col AND p.row = s.row"""


@query("mosaic_merge_packs", PACKS_SQL)
def mosaic_merge_packs(spark, d):
    """Packs of sources on one output grid, bottom to top: as it is where in phase, resampled from another resolution, reprojected from another system. Samples are of 32 bits."""
    dem = view(spark, d, "f_dem")
    grid, w, h = _source_places(spark, dem)
    as_is = dem.filter("mask <> 0").select("col", "row", "z", F.lit(0).alias("ord"))
    coarse = raster.merge4(dem, ["z"], NODATA)
    resampled = resample.resample(coarse, "z", "linear", 0.5, -0.25, -0.25, w, h, -(-w // 2), -(-h // 2), "mask")
    resampled = resampled.filter((c("mask") != 0) & (c("col") >= w // 3) & (c("col") < 2 * w // 3)).select("col", "row", "z", F.lit(1).alias("ord"))
    moved = resample.reproject_nearest(grid.filter((c("col") >= 2 * w // 3) & (c("row") >= h // 2)), dem.filter("mask <> 0"), ["z"]).dropna(subset=["z"]).select("col", "row", "z", F.lit(2).alias("ord"))
    stacked = as_is.unionByName(resampled).unionByName(moved).withColumn("mask", F.lit(255))
    top = raster.top_wins(stacked, ["col", "row"], "ord", ["z"])
    return dem.select("col", "row").join(top, ["col", "row"], "left").select("col", "row", F.coalesce("z", F.lit(NODATA)).cast("float").cast("double").alias("z"))


# ---- slabs ---------------------------------------------------------------------------------------------------------

PIXEL, SIDE, BACKGROUND = 32, 8, 255
_first = lambda v: f"CAST(ceil({v} / {PIXEL} - 0.5) AS BIGINT)"
BOTTOM_SQL = f"""WITH p AS (SELECT img_id, px, py FROM (SELECT img_id, ymin, ymax, unnest(range({_first('xmin')}, {_first('xmax')})) AS px FROM f_img) a, LATERAL (SELECT unnest(range({_first('ymin')}, {_first('ymax')})) AS py) b),
k AS (SELECT DISTINCT col, row FROM ({_COVERED}) c1)
SELECT col * {SIDE} + i % {SIDE} AS col, row * {SIDE} + i // {SIDE} AS row, coalesce(v, {BACKGROUND}) AS v FROM k CROSS JOIN range(0, {SIDE * SIDE}) t(i) LEFT JOIN (SELECT px, py, max(img_id) % 251 AS v FROM p GROUP BY 1, 2) m ON px = col * {SIDE} + i % {SIDE} AND py = row * {SIDE} + i // {SIDE}"""


@query("build_bottom_slab", BOTTOM_SQL)
def build_bottom_slab(spark, d):
    """Slabs that images cover: each pixel of the last image over its centre, else of the background; encoded as slabs, here decoded again."""
    span = lambda a, b: F.sequence(F.ceil(c(a) / PIXEL - 0.5), F.ceil(c(b) / PIXEL - 0.5) - 1)
    held = view(spark, d, "f_img").filter((F.ceil(c("xmin") / PIXEL - 0.5) < F.ceil(c("xmax") / PIXEL - 0.5)) & (F.ceil(c("ymin") / PIXEL - 0.5) < F.ceil(c("ymax") / PIXEL - 0.5)))
    px = spread(held, "img_id").select("img_id", F.explode(span("xmin", "xmax")).alias("col"), "ymin", "ymax").select("img_id", "col", F.explode(span("ymin", "ymax")).alias("row"))
    top = raster.top_wins(px.select("col", "row", "img_id", (c("img_id") % 251).alias("v"), F.lit(255).alias("mask")), ["col", "row"], "img_id", ["v"]).drop("mask")
    keys = covered(spark, d).select("col", "row").distinct().withColumnsRenamed({"col": "sc", "row": "sr"})
    canvas = keys.select("sc", "sr", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i")).select((c("sc") * SIDE + c("i") % SIDE).alias("col"), (c("sr") * SIDE + F.floor(c("i") / SIDE)).alias("row"))
    cells = canvas.join(top, ["col", "row"], "left").select("col", "row", F.coalesce("v", F.lit(BACKGROUND)).alias("v"))
    tiles = slabs.encode_tiles(slabs.tile_samples(cells, ["v"], SIDE // 2, SIDE // 2, "uint8"), SIDE // 2, SIDE // 2, 1, "uint8", "lzw")
    whole = slabs.unpack_slabs(slabs.pack_slabs(tiles, 2, 2, SIDE // 2, SIDE // 2, 1, "uint8", "lzw"), 2, 2)
    return slabs.cells_of(slabs.decode_tiles(whole, SIDE // 2, SIDE // 2, 1, "uint8", "lzw"), ["v"], SIDE // 2, SIDE // 2)
