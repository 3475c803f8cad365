"""Queries that write files of a kind into the shared folder and read them back: descriptors, images, harvests, slab folders."""

from __future__ import annotations

import zlib
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import codecs, grid, jpeg
from ..operators.shared import Scratch, spread
from ..sources import descriptors, slabs, wms
from ..sources.tables import table, view
from .q_build import _COVERED, covered
from .q_io import TH, TW
from .q_raster import STOPS
from .registry import query

c = F.col


def folder(spark, name):
    return Scratch(spark, name).folder()


def _text(df, column, to):
    """One descriptor file of a small table's rows."""
    body = F.array_join(F.sort_array(F.collect_list(column)), "")
    df.agg(F.concat(F.lit("<root>"), body, F.lit("</root>")).alias("value")).write.text(to)
    return to


def _tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


# ---- descriptors ---------------------------------------------------------------------------------------------------


@query("scan_tms_xml", "SELECT CAST(id AS VARCHAR) AS id, res AS resolution, CAST(tile_w AS BIGINT) AS tile_width, row_number() OVER (ORDER BY res) - 1 AS ord FROM f_tm")
def scan_tms_xml(spark, d):
    fields = [_tag("id", c("id")), _tag("resolution", c("res")), _tag("topLeftCornerX", c("x0")), _tag("topLeftCornerY", c("y0")), _tag("tileWidth", c("tile_w")), _tag("tileHeight", c("tile_h"))]
    to = _text(view(spark, d, "f_tm"), F.concat(F.lit("<tileMatrix>"), *fields, F.lit("</tileMatrix>")), folder(spark, "tms"))
    return descriptors.tile_matrices(spark, to).select("id", "resolution", c("tileWidth").alias("tile_width"), c("ord").cast("long").alias("ord"))


LIMITS = "SELECT CAST(lvl AS VARCHAR) AS level, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM f_slab GROUP BY lvl"


def _levels(spark, d):
    g = view(spark, d, "f_slab").groupBy("lvl").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    limits = F.struct(c("r0").alias("minTileRow"), c("r1").alias("maxTileRow"), c("c0").alias("minTileCol"), c("c1").alias("maxTileCol"))
    return g.select(c("lvl").cast("string").alias("tileMatrix"), F.concat(F.lit("./IMAGE/"), c("lvl").cast("string")).alias("baseDir"), F.lit(16).alias("tilesPerWidth"), F.lit(16).alias("tilesPerHeight"), limits.alias("TMSLimits"))


for _n in ("sink_descriptor", "scan_level_xml"):

    @query(_n, LIMITS)
    def _level_round_trip(spark, d, n=_n):
        to = folder(spark, n)
        descriptors.write_levels(_levels(spark, d), to)
        return descriptors.levels(spark, to).select(c("tileMatrix").alias("level"), c("minTileRow").alias("r0"), c("maxTileRow").alias("r1"), c("minTileCol").alias("c0"), c("maxTileCol").alias("c1"))


@query("scan_pyramid_xml", "SELECT DISTINCT pyr AS tms, CAST(3 AS BIGINT) AS channels FROM f_slab")
def scan_pyramid_xml(spark, d):
    p = view(spark, d, "f_slab").select("pyr").distinct()
    to = _text(p, F.concat(F.lit("<Pyramid>"), _tag("tileMatrixSet", c("pyr")), F.lit("<format>TIFF_RAW_INT8</format><channels>3</channels></Pyramid>")), folder(spark, "pyr"))
    return descriptors.pyramids(spark, to).select(c("tileMatrixSet").alias("tms"), "channels")


@query("scan_style_xml", "SELECT * FROM (VALUES " + ", ".join(f"({v}::DOUBLE, {r}::BIGINT, {a}::BIGINT)" for v, (r, _, _, a) in STOPS) + ") s(value, red, alpha)")
def scan_style_xml(spark, d):
    stops = spark.createDataFrame([(v, *p) for v, p in STOPS], "v double, r int, g int, b int, a int")
    body = F.concat(F.lit('<colour value="'), c("v").cast("string"), F.lit('">'), _tag("red", c("r")), _tag("green", c("g")), _tag("blue", c("b")), F.when(c("a") < 255, _tag("alpha", c("a"))).otherwise(""), F.lit("</colour>"))
    return descriptors.colours(spark, _text(stops, body, folder(spark, "style"))).select("value", "red", "alpha")


LAYERS = "SELECT CAST(n_nationkey AS VARCHAR) AS title, n_nationkey % 2 = 0 AS opaque, CASE WHEN n_nationkey % 3 = 0 THEN 'bicubic' ELSE 'lanczos_2' END AS resampling FROM nation"


def _layer_files(spark, d, name):
    n = table(spark, d, "nation").select("n_nationkey")
    k = c("n_nationkey")
    body = F.concat(F.lit("<layer>"), _tag("title", k), F.when(k % 2 == 1, "<opaque>false</opaque>").otherwise(""), F.when(k % 3 == 0, "<resampling>bicubic</resampling>").when(k % 3 == 1, "<resampling>lanczos</resampling>").otherwise(""), F.lit("</layer>"))
    return _text(n, body, folder(spark, name))


@query("scan_layer_xml", LAYERS)
def scan_layer_xml(spark, d):
    return descriptors.layers(spark, _layer_files(spark, d, "layers")).select("title", "opaque", "resampling")


@query("build_layer", "SELECT pyr AS title, min(res) AS min_res, max(res) AS max_res, count(DISTINCT lvl) AS levels, 'lanczos_2' AS resampling FROM f_slab s JOIN f_tm t ON s.lvl - 1 = t.ord GROUP BY pyr")
def build_layer(spark, d):
    """A layer's descriptor from a pyramid's levels: its title, and the resolutions of its finest and coarsest level; written and read back."""
    slab, tm = view(spark, d, "f_slab"), view(spark, d, "f_tm")
    held = slab.select("pyr", "lvl").distinct().join(F.broadcast(tm), c("lvl") - 1 == c("ord"))
    layer = held.groupBy("pyr").agg(F.min("res").alias("least"), F.max("res").alias("most"), F.count("*").alias("levels"))
    body = F.concat(F.lit("<layer>"), _tag("title", c("pyr")), _tag("abstract", c("levels")), _tag("minRes", c("least")), _tag("maxRes", c("most")), F.lit("</layer>"))
    read = descriptors.layers(spark, _text(layer, body, folder(spark, "layer")))
    return read.select("title", c("minRes").alias("min_res"), c("maxRes").alias("max_res"), c("abstract").cast("long").alias("levels"), "resampling")


@query("scan_server_xml", "SELECT 4 AS threads, 'error' AS level")
def scan_server_xml(spark, d):
    """Settings that are not given have defaults."""
    to = _text(spark.range(1), F.lit("<serverConf><nbThread>4</nbThread></serverConf>"), folder(spark, "server"))
    conf = spark.read.format("xml").option("rowTag", "serverConf").schema("nbThread int, logLevel string").load(to)
    return conf.select(F.coalesce("nbThread", F.lit(1)).alias("threads"), F.coalesce("logLevel", F.lit("error")).alias("level"))


@query("scan_config_dir", "SELECT CAST(1 AS BIGINT) AS n")
def scan_config_dir(spark, d):
    """Files of a kind changed after a time."""
    return descriptors.changed_since(spark, _layer_files(spark, d, "conf"), "*.txt", "2000-01-01").agg(F.count("*").alias("n"))


@query("build_ondemand", "SELECT id, CASE WHEN ord >= 2 THEN 'PYRAMID' ELSE 'WEBSERVICE' END AS kind, CAST(CASE WHEN ord >= 2 THEN 2 ELSE 1 END AS BIGINT) AS n FROM f_tm")
def build_ondemand(spark, d):
    """Levels of an on-demand descriptor with their ordered sources."""
    one = lambda k, name: F.struct(F.lit(k).alias("kind"), F.lit(name).alias("name"))
    src = F.when(c("ord") >= 2, F.array(one("PYRAMID", "a"), one("PYRAMID", "b"))).otherwise(F.array(one("WEBSERVICE", "w")))
    lv = view(spark, d, "f_tm").select("id", "ord", src.alias("sources"))
    return lv.select("id", F.get("sources", F.lit(0))["kind"].alias("kind"), F.size("sources").cast("long").alias("n"))


# ---- images --------------------------------------------------------------------------------------------------------

@query("scan_image_dir", "SELECT img_id, xmin AS x, ymax AS y, res FROM f_img")
def scan_image_dir(spark, d):
    """A folder of georeferenced images, in inner folders of a few thousand, written by the executors and listed."""

    @F.pandas_udf("binary")
    def coded(x: pd.Series, y: pd.Series, res: pd.Series) -> pd.Series:
        return pd.Series([codecs.tiff_encode(np.zeros((2, 4, 3), np.uint8), "zip", (a, b, r, r)) for a, b, r in zip(x, y, res, strict=True)], dtype="object")

    to = folder(spark, "images")
    dealt = spread(view(spark, d, "f_img").withColumn("inner", F.hex(F.pmod(F.xxhash64("img_id"), F.lit(4096)))), "inner")
    files = dealt.select(F.concat("inner", F.lit("/"), c("img_id").cast("string"), F.lit(".tif")).alias("path"), coded("xmin", "ymax", "res").alias("data"))
    slabs.write_files(files, to)
    images = slabs.image_dir(spark, to)
    return images.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("img_id"), "x", "y", c("resx").alias("res"))


JPEG_SQL = "SELECT col // 25 AS tc, row // 10 AS tr, true AS near FROM f_rgb GROUP BY 1, 2"


def _jpeg(spark, d):
    """Tiles of a smooth picture through JPEG; near tells whether the largest error is small."""
    smooth = view(spark, d, "f_rgb").select("col", "row", *[(128 + 100 * F.sin(c("col") / 9 + k) * F.cos(c("row") / 7)).cast("int").alias(b) for k, b in enumerate("rgb")])

    @F.pandas_udf("boolean")
    def near(samples: pd.Series) -> pd.Series:
        images = [np.asarray(s).astype(np.uint8).reshape(TH, TW, 3) for s in samples]
        return pd.Series([bool(np.abs(jpeg.decode(jpeg.encode(x, 95)).astype(int) - x).max() <= 12) for x in images])

    return slabs.tile_samples(smooth, ["r", "g", "b"], TW, TH).select("tc", "tr", near("samples").alias("near"))


for _n in ("scan_jpeg", "scan_jpeg_file", "sink_jpeg"):
    query(_n, JPEG_SQL)(_jpeg)


@query("scan_bilz", "SELECT col, row, CAST(r AS DOUBLE) AS v FROM f_rgb")
def scan_bilz(spark, d):
    """Deflated lines of 32-bit floats."""

    @F.pandas_udf("array<double>")
    def through(samples: pd.Series) -> pd.Series:
        stored = [zlib.compress(np.asarray(s).astype("<f4").tobytes()) for s in samples]
        return pd.Series([np.frombuffer(zlib.decompress(x), "<f4").astype(float) for x in stored], dtype="object")

    lines = slabs.tile_samples(view(spark, d, "f_rgb"), ["r"], 100, 1)
    return slabs.cells_of(lines.withColumn("samples", through("samples")), ["v"], 100, 1, "double")


# ---- harvests ------------------------------------------------------------------------------------------------------


@lru_cache(4096)
def _plain_image(width: int, height: int, red: int, green: int) -> bytes:
    image = np.zeros((height, width, 3), np.uint8)
    image[..., 0], image[..., 1] = red, green
    return codecs.png_encode(image)


def local_service(url: str) -> tuple[str, bytes]:
    """A map service without a network, with a cache of its answers: every pixel of an answer holds the box's lower left corner."""
    q = dict(x.split("=", 1) for x in unquote(url.partition("?")[2]).split("&"))
    x, y = (int(float(v)) for v in q["BBOX"].split(",")[:2])
    return "image/png", _plain_image(int(q["WIDTH"]), int(q["HEIGHT"]), x % 256, y % 256)


def _asked(spark, d, pixels):
    s = spread(view(spark, d, "f_img"), "img_id").select(c("img_id").alias("slab"), (F.floor(c("xmin") / 8) * 8.0).alias("xmin"), (F.floor(c("ymin") / 8) * 8.0).alias("ymin"))
    s = s.select("*", (c("xmin") + 64).alias("xmax"), (c("ymin") + 64).alias("ymax"))
    return wms.fetch(wms.requests(s, pixels, pixels, "http://host/wms", "lay", "EPSG:3857", max_pixels=8), local_service)


def _answers(got):
    samples = slabs.decode_files(got.select(F.concat_ws("_", c("slab").cast("string"), c("part_col").cast("string"), c("part_row").cast("string")).alias("path"), "data"), 2)
    p = F.split("path", "_")
    return samples.select(F.get(p, 0).cast("long").alias("img_id"), F.get(p, 1).cast("long").alias("part_col"), F.get(p, 2).cast("long").alias("part_row"), F.get("samples", F.lit(0)).cast("int").alias("r"), F.get("samples", F.lit(1)).cast("int").alias("g"), "width")


@query("scan_wms", "SELECT img_id, CAST(floor(xmin / 8) * 8 AS BIGINT) % 256 AS r, CAST(floor(ymin / 8) * 8 AS BIGINT) % 256 AS g FROM f_img")
def scan_wms(spark, d):
    return _answers(_asked(spark, d, 8)).select("img_id", c("r").cast("long").alias("r"), c("g").cast("long").alias("g"))


PARTS = "SELECT img_id, pc AS part_col, pr AS part_row, (CAST(floor(xmin / 8) * 8 AS BIGINT) + 16 * pc) % 256 AS r, (CAST(floor(ymin / 8) * 8 AS BIGINT) + 16 * (3 - pr)) % 256 AS g FROM f_img, range(0, 4) a(pc), range(0, 4) b(pr)"


@query("scan_wms_slab", PARTS)
def scan_wms_slab(spark, d):
    """A slab too large for one request is cut into sixteen."""
    return _answers(_asked(spark, d, 32)).select("img_id", "part_col", "part_row", c("r").cast("long").alias("r"), c("g").cast("long").alias("g"))


@query("build_wms_slab", f"SELECT img_id, count(*) * 64 AS pixels, CAST(sum(r * 64) AS BIGINT) AS total FROM ({PARTS}) p GROUP BY img_id")
def build_wms_slab(spark, d):
    """The parts put together into one slab."""
    parts = _answers(_asked(spark, d, 32))
    return parts.groupBy("img_id").agg(F.sum(c("width") * c("width")).cast("long").alias("pixels"), F.sum(c("r") * 64).cast("long").alias("total"))


# ---- slab folders --------------------------------------------------------------------------------------------------

# A folder of the slabs that images cover, one file a slab.
def _covered(spark, d):
    return covered(spark, d).select("col", "row").distinct()


def _slab_path():
    return F.concat(F.lit("IMAGE/3/"), grid.b36_path(c("col"), c("row"), 3), F.lit(".tif"))


def _written(spark, d, name):
    to = folder(spark, name)
    slabs.write_files(_covered(spark, d).select(_slab_path().alias("path"), F.concat_ws("_", c("col").cast("string"), c("row").cast("string")).cast("binary").alias("data")), to)
    return to


def _listed(spark, to):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    p = F.regexp_extract("path", r"/IMAGE/(\d+)/(.*)\.tif$", 2)
    return files.select(F.regexp_extract("path", r"/IMAGE/(\d+)/", 1).cast("int").alias("lvl"), grid.b36_unpath(p).alias("x"), c("length").alias("size")).select("lvl", "x.*", "size")


@query("build_list", f"SELECT DISTINCT 3 AS lvl, col, row FROM ({_COVERED}) q")
def build_list(spark, d):
    """The slab list of a folder."""
    return _listed(spark, _written(spark, d, "list")).select("lvl", "col", "row")


@query("build_delete", f"SELECT DISTINCT 3 AS lvl, col, row FROM ({_COVERED}) q WHERE (col + row) % 3 <> 0")
def build_delete(spark, d):
    """Slabs deleted by list, from the executors; what is left is listed."""
    to = _written(spark, d, "delete")
    gone = _covered(spark, d).filter("(col + row) % 3 = 0").select(_slab_path().alias("path"))
    slabs.delete_files(gone, to)
    return _listed(spark, to).select("lvl", "col", "row")


@query("storage_ops", "SELECT true AS copied, false AS left_behind, CAST(3 AS BIGINT) AS size")
def storage_ops(spark, d):
    to = folder(spark, "storage")
    slabs.write_files(spark.createDataFrame([("a", bytearray(b"abc"))], "path string, data binary"), to)
    store = slabs.Storage(spark)
    store.copy(f"{to}/a", f"{to}/b")
    size = store.size(f"{to}/b")
    store.remove(f"{to}/a")
    return spark.createDataFrame([(store.exists(f"{to}/b"), store.exists(f"{to}/a"), size)], "copied boolean, left_behind boolean, size long")


# ---- requests ------------------------------------------------------------------------------------------------------


@query("req_parse_post", "SELECT event_id, 'GetMap' AS request, 'lay' || (user_id % 7) AS layer, event_id % 500 AS width FROM events")
def req_parse_post(spark, d):
    """Parameters of an XML request body."""
    e = table(spark, d, "events")
    body = F.concat(F.lit('<GetMap service="WMS"><StyledLayerDescriptor><NamedLayer><Name>lay'), (c("user_id") % 7).cast("string"), F.lit("</Name></NamedLayer></StyledLayerDescriptor><Output><Size><Width>"), (c("event_id") % 500).cast("string"), F.lit("</Width></Size></Output></GetMap>"))
    p = e.select("event_id", body.alias("b"))
    return p.select("event_id", F.xpath_string("b", F.lit("name(/*)")).alias("request"), F.xpath_string("b", F.lit("/GetMap/StyledLayerDescriptor/NamedLayer/Name")).alias("layer"), F.xpath_long("b", F.lit("/GetMap/Output/Size/Width")).alias("width"))

