"""Queries that pass cells through codecs, containers and streams and give the cells back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators.shared import Scratch
from ..sources import slabs
from ..sources.tables import table, view
from ..streaming import requests as streams
from .registry import query

c = F.col
BANDS = ["r", "g", "b", "a"]
TW, TH, TPW, TPH = 25, 10, 2, 2
CELLS = "SELECT col, row, r, g, b, a FROM f_rgb"


def _tiles(spark, d):
    return slabs.tile_samples(view(spark, d, "f_rgb"), BANDS, TW, TH, "uint8")


def _through(spark, d, codec):
    coded = slabs.encode_tiles(_tiles(spark, d), TW, TH, 4, "uint8", codec)
    return slabs.cells_of(slabs.decode_tiles(coded, TW, TH, 4, "uint8", codec), BANDS, TW, TH)


for _n, _codec in (("scan_png", "png"), ("scan_pkb", "pkb"), ("scan_lzw", "lzw"), ("scan_deflate", "zip")):
    query(_n, CELLS)(lambda spark, d, k=_codec: _through(spark, d, k))


@query("scan_decode_tile", CELLS)
def scan_decode_tile(spark, d):
    """Every tile by a codec of its own."""
    return _through(spark, d, F.element_at(F.array(*map(F.lit, ("raw", "zip", "pkb", "lzw", "png"))), (c("tc") % 5 + 1).cast("int")))


NAMES = ("raw", "zip", "pkb", "lzw", "png")


@query("sink_slab_codecs", "SELECT codec, col // 25 AS tc, row // 10 AS tr, count(*) * 4 AS raw_size, CAST(sum(r + g + b + a) AS BIGINT) AS total FROM f_rgb, (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") k(codec) GROUP BY 1, 2, 3")
def sink_slab_codecs(spark, d):
    """Every tile by every codec: the size before, and the samples' sum after decoding."""
    each = _tiles(spark, d).select("*", F.explode(F.array(*map(F.lit, NAMES))).alias("codec"))
    back = slabs.decode_tiles(slabs.encode_tiles(each, TW, TH, 4, "uint8", c("codec")), TW, TH, 4, "uint8", c("codec"))
    return back.select("codec", "tc", "tr", F.size("samples").cast("long").alias("raw_size"), F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x).cast("long").alias("total"))


def _slabs(spark, d, codec="lzw"):
    coded = slabs.encode_tiles(_tiles(spark, d), TW, TH, 4, "uint8", codec)
    return slabs.pack_slabs(coded, TPW, TPH, TW, TH, 4, "uint8", codec)


@query("sink_slab", CELLS)
def sink_slab(spark, d):
    """Cells to tiles, slabs, and back through the slabs' index."""
    tiles = slabs.unpack_slabs(_slabs(spark, d), TPW, TPH)
    return slabs.cells_of(slabs.decode_tiles(tiles, TW, TH, 4, "uint8", "lzw"), BANDS, TW, TH)


@query("scan_slab_index", "SELECT col // 25 AS tc, row // 10 AS tr, (row // 10 % 2) * 2 + col // 25 % 2 AS n, CAST(0 AS BIGINT) AS rest, CAST(1000 AS BIGINT) AS size FROM f_rgb GROUP BY 1, 2, 3")
def scan_slab_index(spark, d):
    """Tiles start at multiples of 16 bytes."""
    t = slabs.unpack_slabs(_slabs(spark, d, "raw"), TPW, TPH)
    return t.select("tc", "tr", c("n").cast("long").alias("n"), (c("at") % 16).alias("rest"), "size")


@query("scan_slab_tile", "SELECT event_id, r, g, b, a FROM (SELECT event_id, user_id % 4 AS tc, event_id % n AS tr FROM events, (SELECT max(row) // 10 + 1 AS n FROM f_rgb) s) e JOIN f_rgb p ON p.col = tc * 25 + 3 AND p.row = tr * 10 + 2")
def scan_slab_tile(spark, d):
    """Single tiles asked for: found in their slab by its index, and only these decoded; the sample at (3, 2) of each."""
    n = view(spark, d, "f_rgb").agg(F.floor(F.max("row") / 10) + 1).first()[0] or 1
    asked = table(spark, d, "events").select("event_id", (c("user_id") % 4).alias("tc"), (c("event_id") % n).alias("tr"))
    tiles = slabs.unpack_slabs(_slabs(spark, d, "zip"), TPW, TPH).join(asked.select("tc", "tr").distinct(), ["tc", "tr"], "left_semi")
    samples = slabs.decode_tiles(tiles, TW, TH, 4, "uint8", "zip")
    pixel = samples.select("tc", "tr", *[F.get("samples", F.lit((2 * TW + 3) * 4 + k)).cast("int").alias(x) for k, x in enumerate(BANDS)])
    return asked.join(pixel, ["tc", "tr"]).select("event_id", *BANDS)


@query("check_work", "SELECT col // 25 AS tc, row // 10 AS tr, 25 AS width, 10 AS height, 4 AS channels, count(*) * 4 AS samples FROM f_rgb GROUP BY 1, 2")
def check_work(spark, d):
    """Every work image opened and read to its end."""

    @F.pandas_udf("binary")
    def coded(samples: pd.Series) -> pd.Series:
        return pd.Series([codecs.tiff_encode(np.asarray(s).astype(np.uint8).reshape(TH, TW, 4), "lzw") for s in samples], dtype="object")

    files = _tiles(spark, d).select(F.concat_ws("_", c("tc").cast("string"), c("tr").cast("string")).alias("path"), coded("samples").alias("data"))
    p = F.split("path", "_")
    return slabs.decode_files(files).select(F.get(p, 0).cast("long").alias("tc"), F.get(p, 1).cast("long").alias("tr"), "width", "height", "channels", F.size("samples").cast("long").alias("samples"))


@query("scan_slab_image", CELLS)
def scan_slab(spark, d):
    """Whole slabs read as tiled images."""
    files = _slabs(spark, d, "zip").select(F.concat_ws("_", c("slab_col").cast("string"), c("slab_row").cast("string")).alias("path"), "data")
    images = slabs.decode_files(files).select(F.split("path", "_").alias("p"), "samples").select(F.get("p", 0).cast("long").alias("tc"), F.get("p", 1).cast("long").alias("tr"), "samples")
    cells = slabs.cells_of(images, BANDS, TW * TPW, TH * TPH)
    rows = view(spark, d, "f_rgb").agg(F.max("row").alias("last"))
    return cells.join(F.broadcast(rows), c("row") <= c("last")).drop("last")


def _image_query(name, encode):
    """Strips of ten lines as images of a file format, decoded again."""

    def run(spark, d):
        @F.pandas_udf("binary")
        def coded(samples: pd.Series) -> pd.Series:
            return pd.Series([encode(np.asarray(s).astype(np.uint8).reshape(TH, TW, 4)) for s in samples], dtype="object")

        files = _tiles(spark, d).select(F.concat_ws("_", c("tc").cast("string"), c("tr").cast("string")).alias("path"), coded("samples").alias("data"))
        images = slabs.decode_files(files).select(F.split("path", "_").alias("p"), "samples").select(F.get("p", 0).cast("long").alias("tc"), F.get("p", 1).cast("long").alias("tr"), "samples")
        return slabs.cells_of(images, BANDS, TW, TH)

    query(name, CELLS)(run)


_image_query("sink_png", codecs.png_encode)
_image_query("scan_png_buffer", codecs.png_encode)
_image_query("scan_png_file", codecs.png_encode)
_image_query("sink_tiff", lambda x: codecs.tiff_encode(x, "lzw"))
_image_query("sink_tiff_file", lambda x: codecs.tiff_encode(x, "pkb"))
_image_query("scan_tiff", lambda x: codecs.tiff_encode(x, "zip"))
_image_query("sink_tiff_header_tile", lambda x: codecs.tiff_encode(x, "raw"))


@query("mosaic_compose_dir", CELLS)
def mosaic_compose_dir(spark, d):
    """A folder of images, one a place of a grid, named by column and row, composed into one."""

    @F.pandas_udf("binary")
    def coded(samples: pd.Series) -> pd.Series:
        return pd.Series([codecs.tiff_encode(np.asarray(s).astype(np.uint8).reshape(TH, TW, 4), "zip") for s in samples], dtype="object")

    to = Scratch(spark, "compose").folder()
    slabs.write_files(_tiles(spark, d).select(F.concat_ws("_", c("tc").cast("string"), c("tr").cast("string")).alias("path"), coded("samples").alias("data")), to)
    place = F.split(F.regexp_extract("path", r"(\d+_\d+)$", 1), "_")
    images = slabs.decode_files(slabs.read_slab_files(spark, to)).select(F.get(place, 0).cast("long").alias("tc"), F.get(place, 1).cast("long").alias("tr"), "samples")
    return slabs.cells_of(images, BANDS, TW, TH)


@query("scan_geo_image", "SELECT img_id, xmin AS x, ymax AS y, res AS resx, 4 AS width FROM f_img")
def scan_geo_image(spark, d):
    """Georeferencing written into a TIFF file and read back."""

    @F.pandas_udf("binary")
    def coded(x: pd.Series, y: pd.Series, res: pd.Series) -> pd.Series:
        return pd.Series([codecs.tiff_encode(np.zeros((2, 4, 1), np.uint8), "raw", (a, b, r, r)) for a, b, r in zip(x, y, res, strict=True)], dtype="object")

    files = view(spark, d, "f_img").select(c("img_id").cast("string").alias("path"), coded("xmin", "ymax", "res").alias("data"))
    return slabs.decode_files(files).select(c("path").cast("long").alias("img_id"), "x", "y", "resx", "width")


@query("sink_png_palette", "SELECT col, row, r AS r, 255 - r AS g, r // 2 AS b, 255 - r // 4 AS a FROM f_rgb")
def sink_png_palette(spark, d):
    """A palette put into stored PNG tiles without decoding them."""
    palette = [(k, 255 - k, k // 2, 255 - k // 4) for k in range(256)]

    @F.pandas_udf("binary")
    def coded(data: pd.Series) -> pd.Series:
        return pd.Series([codecs.png_with_palette(bytes(x), palette) for x in data], dtype="object")

    one = slabs.encode_tiles(slabs.tile_samples(view(spark, d, "f_rgb"), ["r"], TW, TH, "uint8"), TW, TH, 1, "uint8", "png")
    return slabs.cells_of(slabs.decode_tiles(one.withColumn("data", coded("data")), TW, TH, 4, "uint8", "png"), BANDS, TW, TH)


@query("sink_bil", "SELECT col, row, CAST(r AS DOUBLE) AS v FROM f_rgb")
def sink_bil(spark, d):
    """Lines of 32-bit floats, written and read back."""

    @F.pandas_udf("binary")
    def coded(samples: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(s).astype("<f4").tobytes() for s in samples], dtype="object")

    @F.pandas_udf("array<double>")
    def back(data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(bytes(x), "<f4").astype(float) for x in data], dtype="object")

    lines = slabs.tile_samples(view(spark, d, "f_rgb"), ["r"], 100, 1)
    return slabs.cells_of(lines.withColumn("samples", back(coded("samples"))), ["v"], 100, 1, "double")


# ---- streams -------------------------------------------------------------------------------------------------------


@query("stream_validated", "SELECT event_id, user_id % 64 AS col FROM events WHERE user_id % 64 < 40")
def stream_validated(spark, d):
    """Requests checked against limits as they arrive."""
    to = Scratch(spark, "stream").folder()
    s = streams.events(spark, d).select("event_id", (c("user_id") % 64).alias("col")).filter("col < 40")
    streams.run(s, to)
    return spark.read.schema(s.schema).parquet(f"{to}/rows")


@query("q_gettile_onfly", "SELECT DISTINCT event_id % 4 AS lvl, user_id // 4 AS col, event_id % 64 // 4 AS row FROM events")
def q_gettile_onfly(spark, d):
    """Slabs made on the fly, each once."""
    to = Scratch(spark, "onfly").folder()
    streams.fill_cache(streams.slab_keys(streams.events(spark, d)), lambda keys: keys, to)
    return spark.read.parquet(f"{to}/cache").select("lvl", "col", "row")


@query("stream_window_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    """Requests a day and kind, with a watermark; a batch with a late bound closes the last windows."""
    to = Scratch(spark, "windows").folder()
    s = streams.events(spark, d).withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))

    def keep(rows: DataFrame, number: int) -> None:
        rows.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{to}/rows/batch={number}")

    s.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(f"{to}/rows")
    return latest.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
