"""Files: slabs with links, images, descriptors, harvests, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.functions import codecs
from terrapix.sources import descriptors, slabs, wms

TMS = """<tileMatrixSet><crs>EPSG:3857</crs>
<tileMatrix><id>1</id><resolution>2.0</resolution><topLeftCornerX>0</topLeftCornerX><topLeftCornerY>100</topLeftCornerY><tileWidth>256</tileWidth><tileHeight>256</tileHeight><matrixWidth>4</matrixWidth><matrixHeight>4</matrixHeight></tileMatrix>
<tileMatrix><id>2</id><resolution>1.0</resolution><topLeftCornerX>0</topLeftCornerX><topLeftCornerY>100</topLeftCornerY><tileWidth>256</tileWidth><tileHeight>256</tileHeight><matrixWidth>8</matrixWidth><matrixHeight>8</matrixHeight></tileMatrix>
</tileMatrixSet>"""
PYR = """<Pyramid><tileMatrixSet>PM</tileMatrixSet><format>TIFF_RAW_INT8</format><channels>3</channels>
<level><tileMatrix>2</tileMatrix><baseDir>./IMAGE/2</baseDir><tilesPerWidth>16</tilesPerWidth><tilesPerHeight>16</tilesPerHeight><TMSLimits><minTileRow>1</minTileRow><maxTileRow>2</maxTileRow><minTileCol>3</minTileCol><maxTileCol>4</maxTileCol></TMSLimits></level></Pyramid>"""
STYLE = """<style><palette><colour value="0"><red>1</red><green>2</green><blue>3</blue></colour><colour value="9.5"><red>4</red><green>5</green><blue>6</blue><alpha>7</alpha></colour></palette></style>"""


def test_descriptors(spark, tmp_path):
    for name, text in (("a.tms", TMS), ("b.pyr", PYR), ("c.stl", STYLE)):
        (tmp_path / name).write_text(text)
    tm = descriptors.tile_matrices(spark, str(tmp_path / "a.tms")).orderBy("ord").collect()
    assert [(r["id"], r["resolution"], r["ord"]) for r in tm] == [("2", 1.0, 0), ("1", 2.0, 1)]
    lv = descriptors.levels(spark, str(tmp_path / "b.pyr")).first()
    assert (lv["pathDepth"], lv["minTileRow"], lv["maxTileCol"]) == (2, 1, 4)
    assert descriptors.pyramids(spark, str(tmp_path / "b.pyr")).first()["channels"] == 3
    assert [(r["value"], r["alpha"]) for r in descriptors.colours(spark, str(tmp_path / "c.stl")).orderBy("value").collect()] == [(0.0, 255), (9.5, 7)]
    descriptors.write_levels(descriptors.levels(spark, str(tmp_path / "b.pyr")).drop("file"), str(tmp_path / "out"))
    assert descriptors.changed_since(spark, str(tmp_path), "*.pyr", "2000-01-01").count() == 1


def test_slab_files_and_links(spark, tmp_path):
    tile = codecs.encode(np.full((4, 4, 1), 9, np.uint8), "zip")
    slab = codecs.slab_encode({0: tile, 3: tile}, 2, 2, 4, 4, 1, "uint8", "zip")
    slabs.write_files(spark.createDataFrame([("x/a.tif", bytearray(slab))], "path string, data binary"), f"file://{tmp_path}")
    store = slabs.Storage(spark)
    store.link("a.tif", f"file://{tmp_path}/x/b.tif")
    read = slabs.read_slab_files(spark, f"file://{tmp_path}/x")
    assert sorted((r["path"].rpartition("/")[2], bytes(r["data"]) == slab) for r in read.collect()) == [("a.tif", True), ("b.tif", True)]
    assert store.size(f"file://{tmp_path}/x/a.tif") == len(slab)
    store.copy(f"file://{tmp_path}/x/a.tif", f"file://{tmp_path}/y.tif")
    assert store.exists(f"file://{tmp_path}/y.tif") and store.remove(f"file://{tmp_path}/y.tif") and not store.exists(f"file://{tmp_path}/y.tif")


def test_image_dir(spark, tmp_path):
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "a.png").write_bytes(codecs.png_encode(image))
    (tmp_path / "b.tif").write_bytes(codecs.tiff_encode(image, "lzw", (5.0, 6.0, 1.0, 1.0)))
    images = slabs.image_dir(spark, str(tmp_path))
    assert sorted((r["width"], r["x"]) for r in images.collect() if r["x"]) == [(4, 5.0)] and images.count() == 2 and slabs.uniform(images)


def test_harvest(spark):
    assert wms.cuts(4096, 4096) == (4, 4) and wms.cuts(2000, 100) == (1, 1)
    with pytest.raises(ValueError):
        wms.cuts(16384, 16384)
    asked = wms.requests(spark.createDataFrame([(1, 0.0, 0.0, 8.0, 8.0)], "slab int, xmin double, ymin double, xmax double, ymax double"), 4096, 4096, "http://h", "l", "EPSG:3857")
    assert asked.count() == 16 and "BBOX=0.000000,6.000000,2.000000,8.000000" in asked.filter("part_row = 0 AND part_col = 0").first()["url"]
    got = wms.fetch(asked, lambda u: ("image/png", b"x") if "=0.0" in u else ("text/xml", b"")).groupBy(F.col("error").isNull().alias("ok")).count()
    assert {r["ok"]: r["count"] for r in got.collect()} == {True: 7, False: 9} or got.count() == 2
