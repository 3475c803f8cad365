"""Golden values, properties of kernels, and codec round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.functions import codecs, geometry, grid, pixels
from terrapix.operators import raster, resample
from terrapix.operators.shared import Scratch, components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "text"), [(132348, "2U4C"), (16549465, "9UPND"), (1254, "YU")])
def test_b36(spark, n, text):
    assert one(spark, grid.b36(F.lit(n))) == text
    assert one(spark, grid.b36_value(F.lit(text))) == n


@pytest.mark.parametrize(("text", "n"), [("564S", 241228), ("004FR6G", 7453528)])
def test_b36_value(spark, text, n):
    assert one(spark, grid.b36_value(F.lit(text))) == n


@pytest.mark.parametrize(("col", "row", "parts", "path"), [(15247, 75846, 3, "01BM/RI/JU"), (4032, 18217, 3, "3E/42/01"), (25, 195, 3, "00/05/PF")])
def test_b36_path(spark, col, row, parts, path):
    assert one(spark, grid.b36_path(F.lit(col), F.lit(row), parts)) == path
    assert tuple(one(spark, grid.b36_unpath(F.lit(path)))) == (col, row)


def test_b36_unpath(spark):
    assert tuple(one(spark, grid.b36_unpath(F.lit("0FG8/00/MA")))) == (20758, 710218)


def test_tile_matrix(spark):
    x0, y0, res, w, h = F.lit(0.0), F.lit(12000.0), F.lit(0.324), 256, 128
    assert one(spark, grid.col_to_x(F.lit(127), x0, res, w, 4)) == pytest.approx(42135.552)
    assert one(spark, grid.row_to_y(F.lit(127), y0, res, h, 3)) == pytest.approx(-3800.832)
    assert one(spark, grid.x_to_col(F.lit(42155.7), x0, res, w, 4)) == 127
    assert one(spark, grid.y_to_row(F.lit(-3801.14), y0, res, h, 3)) == 127
    assert tuple(one(spark, grid.indices_to_bbox(F.lit(127), F.lit(12), x0, y0, res, w, h, 16, 16))) == pytest.approx((168542.208, 3373.824, 169869.312, 4037.376))
    assert tuple(one(spark, grid.bbox_to_indices(grid.box(3241.0, 132.4, 6365.45, 213.986), x0, y0, res, w, h, 16, 16))) == (17, 17, 2, 4)


@pytest.mark.parametrize("name", sorted(pixels.RADIUS))
def test_kernel_weights(spark, name):
    rng = random.Random(name)
    asked = [(rng.uniform(-0.5, 99.5),) for _ in range(40)]
    for ratio in (0.5, 1.0, 3.7):
        for x, t in spark.createDataFrame(asked, "x double").select("x", pixels.taps(name, F.col("x"), ratio, 100)).collect():
            assert sum(w["w"] for w in t) == pytest.approx(1, abs=1e-6)
            assert all(0 <= w["i"] < 100 for w in t)
            assert len(t) == 1 or abs(t[0]["i"] + t[-1]["i"] - 2 * x) < 2


@pytest.mark.parametrize("kernel", ["nn", "linear", "bicubic", "lanczos_3"])
def test_constant_image_stays(spark, kernel):
    cells = spark.range(600).select((F.col("id") % 30).alias("col"), F.floor(F.col("id") / 30).alias("row"), F.lit(7.5).alias("v"))
    out = resample.resample(cells, "v", kernel, 1.7, 0.35, 0.35, 17, 11, 30, 20).collect()
    assert len(out) == 17 * 11 and all(abs(r["v"] - 7.5) < 1e-4 for r in out)


def test_codecs_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 3000, 40000):
        for data in (rng.randbytes(n), b"\xff" * n, bytes(rng.choice(b"ab") for _ in range(n)), bytes(k // 300 % 256 for k in range(n))):
            assert codecs.packbits_decode(codecs.packbits_encode(data)) == data
            assert codecs.lzw_decode(codecs.lzw_encode(data)) == data


def test_image_files():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        image = rng.integers(0, 256, (17, 23, n)).astype(np.uint8)
        assert (codecs.png_decode(codecs.png_encode(image)) == image).all()
        for how in codecs.CODECS:
            back, geo = codecs.tiff_decode(codecs.tiff_encode(image, how, (1.0, 2.0, 0.5, 0.5)))
            assert (back == image).all() and geo == (1.0, 2.0, 0.5, 0.5)
    floats = rng.random((9, 7, 1)).astype(np.float32)
    assert (codecs.tiff_decode(codecs.tiff_encode(floats, "zip"))[0] == floats).all()


def test_slab_is_a_tiled_image():
    image = np.random.default_rng(0).integers(0, 256, (32, 64, 3)).astype(np.uint8)
    tiles = {k: codecs.encode(image[k // 4 * 16 : k // 4 * 16 + 16, k % 4 * 16 : k % 4 * 16 + 16], "lzw") for k in range(8)}
    slab = codecs.slab_encode(tiles, 4, 2, 16, 16, 3, "uint8", "lzw")
    assert (codecs.tiff_decode(slab)[0] == image).all()
    assert all(at % 16 == 0 for at, _ in codecs.slab_index(slab, 8))
    del tiles[3]
    assert codecs.slab_index(codecs.slab_encode(tiles, 4, 2, 16, 16, 3, "uint8", "lzw"), 8)[3][1] == 0


def test_geometry():
    triangle = "POLYGON((0 0,10 0,0 10,0 0))"
    assert geometry.meets(triangle, (1, 1, 2, 2)) and geometry.meets(triangle, (-5, -5, 50, 50)) and geometry.meets(triangle, (9, -1, 12, 5))
    assert not geometry.meets(triangle, (8, 8, 9, 9))


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 105), (105, 103)] + [(200, 201 + k) for k in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    assert {got[k] for k in range(21)} == {0} and {got[k] for k in (100, 103, 105)} == {100} and {got[k] for k in range(200, 251)} == {200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_merge4_needs_two_data_cells(spark):
    cells = spark.createDataFrame([(0, 0, 4.0, 255), (1, 0, 9.0, 0), (0, 1, 9.0, 0), (1, 1, 9.0, 0), (2, 0, 4.0, 255), (3, 1, 8.0, 255)], "col long, row long, z double, mask int")
    got = {r["col"]: (r["z"], r["mask"]) for r in raster.merge4(cells, ["z"], -1.0).collect()}
    assert got == {0: (-1.0, 0), 1: (6.0, 255)}


@pytest.mark.parametrize("block", [4, 512])
def test_flood_over_blocks(spark, block):
    rng = random.Random(5)
    hit = {(x, y) for x in range(23) for y in range(19) if rng.random() < 0.6}
    cells = spark.createDataFrame([(x, y, (x, y) in hit) for x in range(23) for y in range(19)], "col long, row long, t boolean")
    todo = [p for p in hit if p[0] in (0, 22) or p[1] in (0, 18)]
    want = set(todo)
    while todo:
        x, y = todo.pop()
        for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if p in hit and p not in want:
                want.add(p)
                todo.append(p)
    assert {tuple(r) for r in raster.flood_from_edges(cells, F.col("t"), Scratch(spark, "t"), block).collect()} == want
