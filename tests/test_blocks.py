"""Operators that work in blocks, against plain versions on rasters larger than a block; vector tiles; databases."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapix.functions import vector_tiles
from terrapix.operators import pyramid, raster
from terrapix.operators.shared import Scratch
from terrapix.plans.catalog import QUERIES
from terrapix.sources import jdbc, slabs


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(5).integers(0, 100, (41, 23))


@pytest.fixture(scope="module")
def cells(spark, picture):
    h, w = picture.shape
    return spark.createDataFrame([(x, y, float(picture[y, x])) for y in range(h) for x in range(w)], "col long, row long, z double")


@pytest.mark.parametrize("block", [4, 7, 64])
def test_neighbours(cells, picture, block):
    h, w = picture.shape
    got = {(r["col"], r["row"]): r for r in raster.neighbours(cells, block=block).collect()}
    assert len(got) == h * w
    for (x, y), r in got.items():
        for n, (dx, dy) in raster.NEIGHBOURS.items():
            inside = 0 <= x + dx < w and 0 <= y + dy < h
            assert r[n] == (picture[y + dy, x + dx] if inside else None)


def test_neighbours_need_one_shuffle(cells):
    plan = raster.neighbours(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


@pytest.mark.parametrize("block", [3, 8, 512])
def test_flood(spark, cells, picture, block):
    h, w = picture.shape
    hit = picture < 55
    reached = {(x, y) for y in range(h) for x in range(w) if hit[y, x] and (x in (0, w - 1) or y in (0, h - 1))}
    todo = list(reached)
    while todo:
        x, y = todo.pop()
        for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= a < w and 0 <= b < h and hit[b, a] and (a, b) not in reached:
                reached.add((a, b))
                todo.append((a, b))
    moved = cells.select((F.col("col") + 5).alias("col"), (F.col("row") - 3).alias("row"), "z")
    got = {(r["col"] - 5, r["row"] + 3) for r in raster.flood_from_edges(moved, F.col("z") < 55, Scratch(spark, "flood"), block).collect()}
    assert got == reached
    assert raster.flood_from_edges(cells.limit(0), F.col("z") < 55, Scratch(spark, "flood")).count() == 0


def test_numbered(spark):
    rng = random.Random(3)
    df = spark.createDataFrame(sorted({(rng.randrange(3), rng.randrange(9), rng.randrange(9)) for _ in range(200)}), "lvl long, col long, row long")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("lvl").orderBy("col", "row"))).collect()
    assert sorted(map(tuple, pyramid.numbered(df, ["lvl"], ["col"], ["row"]).select("lvl", "col", "row", "n").collect())) == sorted(map(tuple, want))


def test_vector_tiles():
    rng = random.Random(1)
    points = [(k * 1000, rng.randrange(-50, 5000), rng.randrange(5000), rng.choice([1.5, -2.25, 1e9])) for k in range(300)]
    assert vector_tiles.decode(vector_tiles.encode(points)) == points and vector_tiles.decode(vector_tiles.encode([])) == []
    # Laid out by hand from the format: version 2, name "p", one point (25, 17) of id 1, extent 4096.
    data = bytes([0x1A, 0x1F, 0x78, 2, 0x0A, 1, 0x70, 0x12, 0x0D, 8, 1, 0x12, 2, 0, 0, 0x18, 1, 0x22, 3, 9, 50, 34, 0x1A, 1, 0x76, 0x22, 9, 0x19, *np.float64(2.5).tobytes(), 0x28, 0x80, 0x20])
    data = bytes([0x1A, len(data) - 2]) + data[2:]
    assert vector_tiles.decode(data) == [(1, 25, 17, 2.5)]


def test_database(spark):
    url = "jdbc:derby:memory:blocks;create=true"
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    df.write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    got = jdbc.read(spark, url, "t", "id", 5, "k = 3")
    assert got.rdd.getNumPartitions() == 5 and sorted(r["id"] for r in got.collect()) == [k for k in range(100) if k % 7 == 3]
    assert "PushedFilters: [*IsNotNull(k), *EqualTo(k,3)]" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["attribute"], r["ord"]) for r in jdbc.catalog(spark, url, "APP").filter("tbl = 'T'").orderBy("ord").collect()] == [("id", 1), ("k", 2)]
    assert jdbc.has_table(spark, url, "t", "APP") and not jdbc.has_table(spark, url, "u", "APP")


def test_copies_follow_links(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    slabs.write_files(spark.createDataFrame([("x/one", bytearray(b"1" * 50)), ("x/two", bytearray(b"2" * 5)), ("x/link", bytearray(b"SYMLINK#one"))], "path string, data binary"), a)
    slabs.copy_files(spark, a, b, 10)
    assert {p.name: p.read_bytes() for p in (tmp_path / "b" / "x").iterdir() if not p.name.startswith(".")} == {"one": b"1" * 50, "link": b"1" * 50}


def test_union_of_footprints_that_repeat(spark, tmp_path):
    """Union strips are made of distinct intervals: repeats neither add rows to sort nor tie in their order."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.union(part).union(part).write.parquet(f"{tmp_path}/part.parquet")
    once, thrice = (QUERIES["set_union_geom"](spark, d) for d in (SF, str(tmp_path)))
    assert sorted(once.collect()) == sorted(thrice.collect())
    assert thrice._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 4  # boxes and intervals are made distinct
