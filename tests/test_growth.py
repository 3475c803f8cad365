"""What grows with the input: tasks, shuffled rows, and what a task or a Python worker holds at once."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from terrapix.functions import codecs
from terrapix.functions.pixels import taps
from terrapix.operators import raster, resample
from terrapix.plans import q_build, q_files
from terrapix.plans.catalog import QUERIES
from terrapix.sources import slabs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folder_of_images_is_read_by_few_tasks(spark, tmp_path):
    image = codecs.tiff_encode(np.zeros((2, 4, 3), np.uint8), "zip", (5.0, 6.0, 1.0, 1.0))
    for k in range(300):
        (tmp_path / f"{k % 9}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 9}" / f"{k}.tif").write_bytes(image)
    (tmp_path / "top.png").write_bytes(codecs.png_encode(np.ones((1, 1, 3), np.uint8)))
    (tmp_path / "notes.txt").write_text("no image")
    images = slabs.image_dir(spark, f"file://{tmp_path}")
    assert images.count() == 301 and images.filter("x = 5.0 AND size(samples) = 24").count() == 300
    assert images.rdd.getNumPartitions() == 4


def test_samples_are_held_small_and_handed_on_in_pieces(spark):
    assert [len(x) for x in slabs.in_pieces(iter([5, 5, 1, 30, 2]), lambda v: v, 10)] == [2, 2, 1]
    tiles = spark.createDataFrame([(0, 0, bytearray(range(256)))], "tc long, tr long, data binary")
    back = slabs.decode_tiles(tiles, 16, 16, 1, "uint8", "raw")
    assert dict(back.dtypes)["samples"] == "array<smallint>" and back.first()["samples"] == list(range(256))
    data = [codecs.png_encode(np.full((4, 4, 1), k, np.uint8)) for k in range(50)]
    frames = list(slabs._images(iter([*data, b"other"]), 2))
    assert [list(s) if s is not None else None for f in frames for s in f["samples"]] == [[k, k] for k in range(50)] + [None]


def test_requests_are_dealt_out(spark):
    assert q_files._asked(spark, SF, 8).rdd.getNumPartitions() == 4


def test_list_is_stored_before_it_is_parsed(spark):
    assert not any("lineitem" in f for f in q_build.scan_slab_list(spark, SF).inputFiles())
    assert not any("lineitem" in f for f in QUERIES["tb_list_gettile"](spark, SF).inputFiles())


def test_top_of_a_stack_is_hashed(spark):
    cells = spark.createDataFrame([(0, 1, 7, 5, 255), (0, 2, 8, 6, 255), (0, 3, 9, 9, 0), (1, 1, 4, 4, 0)], "col int, ord int, r int, a int, mask int")
    top = raster.top_wins(cells, ["col"], "ord", ["r", "a"])
    assert sorted(map(tuple, top.collect())) == [(0, 8, 6, 255), (1, None, None, 0)]
    assert "SortAggregate" not in top._jdf.queryExecution().executedPlan().toString()


def test_costly_filter_stays_above_the_dealing_out(spark):
    plan = optimized(QUERIES["sink_exception"](spark, SF))
    assert 0 <= plan.rindex("Filter") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("kernel", ["linear", "lanczos_2", "lanczos_3"])
def test_kernel_by_blocks(spark, kernel):
    """Against a join of every tap with its cell: borders of blocks and of the raster, gaps, nulls, cells that repeat, places outside."""
    rnd, w, h = random.Random(3), 75, 70
    cells = [(x, y, None if rnd.random() < 0.05 else rnd.random()) for x in range(w) for y in range(h) if rnd.random() > 0.1 and not (x < 9 and y < 9)] + [(40, 40, 0.5), (40, 40, 0.25)]
    at = [(k, 0, rnd.uniform(-5, w + 4), rnd.uniform(-5, h + 4)) for k in range(1500)] + [(2000 + k, 0, float(k), k / 2) for k in range(w)]
    cells, grid = spark.createDataFrame(cells, "col long, row long, z double"), spark.createDataFrame(at, "col long, row long, sx double, sy double")
    got = resample.reproject_kernel(grid, cells, "z", kernel, w, h)
    t = grid.select("col", "row", F.explode(taps(kernel, F.col("sx"), 1.0, w)).alias("x"), taps(kernel, F.col("sy"), 1.0, h).alias("ty")).select("col", "row", "x", F.explode("ty").alias("y"))
    t = t.select("col", "row", F.col("x.i").cast("long").alias("c"), F.col("y.i").cast("long").alias("r"), (F.col("x.w") * F.col("y.w")).alias("w"))
    want = t.join(cells.select(F.col("col").alias("c"), F.col("row").alias("r"), "z"), ["c", "r"]).groupBy("col", "row").agg(F.sum(F.col("w") * F.col("z")).alias("z"))
    a, b = ({r["col"]: r["z"] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 1000
    assert [k for k in a if (a[k] is None) != (b[k] is None) or (a[k] is not None and abs(a[k] - b[k]) > 1e-9)] == []


def test_kernel_does_not_shuffle_taps(spark):
    assert "x.i" not in optimized(QUERIES["win_level_reproject"](spark, SF)) and optimized(QUERIES["win_level_reproject"](spark, SF)).count("explode") == 2  # the borders of blocks
