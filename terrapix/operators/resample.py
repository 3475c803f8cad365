"""Kernel resampling and grid reprojection of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import RADIUS, taps
from .shared import filtered_here


def resample_axis(samples: DataFrame, axis: str, other: list[str], value: str, kernel: str, ratio: float, offset: float, size: int, count: int, mask: str | None = None) -> DataFrame:
    """One pass of a separable resampling: size samples along axis from count, for each value of the other keys.

    Output k is centred at offset + k * ratio in source samples. The taps are a table of size rows times the kernel's width,
    broadcast under that bound; the samples are joined with it and summed, with partial sums. Masked samples are skipped and
    the weights of the rest rescaled; where no weight is left the value is 0 and the mask 0.
    """
    spark = samples.sparkSession
    k = spark.range(size).select(F.col("id").alias("_k"))
    table = k.select("_k", F.explode(taps(kernel, F.lit(offset) + F.col("_k") * ratio, ratio, count)).alias("t")).select("_k", F.col("t.i").cast("long").alias("_i"), "t.w")
    held = samples.join(F.broadcast(table), F.col(axis) == F.col("_i"))
    if mask is None:
        return held.groupBy(*other, F.col("_k").alias(axis)).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    data = F.col(mask) != 0
    total, weight = F.sum(F.when(data, F.col("w") * F.col(value))), F.sum(F.when(data, F.col("w")))
    some = F.coalesce(F.abs(weight) > 1e-9, F.lit(False))
    return held.groupBy(*other, F.col("_k").alias(axis)).agg(F.when(some, total / weight).otherwise(0.0).alias(value), F.when(some, 255).otherwise(0).alias(mask))


def resample(cells: DataFrame, value: str, kernel: str, ratio: float, left: float, top: float, width: int, height: int, src_width: int, src_height: int, mask: str | None = None) -> DataFrame:
    """(col, row) cells on another grid of the same system, along columns and then along rows."""
    across = resample_axis(cells, "col", ["row"], value, kernel, ratio, left, width, src_width, mask)
    return resample_axis(across, "row", ["col"], value, kernel, ratio, top, height, src_height, mask)


STEP = 16


def control_grid(spark, width: int, height: int, transform) -> DataFrame:
    """Control points every STEP pixels and at the last column and row, with transform(x, y) -> (sx, sy)."""
    points = lambda n, name: spark.range((n - 1 + STEP - 1) // STEP + 1).select(F.least(F.col("id") * STEP, F.lit(n - 1)).alias(name))
    grid = points(width, "gx").crossJoin(points(height, "gy"))
    sx, sy = transform(F.col("gx"), F.col("gy"))
    return grid.select("gx", "gy", sx.alias("sx"), sy.alias("sy"))


def interpolated(spark, width: int, height: int, transform) -> DataFrame:
    """(col, row, sx, sy) of every pixel, bilinear between the four control points around it."""
    grid = control_grid(spark, width, height, transform)
    corner = lambda n, x, y: grid.select(F.col("gx").alias(x), F.col("gy").alias(y), F.col("sx").alias(f"sx{n}"), F.col("sy").alias(f"sy{n}"))
    px = spark.range(width * height).select((F.col("id") % width).alias("col"), F.floor(F.col("id") / width).alias("row"))
    low = lambda v, n: F.least(F.floor(F.col(v) / STEP) * STEP, F.lit(max(n - 1 - 1, 0) // STEP * STEP))
    px = px.select("*", low("col", width).alias("x0"), low("row", height).alias("y0"))
    px = px.select("*", F.least(F.col("x0") + STEP, F.lit(width - 1)).alias("x1"), F.least(F.col("y0") + STEP, F.lit(height - 1)).alias("y1"))
    for n, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1"))):
        px = px.join(F.broadcast(corner(n, x, y)), [x, y])
    u = (F.col("col") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1))
    v = (F.col("row") - F.col("y0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    mix = lambda s: (F.col(f"{s}0") * (1 - u) + F.col(f"{s}1") * u) * (1 - v) + (F.col(f"{s}2") * (1 - u) + F.col(f"{s}3") * u) * v
    return px.select("col", "row", mix("sx").alias("sx"), mix("sy").alias("sy"))


def reproject_nearest(grid: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
    """Nearest source cell of every pixel of grid (col, row, sx, sy in source pixels); null outside: an equi-join on the cell."""
    at: Column = grid.select("col", "row", F.floor(F.col("sx") + 0.5).alias("_c"), F.floor(F.col("sy") + 0.5).alias("_r"))
    src = cells.select(F.col("col").alias("_c"), F.col("row").alias("_r"), *values)
    return at.join(src, ["_c", "_r"], "left").select("col", "row", *values)


BLOCK = 32


def reproject_kernel(grid: DataFrame, cells: DataFrame, value: str, kernel: str, src_width: int, src_height: int) -> DataFrame:
    """Two-dimensional kernel at every (sx, sy): the taps of each pixel are summed over the source cells there are.

    The source is dealt in blocks of BLOCK cells a side, with a border as wide as the kernel to the right and below, each an
    array of lines; a pixel joins the block of the first cell that its kernel may reach. So a pixel is shuffled once, not with each of its taps.
    """
    reach = math.ceil(2 * RADIUS[kernel] - 1e-7) - 1
    side, c = BLOCK + reach, F.col
    spots = lambda v: F.array_distinct(F.array(F.floor(c(v) / BLOCK), F.floor((c(v) - reach) / BLOCK)))
    src = cells.select("col", "row", value).select("*", F.explode(spots("col")).alias("_bx")).select("*", F.explode(spots("row")).alias("_by"))
    x = c("col") - c("_bx") * BLOCK
    line = [f for k in range(side) for f in (F.sum(F.when(x == k, c(value))).alias(f"z{k}"), F.max(x == k).alias(f"t{k}"))]
    lines = src.groupBy("_bx", "_by", "row").agg(*line)
    held = F.struct((c("row") - c("_by") * BLOCK).alias("y"), F.array(*[f"z{k}" for k in range(side)]).alias("z"), F.array(*[f"t{k}" for k in range(side)]).alias("t"))
    blocks = lines.select("_bx", "_by", held.alias("line")).groupBy("_bx", "_by").agg(F.collect_list("line").alias("lines"))
    at = lambda y: F.get(F.filter("lines", lambda v: v["y"] == y), F.lit(0))
    blocks = blocks.select("_bx", "_by", F.transform(F.sequence(F.lit(0), F.lit(side - 1)), at).alias("lines"))
    inside = lambda v, n: F.filter(taps(kernel, c(v), 1.0, n), lambda t: t["i"] < n)
    first = lambda v, n: F.least(F.greatest(F.ceil(c(v) - RADIUS[kernel] - 1e-7), F.lit(0)), F.lit(n - 1))
    t = grid.select("col", "row", "sx", "sy", F.floor(first("sx", src_width) / BLOCK).alias("_bx"), F.floor(first("sy", src_height) / BLOCK).alias("_by"))
    # taps are many times a pixel's own size, so they are taken once it has joined its block
    joined = t.join(blocks, ["_bx", "_by"]).select("col", "row", "_bx", "_by", "lines", inside("sx", src_width).alias("tx"), inside("sy", src_height).alias("ty"))

    # one plain term a tap: in nested lambdas the taps of the row would be taken again for each line
    taken = [(F.get("tx", F.lit(b)), F.get("ty", F.lit(a))) for a in range(reach + 1) for b in range(reach + 1)]
    cell = lambda tx, ty, v: F.get(F.get("lines", (ty["i"] - c("_by") * BLOCK).cast("int"))[v], (tx["i"] - c("_bx") * BLOCK).cast("int"))
    values = joined.select("col", "row", *[(tx["w"] * ty["w"] * cell(tx, ty, "z")).alias(f"v{k}") for k, (tx, ty) in enumerate(taken)], F.coalesce(*[F.when(cell(tx, ty, "t"), True) for tx, ty in taken]).alias("there"))
    of = [c(f"v{k}") for k in range(len(taken))]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in of), F.lit(0.0))
    return filtered_here(values, c("there")).select("col", "row", F.when(F.coalesce(*of).isNotNull(), total).alias(value))
