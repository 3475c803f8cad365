"""Operators over cells: DataFrames of (col, row, bands..., mask), one row per pixel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components


def half(v) -> Column:
    return F.floor(F.col(v) / 2).cast("long")


def merge4(cells: DataFrame, bands: list[str], nodata: float, integer: bool = False, gamma: float = 1.0) -> DataFrame:
    """The next coarser level by masked means of 2 x 2 cells, one grouped aggregation with partial sums.

    With fewer than two data cells the value is nodata and the mask 0. Integer bands go through the gamma curve.
    """
    data = F.col("mask") != 0
    n = F.sum(data.cast("int"))
    out = []
    for b in bands:
        total = F.sum(F.when(data, F.col(b)))
        if integer:
            i = (total * 4 / n).cast("int")
            mean = (255 - F.floor(F.pow((1020 - i) / 1020.0, F.lit(gamma)) * 255 + 0.5)).cast("int")
        else:
            mean = total / n
        out.append(F.when(n > 1, mean).otherwise(F.lit(nodata)).alias(b))
    return cells.groupBy(half("col").alias("col"), half("row").alias("row")).agg(*out, F.when(n > 1, 255).otherwise(0).alias("mask"))


def decimate(cells: DataFrame, ratio: int, offset: int, bands: list[str], nodata: float) -> DataFrame:
    """One cell of ratio x ratio; masked cells become nodata. A filter: no shuffle."""
    kept = cells.filter((F.col("col") % ratio == offset) & (F.col("row") % ratio == offset))
    at = lambda v: ((F.col(v) - offset) / ratio).cast("long").alias(v)
    return kept.select(at("col"), at("row"), *[F.when(F.col("mask") != 0, F.col(b)).otherwise(nodata).alias(b) for b in bands], "mask")


NEIGHBOURS = dict(zip("abcdefghi", [(x, y) for y in (-1, 0, 1) for x in (-1, 0, 1)], strict=True))


HALO_BLOCK = 64


def neighbours(cells: DataFrame, value: str = "z", block: int = HALO_BLOCK) -> DataFrame:
    """The 3 x 3 neighbourhood a..i (row above first, null outside) of every cell of a raster.

    Cells are dealt once, in blocks with a border of one cell from the blocks around; two windows, along rows and then along
    columns, run within the blocks without another shuffle. A line of a block is the only state, so the plan holds at any
    raster size. The grid must be dense; (col, row) is unique.
    """
    near = lambda v: F.explode(F.sequence(F.floor((F.col(v) - 1) / block), F.floor((F.col(v) + 1) / block)))
    held = cells.select("col", "row", F.col(value).alias("e")).select("*", near("col").alias("_x")).select("*", near("row").alias("_y"))
    along = Window.partitionBy("_x", "_y", "row").orderBy("col")
    down = Window.partitionBy("_x", "_y", "col").orderBy("row")
    x = held.repartition("_x", "_y").select("*", F.lag("e").over(along).alias("d"), F.lead("e").over(along).alias("f"))
    line = lambda f, names: [f(s).over(down).alias(n) for s, n in zip("def", names, strict=True)]
    own = (F.col("_x") == F.floor(F.col("col") / block)) & (F.col("_y") == F.floor(F.col("row") / block))
    return x.select("*", *line(F.lag, "abc"), *line(F.lead, "ghi")).filter(own).drop("_x", "_y")


def stencil(cells: DataFrame, value: str = "z", nodata: str = "mask = 0") -> DataFrame:
    """Neighbourhoods of which every cell holds data."""
    held = cells.withColumn("_v", F.when(~F.expr(nodata), F.col(value)))
    return neighbours(held, "_v").dropna(subset=list("abcdefghi"))


def slope(n: DataFrame, res: float, algo: str = "H", unit: str = "degree", top: float = 90.0) -> DataFrame:
    c = F.col
    if algo == "H":
        dx = ((c("c") + 2 * c("f") + c("i")) - (c("a") + 2 * c("d") + c("g"))) / (8 * res)
        dy = ((c("g") + 2 * c("h") + c("i")) - (c("a") + 2 * c("b") + c("c"))) / (8 * res)
    elif algo == "Z":
        dx, dy = (c("f") - c("d")) / (2 * res), (c("h") - c("b")) / (2 * res)
    else:
        raise ValueError("algo is H or Z")
    rise = F.sqrt(dx * dx + dy * dy)
    value = {"degree": F.atan(rise) * (180 / 3.141592653589793), "pourcent": rise * 100}[unit]
    return n.select("col", "row", F.least(value, F.lit(top)).alias("slope"))


def aspect(n: DataFrame, res: float, least_slope: float) -> DataFrame:
    """Degrees in 0..360, -1 where the gradient is below least_slope."""
    c = F.col
    east = ((c("c") + 2 * c("f") + c("i")) - (c("a") + 2 * c("d") + c("g"))) / (8 * res)
    north = ((c("a") + 2 * c("b") + c("c")) - (c("g") + 2 * c("h") + c("i"))) / (8 * res)
    steep = F.sqrt(east * east + north * north)
    return n.select("col", "row", F.when(steep < least_slope, F.lit(-1.0)).otherwise((F.atan2(east, north) + 3.141592653589793) * (180 / 3.141592653589793)).alias("aspect"))


def hillshade(n: DataFrame, res: float, zenith: float, azimuth: float, z_factor: float) -> DataFrame:
    """Light of 0..255, not rounded; zenith and azimuth in radians."""
    c = F.col
    pi = 3.141592653589793
    dx = ((c("c") + 2 * c("f") + c("i")) - (c("a") + 2 * c("d") + c("g"))) / (8 * res)
    dy = ((c("g") + 2 * c("h") + c("i")) - (c("a") + 2 * c("b") + c("c"))) / (8 * res)
    s = F.atan(z_factor * F.sqrt(dx * dx + dy * dy))
    a = F.when(dx != 0, F.when(F.atan2(dy, -dx) < 0, F.atan2(dy, -dx) + 2 * pi).otherwise(F.atan2(dy, -dx))).when(dy > 0, F.lit(pi / 2)).when(dy < 0, F.lit(3 * pi / 2)).otherwise(0.0)
    light = 255 * (F.cos(F.lit(zenith)) * F.cos(s) + F.sin(F.lit(zenith)) * F.sin(s) * F.cos(F.lit(azimuth) - a))
    return n.select("col", "row", F.greatest(light, F.lit(0.0)).alias("light"))


def top_wins(cells: DataFrame, keys: list[str], order: str, bands: list[str]) -> DataFrame:
    """Of stacked cells the last in order whose mask is not 0; a grouped max_by with partial aggregation. The order must be total.

    One max_by a band: of plain numbers they are hashed, so that a task holds a row a place; of a struct all its cells would be sorted.
    """
    at = F.when(F.col("mask") != 0, F.col(order))
    return cells.groupBy(*keys).agg(*[F.max_by(b, at).alias(b) for b in bands], F.max("mask").alias("mask"))


def fold_layers(cells: DataFrame, keys: list[str], order: str, start: Column, step, values: list[str]) -> DataFrame:
    """An ordered fold over the stacked cells of each key; the stack of a key is as deep as there are layers."""
    stack = F.sort_array(F.collect_list(F.struct(order, *values)))
    return cells.groupBy(*keys).agg(stack.alias("_s")).select(*keys, F.aggregate("_s", start, step).alias("px"))


def over(acc: Column, top: Column) -> Column:
    """Porter-Duff over with unassociated alpha; bands and alpha are in 0..1."""
    a = top["a"] + acc["a"] * (1 - top["a"])
    mix = lambda b: (top[b] * top["a"] + acc[b] * acc["a"] * (1 - top["a"])) / a
    return F.when(top["a"] == 0, acc).otherwise(F.struct(*[mix(b).alias(b) for b in "rgb"], a.alias("a")))


def multiply(acc: Column, top: Column) -> Column:
    return F.struct(*[(acc[b] * top[b]).alias(b) for b in "rgba"])


BLOCK = 512


def _block_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of one block's cells over 4-neighbours: union-find over the runs of each row."""
    pdf = pdf.sort_values(["row", "col"], ignore_index=True)
    row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    runs = list(zip(row[first].tolist(), col[first].tolist(), col[last].tolist(), strict=True))
    parent = list(range(len(runs)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    j = 0
    for k, (r, lo, hi) in enumerate(runs):
        while j < k and (runs[j][0] < r - 1 or (runs[j][0] == r - 1 and runs[j][2] < lo)):
            j += 1
        m = j
        while m < k and runs[m][0] == r - 1 and runs[m][1] <= hi:
            a, b = find(m), find(k)
            parent[max(a, b)] = min(a, b)
            m += 1
    root = np.array([find(k) for k in range(len(runs))], np.int64)
    pdf["label"] = ((row[first] << 32) + col[first])[root][np.cumsum(new) - 1]
    return pdf


def flood_from_edges(cells: DataFrame, target: Column, scratch, block: int = BLOCK) -> DataFrame:
    """(col, row) of the target cells reachable from the raster's border over 4-neighbours that are targets.

    Components are found within blocks of at most block x block cells first, which bounds what a task holds; in a raster
    narrower than a block, blocks are as much longer. Only cells on the sides of blocks are then joined with their
    neighbours, and the components of that small graph are found by rounds of joins. A raster of one block needs none.
    """
    c, r = F.col("col"), F.col("row")
    c0, c1, r0, r1 = cells.agg(F.min("col"), F.max("col"), F.min("row"), F.max("row")).first()
    if c0 is None:
        return cells.select("col", "row")
    wide = min(block, c1 - c0 + 1)
    sides = {"col": (c0, wide), "row": (r0, block * block // wide)}
    hit = cells.filter(target).select("col", "row", F.floor((c - c0) / wide).alias("bc"), F.floor((r - r0) / sides["row"][1]).alias("br"))
    own = scratch.write(hit.groupBy("bc", "br").applyInPandas(lambda pdf: _block_labels(pdf[["col", "row"]]), "col long, row long, label long"))
    whole = own.select("col", "row", "label", F.col("label").alias("node"))
    links = None
    for v, w in (("col", "row"), ("row", "col")):
        start, size = sides[v]
        if (c1 - c0 if v == "col" else r1 - r0) < size:
            continue
        near = own.filter((F.col(v) - start) % size == size - 1).select((F.col(v) + 1).alias(v), w, F.col("label").alias("a"))
        far = own.filter((F.col(v) - start) % size == 0).select(v, w, F.col("label").alias("b"))
        pairs = near.join(far, [v, w]).select("a", "b")
        links = pairs if links is None else links.union(pairs)
    links = scratch.write(links.distinct()) if links is not None else None
    if links is not None and not links.isEmpty():
        whole = own.withColumnRenamed("label", "node").join(components(links, scratch), "node", "left").select("col", "row", "node", F.coalesce("label", "node").alias("label"))
    edge = whole.filter(c.isin(c0, c1) | r.isin(r0, r1)).select("label").distinct()
    return whole.join(edge, "label", "left_semi").select("col", "row")
