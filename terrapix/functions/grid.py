"""Column functions over tile matrices, indices, slab paths and boxes.

A tile matrix is passed as columns or numbers: origin x0, y0 (top left), resolution res, tile size tw, th in pixels; tpw and
tph are the tiles of a slab. Boxes are structs of xmin, ymin, xmax, ymax.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_to_x(col, x0, res, tw, tpw=1) -> Column:
    return x0 + col * res * tw * tpw


def row_to_y(row, y0, res, th, tph=1) -> Column:
    return y0 - row * res * th * tph


def x_to_col(x, x0, res, tw, tpw=1) -> Column:
    """Truncates towards zero."""
    return ((x - x0) / (res * tw * tpw)).cast("long")


def y_to_row(y, y0, res, th, tph=1) -> Column:
    return ((y0 - y) / (res * th * tph)).cast("long")


def box(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for c, n in zip((xmin, ymin, xmax, ymax), ("xmin", "ymin", "xmax", "ymax"), strict=True)])


def indices_to_bbox(col, row, x0, y0, res, tw, th, tpw=1, tph=1) -> Column:
    return box(col_to_x(col, x0, res, tw, tpw), row_to_y(row + 1, y0, res, th, tph), col_to_x(col + 1, x0, res, tw, tpw), row_to_y(row, y0, res, th, tph))


def bbox_to_indices(b: Column, x0, y0, res, tw, th, tpw=1, tph=1) -> Column:
    """row_min, row_max, col_min, col_max; a tile that starts just at xmax or ymin is included."""
    return F.struct(
        y_to_row(b["ymax"], y0, res, th, tph).alias("row_min"),
        y_to_row(b["ymin"], y0, res, th, tph).alias("row_max"),
        x_to_col(b["xmin"], x0, res, tw, tpw).alias("col_min"),
        x_to_col(b["xmax"], x0, res, tw, tpw).alias("col_max"),
    )


def box_wkt(b: Column, decimals: int = 2) -> Column:
    f = f"%.{decimals}f"
    return F.format_string(f"POLYGON(({f} {f},{f} {f},{f} {f},{f} {f},{f} {f}))", b["xmin"], b["ymin"], b["xmin"], b["ymax"], b["xmax"], b["ymax"], b["xmax"], b["ymin"], b["xmin"], b["ymin"])


def b36(n) -> Column:
    return F.conv(n.cast("string"), 10, 36)


def b36_value(s) -> Column:
    return F.conv(s, 36, 10).cast("long")


def b36_path(col: Column, row: Column, parts: int) -> Column:
    """Slab path: the base-36 digits of column and row, interlaced, in the given number of components of which the first takes the rest."""
    c, r = b36(col), b36(row)
    n = F.greatest(F.lit(parts), F.length(c), F.length(r))
    c, r = F.lpad(c, 64, "0"), F.lpad(r, 64, "0")
    mixed = F.array_join(F.transform(F.sequence(F.lit(65) - n, F.lit(64)), lambda i: F.concat(c.substr(i, F.lit(1)), r.substr(i, F.lit(1)))), "")
    tail = [mixed.substr(2 * n - 2 * (parts - k) + 1, F.lit(2)) for k in range(1, parts)]
    return F.concat_ws("/", mixed.substr(F.lit(1), 2 * n - 2 * (parts - 1)), *tail)


def b36_unpath(path: Column) -> Column:
    """(col, row) of a slab path."""
    digits = F.replace(path, F.lit("/"), F.lit(""))
    half = (F.length(digits) / 2).cast("int")
    pick = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), half - 1), lambda i: digits.substr(2 * i + k, F.lit(1))), "")
    return F.struct(b36_value(pick(1)).alias("col"), b36_value(pick(2)).alias("row"))


def intersects(a: Column, b: Column) -> Column:
    """Closed: touching boxes intersect."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def contains(a: Column, b: Column) -> Column:
    """b lies strictly inside a."""
    return (a["xmin"] < b["xmin"]) & (a["xmax"] > b["xmax"]) & (a["ymin"] < b["ymin"]) & (a["ymax"] > b["ymax"])


def contains_inside(a: Column, b: Column) -> Column:
    """b lies in a, borders included."""
    return (a["xmin"] <= b["xmin"]) & (a["xmax"] >= b["xmax"]) & (a["ymin"] <= b["ymin"]) & (a["ymax"] >= b["ymax"])


def intersection(a: Column, b: Column) -> Column:
    return box(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"]))


def adapt(a: Column, to: Column) -> Column:
    """The part of a that lies in another box: the inner one of two nested boxes, null for disjoint ones, else the cut."""
    return F.when(contains_inside(to, a), a).when(contains_inside(a, to), to).when(~intersects(a, to), F.lit(None)).otherwise(intersection(a, to))


def expand(b: Column, resx, resy, gap) -> Column:
    return box(b["xmin"] - gap * resx, b["ymin"] - gap * resy, b["xmax"] + gap * resx, b["ymax"] + gap * resy)


def phase(v: Column, res) -> Column:
    x = v / res
    return x - F.floor(x)


def euclid(n, by) -> Column:
    """Floor division, for negative indices too."""
    return F.floor(n / by).cast("long")
