"""Conversions between boxes, points, slab and tile indices, paths, and request parameters.

A tile-matrix set is a DataFrame of (id, ord, res, x0, y0, tile_w, tile_h); slabs have tpw x tph tiles. The set is small (one
row a level) and broadcast; everything else stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid

c = F.col


def with_levels(df: DataFrame, levels: DataFrame) -> DataFrame:
    return df.join(F.broadcast(levels), F.lit(True))


def slab_box(tpw: int, tph: int) -> Column:
    return grid.indices_to_bbox(c("col"), c("row"), c("x0"), c("y0"), c("res"), c("tile_w"), c("tile_h"), tpw, tph)


def bbox_slabs(boxes: DataFrame, levels: DataFrame, tpw: int, tph: int) -> DataFrame:
    """Slabs covered by each box (column box), one row a slab."""
    ix = grid.bbox_to_indices(c("box"), c("x0"), c("y0"), c("res"), c("tile_w"), c("tile_h"), tpw, tph)
    e = with_levels(boxes, levels).withColumn("ix", ix)
    return e.select("*", F.explode(F.sequence("ix.col_min", "ix.col_max")).alias("col")).select("*", F.explode(F.sequence("ix.row_min", "ix.row_max")).alias("row")).drop("ix")


def geom_slabs(boxes: DataFrame, levels: DataFrame, tpw: int, tph: int) -> DataFrame:
    """As bbox_slabs, for the slabs that meet the geometry itself; distinct."""
    met = bbox_slabs(boxes, levels, tpw, tph).filter(grid.intersects(c("box"), slab_box(tpw, tph)))
    return met.select("id", "col", "row", "x0", "y0", "res", "tile_w", "tile_h").distinct()


def gettile_params(layer: str = "LAYER") -> Column:
    return F.format_string(f"LAYER={layer}&TILEMATRIX=%d&TILECOL=%d&TILEROW=%d", "id", "col", "row")


def getmap_params(b: Column, inverted: Column) -> Column:
    f = "WIDTH=64&HEIGHT=64&BBOX=%.2f,%.2f,%.2f,%.2f"
    return F.when(inverted, F.format_string(f, b["ymin"], b["xmin"], b["ymax"], b["xmax"])).otherwise(F.format_string(f, b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def sql_insert(b: Column) -> Column:
    return F.format_string("INSERT INTO slabs (level, col, row, geom) VALUES (%d, %d, %d, '%s');", c("id"), c("col"), c("row"), grid.box_wkt(b))


def point_indices(points: DataFrame, levels: DataFrame, tpw: int, tph: int) -> DataFrame:
    e = with_levels(points, levels)
    return e.select("*", grid.x_to_col(c("x"), c("x0"), c("res"), c("tile_w"), tpw).alias("col"), grid.y_to_row(c("y"), c("y0"), c("res"), c("tile_h"), tph).alias("row"))
