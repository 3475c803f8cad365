"""Coordinate systems in closed form: EPSG:4326 and EPSG:3857, their areas and box reprojection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
HALF = math.pi * RADIUS
METRES_PER_DEGREE = 111319.49079327358
#: Definition area in degrees of each coordinate system.
AREAS = {"EPSG:4326": (-180.0, -90.0, 180.0, 90.0), "EPSG:3857": (-180.0, -85.06, 180.0, 85.06)}


def lon_to_x(lon) -> Column:
    return lon * (HALF / 180)


def lat_to_y(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + lat * (math.pi / 360))) * RADIUS


def x_to_lon(x) -> Column:
    return x * (180 / HALF)


def y_to_lat(y) -> Column:
    return (2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2) * (180 / math.pi)


def to_metres(res, geographic) -> Column:
    """A resolution in metres: degrees are multiplied by the length of a degree at the equator."""
    return F.when(geographic, res * METRES_PER_DEGREE).otherwise(res)
