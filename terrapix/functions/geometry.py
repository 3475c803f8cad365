"""Polygons in WKT against boxes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_rings = re.compile(r"\(([^()]+)\)").findall


def rings(wkt: str) -> list[list[tuple[float, float]]]:
    return [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in _rings(wkt)]


def inside(x: float, y: float, parts: list[list[tuple[float, float]]]) -> bool:
    """Even-odd rule over all rings."""
    hit = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


def _cuts(p: tuple[float, float], q: tuple[float, float], box: tuple[float, float, float, float]) -> bool:
    """Does the segment meet the box?"""
    t0, t1 = 0.0, 1.0
    for a, d, lo, hi in ((p[0], q[0] - p[0], box[0], box[2]), (p[1], q[1] - p[1], box[1], box[3])):
        if d == 0:
            if a < lo or a > hi:
                return False
            continue
        u, v = sorted(((lo - a) / d, (hi - a) / d))
        t0, t1 = max(t0, u), min(t1, v)
        if t0 > t1:
            return False
    return True


def meets(wkt: str, box: tuple[float, float, float, float]) -> bool:
    parts = rings(wkt)
    return any(_cuts(p, q, box) for r in parts for p, q in zip(r, r[1:] + r[:1], strict=True)) or inside(box[0], box[1], parts)


@F.pandas_udf(BooleanType())
def polygon_meets_box(wkt: pd.Series, xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """Whether a polygon meets a box; the last filter after slab keys have been enumerated."""
    return pd.Series([meets(w, b) for w, *b in zip(wkt, xmin, ymin, xmax, ymax, strict=True)])
