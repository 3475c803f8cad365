"""Column functions over samples: casts, channel conversion, kernels, palettes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_u8(v: Column) -> Column:
    """v + 0.5 truncated towards zero, held within 0..255."""
    return F.least(F.greatest((v + 0.5).cast("int"), F.lit(0)), F.lit(255))


def to_u16(v: Column) -> Column:
    return F.least(F.greatest((v + 0.5).cast("int"), F.lit(0)), F.lit(65535))


# The two sets of luminance weights.
GRAY = (0.2125, 0.7154, 0.0721)
GRAY_ROUNDED = (0.2126, 0.7152, 0.0722)


def gray(r, g, b) -> Column:
    """Luminance, truncated."""
    return (GRAY[0] * r + GRAY[1] * g + GRAY[2] * b).cast("int")


def gray_rounded(r, g, b) -> Column:
    """Luminance, rounded half up; the variant of on-demand tiles."""
    return F.floor(GRAY_ROUNDED[0] * r + GRAY_ROUNDED[1] * g + GRAY_ROUNDED[2] * b + 0.5).cast("int")


def convert(bands: list[Column], to: int, alpha: int = 255) -> list[Column]:
    """1..4 bands (gray, gray and alpha, rgb, rgb and alpha) as 1..4 bands."""
    n = len(bands)
    a = bands[-1] if n in (2, 4) else F.lit(alpha)
    rgb = bands[:3] if n >= 3 else [bands[0]] * 3
    if to <= 2:
        return [gray(*rgb) if n >= 3 else bands[0], *[a] * (to == 2)]
    return [*rgb, *[a] * (to == 4)]


# The half-width of each kernel at ratio 1.
RADIUS = {"nn": 0.5, "linear": 1.0, "bicubic": 2.0, "lanczos_2": 2.0, "lanczos_3": 3.0, "lanczos_4": 4.0}


def kernel(name: str, d: Column) -> Column:
    """Unnormalised weight at distance d >= 0 in source pixels of ratio 1."""
    if name == "nn":
        return F.lit(1.0)
    if name == "linear":
        return F.greatest(1 - d, F.lit(0.0))
    if name == "bicubic":
        near = 1 + d * d * (-2.5 + 1.5 * d)
        far = 2 + d * (-4 + d * (2.5 - 0.5 * d))
        return F.when(d <= 1, near).when(d <= 2, far).otherwise(0.0)
    size = float(name[-1])
    x = d * math.pi
    return F.when(d < 1e-9, 1.0).when(d >= size, 0.0).otherwise(F.sin(x) * F.sin(x / size) / (x * x / size))


def taps(name: str, centre: Column, ratio: float, count) -> Column:
    """Array of (i, w): the source samples, of count, that an output sample centred at centre uses; the weights sum to 1.

    The support is as wide as the kernel at this ratio, and shrinks near a border so that it stays centred.
    """
    base = RADIUS[name]
    wide = math.ceil(2 * base * (1.0 if name == "nn" else max(1.0, ratio)) - 1e-7)
    count = count if isinstance(count, Column) else F.lit(count)
    first = lambda x, r: F.ceil(x - r - 1e-7)
    length = lambda r: F.ceil(2 * r - 1e-7)
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  # value is computed once
    pack = lambda x, r, lo, n: F.struct(x.alias("x"), r.cast("double").alias("r"), lo.cast("long").alias("lo"), n.cast("long").alias("n"))

    def from_left(p: Column) -> Column:
        x, left = p["x"], first(p["x"], F.lit(wide / 2)) < 0
        return pack(x, F.when(left, F.abs(x)).otherwise(wide / 2), F.greatest(first(x, F.lit(wide / 2)), F.lit(0)), F.when(left, length(F.abs(x))).otherwise(wide))

    def from_right(p: Column) -> Column:
        x, right, r = p["x"], p["lo"] + p["n"] > count, F.abs(count - 1 - p["x"])
        return pack(x, F.when(right, r).otherwise(p["r"]), F.when(right, first(x, r)).otherwise(p["lo"]), F.when(right, length(r)).otherwise(p["n"]))

    def weigh(p: Column) -> Column:
        one = F.array(F.struct(F.least(F.greatest(p["lo"], F.lit(0)), count - 1).cast("int").alias("i"), F.lit(1.0).alias("w")))
        raw = F.transform(F.sequence(p["lo"].cast("int"), (p["lo"] + p["n"] - 1).cast("int")), lambda i: F.struct(i.alias("i"), kernel(name, F.abs(p["x"] - i) * (base / p["r"])).alias("w")))
        raw = F.filter(raw, lambda t: t["i"] < p["x"] + p["r"])
        shared = lambda q: F.transform(q["raw"], lambda t: F.struct(t["i"].alias("i"), (t["w"] / q["sum"]).alias("w")))
        summed = lambda q: F.struct(q.alias("raw"), F.aggregate(q, F.lit(0.0), lambda acc, t: acc + t["w"]).alias("sum"))
        return F.when(p["n"] <= 1, one).otherwise(let(let(raw, summed), shared))

    return let(let(let(F.struct(centre.cast("double").alias("x")), from_left), from_right), weigh)


def palette(v: Column, stops: list[tuple[float, tuple[float, ...]]], smooth: bool) -> list[Column]:
    """Bands of a palette at v: the stop at or below v, or linear between it and the next; the end stops hold beyond."""
    out = []
    for band in range(len(stops[0][1])):
        c = F.when(v < stops[0][0], F.lit(float(stops[0][1][band])))
        for (lo, a), (hi, b) in zip(stops, stops[1:], strict=False):
            x = F.lit(float(a[band]))
            if smooth:
                x = x + (v - lo) / (hi - lo) * (b[band] - a[band])
            c = c.when(v < hi, x)
        out.append(c.otherwise(F.lit(float(stops[-1][1][band]))))
    return out
