"""Harvesting of web map services with a pluggable fetcher: the requests are rows, and so are the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slabs import BYTES_AT_ONCE, in_pieces

MAX_PIXELS = 2000
MAX_CUTS = 25

c = F.col


def cuts(width: int, height: int, max_pixels: int = MAX_PIXELS, max_cuts: int = MAX_CUTS) -> tuple[int, int]:
    """How many requests across and down a slab needs, each dividing it exactly; ValueError beyond max_cuts."""

    def of(n: int) -> int:
        return next(k for k in range(max(1, -(-n // max_pixels)), n + 1) if n % k == 0)

    across, down = of(width), of(height)
    if across * down > max_cuts:
        raise ValueError(f"{across * down} requests for a slab, more than {max_cuts}")
    return across, down


def requests(slabs: DataFrame, width: int, height: int, url: str, layer: str, crs: str, max_pixels: int = MAX_PIXELS, max_cuts: int = MAX_CUTS) -> DataFrame:
    """One row a request: slabs (slab, xmin, ymin, xmax, ymax) cut into equal parts, top row first."""
    across, down = cuts(width, height, max_pixels, max_cuts)
    e = slabs.select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("part_row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("part_col"))
    w, h = (c("xmax") - c("xmin")) / across, (c("ymax") - c("ymin")) / down
    box = [c("xmin") + c("part_col") * w, c("ymax") - (c("part_row") + 1) * h, c("xmin") + (c("part_col") + 1) * w, c("ymax") - c("part_row") * h]
    text = f"{url}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS={layer}&CRS={crs}&WIDTH={width // across}&HEIGHT={height // down}&FORMAT=image/png&BBOX=%s,%s,%s,%s"
    plain: Callable[[Column], Column] = lambda v: v.cast("decimal(24,6)").cast("string")
    return e.select("slab", "part_col", "part_row", F.format_string(text, *map(plain, box)).alias("url"))


def fetch(asked: DataFrame, get: Callable[[str], tuple[str, bytes]], tries: int = 3, kind: str = "image/") -> DataFrame:
    """Adds data and error. get(url) returns (content type, body) or raises; answers of another kind count as failures."""

    def answer(url: str) -> tuple[bytes | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                found, body = get(url)
            except Exception as e:  # noqa: BLE001 - a fetcher may raise anything; the row carries it
                error = f"{type(e).__name__}: {e}"
                continue
            if found.startswith(kind):
                return body, None
            error = f"answered {found}"
        return None, error

    @F.pandas_udf("data binary, error string")
    def run(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in urls:
            for out in in_pieces(map(answer, part), lambda x: 64 + len(x[0] or b""), BYTES_AT_ONCE):
                data, error = zip(*out, strict=True)
                yield pd.DataFrame({"data": pd.Series(data, dtype="object"), "error": pd.Series(error, dtype="object")})

    return asked.withColumn("_f", run("url")).select(*asked.columns, "_f.data", "_f.error")
