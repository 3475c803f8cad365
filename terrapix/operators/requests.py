"""Map and tile requests: parsing, classification and ordered validation, many requests at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_kvp(text: Column) -> Column:
    """Entries (k, v) of a query string: keys in lower case, values decoded, control characters as _."""
    parts = F.filter(F.split(text, "&"), lambda x: F.instr(x, "=") > 1)
    decoded = lambda x: F.when(F.instr(x, "%") > 0, F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))).otherwise(x)
    clean = lambda x: F.regexp_replace(decoded(x), r"[\x00-\x1F\x7F]", "_")
    return F.transform(parts, lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("k"), clean(F.substr(x, F.instr(x, "=") + 1)).alias("v")))


def param(entries: Column, key: str) -> Column:
    """The first value of a key; null if absent."""
    return F.get(entries["v"], (F.array_position(entries["k"], key) - 1).cast("int"))


def options(text: Column) -> Column:
    """A map of k:v;k:v, in lower case."""
    return F.str_to_map(F.lower(text), F.lit(";"), F.lit(":"))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that does not hold, in order; null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in checks])


def classify(path: Column, service: Column, request: Column) -> Column:
    """SERVICE.Request of a request by its parameters or, for a tile map service, by its place after 1.0.0 in the path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    at = F.array_position(parts, "1.0.0")
    depth = F.size(parts) - at
    tms = F.when(at == 0, "TMS.Services").when(depth == 0, "TMS.Capabilities").when(depth == 1, "TMS.Layer").when((depth == 2) & (F.element_at(parts, -1) == "metadata.json"), "TMS.Metadata").when(depth == 4, "TMS.Tile").otherwise("TMS.Unknown")
    known = {"wms": ("getcapabilities", "getmap", "getfeatureinfo"), "wmts": ("getcapabilities", "gettile", "getfeatureinfo")}
    named = F.lit(None).cast("string")
    for s, requests in known.items():
        named = F.when(F.lower(service) == s, F.when(F.lower(request).isin(*requests), F.concat(F.upper(F.lit(s)), F.lit("."), F.lower(request))).when(F.lower(request) == "getversion", "OperationNotSupported").otherwise(F.concat(F.upper(F.lit(s)), F.lit(".unknown")))).otherwise(named)
    return F.coalesce(F.when(F.array_contains(parts, "tms"), tms), named, F.lit("unknown"))


def service_exception(code: Column, text: Column) -> Column:
    return F.concat(F.lit('<ServiceExceptionReport xmlns="http://www.opengis.net/ogc"><ServiceException code="'), code, F.lit('">'), text, F.lit("</ServiceException></ServiceExceptionReport>"))


def decimal_places(v: Column) -> Column:
    """Significant decimals of a number as it is written."""
    text = F.regexp_replace(v.cast("decimal(20,8)").cast("string"), "0+$", "")
    return F.length(F.substring_index(text, ".", -1))
