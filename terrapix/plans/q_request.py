"""Queries over requests, capabilities and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import raster, requests
from ..operators.shared import filtered_here, spread
from ..sources import slabs
from ..sources.tables import table, view
from .registry import query

c = F.col


def kvp(spark, d):
    """A request log: one query string an event."""
    e = spread(table(spark, d, "events").select("event_id", "user_id"), "event_id")
    i, u = c("event_id"), c("user_id")
    text = F.concat(F.lit("SERVICE=WMS&Request=GetMap&LAYERS=lay%5F"), (u % 7).cast("string"), F.lit("&layers=other&STYLES=s"), (i % 4).cast("string"), F.lit("&WIDTH="), (i % 11 * 100).cast("string"), F.lit("&HEIGHT="), (u % 13 * 100).cast("string"), F.lit("&CRS=EPSG:"), F.when(i % 5 == 0, "9999").otherwise("3857"), F.lit("&BBOX="), (i % 90).cast("string"), F.lit(","), (u % 90).cast("string"), F.lit(","), (i * 7 % 120).cast("string"), F.lit(",200&FORMAT=image%2F"), F.when(i % 9 == 0, "gif").otherwise("png"), F.lit("&VERSION="), F.when(i % 17 == 0, "1.0.0").otherwise("1.3.0"), F.lit("&I="), (u % 120 * 10).cast("string"), F.lit("&J="), (i % 70 * 10).cast("string"), F.lit("&QUERY_LAYERS=lay_"), ((u + i % 2) % 7).cast("string"))
    return e.select("event_id", "user_id", text.alias("text"))


KVP = """SELECT event_id, user_id, 'lay_' || (user_id % 7) AS layers, 's' || (event_id % 4) AS styles, event_id % 11 * 100 AS width, user_id % 13 * 100 AS height, 'EPSG:' || CASE WHEN event_id % 5 = 0 THEN '9999' ELSE '3857' END AS crs, event_id % 90 AS b0, user_id % 90 AS b1, event_id * 7 % 120 AS b2, 200 AS b3, 'image/' || CASE WHEN event_id % 9 = 0 THEN 'gif' ELSE 'png' END AS format, CASE WHEN event_id % 17 = 0 THEN '1.0.0' ELSE '1.3.0' END AS version, user_id % 120 * 10 AS i, event_id % 70 * 10 AS j, 'lay_' || ((user_id + event_id % 2) % 7) AS query_layers FROM events"""


def parsed(spark, d):
    p = kvp(spark, d).withColumn("p", requests.parse_kvp(c("text")))
    names = ["layers", "styles", "width", "height", "crs", "bbox", "format", "version", "i", "j", "query_layers"]
    p = p.select("event_id", "user_id", *[requests.param(c("p"), n).alias(n) for n in names])
    b = F.split("bbox", ",")
    return p.withColumns({**{f"b{k}": F.get(b, k).cast("long") for k in range(4)}, **{n: c(n).cast("long") for n in ("width", "height", "i", "j")}})


@query("req_parse_kvp", f"SELECT event_id, layers, styles, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, crs, format, version FROM ({KVP}) q")
def req_parse_kvp(spark, d):
    return parsed(spark, d).select("event_id", "layers", "styles", "width", "height", "crs", "format", "version")


def _map_checks():
    return [
        (c("version").isin("1.3.0", "1.1.1"), "InvalidVersion"),
        (c("layers").isin("lay_0", "lay_1", "lay_2", "lay_3", "lay_4"), "LayerNotDefined"),
        (c("width").between(1, 1000), "InvalidWidth"),
        (c("height").between(1, 1000), "InvalidHeight"),
        (c("crs").isin("EPSG:3857", "EPSG:4326"), "InvalidCRS"),
        ((c("b0") < c("b2")) & (c("b1") < c("b3")), "InvalidBBox"),
        (c("format").isin("image/png", "image/jpeg", "image/tiff", "image/x-bil;bits=32", "text/asc"), "InvalidFormat"),
        (c("styles").isin("", "s0", "s1", "s2"), "StyleNotDefined"),
    ]


MAP_CASES = "WHEN version NOT IN ('1.3.0', '1.1.1') THEN 'InvalidVersion' WHEN layers IN ('lay_5', 'lay_6') THEN 'LayerNotDefined' WHEN width NOT BETWEEN 1 AND 1000 THEN 'InvalidWidth' WHEN height NOT BETWEEN 1 AND 1000 THEN 'InvalidHeight' WHEN crs = 'EPSG:9999' THEN 'InvalidCRS' WHEN b0 >= b2 OR b1 >= b3 THEN 'InvalidBBox' WHEN format = 'image/gif' THEN 'InvalidFormat' WHEN styles = 's3' THEN 'StyleNotDefined'"


@query("req_validate_getmap", f"SELECT event_id, CASE {MAP_CASES} END AS error FROM ({KVP}) q")
def req_validate_getmap(spark, d):
    return parsed(spark, d).select("event_id", requests.first_failure(*_map_checks()).alias("error"))


@query("req_validate_gfi_wms", f"SELECT event_id, CASE {MAP_CASES} WHEN query_layers <> layers THEN 'LayerNotQueryable' WHEN layers = 'lay_3' THEN 'LayerNotQueryable' WHEN i >= width OR j >= height THEN 'InvalidPoint' END AS error FROM ({KVP}) q")
def req_validate_gfi_wms(spark, d):
    more = [(F.array_contains(F.split("layers", ","), c("query_layers")), "LayerNotQueryable"), (c("query_layers") != "lay_3", "LayerNotQueryable"), ((c("i") >= 0) & (c("i") < c("width")) & (c("j") >= 0) & (c("j") < c("height")), "InvalidPoint")]
    return parsed(spark, d).select("event_id", requests.first_failure(*_map_checks(), *more).alias("error"))


@query("join_gfi_query_layers", f"SELECT event_id FROM ({KVP}) q WHERE query_layers = layers")
def join_gfi_query_layers(spark, d):
    return parsed(spark, d).filter(F.array_contains(F.split("layers", ","), c("query_layers"))).select("event_id")


TILE = "SELECT event_id, user_id % 7 AS layer, event_id % 6 AS tm, event_id % 70 AS col, user_id % 70 AS row, event_id % 3 AS fmt FROM events"


def tiles(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", (c("user_id") % 7).alias("layer"), (c("event_id") % 6).alias("tm"), (c("event_id") % 70).alias("col"), (c("user_id") % 70).alias("row"), (c("event_id") % 3).alias("fmt"))


def limits(spark, d):
    """Tile limits of each level of one pyramid: a few rows."""
    s = view(spark, d, "f_slab").filter("pyr = 'A'").groupBy((c("lvl") - 1).cast("long").alias("tm"))
    return s.agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))


LIMITS = "SELECT CAST(lvl - 1 AS BIGINT) AS tm, min(col) AS c0, max(col) AS c1, min(row) AS r0, max(row) AS r1 FROM f_slab WHERE pyr = 'A' GROUP BY 1"

# The parameters of tile requests, in the order in which they are checked; every twelfth request lacks the first, and so on.
WMTS = {
    "version": "CASE WHEN user_id % 13 = 0 THEN '9' ELSE '1.0.0' END",
    "layer": "'lay' || (user_id % 7)",
    "tilematrixset": "CASE event_id % 17 WHEN 0 THEN 'NONE' WHEN 1 THEN 'OTHER' ELSE 'GRID' END",
    "tilematrix": "CAST(event_id % 6 AS VARCHAR(9))",
    "tilerow": "CASE WHEN event_id % 19 = 0 THEN 'a1' ELSE CAST(user_id % 70 AS VARCHAR(9)) END",
    "tilecol": "CASE WHEN event_id % 23 = 0 THEN 'x' ELSE CAST(event_id % 70 AS VARCHAR(9)) END",
    "format": "CASE WHEN event_id % 3 = 2 THEN 'image/jpeg' ELSE 'image/png' END",
    "style": "CASE WHEN user_id % 11 = 0 THEN 'odd' ELSE 'normal' END",
}
_bad = {"version": "user_id % 13 = 0", "layer": "user_id % 7 = 6", "tilematrixset": "event_id % 17 < 2", "tilematrix": "event_id % 6 = 5", "tilerow": "event_id % 19 = 0", "tilecol": "event_id % 23 = 0", "format": "event_id % 3 = 2", "style": "user_id % 11 = 0"}
_said = {"tilematrixset": "CASE WHEN event_id % 17 = 1 THEN 'Missing' ELSE 'Invalid' END || 'ParameterValue tilematrixset'"}
_WMTS_CASES = " ".join(f"WHEN event_id % 12 = {k} THEN 'MissingParameterValue {n}' WHEN {_bad[n]} THEN {_said.get(n, repr(f'InvalidParameterValue {n}'))}" for k, n in enumerate(WMTS))
WMTS_SQL = f"SELECT event_id, CASE {_WMTS_CASES} WHEN c0 IS NULL OR NOT (event_id % 70 BETWEEN c0 AND c1 AND user_id % 70 BETWEEN r0 AND r1) THEN 'TileOutOfRange' END AS error FROM events e LEFT JOIN ({LIMITS}) l ON l.tm = e.event_id % 6"


@query("req_validate_gettile_wmts", WMTS_SQL)
def req_validate_gettile_wmts(spark, d):
    """Each parameter present, known and of its kind, in order; a grid that is not the layer's counts as a missing one; then the tile within the level's limits."""
    parts = [F.when(c("event_id") % 12 != k, F.concat(F.lit(f"{n.upper()}="), F.expr(v))) for k, (n, v) in enumerate(WMTS.items())]
    asked = table(spark, d, "events").select("event_id", F.concat_ws("&", F.lit("SERVICE=WMTS&REQUEST=GetTile"), *parts).alias("text"))
    e = asked.select("event_id", requests.parse_kvp(c("text")).alias("kv")).select("event_id", *[requests.param(c("kv"), n).alias(n) for n in WMTS])
    known = {
        "version": c("version").contains("1.0.0"),
        "layer": c("layer").isin(*[f"lay{k}" for k in range(6)]),
        "tilematrixset": c("tilematrixset").isin("GRID", "OTHER"),
        "tilematrix": c("tilematrix").isin(*map(str, range(5))),
        "tilerow": c("tilerow").rlike(r"^\s*[+-]?[0-9]"),
        "tilecol": c("tilecol").rlike(r"^\s*[+-]?[0-9]"),
        "format": c("format") == "image/png",
        "style": c("style") == "normal",
    }
    checks = []
    for n, ok in known.items():
        checks += [(F.coalesce(c(n), F.lit("")) != "", f"MissingParameterValue {n}"), (ok, f"InvalidParameterValue {n}")]
        if n == "tilematrixset":
            checks.append((c(n) == "GRID", f"MissingParameterValue {n}"))
    number = lambda n: F.regexp_extract(n, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    t = e.withColumns({"tm": c("tilematrix").try_cast("long"), "col": number("tilecol"), "row": number("tilerow")}).join(F.broadcast(limits(spark, d)), "tm", "left")
    checks.append((c("col").between(c("c0"), c("c1")) & c("row").between(c("r0"), c("r1")), "TileOutOfRange"))
    return t.select("event_id", requests.first_failure(*checks).alias("error"))


TMS_SQL = f"SELECT event_id, CASE WHEN layer >= 6 THEN '404 layer' WHEN t.tm >= 5 THEN '404 level' WHEN event_id % 23 = 0 OR event_id % 19 = 0 THEN '404 number' WHEN fmt = 2 THEN '404 format' WHEN c0 IS NULL OR NOT (col BETWEEN c0 AND c1 AND row BETWEEN r0 AND r1) THEN '404 tile' END AS error FROM ({TILE}) t LEFT JOIN ({LIMITS}) l ON l.tm = t.tm"


@query("req_validate_gettile_tms", TMS_SQL)
def req_validate_gettile_tms(spark, d):
    """A tile named by its path: layer, level, column, row and kind of file."""
    number = lambda k, n: F.when(c("event_id") % k == 0, "x1").otherwise(c(n).cast("string"))
    kind = F.when(c("fmt") == 2, ".jpg").otherwise(".png")
    path = F.concat_ws("/", F.lit("/tms/1.0.0"), F.concat(F.lit("lay"), c("layer").cast("string")), c("tm").cast("string"), number(23, "col"), F.concat(number(19, "row"), kind))
    p = tiles(spark, d).select("event_id", F.slice(F.split(path, "/"), 4, 4).alias("p"))
    last = F.split(F.get("p", F.lit(3)), r"\.")
    e = p.select("event_id", F.get("p", F.lit(0)).alias("layer"), F.get("p", F.lit(1)).try_cast("long").alias("tm"), F.get("p", F.lit(2)).try_cast("long").alias("col"), F.get(last, F.lit(0)).try_cast("long").alias("row"), F.get(last, F.lit(1)).alias("kind"))
    t = e.join(F.broadcast(limits(spark, d)), "tm", "left")
    checks = [(c("layer").isin(*[f"lay{k}" for k in range(6)]), "404 layer"), (c("tm").between(0, 4), "404 level"), (c("col").isNotNull() & c("row").isNotNull(), "404 number"), (c("kind") == "png", "404 format"), (c("col").between(c("c0"), c("c1")) & c("row").between(c("r0"), c("r1")), "404 tile")]
    return t.select("event_id", requests.first_failure(*checks).alias("error"))


@query("req_validate_gfi_wmts", f"SELECT event_id, CASE WHEN layer >= 6 THEN 'LayerNotDefined' WHEN layer = 3 THEN 'LayerNotQueryable' WHEN (event_id % 300) >= 256 THEN 'PointIJOutOfRange' END AS error FROM ({TILE}) t")
def req_validate_gfi_wmts(spark, d):
    return tiles(spark, d).select("event_id", requests.first_failure((c("layer") < 6, "LayerNotDefined"), (c("layer") != 3, "LayerNotQueryable"), (c("event_id") % 300 < 256, "PointIJOutOfRange")).alias("error"))


@query("req_tile_in_limits", f"SELECT event_id FROM ({TILE}) t JOIN ({LIMITS}) l ON l.tm = t.tm WHERE col BETWEEN c0 AND c1 AND row BETWEEN r0 AND r1")
def req_tile_in_limits(spark, d):
    return tiles(spark, d).join(F.broadcast(limits(spark, d)), "tm").filter("col BETWEEN c0 AND c1 AND row BETWEEN r0 AND r1").select("event_id")


@query("req_format_options", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'lzw' ELSE 'deflate' END AS compression, CAST(event_id % 5 AS VARCHAR) AS level FROM events")
def req_format_options(spark, d):
    text = F.concat(F.lit("COMPRESSION:"), F.when(c("event_id") % 3 == 0, "LZW").otherwise("Deflate"), F.lit(";Level:"), (c("event_id") % 5).cast("string"))
    return table(spark, d, "events").select("event_id", requests.options(text).alias("o")).select("event_id", c("o")["compression"].alias("compression"), c("o")["level"].alias("level"))


PATHS = ["/tms/1.0.0", "/tms/1.0.0/lay", "/tms/1.0.0/lay/metadata.json", "/tms/1.0.0/lay/3/4/5.png", "/tms", "/wms", "/wmts", "/tms/1.0.0/a/b/c/d/e"]
KINDS = ["TMS.Capabilities", "TMS.Layer", "TMS.Metadata", "TMS.Tile", "TMS.Services", None, None, "TMS.Unknown"]


@query("req_classify", f"SELECT event_id, CASE WHEN event_id % 8 = 5 THEN CASE WHEN user_id % 3 = 0 THEN 'WMS.getmap' WHEN user_id % 3 = 1 THEN 'OperationNotSupported' ELSE 'WMS.unknown' END WHEN event_id % 8 = 6 THEN CASE WHEN user_id % 3 = 0 THEN 'WMTS.unknown' WHEN user_id % 3 = 1 THEN 'OperationNotSupported' ELSE 'WMTS.gettile' END ELSE list_extract({[k or '' for k in KINDS]}, CAST(event_id % 8 + 1 AS BIGINT)) END AS kind FROM events")
def req_classify(spark, d):
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    path = pick(PATHS, c("event_id") % 8)
    service = F.when(c("event_id") % 8 == 5, "WMS").when(c("event_id") % 8 == 6, "WMTS")
    return table(spark, d, "events").select("event_id", requests.classify(path, service, pick(["GetMap", "GetVersion", "GetTile"], c("user_id") % 3)).alias("kind"))


# ---- answers -------------------------------------------------------------------------------------------------------

@query("q_gettile", f"SELECT t.event_id, s.prio FROM ({TILE}) t JOIN f_slab s ON s.pyr = 'A' AND s.lvl = t.tm + 1 AND s.col = t.col // 4 AND s.row = t.row // 4 JOIN ({LIMITS}) l ON l.tm = t.tm WHERE t.col // 4 BETWEEN c0 AND c1 AND t.row // 4 BETWEEN r0 AND r1")
def q_gettile(spark, d):
    """Validated against the limits, then an equality lookup on the slab inventory; tiles are not decoded."""
    t = tiles(spark, d).withColumns({"sc": F.floor(c("col") / 4), "sr": F.floor(c("row") / 4)}).join(F.broadcast(limits(spark, d)), "tm")
    t = t.filter("sc BETWEEN c0 AND c1 AND sr BETWEEN r0 AND r1").select("event_id", (c("tm") + 1).cast("int").alias("lvl"), c("sc").alias("col"), c("sr").alias("row"))
    return t.join(view(spark, d, "f_slab").filter("pyr = 'A'").select("lvl", "col", "row", "prio"), ["lvl", "col", "row"]).select("event_id", "prio")


ODS_SQL = "SELECT col, row, CASE WHEN b.z IS NOT NULL THEN b.z ELSE a.z END AS z FROM f_dem a LEFT JOIN (SELECT col, row, z * 2 AS z FROM f_dem WHERE mask <> 0 AND col BETWEEN 20 AND 80) b USING (col, row)"


@query("q_gettile_ondemand", f"SELECT col, row, CAST(z AS FLOAT)::DOUBLE AS z FROM ({ODS_SQL}) o")
def q_gettile_ondemand(spark, d):
    """Tiles of 15 x 10 made when asked for: the level's sources merged, later ones on top, then encoded; here decoded again."""
    tiles = slabs.encode_tiles(slabs.tile_samples(join_ods_sources(spark, d), ["z"], 15, 10), 15, 10, 1, "float32", "zip")
    return slabs.cells_of(slabs.decode_tiles(tiles, 15, 10, 1, "float32", "zip"), ["z"], 15, 10, "double")


@query("q_gfi_pyramid", "SELECT event_id, r, g, b FROM f_rgb p JOIN (SELECT event_id, user_id % 100 AS col, event_id % 30 AS row FROM events) e ON e.col = p.col AND e.row = p.row")
def q_gfi_pyramid(spark, d):
    e = table(spark, d, "events").select("event_id", (c("user_id") % 100).alias("col"), (c("event_id") % 30).alias("row"))
    return e.join(view(spark, d, "f_rgb").select("col", "row", *"rgb"), ["col", "row"]).select("event_id", *"rgb")


_g = lambda *vs: ", ".join(f"regexp_replace(CAST({v} AS VARCHAR), '[.]0$', '')" for v in vs)
_GFI = "'http://host/wms?REQUEST=GetFeatureInfo&VERSION=1.3.0&CRS=' || crs || '&BBOX=' || concat_ws(',', {box}) || '&I=' || (pt_id % 256)"
EXTERNAL_SQL = f"SELECT pt_id, CASE WHEN crs = 'EPSG:4326' THEN {_GFI.format(box=_g('lat', 'lon', 'lat + 1', 'lon + 1'))} ELSE {_GFI.format(box=_g('lon', 'lat', 'lon + 1', 'lat + 1'))} END AS url FROM (SELECT *, CASE WHEN pt_id % 2 = 0 THEN 'EPSG:4326' ELSE 'CRS:84' END AS crs FROM f_point) p"


def as_written(v):
    """A number of less than seven digits before the point in the fewest digits that give it back."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


@query("q_gfi_external", EXTERNAL_SQL)
def q_gfi_external(spark, d):
    """Feature info passed on to another service: the axes are swapped for the systems that put latitude first."""
    p = view(spark, d, "f_point").withColumn("crs", F.when(c("pt_id") % 2 == 0, "EPSG:4326").otherwise("CRS:84"))
    x, y = (c("lon"), c("lon") + 1), (c("lat"), c("lat") + 1)
    box = lambda *vs: F.concat_ws(",", *map(as_written, vs))
    bbox = F.when(c("crs") == "EPSG:4326", box(y[0], x[0], y[1], x[1])).otherwise(box(x[0], y[0], x[1], y[1]))
    return p.select("pt_id", F.concat(F.lit("http://host/wms?REQUEST=GetFeatureInfo&VERSION=1.3.0&CRS="), "crs", F.lit("&BBOX="), bbox, F.lit("&I="), (c("pt_id") % 256).cast("string")).alias("url"))


# The four formats of feature info.
GFI_SQL = "SELECT event_id, r || ' ' || g || ' ' || b AS plain, '<html><body><b>FeatureInfo :</b><br><ul><ul>' || r || '</ul><ul>' || g || '</ul><ul>' || b || '</ul></ul></body></html>' AS html, '<FeatureInfo><value>' || r || '</value><value>' || g || '</value><value>' || b || '</value></FeatureInfo>' AS xml, '{\"featureInfo\":[' || r || ', ' || g || ', ' || b || ']}' AS js FROM (SELECT r, g, b, col + 100 * row AS event_id FROM f_rgb) q"


@query("sink_gfi", GFI_SQL)
def sink_gfi(spark, d):
    """The values of a pixel as text, HTML, XML and JSON."""
    v = view(spark, d, "f_rgb").select((c("col") + 100 * c("row")).alias("event_id"), F.array(*[c(n).cast("string") for n in "rgb"]).alias("vs"))
    wrapped = lambda a, b: F.array_join(F.transform("vs", lambda x: F.concat(F.lit(a), x, F.lit(b))), "")
    html = F.concat(F.lit("<html><body><b>FeatureInfo :</b><br><ul>"), wrapped("<ul>", "</ul>"), F.lit("</ul></body></html>"))
    xml = F.concat(F.lit("<FeatureInfo>"), wrapped("<value>", "</value>"), F.lit("</FeatureInfo>"))
    js = F.concat(F.lit('{"featureInfo":['), F.array_join("vs", ", "), F.lit("]}"))
    return v.select("event_id", F.array_join("vs", " ").alias("plain"), html.alias("html"), xml.alias("xml"), js.alias("js"))


@query("sink_exception", f"SELECT event_id, '<ServiceExceptionReport xmlns=\"http://www.opengis.net/ogc\"><ServiceException code=\"' || error || '\">event ' || event_id || '</ServiceException></ServiceExceptionReport>' AS body FROM (SELECT event_id, CASE {MAP_CASES} END AS error FROM ({KVP}) q) e WHERE error IS NOT NULL")
def sink_exception(spark, d):
    bad = filtered_here(req_validate_getmap(spark, d), c("error").isNotNull())
    return bad.select("event_id", requests.service_exception(c("error"), F.concat(F.lit("event "), c("event_id").cast("string"))).alias("body"))


LAYER = "SELECT img_id, res, xmin / 40 - 50 AS xmin, ymin / 40 - 50 AS ymin, xmax / 40 - 50 AS xmax, ymax / 40 - 50 AS ymax FROM f_img"
CRS = [("EPSG:4326", -180.0, -90.0, 180.0, 90.0), ("TEST:A", -20.0, -20.0, 30.0, 20.0), ("TEST:B", 40.0, -50.0, 90.0, 10.0)]
CRS_SQL = ", ".join(f"('{n}', {a}, {b}, {x}, {y})" for n, a, b, x, y in CRS)


CAPABILITIES_SQL = f"SELECT img_id, code, printf('<Layer><Name>%d</Name><BoundingBox CRS=\"%s\" minx=\"%.4f\" miny=\"%.4f\" maxx=\"%.4f\" maxy=\"%.4f\"/><MinScaleDenominator>%.4f</MinScaleDenominator><MaxScaleDenominator>%.4f</MaxScaleDenominator></Layer>', img_id, code, greatest(xmin, a), greatest(ymin, b), least(xmax, x), least(ymax, y), res / 0.00028::DOUBLE, res * 16 / 0.00028::DOUBLE) AS body FROM ({LAYER}) l, (VALUES {CRS_SQL}) k(code, a, b, x, y) WHERE xmin <= x AND xmax >= a AND ymin <= y AND ymax >= b"


@query("q_wms_capabilities", CAPABILITIES_SQL)
def q_wms_capabilities(spark, d):
    """Each layer's element in each coordinate system whose area its box meets: the box cropped to the area, and the scales of its finest and coarsest level."""
    side = lambda n: (c(n) / 40 - 50).alias(n)
    systems = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("code", "a", "b", "x", "y"), k, strict=True)]) for k in CRS])
    each = view(spark, d, "f_img").select("img_id", "res", *[side(n) for n in ("xmin", "ymin", "xmax", "ymax")], F.explode(systems).alias("k")).select("*", "k.*")
    hit = each.filter("xmin <= x AND xmax >= a AND ymin <= y AND ymax >= b")
    form = '<Layer><Name>%d</Name><BoundingBox CRS="%s" minx="%.4f" miny="%.4f" maxx="%.4f" maxy="%.4f"/><MinScaleDenominator>%.4f</MinScaleDenominator><MaxScaleDenominator>%.4f</MaxScaleDenominator></Layer>'
    box = [F.bround(v, 4) for v in (F.greatest("xmin", "a"), F.greatest("ymin", "b"), F.least("xmax", "x"), F.least("ymax", "y"))]
    return hit.select("img_id", "code", F.format_string(form, "img_id", "code", *box, F.bround(c("res") / 0.00028, 4), F.bround(c("res") * 16 / 0.00028, 4)).alias("body"))


@query("q_wmts_capabilities", "SELECT pyr, id, min(col) AS min_col, max(col) AS max_col, min(row) AS min_row, max(row) AS max_row, max(res / 0.00028) AS scale FROM f_slab s JOIN f_tm t ON s.lvl - 1 = t.ord GROUP BY pyr, id")
def q_wmts_capabilities(spark, d):
    s = view(spark, d, "f_slab").groupBy("pyr", "lvl").agg(F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.min("row").alias("min_row"), F.max("row").alias("max_row"))
    return s.join(F.broadcast(view(spark, d, "f_tm")), c("lvl") - 1 == c("ord")).select("pyr", "id", "min_col", "max_col", "min_row", "max_row", (c("res") / 0.00028).alias("scale"))


@query("q_tms_services", "SELECT '<TileMapService title=\"TMS\" version=\"1.0.0\" href=\"http://host/tms/1.0.0\"/>' AS body")
def q_tms_services(spark, d):
    return spark.range(1).select(F.lit('<TileMapService title="TMS" version="1.0.0" href="http://host/tms/1.0.0"/>').alias("body"))


@query("q_tms_capabilities", "SELECT DISTINCT pyr, '<TileMap title=\"' || pyr || '\" href=\"http://host/tms/1.0.0/' || pyr || '\"/>' AS body FROM f_slab")
def q_tms_capabilities(spark, d):
    p = view(spark, d, "f_slab").select("pyr").distinct()
    return p.select("pyr", F.concat(F.lit('<TileMap title="'), c("pyr"), F.lit('" href="http://host/tms/1.0.0/'), c("pyr"), F.lit('"/>')).alias("body"))


@query("q_tms_layer", "SELECT DISTINCT pyr, id, printf('<TileSet href=\"%s/%d\" units-per-pixel=\"%.4f\" order=\"%d\"/>', pyr, id, res, ord) AS body FROM f_slab s JOIN f_tm t ON s.lvl - 1 = t.ord")
def q_tms_layer(spark, d):
    p = view(spark, d, "f_slab").select("pyr", "lvl").distinct().join(F.broadcast(view(spark, d, "f_tm")), c("lvl") - 1 == c("ord"))
    return p.select("pyr", "id", F.format_string('<TileSet href="%s/%d" units-per-pixel="%.4f" order="%d"/>', "pyr", "id", "res", "ord").alias("body"))


@query("q_tms_metadata", "SELECT pyr, '{\"name\":\"' || pyr || '\",\"minzoom\":' || min(id) || ',\"maxzoom\":' || max(id) || '}' AS body FROM f_slab s JOIN f_tm t ON s.lvl - 1 = t.ord GROUP BY pyr")
def q_tms_metadata(spark, d):
    p = view(spark, d, "f_slab").select("pyr", "lvl").distinct().join(F.broadcast(view(spark, d, "f_tm")), c("lvl") - 1 == c("ord"))
    g = p.groupBy("pyr").agg(F.min("id").alias("minzoom"), F.max("id").alias("maxzoom"))
    return g.select("pyr", F.to_json(F.struct(c("pyr").alias("name"), "minzoom", "maxzoom")).alias("body"))


@query("q_decimal_places", "SELECT img_id, CAST(len(split_part(rtrim(CAST(CAST(xmin / 16 AS DECIMAL(20, 8)) AS VARCHAR), '0'), '.', 2)) AS INT) AS n FROM f_img")
def q_decimal_places(spark, d):
    return view(spark, d, "f_img").select("img_id", requests.decimal_places(c("xmin") / 16).alias("n"))


@query("q_version", "SELECT 'OperationNotSupported' AS code, 501 AS status")
def q_version(spark, d):
    return spark.range(1).select(F.lit("OperationNotSupported").alias("code"), F.lit(501).alias("status"))


# ---- layers of a request: the whole of a map, for many requests at once -----------------------------------------------


@query("join_request_tiles", "SELECT q.img_id, tc, tr, greatest(px0 - tc * 16, 0) AS crop_left, greatest(py0 - tr * 16, 0) AS crop_top, greatest((tc + 1) * 16 - px1, 0) AS crop_right, greatest((tr + 1) * 16 - py1, 0) AS crop_bottom FROM (SELECT *, unnest(range(px0 // 16, (px1 - 1) // 16 + 1)) AS tc FROM (SELECT img_id, CAST(floor(xmin / 8) AS BIGINT) AS px0, CAST(floor(ymin / 8) AS BIGINT) AS py0, CAST(floor(xmax / 8) AS BIGINT) + 1 AS px1, CAST(floor(ymax / 8) AS BIGINT) + 1 AS py1 FROM f_img) a) q, LATERAL (SELECT unnest(range(py0 // 16, (py1 - 1) // 16 + 1)) AS tr) z")
def join_request_tiles(spark, d):
    w = view(spark, d, "f_img").select("img_id", F.floor(c("xmin") / 8).alias("px0"), F.floor(c("ymin") / 8).alias("py0"), (F.floor(c("xmax") / 8) + 1).alias("px1"), (F.floor(c("ymax") / 8) + 1).alias("py1"))
    t = lambda n: grid.euclid(c(n), 16)
    e = w.select("*", F.explode(F.sequence(t("px0"), grid.euclid(c("px1") - 1, 16))).alias("tc")).select("*", F.explode(F.sequence(t("py0"), grid.euclid(c("py1") - 1, 16))).alias("tr"))
    zero = F.lit(0).cast("long")
    return e.select("img_id", "tc", "tr", F.greatest(c("px0") - c("tc") * 16, zero).alias("crop_left"), F.greatest(c("py0") - c("tr") * 16, zero).alias("crop_top"), F.greatest((c("tc") + 1) * 16 - c("px1"), zero).alias("crop_right"), F.greatest((c("tr") + 1) * 16 - c("py1"), zero).alias("crop_bottom"))


@query("join_layer_style_pyramid", "SELECT e.event_id, t.res, s.n AS slabs FROM events e JOIN f_tm t ON t.ord = e.event_id % 5 LEFT JOIN (SELECT lvl, count(*) AS n FROM f_slab GROUP BY lvl) s ON s.lvl = t.ord + 1")
def join_layer_style_pyramid(spark, d):
    slabs = view(spark, d, "f_slab").groupBy("lvl").agg(F.count("*").alias("slabs"))
    dims = view(spark, d, "f_tm").join(slabs, c("lvl") == c("ord") + 1, "left").select("ord", "res", "slabs")
    return table(spark, d, "events").join(F.broadcast(dims), c("event_id") % 5 == c("ord")).select("event_id", "res", "slabs")


@query("join_ods_sources", ODS_SQL)
def join_ods_sources(spark, d):
    """Sources of an on-demand level, later ones on top, each within its own area."""
    dem = view(spark, d, "f_dem")
    a = dem.select("col", "row", "z", F.lit(255).alias("mask"), F.lit(0).alias("ord"))
    b = dem.filter("mask <> 0 AND col BETWEEN 20 AND 80").select("col", "row", (c("z") * 2).alias("z"), "mask", F.lit(1).alias("ord"))
    return raster.top_wins(a.unionByName(b), ["col", "row"], "ord", ["z"]).select("col", "row", "z")



