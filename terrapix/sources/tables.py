"""Rasters, slabs, images and points derived from the base tables: a DataFrame and a SQL text for each view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "f_dem": "SELECT CAST(o_orderkey % 150 AS BIGINT) AS col, CAST((o_orderkey - o_orderkey % 150) / 150 AS BIGINT) AS row, o_totalprice / 100 AS z, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 255 END AS mask FROM orders",
    "f_rgb": "SELECT CAST(event_id % 100 AS BIGINT) AS col, CAST((event_id - event_id % 100) / 100 AS BIGINT) AS row, CAST((event_id * 7 + user_id) % 256 AS INT) AS r, CAST((event_id * 13) % 256 AS INT) AS g, CAST((user_id * 31) % 256 AS INT) AS b, CAST((event_id * 5) % 256 AS INT) AS a, event_type AS src FROM events",
    "f_img": "SELECT p_partkey AS img_id, CAST((p_partkey * 37) % 4000 AS DOUBLE) AS xmin, CAST((p_partkey * 53) % 4000 AS DOUBLE) AS ymin, CAST((p_partkey * 37) % 4000 + p_size * 8 AS DOUBLE) AS xmax, CAST((p_partkey * 53) % 4000 + p_size * 8 AS DOUBLE) AS ymax, CAST(p_size % 4 + 1 AS INT) AS channels, CASE WHEN p_size % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS res FROM part",
    "f_slab": "SELECT DISTINCT l_returnflag AS pyr, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS prio, CAST(l_orderkey % 64 AS BIGINT) AS col, CAST(l_partkey % 64 AS BIGINT) AS row, CAST(l_linenumber AS INT) AS lvl FROM lineitem",
    "f_point": "SELECT c_custkey AS pt_id, CAST((c_custkey * 97) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((c_custkey * 61) % 1700 AS DOUBLE) / 10 - 85 AS lat, c_acctbal AS v FROM customer",
    "f_tm": "SELECT o AS ord, CAST(21 - o AS INT) AS id, CAST(power(2, o) AS DOUBLE) AS res, CAST(0 AS DOUBLE) AS x0, CAST(4096 AS DOUBLE) AS y0, 16 AS tile_w, 16 AS tile_h FROM (SELECT CAST(r_regionkey AS INT) AS o FROM region) t",
}
_LINE = "SELECT vec_id AS line, pos AS x, CAST(v AS DOUBLE) AS s FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v"
_LINE_SQL = "SELECT vec_id AS line, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS s FROM embeddings, range(1, 65) t(i)"
_BASE = {"f_dem": "orders", "f_rgb": "events", "f_img": "part", "f_slab": "lineitem", "f_point": "customer", "f_tm": "region", "f_line": "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; the base table is passed to the SQL text as a DataFrame, so that no name is left in the catalog."""
    text = _LINE if name == "f_line" else VIEWS[name]
    base = _BASE[name]
    return spark.sql(text.replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views that it names put in front."""
    used = [f"{n} AS ({_LINE_SQL if n == 'f_line' else VIEWS[n]})" for n in _BASE if n in sql]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join([*used, body[14:].strip()])}"
    if body.upper().startswith("WITH"):
        return f"WITH {', '.join([*used, body[4:].strip()])}"
    return f"WITH {', '.join(used)} {body}" if used else body
