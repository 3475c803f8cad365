"""Operators over slab inventories: range joins, levels, joins of pyramids, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_keys(df: DataFrame, c0: Column, c1: Column, r0: Column, r1: Column) -> DataFrame:
    """One row per covered (col, row): a range join becomes an equi-join on slab keys."""
    return df.select("*", F.explode(F.sequence(c0, c1)).alias("col")).select("*", F.explode(F.sequence(r0, r1)).alias("row"))


def parents(nodes: DataFrame, up: int = 1) -> DataFrame:
    """Distinct parents, up levels above, of (lvl, col, row)."""
    at = lambda v: F.floor(F.col(v) / 2**up).cast("long").alias(v)
    return nodes.select((F.col("lvl") + up).alias("lvl"), at("col"), at("row"), *[c for c in nodes.columns if c not in ("lvl", "col", "row")]).distinct()


def all_ancestors(nodes: DataFrame, top: int) -> DataFrame:
    """Nodes and all their ancestors up to level top. One explode and one distinct: ancestors are arithmetic, so no loop of shuffles."""
    up = F.explode(F.sequence(F.lit(0), F.lit(top) - F.col("lvl"))).alias("_k")
    rest = [c for c in nodes.columns if c not in ("lvl", "col", "row")]
    e = nodes.filter(F.col("lvl") <= top).select("lvl", "col", "row", *rest, up)
    at = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("_k"))).cast("long").alias(v)
    return e.select((F.col("lvl") + F.col("_k")).alias("lvl"), at("col"), at("row"), *rest).distinct()


def join_inventories(slabs: DataFrame, merge: str = "ALPHATOP") -> DataFrame:
    """Slab inventories (pyr, prio, lvl, col, row) joined by priority.

    Each slab's main source is the one of smallest priority; the later ones follow, unless merge is REPLACE, which keeps the
    main one alone and needs no list.
    """
    g = slabs.groupBy("lvl", "col", "row")
    if merge == "REPLACE":
        return g.agg(F.min_by("pyr", "prio").alias("main"), F.min_by("pyr", "prio").alias("sources"), F.lit(1).cast("long").alias("n"))
    order = F.sort_array(F.collect_set(F.struct("prio", "pyr")))
    return g.agg(order.alias("_s")).select("lvl", "col", "row", F.get("_s", F.lit(0))["pyr"].alias("main"), F.array_join(F.transform("_s", lambda x: x["pyr"]), ",").alias("sources"), F.size("_s").cast("long").alias("n"))


def updated(ancestor: DataFrame, new: DataFrame) -> DataFrame:
    """An updated pyramid: new slabs (root 0) and those of the ancestor (root 1) that were not made anew."""
    keys = ["lvl", "col", "row"]
    return new.select(*keys, F.lit(0).alias("root_id")).unionByName(ancestor.select(*keys).join(new.select(*keys), keys, "left_anti").withColumn("root_id", F.lit(1)))


def profile(df: DataFrame, columns: list[str], numeric: list[str], limit: int = 50) -> DataFrame:
    """Per column: type group, distinct values (null counts as one), smallest and largest of numeric ones, and the values of
    other columns that have at most limit. One unpivot and two grouped aggregations, so that a wide table is read once; no
    list is longer than limit."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")) for c in columns])).alias("s")).select("s.*")
    values = cells.groupBy("attribute", "value").agg(F.min("x").alias("x"))
    sums = values.groupBy("attribute").agg(F.count("*").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"))
    few = sums.filter((F.col("count") <= limit) & ~F.col("attribute").isin(*numeric)).select("attribute")
    listed = values.join(F.broadcast(few), "attribute").groupBy("attribute").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("values"))
    return sums.join(listed, "attribute", "left")


def numbered(df: DataFrame, group: list[str], outer: list[str], inner: list[str]) -> DataFrame:
    """Adds n, each row's number from 1 within its group, in the order of outer and then inner keys.

    No group is sorted in one task: rows are numbered within a group and outer key (of slabs a column of the grid, so no more
    than its height), and what comes before is a running sum over one row an outer key.
    """
    counts = df.groupBy(*group, *outer).agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*group).orderBy(*outer)) - F.col("_m")
    counts = counts.select(*group, *outer, before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, *outer).orderBy(*inner))
    return df.withColumn("_own", own).join(counts, [*group, *outer]).withColumn("n", F.col("_before") + F.col("_own")).drop("_before", "_own")
