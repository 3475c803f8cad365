"""Stored intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='terrapix-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written once in the shared folder, so that no later stage depends on an executor's memory or disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        to = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(to)
        if self.n == 1:
            self.fs.deleteOnExit(self.path(self.root))
        out = self.spark.read.schema(df.schema).parquet(to)
        out._scratch = to
        return out

    def folder(self) -> str:
        """A path below the scratch folder that is removed with it when the session ends."""
        self.fs.mkdirs(self.path(self.root))
        self.fs.deleteOnExit(self.path(self.root))
        return f"{self.root}/data"

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            self.fs.delete(self.path(t._scratch), True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys to as many tasks as shuffles have, ahead of work that costs more than a shuffle: a compact table is a single split, and one task would do all of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def filtered_here(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on costly columns. A plain filter is moved down to the source, where these columns are computed a first time, before rows are dealt out and once for each place the condition names them."""
    return df.withColumn("_n", F.monotonically_increasing_id()).filter(condition & (F.col("_n") >= 0)).drop("_n")


def follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by its parent where it has one; changed tells which rows were."""
    p = parents.select(F.col("node").alias("_n"), F.col("label").alias("_p"))
    return labels.join(p, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_p", "label").alias("label"), F.coalesce(F.col("_p") != F.col("label"), F.lit(False)).alias("changed"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label) per node, label being the component's smallest node.

    Each round hooks every node to its smallest neighbour below it, shortens the chains by pointer jumping, and contracts
    the edges to those between different roots. Every step is a grouped minimum or a join whose two inputs are stored
    tables, so that skewed nodes are split when joined; nothing is gathered on the driver.
    """
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
        while True:
            jumped = scratch.write(follow(parents, parents))
            scratch.drop(parents)
            parents = jumped
            if parents.filter("changed").isEmpty():
                break
        labels = parents if labels is None else scratch.write(follow(labels, parents))
        p = parents.select("node", "label")
        left = scratch.write(edges.join(p, F.col("a") == F.col("node")).select(F.col("label").alias("a"), "b"))
        right = left.join(p, F.col("b") == F.col("node")).select("a", F.col("label").alias("b"))
        nxt = scratch.write(right.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        scratch.drop(left)
        if nxt.isEmpty():
            return labels.select("node", "label")
        edges = nxt
