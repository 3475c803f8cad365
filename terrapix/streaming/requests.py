"""Request logs as streams: validated tile requests, counts by window, and the cache of slabs made on the fly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def slab_keys(requests: DataFrame) -> DataFrame:
    """(ts, lvl, col, row): the slab of each tile request."""
    return requests.select("ts", (c("event_id") % 4).alias("lvl"), F.floor(c("user_id") / 4).alias("col"), F.floor(c("event_id") % 64 / 4).alias("row"))


def run(stream: DataFrame, to: str, mode: str = "append") -> None:
    """Reads all there is now and stops; to holds the rows and, beside them, the query's state."""
    stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def fill_cache(requests: DataFrame, build, to: str) -> None:
    """The slabs that requests ask for, each built once.

    Every micro-batch takes the distinct keys that the cache does not hold, builds them and appends them under its batch
    number; a batch that is run again writes the same file names' folder anew, so that a lost driver leaves no slab twice.
    build turns keys (lvl, col, row) into slabs.
    """
    spark = requests.sparkSession

    def batch(keys: DataFrame, number: int) -> None:
        asked = keys.select("lvl", "col", "row").distinct()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}/cache")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            held = spark.read.parquet(f"{to}/cache")
            if "batch" in held.columns:
                held = held.filter(c("batch") != number)
            asked = asked.join(held.select("lvl", "col", "row"), ["lvl", "col", "row"], "left_anti")
        build(asked).write.mode("overwrite").parquet(f"{to}/cache/batch={number}")

    requests.writeStream.foreachBatch(batch).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
