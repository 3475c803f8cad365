"""Descriptor files: tile-matrix sets, pyramids, styles and layers, read with Spark's XML reader and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_d, _s, _l = T.DoubleType(), T.StringType(), T.LongType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TILE_MATRIX = _schema(id=_s, resolution=_d, topLeftCornerX=_d, topLeftCornerY=_d, tileWidth=_l, tileHeight=_l, matrixWidth=_l, matrixHeight=_l)
LIMITS = _schema(minTileRow=_l, maxTileRow=_l, minTileCol=_l, maxTileCol=_l)
LEVEL = _schema(tileMatrix=_s, baseDir=_s, tilesPerWidth=_l, tilesPerHeight=_l, pathDepth=_l, TMSLimits=LIMITS)
COLOUR = _schema(_value=_d, red=_l, green=_l, blue=_l, alpha=_l)


def _read(spark, path: str, tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(schema).load(path).withColumn("file", F.input_file_name())


def tile_matrices(spark, path: str) -> DataFrame:
    """One row a tile matrix, ordered by resolution within its file: order 0 is the finest."""
    tm = _read(spark, path, "tileMatrix", TILE_MATRIX).filter("id IS NOT NULL AND resolution > 0")
    from pyspark.sql import Window

    return tm.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("resolution")) - 1)


def levels(spark, path: str) -> DataFrame:
    """One row a level of a pyramid descriptor; a path depth that is not given is 2."""
    lv = _read(spark, path, "level", LEVEL)
    return lv.select("file", "tileMatrix", "baseDir", "tilesPerWidth", "tilesPerHeight", F.coalesce("pathDepth", F.lit(2)).alias("pathDepth"), "TMSLimits.*")


def pyramids(spark, path: str) -> DataFrame:
    return _read(spark, path, "Pyramid", _schema(tileMatrixSet=_s, format=_s, channels=_l, nodataValue=_s, interpolation=_s, photometric=_s))


def colours(spark, path: str) -> DataFrame:
    """Stops of a style's palette, sorted by value within a file when read as an array."""
    return _read(spark, path, "colour", COLOUR).select("file", F.col("_value").alias("value"), "red", "green", "blue", F.coalesce("alpha", F.lit(255)).alias("alpha"))


def layers(spark, path: str) -> DataFrame:
    """Layers with defaults: opaque, resampling by lanczos_2."""
    lay = _read(spark, path, "layer", _schema(title=_s, abstract=_s, style=_s, minRes=_d, maxRes=_d, opaque=T.BooleanType(), authority=_s, resampling=_s))
    return lay.withColumn("opaque", F.coalesce("opaque", F.lit(True))).withColumn("resampling", F.when(F.coalesce("resampling", F.lit("lanczos")) == "lanczos", "lanczos_2").otherwise(F.col("resampling")))


def write_levels(df: DataFrame, path: str) -> None:
    df.write.format("xml").option("rootTag", "Pyramid").option("rowTag", "level").mode("overwrite").save(path)


def changed_since(spark, path: str, pattern: str, since) -> DataFrame:
    """(path, modified) of configuration files changed after a time."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.filter(F.col("modificationTime") > F.lit(since)).select("path", F.col("modificationTime").alias("modified"))
