"""Slabs: tiles encoded into containers, and back to cells; single-image files; storage of slab files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators.shared import spread

c = F.col
#: What a Python worker hands back at once: samples, or bytes of files. A batch that it is given is bounded in rows only.
SAMPLES_AT_ONCE = 1 << 19
BYTES_AT_ONCE = 1 << 22
#: How samples are held: the smallest type that has all values, as a batch of ten thousand tiles is held at once.
HELD = {"uint8": "short", "uint16": "int", "float32": "float"}


def in_pieces(values: Iterator, size, most: int) -> Iterator[list]:
    """values in lists of a total size of most, or of one value that is larger."""
    out, held = [], 0
    for v in values:
        out.append(v)
        held += size(v)
        if held >= most:
            yield out
            out, held = [], 0
    if out:
        yield out


def _objects(values: list) -> pd.Series:
    return pd.Series(values, dtype="object")


def tile_samples(cells: DataFrame, bands: list[str], tile_w: int, tile_h: int, dtype: str = "float64") -> DataFrame:
    """(tc, tr, samples): each tile's samples in order, band by band within a pixel, held as dtype asks. A tile's cells are as many as its area; all must be there."""
    px = F.struct((c("row") % tile_h).alias("y"), (c("col") % tile_w).alias("x"), F.array(*[c(b).cast(HELD.get(dtype, "double")) for b in bands]).alias("v"))
    g = cells.groupBy(F.floor(c("col") / tile_w).alias("tc"), F.floor(c("row") / tile_h).alias("tr")).agg(F.sort_array(F.collect_list(px)).alias("s"))
    return g.select("tc", "tr", F.flatten(F.transform("s", lambda p: p["v"])).alias("samples"))


def encode_tiles(tiles: DataFrame, tile_w: int, tile_h: int, channels: int, dtype: str, codec) -> DataFrame:
    """Adds data, the encoded samples; codec is a name or a column of names. Incomplete tiles raise an error."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for samples, how in batches:
            coded = (codecs.encode(np.asarray(s).astype(dtype).reshape(tile_h, tile_w, channels), h) for s, h in zip(samples, how, strict=True))
            yield from map(_objects, in_pieces(coded, len, BYTES_AT_ONCE))

    return tiles.withColumn("data", run("samples", codec if not isinstance(codec, str) else F.lit(codec))).drop("samples")


def decode_tiles(tiles: DataFrame, tile_w: int, tile_h: int, channels: int, dtype: str, codec) -> DataFrame:
    """Adds samples, decoded from data."""

    kind = HELD.get(dtype, "double")
    held = {"short": np.int16, "int": np.int32, "float": np.float32}.get(kind, float)

    @F.pandas_udf(f"array<{kind}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, how in batches:
            samples = (codecs.decode(bytes(x), h, (tile_h, tile_w, channels), dtype).astype(held).reshape(-1) for x, h in zip(data, how, strict=True))
            yield from map(_objects, in_pieces(samples, len, SAMPLES_AT_ONCE))

    return tiles.withColumn("samples", run("data", codec if not isinstance(codec, str) else F.lit(codec))).drop("data")


def cells_of(tiles: DataFrame, bands: list[str], tile_w: int, tile_h: int, kind: str = "int") -> DataFrame:
    """(col, row, bands...) of tiles (tc, tr, samples)."""
    n = len(bands)
    px = tiles.select("tc", "tr", "samples", F.explode(F.sequence(F.lit(0), F.lit(tile_w * tile_h - 1))).alias("k"))
    return px.select((c("tc") * tile_w + c("k") % tile_w).alias("col"), (c("tr") * tile_h + F.floor(c("k") / tile_w)).alias("row"), *[F.get("samples", c("k") * n + b).cast(kind).alias(name) for b, name in enumerate(bands)])


def pack_slabs(tiles: DataFrame, tpw: int, tph: int, tile_w: int, tile_h: int, channels: int, dtype: str, codec: str) -> DataFrame:
    """(slab_col, slab_row, data) of encoded tiles (tc, tr, data). A slab holds at most tpw x tph tiles."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            packed = (codecs.slab_encode({int(t["n"]): bytes(t["data"]) for t in ts}, tpw, tph, tile_w, tile_h, channels, dtype, codec) for ts in part)
            yield from map(_objects, in_pieces(packed, len, BYTES_AT_ONCE))

    n = ((c("tr") % tph) * tpw + c("tc") % tpw).cast("int").alias("n")
    g = tiles.groupBy(F.floor(c("tc") / tpw).alias("slab_col"), F.floor(c("tr") / tph).alias("slab_row")).agg(F.collect_list(F.struct(n, "data")).alias("t"))
    return g.select("slab_col", "slab_row", run("t").alias("data"))


def unpack_slabs(slabs: DataFrame, tpw: int, tph: int) -> DataFrame:
    """(tc, tr, n, at, size, data) of every tile that slabs (slab_col, slab_row, data) hold."""

    @F.pandas_udf("array<struct<n:int,at:long,size:long,data:binary>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            tiles = ([{"n": k, "at": a, "size": s, "data": x[a : a + s]} for k, (a, s) in enumerate(codecs.slab_index(x, tpw * tph)) if s] for x in map(bytes, part))
            yield from map(_objects, in_pieces(tiles, lambda ts: sum(t["size"] for t in ts), BYTES_AT_ONCE))

    t = slabs.select("slab_col", "slab_row", F.explode(run("data")).alias("t")).select("slab_col", "slab_row", "t.*")
    return t.select((c("slab_col") * tpw + c("n") % tpw).alias("tc"), (c("slab_row") * tph + F.floor(c("n") / tpw)).alias("tr"), "n", "at", "size", "data")


def read_slab_files(spark, root: str) -> DataFrame:
    """(path, data) of the files below root in any Hadoop file system; a symbolic object is followed once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", c("content").alias("data"))
    link = (F.length("data") < codecs.HEADER) & (F.substring("data", 1, len(codecs.LINK)) == F.lit(codecs.LINK))
    target = F.expr(f"CAST(substring(data, {len(codecs.LINK) + 1}) AS STRING)")
    plain = files.filter(~link)
    followed = files.filter(link).select("path", F.concat(F.regexp_replace("path", r"[^/]*$", ""), target).alias("to"))
    return plain.unionByName(followed.join(plain.withColumnRenamed("path", "to"), "to").select("path", "data"))


def write_files(df: DataFrame, root: str) -> None:
    """Writes (path, data) rows as files below root, from the executors; a file appears whole or not at all."""

    def run(rows) -> None:
        import pyarrow.fs as fs

        system, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for r in rows:
            to = f"{base}/{r['path']}"
            if (into := to.rpartition("/")[0]) not in made:
                system.create_dir(into, recursive=True)
                made.add(into)
            with system.open_output_stream(f"{to}.part") as out:
                out.write(bytes(r["data"]))
            system.move(f"{to}.part", to)

    df.select("path", "data").foreachPartition(run)


def copy_files(spark, root: str, to: str, limit: int = 0) -> None:
    """Copies the objects below root that are larger than limit, from the executors; a link is followed, and what it names copied under the link's own name."""
    base = re.sub(r"^[a-z0-9]+:", "", root).strip("/")
    inner = F.regexp_replace("path", f"^(?:[a-z0-9]+:)?/*{re.escape(base)}/+", "")
    write_files(read_slab_files(spark, root).filter(F.length("data") > limit).select(inner.alias("path"), "data"), to)


def delete_files(df: DataFrame, root: str) -> None:
    """Deletes files (path) below root, from the executors; a file that is gone already is passed over."""

    def run(rows) -> None:
        import pyarrow.fs as fs

        system, base = fs.FileSystem.from_uri(root)
        for r in rows:
            if system.get_file_info(f"{base}/{r['path']}").type != fs.FileType.NotFound:
                system.delete_file(f"{base}/{r['path']}")

    df.select("path").foreachPartition(run)


class Storage:
    """Copy, test, size, removal and links of stored objects, on any Hadoop file system; a link is a small object naming its target."""

    def __init__(self, spark):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self.jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.conf), path

    def exists(self, uri: str) -> bool:
        fs, path = self._at(uri)
        return fs.exists(path)

    def size(self, uri: str) -> int:
        fs, path = self._at(uri)
        return fs.getFileStatus(path).getLen()

    def remove(self, uri: str) -> bool:
        fs, path = self._at(uri)
        return fs.delete(path, True)

    def copy(self, uri: str, to: str) -> bool:
        (fs, path), (fs2, path2) = self._at(uri), self._at(to)
        return self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, fs2, path2, False, self.conf)

    def link(self, name: str, uri: str) -> None:
        fs, path = self._at(uri)
        out = fs.create(path)
        out.write(bytearray(codecs.LINK + name.encode()))
        out.close()


IMAGE = "width int, height int, channels int, x double, y double, resx double, resy double, samples array<double>"


def _image(x: bytes, head: int | None) -> tuple:
    geo = None
    if x[:4] == b"\x89PNG":
        image = codecs.png_decode(x)
    elif x[:2] in (b"II", b"MM"):
        image, geo = codecs.tiff_decode(x)
    else:
        return (None,) * 8
    h, w, n = image.shape
    return w, h, n, *(geo or (None,) * 4), image.reshape(-1)[:head].astype(float)


def _images(files: Iterator[bytes], head: int | None) -> Iterator[pd.DataFrame]:
    """IMAGE of each file, in frames of a bounded number of samples."""
    names = [x.split()[0] for x in IMAGE.split(", ")]
    for rows in in_pieces((_image(x, head) for x in files), lambda r: 64 + (0 if r[7] is None else len(r[7])), SAMPLES_AT_ONCE):
        columns = dict(zip(names, zip(*rows, strict=True), strict=True))
        yield pd.DataFrame({k: pd.Series(v, dtype="object" if k == "samples" else float if k in ("x", "y", "resx", "resy") else "Int32") for k, v in columns.items()})


def decode_files(files: DataFrame, head: int | None = None) -> DataFrame:
    """(path, width, height, channels, x, y, resx, resy, samples) of TIFF and PNG files (path, data); files of other kinds give nulls. With head, only so many samples of each image, which is decoded whole, are handed on."""

    @F.pandas_udf(IMAGE)
    def run(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in data:
            yield from _images(map(bytes, part), head)

    return files.select("path", run("data").alias("i")).select("path", "i.*")


def image_dir(spark, root: str) -> DataFrame:
    """The images below root: one schema for all is demanded by uniform(). Tasks list the folders in root, each on its own, and read what they find; the driver lists root alone."""
    import pyarrow as pa
    import pyarrow.fs as fs

    ends = (".tif", ".tiff", ".png")
    try:
        system, base = fs.FileSystem.from_uri(root)
    except pa.ArrowInvalid:  # a file system that only Spark knows
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,png}").load(root)
        return decode_files(files.select("path", c("content").alias("data")))
    top = [x for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory or x.path.endswith(ends)]
    places = spark.createDataFrame([(x.path, x.type == fs.FileType.Directory) for x in top], "path string, inner boolean")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(root)

        def found(rows: pd.DataFrame) -> Iterator[str]:
            for path, inner in zip(rows["path"], rows["inner"], strict=True):
                if inner:
                    yield from (x.path for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(ends))
                else:
                    yield path

        def body(path: str) -> bytes:
            with system.open_input_file(path) as f:
                return f.read()

        for rows in batches:
            for paths in in_pieces(found(rows), lambda _: 1, 1000):
                at = 0
                for frame in _images(map(body, paths), None):
                    frame.insert(0, "path", paths[at : at + len(frame)])
                    at += len(frame)
                    yield frame

    return spread(places, "path").mapInPandas(read, f"path string, {IMAGE}")


def uniform(images: DataFrame) -> bool:
    """All images have the same number of channels."""
    return images.agg(F.count_distinct("channels")).first()[0] <= 1
