"""Zarr (version 2) and .npy volumes as Spark data sources: chunks are decoded in the tasks, boxes prune what is opened.

    spark.dataSource.register(ZarrSource); spark.read.format("zarr").load("s3://bucket/store/0").where("z < 512 AND cy = 3")

gives rows (z, y, x, v, cz, cy, cx). Comparisons of these columns with numbers are pushed to the reader: a chunk outside of them
is never opened. A partition is a range of the chunks that are left, or of slabs of an array file. Paths are those of Arrow's file systems (local or
mounted, s3, gs, hdfs), which every executor must reach. Chunks that the store doesn't have are its fill value; they are left out where that is zero or
null, as sampling counts what doesn't exist as zero. Compressors: none, zlib, gzip, zstd; others raise an error.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "z int, y int, x int, v double, cz int, cy int, cx int"
#: Bytes of chunks that a partition takes, and rows of a batch.
PARTITION_BYTES, BATCH = 64 << 20, 1 << 16


def _file(url: str):
    """The file system and the path there of a URL or a local path."""
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _BlockReader(DataSourceReader):
    """A volume in blocks of a fixed shape: keeps the box of blocks that pushed filters allow, and deals it in ranges."""

    def __init__(self, shape: tuple[int, ...], block: tuple[int, ...], itemsize: int):
        if len(shape) != 3:
            raise ValueError(f"a volume has three axes, not {len(shape)}")
        self.shape, self.block, self.itemsize = tuple(shape), tuple(block), itemsize
        self.low, self.high = [0, 0, 0], [math.ceil(s / b) for s, b in zip(shape, block)]

    def pushFilters(self, filters):
        """Narrows the box; yields what Spark must still apply: all but comparisons of cz, cy, cx."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            value = getattr(f, "value", None)
            values = [v for v in value if v is not None] if isinstance(f, In) else [value]
            known = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and values and all(isinstance(v, (int, float)) for v in values)
            if name.removeprefix("c") not in ("z", "y", "x") or not known:
                yield f
                continue
            axis, size = "zyx".index(name[-1]), 1 if name[0] == "c" else self.block["zyx".index(name)]
            # The least and largest whole number that may pass.
            least, most = math.ceil(min(values)), math.floor(max(values))
            if isinstance(f, GreaterThan):
                least = math.floor(values[0]) + 1
            if isinstance(f, LessThan):
                most = math.ceil(values[0]) - 1
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low[axis] = max(self.low[axis], least // size)
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high[axis] = min(self.high[axis], most // size + 1)
            if name[0] != "c" or isinstance(f, In):
                yield f

    def _counts(self) -> list[int]:
        return [max(0, h - l) for l, h in zip(self.low, self.high)]

    def partitions(self):
        n = math.prod(self._counts())
        each = max(1, PARTITION_BYTES // (math.prod(self.block) * self.itemsize))
        return [Range(k, min(n, k + each)) for k in range(0, n, each)] or [Range(0, 0)]

    def read(self, partition):
        _, ny, nx = self._counts()
        for k in range(partition.first, partition.last):
            key = (self.low[0] + k // (ny * nx), self.low[1] + k // nx % ny, self.low[2] + k % nx)
            values = self.block_at(key)
            if values is None:
                continue
            at = np.indices(values.shape, dtype=np.int32).reshape(3, -1)
            columns = [*(a + np.int32(c * b) for a, c, b in zip(at, key, self.block)), values.astype(np.float64).ravel(), *(np.full(values.size, c, np.int32) for c in key)]
            for first in range(0, values.size, BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[first : first + BATCH]) for c in columns], ["z", "y", "x", "v", "cz", "cy", "cx"])

    def block_at(self, key: tuple[int, int, int]) -> np.ndarray | None:
        """The values of a block, without what lies beyond the volume; None where there is nothing to say."""
        raise NotImplementedError


def decoded(data: bytes, compressor: dict | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return data
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)  # either header
    if kind == "zstd":
        import zstandard

        return b"".join(zstandard.ZstdDecompressor().read_to_iter(data))
    raise ValueError(f"chunks compressed with {kind} can't be read")


class ZarrReader(_BlockReader):
    def __init__(self, url: str):
        self.url = url.rstrip("/")
        files, path = _file(self.url)
        if files.get_file_info(f"{path}/.zarray").type == fs.FileType.NotFound:
            raise ValueError(f"{url} holds no array of Zarr version 2")
        with files.open_input_stream(f"{path}/.zarray") as f:
            self.meta = json.loads(f.read())
        self.dtype = np.dtype(self.meta["dtype"])
        if self.meta.get("filters"):
            raise ValueError("arrays with filters can't be read")
        super().__init__(self.meta["shape"], self.meta["chunks"], self.dtype.itemsize)

    def block_at(self, key):
        files, path = _file(self.url)
        name = f"{path}/{self.meta.get('dimension_separator', '.').join(map(str, key))}"
        fill = self.meta.get("fill_value")
        there = [min(b, s - c * b) for s, b, c in zip(self.shape, self.block, key)]
        try:
            with files.open_input_stream(name, compression=None) as f:
                data = f.read()
        except FileNotFoundError:
            return None if not fill else np.full(there, float(fill))
        values = np.frombuffer(decoded(data, self.meta.get("compressor")), self.dtype).reshape(self.block, order=self.meta.get("order", "C"))
        return values[tuple(slice(0, n) for n in there)]


class NpyReader(_BlockReader):
    """An array file by slabs of z: a task seeks to its slabs and reads nothing else."""

    def __init__(self, url: str, slab: int):
        self.url = url
        files, path = _file(url)
        with files.open_input_file(path) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, self.dtype = read(f)
            self.start = f.tell()
        if fortran or self.dtype.hasobject:
            raise ValueError("array files must hold numbers in C order")
        super().__init__(shape, (slab, *shape[1:]), self.dtype.itemsize)

    def block_at(self, key):
        files, path = _file(self.url)
        plane = self.shape[1] * self.shape[2]
        n = min(self.block[0], self.shape[0] - key[0] * self.block[0])
        with files.open_input_file(path) as f:
            f.seek(self.start + key[0] * self.block[0] * plane * self.dtype.itemsize)
            data = f.read(n * plane * self.dtype.itemsize)
        return np.frombuffer(data, self.dtype).reshape(n, *self.shape[1:])


class ZarrSource(DataSource):
    @classmethod
    def name(cls):
        return "zarr"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZarrReader(self.options["path"])


class NpySource(ZarrSource):
    """option slab: layers of z a block."""

    @classmethod
    def name(cls):
        return "npy"

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("slab", 16)))


def read_volume(spark: SparkSession, url: str, bounds: dict[str, tuple[int, int]] | None = None, vol: int = 0, **options) -> DataFrame:
    """vol, z, y, x, v of an array (a Zarr array's folder or an .npy file), within bounds ({"z": (lo, hi), ...}, hi exclusive)."""
    source = NpySource if url.endswith(".npy") else ZarrSource
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).options(**options).load(url)
    for k, (lo, hi) in (bounds or {}).items():
        rows = rows.where((F.col(k) >= lo) & (F.col(k) < hi))
    return rows.select(F.lit(vol).cast("long").alias("vol"), "z", "y", "x", "v")


def open_ome(spark: SparkSession, url: str, level: int = 0, bounds: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, list[float], list[float]]:
    """(voxels, scale, offset) of a level of a multiscale store: scale and offset in z, y, x order, the offset in voxels."""
    from surfacelab.sources.files import read_ome_levels

    found = read_ome_levels(spark, url).where(F.col("level") == level).first()
    if found is None:
        raise ValueError(f"{url} has no level {level}")
    return read_volume(spark, f"{url.rstrip('/')}/{found.dataset}", bounds), list(found.scale), list(found.offset)


def write_zarr(voxels: DataFrame, url: str, shape: tuple[int, int, int], chunk: tuple[int, int, int], dtype: str = "<f8", compressor: str | None = "zstd") -> None:
    """voxels (z, y, x, v) of one volume as a Zarr array; chunks are written by the tasks that hold them, and only those with a voxel.

    A chunk is written under another name and then moved, so a task that is run again does no harm.
    """
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunk), "dtype": np.dtype(dtype).str, "compressor": compressor and {"id": compressor, "level": 3}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "."}
    files, path = _file(url.rstrip("/"))
    files.create_dir(path, recursive=True)
    keys = [F.floor(F.col(k) / n).cast("int").alias("c" + k) for k, n in zip("zyx", chunk)]
    place = (F.pmod("z", F.lit(chunk[0])) * chunk[1] + F.pmod("y", F.lit(chunk[1]))) * chunk[2] + F.pmod("x", F.lit(chunk[2]))
    chunks = voxels.select(*keys, F.struct(place.cast("int").alias("i"), F.col("v").cast("double").alias("v")).alias("cell")).groupBy("cz", "cy", "cx").agg(F.collect_list("cell").alias("cells"))

    def run(batches):
        files, path = _file(url.rstrip("/"))
        for b in batches:
            for cz, cy, cx, cells in zip(*b.columns):
                cells, cube = cells.values, np.zeros(math.prod(chunk))
                cube[cells.field("i").to_numpy()] = cells.field("v").to_numpy()
                data = cube.astype(dtype).tobytes()
                if compressor == "zstd":
                    import zstandard

                    data = zstandard.ZstdCompressor(3).compress(data)
                elif compressor:
                    data = zlib.compress(data, 3)
                name = f"{path}/{cz}.{cy}.{cx}"
                part = f"{path}/.part-{uuid.uuid4().hex}"
                with files.open_output_stream(part, compression=None) as f:
                    f.write(data)
                files.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    chunks.select("cz", "cy", "cx", "cells").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    with files.open_output_stream(f"{path}/.zarray", compression=None) as f:
        f.write(json.dumps(meta).encode())
