"""What the operators share: tables, the shared scratch folder, Arrow column helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import pickle
import re
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="peakpool-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/peakpool-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files behind a table that is now written aren't needed any more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.peakpool_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing reads them any more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.peakpool_path)
    hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df's scan, from file sizes; 16 MB for each partition where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.rdd.getNumPartitions() << 24


def part_count(df: DataFrame, mb: int = 8, least: int = 4) -> int:
    """Partitions or buckets for df, in proportion to the bytes of its input."""
    return max(least, -(-input_bytes(df) // (mb << 20)))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def trim() -> None:
    """Gives freed memory back to the system: a worker is used again and again, and what it keeps counts for its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches, text_at: int, step: int = 4 << 20):
    """Arrow batches cut into runs of rows with about `step` bytes of text, so that what a task makes of them at once follows
    that and not the batch."""
    trim()
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = [0, *(np.flatnonzero(np.diff(size // step)) + 1).tolist(), len(size)] if len(size) else []
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield b.slice(lo, hi - lo)
    trim()


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, mod m; null ids count as remainder null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) on unsigned integers; wraps by intention."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@cache
def packer(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@cache
def unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value, to be moved as a single cell. Each array's first bytes stand together, then its second
    ones and so on, as numbers' high bytes are alike."""
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return packer(level).compress(pickle.dumps(planes, protocol=5))


def unpack(cell: bytes) -> list[np.ndarray]:
    planes = pickle.loads(unpacker().decompress(cell))
    out = []
    for kind, data in planes:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1))
    return out


def dealt(to: np.ndarray, *arrays: np.ndarray):
    """(value of to, the arrays' parts with that value), for each value."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.diff(to)) + 1
    parts = [np.split(a[order], cut) for a in arrays]
    for i, t in enumerate(to[np.concatenate([[0], cut])].tolist() if len(to) else []):
        yield t, *(p[i] for p in parts)


def joined(cells) -> list[np.ndarray]:
    """The arrays of several packed cells, each concatenated."""
    return [np.concatenate(x) for x in zip(*map(unpack, cells), strict=True)]


def cells(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"to": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


CELLS = "to int, payload binary"


def handed(carry: list[str] | None) -> list:
    """The columns to be handed on, as one struct; none if there are none."""
    return [F.struct(*carry).alias("carry")] if carry else []


def handed_on(df: DataFrame) -> tuple[DataFrame, str]:
    """df, and what its schema needs to hand on its struct `carry`."""
    return df, f", carry {df.schema['carry'].dataType.simpleString()}" if "carry" in df.columns else ""
