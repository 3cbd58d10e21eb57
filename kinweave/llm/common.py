"""What the operators of this subpackage share: tables, words, scratch space on the shared store."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_libc = ctypes.CDLL(None)
_own_dirs: dict[str, str] = {}
scratch_folders: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and they are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    return _own_dirs[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    path = f"{shared_dir(spark)}/kinweave/{name}-{uuid.uuid4().hex}"
    scratch_folders.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, once all results built on them are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def forget(table: DataFrame) -> None:
    """Delete a table that ``stored`` made, once nothing will read it again."""
    folders = {f.rpartition("/")[0] for f in table.inputFiles()}
    remove(table.sparkSession, sorted(f for f in folders if f.rpartition("/")[0].endswith("/kinweave")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Rows in Python workers.


#: What modules keep in a worker from task to task, by their names.
kept: dict[str, dict] = {}


def without_cycles(keep: str = "") -> None:
    """Stop the collector of cycles in this worker: it would walk millions of live lists again and again, and no cycles are made.

    What other operators than ``keep`` have kept in the worker is dropped, and what earlier tasks have freed goes back to the system.
    """
    gc.disable()
    for name, held in kept.items():
        if name != keep:
            held.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and, but for single rows, bytes in the column number ``text``."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(sizes, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of as many whole numbers each: widths in bytes, then byte planes together, compressed."""
    widths, planes = bytearray(), []
    for c in columns:
        c = np.ascontiguousarray(c, "<i8")
        width = 8 if len(c) and int(c.min()) < 0 else max(1, -(-int(c.max(initial=0)).bit_length() // 8))
        widths.append(width)
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return bytes(widths) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[n:]), np.uint8), [], 0
    rows = len(raw) // sum(data[:n])
    for width in data[:n]:
        c = np.zeros((rows, 8), np.uint8)
        c[:, :width] = raw[at : at + rows * width].reshape(width, rows).T
        out.append(c.reshape(-1).view("<i8"))
        at += rows * width
    return out


# Files that Python workers write and read on the shared store.


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system for a uri (file, hdfs, s3, gs) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, chunks) -> int:
    """Write a file under a temporary name, then move it, so that readers and retried tasks see whole files only."""
    fs, path = open_store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    fs.move(draft, path)
    return n
