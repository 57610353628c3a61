"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on at once; a longer text is a pass of its own.
BLOCK_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a local master a temporary one is made where none is set; on a cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


#: Spark's own setting: the shuffle files of a query go when the query has ended, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, compression: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Materialise df as Parquet in the shared folder and continue from there (survives lost executors). The folder stays: it is a result."""
    return _write(df, f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}", compression)


class Scratch:
    """Intermediate tables of one job, as Parquet in the shared folder. They go at the end of the `with` block, or by drop()."""

    def __init__(self, spark: SparkSession):
        self._root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """Materialise df and continue from there (survives lost executors)."""
        path = f"{self._root}/{uuid.uuid4().hex}"
        out = _write(df, path, compression)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that keep() gave and nothing reads any more."""
        for t in tables:
            if t is not None and id(t) in self._paths:
                self._delete(self._paths.pop(id(t))[1])

    def _delete(self, path: str) -> None:
        where = self._fs_path(path)
        where.getFileSystem(self._conf).delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._paths.clear()
        self._delete(self._root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-case A-Z alone; plain lower() does the same for pure ASCII texts and is faster there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


# ---------------------------------------------------------------- vectorised text work inside tasks

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective) over uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. _BASE ** (n-1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        m = max(1024, 1 << (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _BASE)]), dtype=np.uint64)
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    buf = column.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data, off


def blocks(off: np.ndarray, size: int = BLOCK_BYTES):
    """Runs [i, j) of rows whose texts hold about size bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, A-Z lowered, and the number of words before each text (n+1).

    data: the bytes from off[0] to off[-1]; space: which byte values separate words.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = off[:-1] - off[0]
    at = at[at < n]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    run = np.diff(np.append(starts, n))
    within = np.arange(n, dtype=np.int64)
    within[starts[0]:] -= np.repeat(starts, run)
    within[: starts[0]] = 0
    longest = int(within[inside].max()) + 1
    part = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(longest)[np.minimum(within, longest - 1)]
    part[~inside] = 0
    return mix(np.add.reduceat(part, starts)), np.searchsorted(starts, off - off[0])


def sets_of(data: np.ndarray, off: np.ndarray, k: int):
    """Per text: the sorted distinct 64-bit hashes of its k-word shingles (all its words, if fewer; none: empty)."""
    words, begin = word_hashes(data, off)
    step = (2 * np.arange(k, dtype=np.uint64) + np.uint64(3)) * _M2
    if len(words) >= k:
        gram = mix(sum((words[i: len(words) - k + 1 + i] * step[i] for i in range(k)), np.zeros(len(words) - k + 1, np.uint64)))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= k:
            yield np.unique(gram[a: b - k + 1])
        elif b > a:
            few = words[a:b] * step[: b - a]
            yield mix(few.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
