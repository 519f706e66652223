"""Helpers shared by the training-data operators.

Text travels JVM -> Python as Arrow batches (``mapInArrow``); every kernel cuts
a batch into slices of bounded bytes, so a batch of very long documents does
not multiply a worker's memory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text bytes a kernel holds as Python or numpy objects at a time (a longer document is one slice).
SLICE_BYTES = 1 << 20

#: The ASCII white space that separates words: 0x20 and 0x09 to 0x0D. ``bytes.split()`` and ``bytes.strip()`` use exactly these.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset and Spark runs in one local process (tests), a local one.

    The folder is what every executor can read, so tables written there outlive any executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    The codec works in the heap: the default one's direct buffers are only given back by a collection that may be long in coming.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def skew_join(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, total: int, hot: int = 4096) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (unique by ``keys``; ``count``: rows of each key, summing to ``total`` at most).

    Keys with more than 1/hot of all rows, of which there are fewer than ``hot``, are joined by broadcast, so none gathers in a task.
    """
    big = F.broadcast(counted.filter(F.col(count) > total // hot))
    rest = counted.filter(F.col(count) <= total // hot)
    return rows.join(big, keys).unionByName(rows.join(big, keys, "left_anti").join(rest, keys))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input cannot clash with ours."""
    return df.select(*[df[c] for c in cols])


def binary(col: pa.Array) -> pa.Array:
    """A string or binary column as a binary one, without a copy."""
    return col.cast(pa.large_binary()) if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.binary())


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column, each with about ``limit`` bytes at most, or one row."""
    n = len(col)
    if not n:
        return
    off = offsets(col)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column (a null row is empty)."""
    off = offsets(col)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def arrow_schema(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(ddl)


def batch(schema: pa.Schema, cols: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


# ---------------------------------------------------------------- word and shingle hashes

_rng = np.random.default_rng(0x5EED_CA12)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_TABLE = _BYTE[_FOLD]
_TABLE[list(WHITE)] = 0
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SHIFT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; one-to-one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        m = max(n, SLICE_BYTES + (1 << 17))
        a, b = np.full(m, _P, np.uint64), np.full(m, _INV, np.uint64)
        a[0] = b[0] = 1
        _pow, _ipow = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow[:n], _ipow[:n]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of documents laid end to end, A-Z lower-cased, and each document's first word's place.

    A word is a run of bytes that aren't ``WHITE``. Its hash is a polynomial in random byte values, finalized;
    equal words have equal hashes, different ones differ but for one pair in about 2**64.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = _IS_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < n]
    start[at] = inside[at]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    p, ip = _powers(n)
    h = _TABLE[data]
    h *= p
    h = np.add.reduceat(h, starts) * ip[starts]
    # a word of one document is not continued by the next document's: a start there ends it
    return mix(h), np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``k``-word shingles.

    With 1 to k-1 words (k is 32 at most): one hash, of the whole sequence; without words: none.
    """
    out = []
    if len(words) >= k:
        m = len(words) - k + 1
        h = words[:m] * _SHIFT[0]
        for j in range(1, k):
            h += words[j : m + j] * _SHIFT[j]
        h = mix(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mix((words[a:b] * _SHIFT[: b - a]).sum(keepdims=True) + _SHIFT[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def doc_shingles(col: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For slices of a text column: the first row's place, and each row's shingle hashes."""
    for a, b in slices(col):
        data, off = raw(col.slice(a, b - a))
        yield a, shingle_hashes(*word_hashes(data, off), k)
