"""Small files and folders of a knowledge base on any file system that Spark reads: local, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What partition folders write as %XX.
_ESCAPED = set("\"#%'*/:=?\\{}[]^\x7f") | {chr(i) for i in range(1, 32)}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """A file, or a folder with all that is in it; False if it was not there."""
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def partition(column: str, value: str) -> str:
    """The name of a partition's folder."""
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)
