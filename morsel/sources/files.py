"""Single files in whatever store the session's paths lead to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or all files of a folder; 0 where there is nothing."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """What tells whether a file, or a folder's list of files, has changed: size and time."""
    fs, p = _at(spark, path)
    return (total_size(spark, path), fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else (0, 0)
