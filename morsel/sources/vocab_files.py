"""Vocabularies on disk: a compact binary file (magic, count, then length, bytes and log-probability of each token) and Parquet."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morsel.sources.files import write_bytes

MAGIC = b"NXT1"


class VocabError(ValueError):
    """A vocabulary file that can't be read, or a token that doesn't fit one."""


def parse(data: bytes) -> list[tuple[int, bytes, float]]:
    """(token_id, token, log_prob) in the file's order; what follows the last entry is ignored."""
    if data[:4] != MAGIC:
        raise VocabError("this is no vocabulary file")
    try:
        (n,) = struct.unpack_from("<I", data, 4)
        at, out = 8, []
        for i in range(n):
            size = data[at]
            token = data[at + 1 : at + 1 + size]
            (p,) = struct.unpack_from("<f", data, at + 1 + size)
            out.append((i, token, p))
            at += 5 + size
    except (struct.error, IndexError):
        raise VocabError("the vocabulary file ends early") from None
    return out


def pack(rows: list[tuple[bytes, float]]) -> bytes:
    if long := next((t for t, _ in rows if len(t) > 255), None):
        raise VocabError(f"a token has {len(long)} bytes; the file format holds 255")
    return MAGIC + struct.pack("<I", len(rows)) + b"".join(bytes([len(t)]) + t + struct.pack("<f", p) for t, p in rows)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token, log_prob); Parquet where the path is a folder of it."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    data = spark.read.format("binaryFile").load(path).select("content").first()
    if data is None:
        raise VocabError(f"no file at {path}")
    return spark.createDataFrame([(i, bytearray(t), p) for i, t, p in parse(bytes(data[0]))], "token_id int, token binary, log_prob float")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """In the order of ids. The binary file is written by the driver: a vocabulary has fewer than 2 ** 22 tokens."""
    if path.endswith(".parquet"):
        vocab.select("token_id", "token", "log_prob").write.mode("overwrite").parquet(path)
        return
    rows = vocab.orderBy("token_id").select(F.col("token").cast("binary"), "log_prob").collect()
    write_bytes(vocab.sparkSession, path, pack([(bytes(t), p) for t, p in rows]))
