"""Measures of a vocabulary on texts: compression, parity of languages, fidelity."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def compression(encoded: DataFrame, group: str = "lang", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """(group, n_docs, tokens, chars, bytes, chars_per_token, bytes_per_token); 0 a token where there are none."""
    x = encoded.groupBy(group).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(ids_col)), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.char_length(text_col)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"))
    return x.withColumn("chars_per_token", _ratio(F.col("chars"), F.col("tokens"))).withColumn("bytes_per_token", _ratio(F.col("bytes"), F.col("tokens")))


def parity(measured: DataFrame, base: str, group: str = "lang", good: float = 1.5, fair: float = 2.0) -> DataFrame:
    """(group, raw_ratio, char_ratio, verdict) against one group: of tokens, and of tokens a character."""
    b = measured.filter(F.col(group) == base).select(F.col("tokens").alias("bt"), F.col("chars").alias("bc"))
    char = (F.col("tokens") / F.col("chars")) / (F.col("bt") / F.col("bc"))
    x = measured.crossJoin(F.broadcast(b)).select(group, (F.col("tokens") / F.col("bt")).alias("raw_ratio"), char.alias("char_ratio"))
    return x.withColumn("verdict", F.when(F.col("char_ratio") <= good, "good").when(F.col("char_ratio") <= fair, "fair").otherwise("poor"))


def status_of(text: Column, decoded: Column) -> Column:
    """lossless, unknown (the vocabulary lacks a character), error (no text came back) or broken."""
    return F.when(decoded.eqNullSafe(text), "lossless").when(decoded.isNull(), "error").when(decoded.contains("<unk>"), "unknown").otherwise("broken")


def round_trip(decoded: DataFrame, text_col: str = "text", decoded_col: str = "decoded") -> DataFrame:
    """(status, n) by status_of()."""
    return decoded.groupBy(status_of(F.col(text_col), F.col(decoded_col)).alias("status")).agg(F.count("*").alias("n"))


def improvement(measured: DataFrame, key: str, of: str, over: str, value: str) -> DataFrame:
    """(percent, times): how much one row's value is above another's."""
    pick = lambda k: F.max(F.when(F.col(key) == k, F.col(value)))
    x = measured.agg(pick(of).alias("a"), pick(over).alias("b"))
    return x.select(((F.col("a") - F.col("b")) / F.col("b") * 100).alias("percent"), (F.col("a") / F.col("b")).alias("times"))


def throughput(work: Callable[[], object], n_bytes: int, times: int = 5) -> dict[str, float]:
    """Best and mean MB (10**6) and MiB (2**20) a second of wall time."""
    took = []
    for _ in range(times):
        t = time.perf_counter()
        work()
        took.append(time.perf_counter() - t)
    mean = sum(took) / len(took)
    return {"best_mb": n_bytes / 1e6 / min(took), "mean_mb": n_bytes / 1e6 / mean, "best_mib": n_bytes / 2**20 / min(took), "mean_mib": n_bytes / 2**20 / mean}
