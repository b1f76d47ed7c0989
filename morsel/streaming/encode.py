"""Segmentation of streams. The kernel keeps no state between rows, so a stream is encoded as a table is."""

from __future__ import annotations

from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from morsel.operators.segment import Segmenter, encode


def encode_stream(stream: DataFrame, segmenter: Segmenter | Broadcast, text_col: str = "text", mode: str = "unit") -> DataFrame:
    return encode(stream, segmenter, text_col, mode=mode)


def token_rates(stream: DataFrame, segmenter: Segmenter | Broadcast, time_col: str, text_col: str = "text", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, n_texts, tokens) by event time; what comes later than `late` is dropped."""
    return encode(stream, segmenter, text_col).withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window")).agg(F.count("*").alias("n_texts"), F.sum(F.size("ids")).alias("tokens"))


def write(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parquet files of a stream, each row once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
