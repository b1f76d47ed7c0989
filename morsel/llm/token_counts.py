"""Exact token counts for every context limit (operator 1).

Documents are counted by encoded length. Sums over the suffixes of that histogram then answer, for any limit,
how many documents reach it, how many tokens they hold, and what truncating to it leaves; no document is read again.

Cases: a null text has no length and is counted in no row; an empty text has length 0; repeated rows count each;
an empty table gives an empty histogram; very long texts are encoded whole; documents of equal length are one row of the
histogram; other columns, also ones named as those of the result, are ignored; ids are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morsel.llm.bpe import RANKS_PATH, encoder
from morsel.llm.common import Scratch, blocks

#: Lengths of one block of the two-level suffix sum.
BLOCK = 1024


def _count_batches(it: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    total: dict[int, int] = {}
    for batch in it:
        text = batch.column(0).drop_null()
        size = np.array(pa.compute.binary_length(text), dtype=np.int64)
        for i, j in blocks(size, 1 << 21):
            n, c = np.unique(enc.counts(text.slice(i, j - i).to_pylist()), return_counts=True)
            for a, b in zip(n.tolist(), c.tolist()):
                total[a] = total.get(a, 0) + b
    # one partial histogram a task is all that is shuffled
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["n_tokens", "n_docs"])


def length_histogram(docs: DataFrame, path: str = RANKS_PATH, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): the exact number of documents of each encoded length."""
    import pyarrow.compute  # noqa: F401

    slim = docs.select(docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _count_batches(it, path), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of a histogram (n_tokens, n_docs):

    n_docs and tokens of exactly L; docs_at_least and tokens_at_least of L or more; total_docs and total_tokens;
    truncated_total, the tokens left when every document is cut to L; quantile, the share of documents of at most L.

    Two levels, so that no single task holds all lengths: sums of blocks of BLOCK lengths, then sums within each block.
    """
    # both levels read it: a small written table, or all texts would be encoded twice
    hist = Scratch(hist.sparkSession, "lengths").write(hist, "histogram")
    h = hist.select(F.col("n_tokens").cast("long"), F.col("n_docs").cast("long")).filter("n_tokens is not null")
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    sums = sums.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = h.join(sums, "block").withColumns({"docs_at_least": F.col("d_later") + F.sum("n_docs").over(within), "tokens_at_least": F.col("t_later") + F.sum("tokens").over(within)})
    return x.select(
        "n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits of 0 or more, from suffix_sums()."""
    spark = sums.sparkSession
    want = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    first = want.join(sums, sums["n_tokens"] > want["context_limit"], "left").groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("s"))
    total = sums.agg(F.max("total_tokens").alias("total_tokens"))
    over, beyond = F.coalesce(F.col("s.docs_at_least"), F.lit(0)), F.coalesce(F.col("s.tokens_at_least"), F.lit(0))
    return first.crossJoin(F.broadcast(total)).select("context_limit", over.alias("docs_over"), (F.coalesce("total_tokens", F.lit(0)) - beyond + F.col("context_limit") * over).alias("truncated_total"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    want = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return want.join(sums, sums["quantile"] >= want["share"], "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
