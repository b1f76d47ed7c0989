"""Vocabularies: tables (token_id, token, log_prob), token as binary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.functions.text import FLAG, is_single
from morsel.operators.ranking import global_rank
from morsel.operators.seeds import SPECIALS
from morsel.scratch import Scratch


def first_wins(*parts: DataFrame, on: str = "token") -> DataFrame:
    """Union of tables; of rows with one token that of the earliest table stays."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    cols = [c for c in parts[0].columns if c != on]
    return out.groupBy(on).agg(F.min_by(F.struct(*cols), "__part").alias("__x")).select(on, *[f"__x.{c}" for c in cols])


def later_wins(*parts: DataFrame, on: str = "token") -> DataFrame:
    return first_wins(*reversed(parts), on=on)


def assign_ids(tokens: DataFrame, scratch: Scratch, special_order: str = "bytes") -> DataFrame:
    """(token_id, token, log_prob) of a table (token, log_prob): ids from the highest log-probability down, ties by bytes.

    special_order="declared" puts the special tokens first among equals, in the order of SPECIALS.
    """
    t = tokens.groupBy(F.col("token").cast("binary").alias("token")).agg(F.max("log_prob").cast("float").alias("log_prob"))
    order = [F.desc("log_prob")]
    if special_order == "declared":
        place = F.lit(len(SPECIALS))
        for k, s in enumerate(SPECIALS):
            place = F.when(F.col("token") == F.encode(F.lit(s), "UTF-8"), k).otherwise(place)
        order.append(place)
    order.append(F.asc("token"))
    return global_rank(t, order, scratch, "ids").select(F.col("rank").cast("int").alias("token_id"), "token", "log_prob")


def insertion_lookup(vocab: DataFrame) -> DataFrame:
    """The row of each token that lookups find: the latest where a token was inserted again."""
    return vocab.groupBy("token").agg(F.max("token_id").alias("token_id"), F.max_by("log_prob", "token_id").alias("log_prob"))


def without_repeats(vocab: DataFrame) -> DataFrame:
    """The earliest row of each token."""
    return vocab.groupBy("token").agg(F.min("token_id").alias("token_id"), F.min_by("log_prob", "token_id").alias("log_prob")).select("token_id", "token", "log_prob")


def look_up(df: DataFrame, vocab: DataFrame, token_col: str = "token", missing: float = float("-inf")) -> DataFrame:
    """df with token_id (null if absent) and log_prob (`missing` if absent). Spark broadcasts the vocabulary if its size allows."""
    v = insertion_lookup(vocab).select(F.col("token").alias("__t"), "token_id", "log_prob")
    return df.join(v, df[token_col].cast("binary") == v["__t"], "left").drop("__t").withColumn("log_prob", F.coalesce("log_prob", F.lit(missing).cast("float")))


def statistics(vocab: DataFrame) -> DataFrame:
    """(size, mean_bytes, multi_byte, multi_byte_percent)."""
    many = F.count_if(F.octet_length("token") > 1)
    return vocab.agg(F.count("*").alias("size"), F.avg(F.octet_length("token")).alias("mean_bytes"), many.alias("multi_byte"), (F.lit(100.0) * many / F.count("*")).alias("multi_byte_percent"))


def missing_ascii(vocab: DataFrame) -> DataFrame:
    """(token): printable ASCII characters that the vocabulary lacks."""
    chars = vocab.sparkSession.range(32, 127).select(F.char("id").alias("token"))
    return chars.join(vocab.select(F.col("token").cast("string").alias("token")), "token", "left_anti")


def check_size(n: int) -> None:
    if n >= FLAG:
        raise ValueError(f"a vocabulary holds fewer than {FLAG} tokens: higher ids would run into the space flag")


def split_single(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single characters, and the rest."""
    return tokens.filter(is_single(F.col("token"))), tokens.filter(~is_single(F.col("token")))
