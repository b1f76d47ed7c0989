"""Ranks and exact top-k of whole tables without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morsel.scratch import Scratch


def global_rank(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """df with `rank`, from 0, in the given order, which must not leave ties.

    Rows are range-partitioned by the order, numbered within their range, and shifted by the sizes of the ranges before:
    what is gathered is one count a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), name)
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    w = Window.partitionBy("__range").orderBy(*order)
    return ranged.join(F.broadcast(before), "__range").withColumn("rank", F.col("__before") + F.row_number().over(w) - 1).drop("__range", "__before")


def top(df: DataFrame, order: list[Column], k: int, scratch: Scratch, name: str = "top") -> DataFrame:
    """The first k rows in an order without ties."""
    return global_rank(df, order, scratch, name).filter(F.col("rank") < k).drop("rank")


def top_by_count(df: DataFrame, count: str, then: list[Column], k: int, scratch: Scratch, name: str = "top") -> DataFrame:
    """The k rows of the highest counts, ties in the order of `then`: rows below the k-th count go before the rest is ranked.

    What one task sees is a row for each value that counts take.
    """
    each = df.groupBy(count).agg(F.count("*").alias("__n"))
    above = each.withColumn("__above", F.sum("__n").over(Window.orderBy(F.desc(count))) - F.col("__n")).filter(F.col("__above") < k)
    least = above.agg(F.min(count)).first()[0]
    return top(df if least is None else df.filter(F.col(count) >= least), [F.desc(count), *then], k, scratch, name)


def rank_within(df: DataFrame, group: str, order: list[Column], scratch: Scratch, name: str = "within") -> DataFrame:
    """df with `rank`, from 0, within each value of a column, however large the groups are.

    Rows are range-partitioned by group and order and numbered within range and group. Only the first group of a range can have begun
    before it, so that what shifts numbers is one count a range at most, and no rows are brought together by their group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(df.repartitionByRange(n, F.col(group), *order).withColumn("__range", F.spark_partition_id()), f"{name}-ranked")
    sizes = ranged.groupBy("__range", group).count()
    before = sizes.withColumn("__before", F.sum("count").over(Window.partitionBy(group).orderBy("__range")) - F.col("count"))
    before = before.filter("__before > 0").select(F.col("__range").alias("__r"), F.col(group).alias("__g"), "__before")
    w = Window.partitionBy("__range", group).orderBy(*order)
    numbered = ranged.withColumn("rank", F.row_number().over(w) - 1)
    # group values may be null
    out = numbered.join(F.broadcast(before), (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return out.select(*[F.col(c) for c in df.columns], (F.col("rank") + F.coalesce("__before", F.lit(0))).alias("rank"))
