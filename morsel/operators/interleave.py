"""Blending corpora by weight."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.functions.text import is_blank
from morsel.operators.ranking import global_rank, rank_within
from morsel.scratch import Scratch


def credit_schedule(sizes: list[int], weights: list[float], limit: int = 0) -> list[int]:
    """The source of each step. Every source earns its share a step, the one with most credit that has documents left pays 1; the last of equals."""
    w = np.array(weights, dtype=np.float32)
    share = w / w.sum(dtype=np.float32) if len(w) else w
    credit, left, out = share.copy(), list(sizes), []
    while any(left) and not (limit and len(out) >= limit):
        best = -1
        for i, n in enumerate(left):
            if n and (best < 0 or credit[i] >= credit[best]):
                best = i
        out.append(best)
        left[best] -= 1
        credit[best] -= np.float32(1)
        credit = credit + share
    return out


def random_schedule(sizes: list[int], weights: list[float], seed: int = 42) -> list[int]:
    """The source of each step by seeded draws over the weight of the sources that are not used up; one that finds its source empty gives nothing."""
    total = sum(weights)
    chance = [w / total for w in weights]
    r, left, live, out = random.Random(seed), list(sizes), list(range(len(sizes))), []
    while live:
        x, mass, pick = r.random() * sum(chance[i] for i in live), 0.0, live[0]
        for i in live:
            mass += chance[i]
            if x <= mass:
                pick = i
                break
        if left[pick]:
            left[pick] -= 1
            out.append(pick)
        else:
            live.remove(pick)
    return out


def interleave(docs: DataFrame, weights: list[tuple[str, float]], source_col: str = "source", order_col: str = "doc_id", text_col: str = "text", max_docs: int = 0, method: str = "spread", seed: int = 42) -> DataFrame:
    """docs with `ord`, their place in the blend, without blank texts; max_docs counts what is left.

    method "spread" puts the k-th document of a source of weight w at (k + 1/2) / w: the same shares as the credit schedule while
    all sources last, without any step by step work. "credit" and "random" are exact schedules, made on the driver in one step a
    document, for corpora up to some ten million documents. Sources that weights don't name are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "interleave")
    known = docs.filter(docs[source_col].isin([s for s, _ in weights]))
    ranked = rank_within(known, source_col, [F.col(order_col)], scratch)
    if method == "spread":
        w = F.lit(None).cast("double")
        place = F.lit(0)
        for k, (s, x) in enumerate(weights):
            w = F.when(F.col(source_col) == s, float(x)).otherwise(w)
            place = F.when(F.col(source_col) == s, -k).otherwise(place)
        # blank texts take their place in the schedule and go
        kept = ranked.withColumn("__due", (F.col("rank") + 0.5) / w).withColumn("__place", place).filter(~is_blank(F.col(text_col)))
        out = global_rank(kept.drop("rank"), [F.col("__due"), F.col("__place"), F.col(order_col)], scratch, "blend").drop("__due", "__place")
    else:
        ranked = scratch.write(ranked, "numbered")
        size = {r[0]: r[1] for r in ranked.groupBy(source_col).count().collect()}
        sizes, ws = [size.get(s, 0) for s, _ in weights], [x for _, x in weights]
        steps = credit_schedule(sizes, ws) if method == "credit" else random_schedule(sizes, ws, seed)
        seen, rows = [0] * len(weights), []
        for k, i in enumerate(steps):
            rows.append((weights[i][0], seen[i], k))
            seen[i] += 1
        plan = spark.createDataFrame(rows, f"{source_col} string, rank long, __step long")
        kept = ranked.join(plan, [source_col, "rank"]).filter(~is_blank(F.col(text_col)))
        out = global_rank(kept.drop("rank"), [F.col("__step")], scratch, "blend").drop("__step")
    out = out.withColumnRenamed("rank", "ord")
    return out.filter(F.col("ord") < max_docs) if max_docs else out


def round_robin(docs: DataFrame, group: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """docs with `ord`: one of each group in turn, the last group by name first, until the first group is used up."""
    scratch = Scratch(docs.sparkSession, "round-robin")
    ranked = scratch.write(rank_within(docs, group, [F.col(order_col)], scratch), "numbered")
    least = ranked.groupBy(group).count().agg(F.min("count").alias("least"))
    even = ranked.crossJoin(F.broadcast(least)).filter("rank < least").drop("least").withColumnRenamed("rank", "turn")
    return global_rank(even, [F.col("turn"), F.desc(group)], scratch, "turns").drop("turn").withColumnRenamed("rank", "ord")
