"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates (operator 9).

Features of a text are its words and marks of punctuation, case kept, and their adjacent pairs; a pair of equal words is
the one feature "repeat". Each is hashed into 2**BITS places. Two heads share them. For quality, a matter of the whole text,
a feature seen c times among n has the value c / sqrt(n). For toxicity, of which one word is enough, it has the value 1 if it
is there. Scores are sparse dot products through a sigmoid.

Training reads at most MAX_TRAIN labelled documents (those of least hashed id, a documented bound); scoring reads every
document whole in one narrow pass that holds 2 ** BITS weights a head, whatever the input.

Cases: very long texts are scored whole; a score equal to a threshold keeps for quality and rejects for toxicity; a doc_id that is no
number is a null id; a null or empty text has only the bias as a feature in scoring, is not trained on, and is kept or not by that score;
null labels are not trained on; several labels of a document each count; with no labels of a head, or of one class only, its
score is the share of that class, 1 (good) or 0 (toxic) if there is none; repeated rows each their own row; an empty table
gives no rows; other columns pass through drop_low_quality() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.llm.common import BLOCK, U64, blocks, hash_spans, mix64, segment_sum, text_buffer, words

BITS = 20
MAX_TRAIN = 20_000
#: A document goes when its quality is below the first or its toxicity at or above the second.
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.5


@dataclass(frozen=True)
class Head:
    """Settings of a head: whether features count by presence, FTRL's alpha and L1, epochs, and the score without labels."""

    presence: bool
    alpha: float
    l1: float
    epochs: int
    none: float


HEADS = {"quality": Head(False, 0.5, 0.05, 3, 1.0), "toxic": Head(True, 2.0, 8.0, 6, 0.0)}
BETA, L2 = 1.0, 0.01
_REPEAT = U64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Model:
    """Weights of a head by place, with its bias."""

    weights: np.ndarray
    bias: float
    presence: bool = False


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of each text, one after another, and n + 1 offsets."""
    raw, off = text_buffer(text)
    start, end, first = words(raw, off, punctuation=True)
    h = hash_spans(raw, start, end)
    n = len(h)
    place = np.empty(2 * n, dtype=np.int32)
    place[0::2] = (mix64(h) >> U64(64 - BITS)).astype(np.int32)
    pair = np.zeros(n, dtype=U64)
    if n:
        pair[:-1] = np.where(h[:-1] == h[1:], _REPEAT, h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])
    place[1::2] = (mix64(pair) >> U64(64 - BITS)).astype(np.int32)
    keep = np.ones(2 * n, dtype=bool)
    keep[2 * first[1:][np.diff(first) > 0] - 1] = False  # no pair reaches into the next text
    count = 2 * np.diff(first) - (np.diff(first) > 0)
    return place[keep], np.concatenate([[0], np.cumsum(count)])


def train(rows: list[tuple[np.ndarray, float]], head: Head) -> Model:
    """FTRL-proximal over (places, label) in the order given, each epoch."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    # in one piece, which goes back to the system after training; what is not filled takes no memory
    total = sum(len(place) for place, _ in rows)
    held, value, first = np.empty(total, np.int32), np.empty(0 if head.presence else total, np.float32), [0]
    for place, _ in rows:
        at, c = np.unique(place, return_counts=True)
        first.append(first[-1] + len(at))
        held[first[-2] : first[-1]] = at
        if not head.presence:
            value[first[-2] : first[-1]] = c / np.sqrt(max(1, len(place)))
    weight = lambda z, n: np.where(np.abs(z) <= head.l1, 0.0, (np.sign(z) * head.l1 - z) / ((BETA + np.sqrt(n)) / head.alpha + L2))
    for _ in range(head.epochs):
        for i, j, (_, y) in zip(first, first[1:], rows):
            at, x = held[i:j], 1.0 if head.presence else value[i:j]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            b = -bz / ((BETA + np.sqrt(bn)) / head.alpha)
            d = 1 / (1 + np.exp(-np.clip((w * x).sum() + b, -35, 35))) - y
            g = d * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / head.alpha * w
            n[at] = ni + g * g
            bz += d - (np.sqrt(bn + d * d) - np.sqrt(bn)) / head.alpha * b
            bn += d * d
    return Model(weight(z, n).astype(np.float32), float(-bz / ((BETA + np.sqrt(bn)) / head.alpha)), head.presence)


def _fit(rows: list[tuple[np.ndarray, float]], head: Head) -> Model:
    y = {v for _, v in rows}
    if len(y) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 35.0 if (y.pop() if y else head.none) else -35.0, head.presence)
    return train(rows, head)


def _features_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        # in blocks, as hashing holds tables as long as the bytes that it is given
        for i, j in blocks(np.diff(text_buffer(batch.column(batch.num_columns - 1))[1]), BLOCK):
            part = batch.slice(i, j - i)
            place, off = features(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(place))], names=[*part.schema.names[:-1], "place"])


def _ordered(pdf: pd.DataFrame, known: list[str]) -> pd.DataFrame:
    """Rows of features by key, labels and places. Places are compared where the rest is equal; rows that are still equal then are the same row."""
    same = pdf.duplicated(["key", *known], keep=False)
    pdf["all"] = [np.asarray(p, np.int32).tobytes() if s else b"" for p, s in zip(pdf["place"], same)]
    return pdf.sort_values(["key", *known, "all"], kind="stable").drop(columns="all")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text_col: str = "text", id_col: str = "doc_id") -> dict[str, Model]:
    """Heads by name. Features are made where the documents are, by all tasks; the at most max_train rows of features then move to
    one task, which does the sequential updates; the driver gets weights."""
    known = [c for c in HEADS if c in labels.columns]
    lab = labels.select(F.col(id_col).try_cast("long").alias("doc_id"), *[F.col(c).cast("int") for c in known]).filter(F.col("doc_id").isNotNull())
    lab = lab.withColumn("key", F.xxhash64("doc_id")).orderBy("key", *known).limit(max_train)
    text = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("text is not null and text <> ''")
    # at most max_train narrow rows: a bounded side to broadcast
    rows = text.join(F.broadcast(lab), "doc_id").select("key", *known, "text").mapInArrow(_features_of, "key long, " + "".join(f"{c} int, " for c in known) + "place array<int>")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _ordered(pd.concat([pd.DataFrame({"key": [], "place": []} | {c: [] for c in known}), *it]), known)
        for c, head in HEADS.items():
            m = _fit([(p, float(y)) for p, y in zip(pdf["place"], pdf[c]) if pd.notna(y)] if c in known else [], head)
            at = np.flatnonzero(m.weights)
            yield pd.DataFrame({"head": [c], "bias": [m.bias], "at": [at.astype(np.int32)], "weight": [m.weights[at]]})

    out = {}
    for r in rows.repartition(1).mapInPandas(run, "head string, bias double, at array<int>, weight array<float>").collect():
        w = np.zeros(1 << BITS, np.float32)
        w[r["at"]] = r["weight"]
        out[r["head"]] = Model(w, r["bias"], HEADS[r["head"]].presence)
    return out


def scores(text: pa.Array, models: list[Model]) -> list[np.ndarray]:
    """Probability of each head for each text."""
    place, off = features(text)
    out = []
    for m in models:
        if m.presence:
            # few weights are not zero: only their places are made distinct
            some = np.flatnonzero(m.weights[place])
            key = np.sort((np.searchsorted(off, some, side="right") - 1 << BITS) | place[some])
            key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            dot = np.bincount(key >> BITS, weights=m.weights[key & ((1 << BITS) - 1)], minlength=len(text))
        else:
            dot = segment_sum(m.weights[place].astype(np.float64), off) / np.sqrt(np.maximum(np.diff(off), 1))
        out.append(1 / (1 + np.exp(-np.clip(dot + m.bias, -35, 35))))
    return out


def _scored(text: pa.Array, models: list[Model]) -> list[np.ndarray]:
    size = np.diff(text_buffer(text)[1])
    parts = [scores(text.slice(i, j - i), models) for i, j in blocks(size, BLOCK)]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(models))]


def score_documents(docs: DataFrame, models: dict[str, Model], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) of every document."""
    held = docs.sparkSession.sparkContext.broadcast([models["quality"], models["toxic"]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            q, t = _scored(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array(t), pa.array((q >= KEEP_QUALITY) & (t < KEEP_TOXIC))], names=["doc_id", "quality_score", "toxic_score", "keep"])

    slim = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, quality_score double, toxic_score double, keep boolean")


def drop_low_quality(docs: DataFrame, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps."""
    held = docs.sparkSession.sparkContext.broadcast([models["quality"], models["toxic"]])
    place = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            q, t = _scored(batch.column(place), held.value)
            yield batch.filter(pa.array((q >= KEEP_QUALITY) & (t < KEEP_TOXIC)))

    return docs.mapInArrow(run, docs.schema)
