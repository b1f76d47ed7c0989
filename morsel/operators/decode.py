"""Ids to text: bytes of tokens are gathered for whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.functions.text import FLAG, plain_id
from morsel.operators.kernel import SPACE, joined, ranges


class DecodeError(ValueError):
    """An id that no token has, or bytes that are no UTF-8."""


class Decoder:
    """Tokens by id, None where no token has it, as one buffer."""

    def __init__(self, tokens: list[bytes | None]):
        self.data, off = joined([t or b"" for t in tokens])
        self.start, self.size = off[:-1], np.diff(off)
        self.known = np.array([t is not None for t in tokens], dtype=bool)

    def texts(self, ids: np.ndarray, off: np.ndarray, strict: bool = True) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of lists of ids ids[off[i] : off[i + 1]], one after another, their offsets, and which lists hold an id of no token.

        Only the space flag is taken out of an id: whatever else lies beyond the tokens is an error, or ends in such a mark.
        """
        spaced = (ids & FLAG) != 0
        plain = ids & ~FLAG
        ok = (plain >= 0) & (plain < len(self.size))
        ok[ok] = self.known[plain[ok]]
        if strict and not ok.all():
            raise DecodeError(f"unknown token id {int(plain[~ok][0])}")
        plain = np.where(ok, plain, 0)
        size = np.where(ok, self.size[plain] if len(self.size) else 0, 0)
        ends = np.concatenate([[0], np.cumsum(size + spaced)])
        out = np.full(int(ends[-1]), SPACE, dtype=np.uint8)
        out[ranges(ends[:-1] + spaced, size)] = self.data[ranges(self.start[plain], size)] if len(self.size) else 0
        bad = np.zeros(len(off) - 1, dtype=bool)
        bad[np.searchsorted(off, np.flatnonzero(~ok), side="right") - 1] = True
        return out.tobytes(), ends[off], bad

    def column(self, lists: pa.Array, strict: bool = True) -> pa.Array:
        """Texts of a column of lists; null for null, and unless strict for what can't be decoded."""
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.where(null, 0, np.diff(lists.offsets.to_numpy())) if (null := lists.is_null().to_numpy(zero_copy_only=False)).any() else np.diff(lists.offsets.to_numpy())
        data, off, bad = self.texts(ids, np.concatenate([[0], np.cumsum(size)]), strict)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
        if (null | bad).any():
            made = pa.compute.if_else(pa.array(null | bad), None, made)
        try:
            return made.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([_text(t, strict) for t in made.to_pylist()], pa.string())


def _text(data: bytes | None, strict: bool) -> str | None:
    try:
        return None if data is None else data.decode()
    except UnicodeDecodeError as e:
        if strict:
            raise DecodeError(f"the bytes of these ids are no UTF-8: {e.reason} at {e.start}") from None
        return None


def decode_ids(ids: list[int] | np.ndarray, tokens: list[bytes | None] | Decoder) -> str:
    d = tokens if isinstance(tokens, Decoder) else Decoder(tokens)
    x = np.asarray(ids, dtype=np.int64)
    return _text(d.texts(x, np.array([0, len(x)]))[0], True)


def decode(df: DataFrame, tokens: list[bytes | None], ids_col: str = "ids", into: str = "decoded", strict: bool = True) -> DataFrame:
    """df and the text of its ids. strict: an error ends the job; else such rows are null."""
    held = df.sparkSession.sparkContext.broadcast(Decoder(tokens))

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield held.value.column(b, strict)

    return df.withColumn(into, text(df[ids_col]))


def decode_by_join(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, decoded) by a join with the vocabulary and an ordered concatenation of bytes; null for what can't be decoded."""
    one = df.select(id_col, F.posexplode_outer(ids_col).alias("pos", "x"))
    v = vocab.select("token_id", "token")
    hit = one.join(v, plain_id(F.col("x")) == F.col("token_id"), "left").withColumn("bytes", F.when(F.col("pos").isNull(), F.lit(b"")).otherwise(F.when(F.col("x").bitwiseAND(FLAG) != 0, F.concat(F.lit(b" "), "token")).otherwise(F.col("token"))))
    made = hit.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["bytes"]))
    return made.select(id_col, F.try_validate_utf8(whole.cast("string")).alias("decoded"))


def token_list(vocab: DataFrame) -> list[bytes | None]:
    """Tokens by id; None for an id that is missing."""
    rows = vocab.select("token_id", "token").toArrow().to_pydict()
    out: list[bytes | None] = [None] * (max(rows["token_id"], default=-1) + 1)
    for i, t in zip(rows["token_id"], rows["token"]):
        out[i] = bytes(t)
    return out
