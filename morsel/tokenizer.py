"""A vocabulary ready for use on single texts, lists and tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from morsel.operators import decode as d
from morsel.operators import segment
from morsel.sources.vocab_files import parse, read_vocab


class Tokenizer:
    """depth and byte_fallback are those of Segmenter."""

    def __init__(self, rows: list[tuple[int, bytes, float]], depth: int | None = None, byte_fallback: bool = False):
        self.tokens: list[bytes | None] = [None] * (max((i for i, _, _ in rows), default=-1) + 1)
        for i, t, _ in rows:
            self.tokens[i] = t
        by = {t: (i, p) for i, t, p in sorted(rows)}
        self.segmenter = segment.Segmenter(by, by.get(b"<unk>", (0, 0.0))[0], depth, byte_fallback)
        self.decoder = d.Decoder(self.tokens)

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls(parse(f.read()))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        return cls.of(read_vocab(spark, path))

    @classmethod
    def of(cls, vocab: DataFrame) -> Tokenizer:
        r = vocab.toArrow().to_pydict()
        return cls([(i, bytes(t), p) for i, t, p in zip(r["token_id"], r["token"], r["log_prob"])])

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    def token_to_id(self, token: bytes) -> int | None:
        hit = self.segmenter.tokens.get(token)
        return None if hit is None else hit[0]

    def encode(self, text: str) -> list[int]:
        return self.segmenter.encode(text).tolist()

    def encode_numpy(self, text: str) -> np.ndarray:
        return self.segmenter.encode(text).astype(np.uint32)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Each text as one stretch."""
        return [self.segmenter.encode(t, True).tolist() for t in texts]

    def encode_batch_numpy(self, texts: list[str]) -> list[np.ndarray]:
        return [self.segmenter.encode(t, True).astype(np.uint32) for t in texts]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return d.decode_ids(ids, self.decoder)

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return [self.decode(x) for x in ids]

    def encode_table(self, df: DataFrame, text_col: str = "text", mode: str = "unit") -> DataFrame:
        """df and its `ids`."""
        return segment.encode(df, self.segmenter, text_col, mode=mode)

    def decode_table(self, df: DataFrame, ids_col: str = "ids", strict: bool = True) -> DataFrame:
        """df and its `decoded` text."""
        return d.decode(df, self.tokens, ids_col, strict=strict)
