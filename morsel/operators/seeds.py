"""Candidate tokens: counts of all substrings of units, and tokens that are always there."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morsel.functions import text as T
from morsel.operators.kernel import SPACE, cut_units, ranges, slices, text_buffer

SPECIALS = ("<unk>", "<s>", "</s>", "<pad>")
ASCII = (0, 0x7F)
LETTERS = ((0x80, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x4E00, 0x4EFF))
SYMBOLS = ((0x1F000, 0x1F0FF), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF))
#: Characters of one stretch of a long unit; stretches overlap by a token's length.
STRETCH = 1024
#: Substrings of so many characters or more are counted where all stretches that begin with the same HEAD characters are.
HEAD = 4
#: Batches of up to so many documents are counted by one task each; larger ones are taken apart as the whole corpus is.
ONE_TASK = 4096
#: Bytes of texts whose units are found at a time.
BLOCK = 1 << 22


def unit_counts(docs: DataFrame, by_word: bool = False, text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """([keys,] unit, n): units are counted before they are taken apart, so that each is taken apart once."""
    return _part_counts(docs, by_word, text_col, keys).groupBy(*keys, "unit").agg(F.sum("n").alias("n"))


def _part_counts(docs: DataFrame, by_word: bool, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, unit, n), counted within each stretch of texts, so rows may repeat."""
    if by_word:
        return docs.select(*keys, F.explode(T.byte_words(docs[text_col])).alias("unit"), F.lit(1).cast("long").alias("n"))
    d = docs.select(*keys, docs[text_col].cast("string").alias("__text"))
    names = d.columns[:-1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, off = text_buffer(batch.column(len(names)))
            for i, j in slices(off, BLOCK):
                part = batch.slice(i, j - i)
                group, rows = _groups([part.column(k) for k in range(len(names))], j - i)
                unit, of, n = _units_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], group)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(rows[of])) for k in range(len(names))), unit, pa.array(n)], names=[*names, "unit", "n"])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{types}unit string, n long")


def _groups(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's values, and a row of each number."""
    group = np.zeros(n, np.int64)
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = np.unique(group * n + code, return_inverse=True)[1]
    return group, np.unique(group, return_index=True)[1]


def _units_of(raw: np.ndarray, off: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(unit, group, n) of the seed units of texts (text.seed_units), each text in a group."""
    feed = raw == 10
    ends = np.zeros(len(raw) + 1, dtype=bool)
    ends[off[1:]] = True
    ends[:-1] |= feed
    gone = feed | ((raw == 13) & ends[1:])
    # lines begin where texts do and behind line feeds
    begin = np.union1d(off[:-1], np.flatnonzero(feed) + 1)
    begin = begin[begin < len(raw)]
    text = np.searchsorted(off, begin, side="right") - 1
    kept = raw[~gone]
    at = np.append(begin - np.concatenate([[0], np.cumsum(gone)])[begin], len(kept))
    cut = cut_units(kept, at)
    if len(cut) == 1:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = cut[:-1], cut[1:]
    own = group[text[np.searchsorted(at, start, side="right") - 1]]
    lead = (kept[start] == SPACE) & (end - start > 1) & (kept[np.minimum(start + 1, len(kept) - 1)] != SPACE)
    size = end - start - lead
    some = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(size), pa.py_buffer(some), pa.py_buffer(kept[ranges(start + lead, size)])).dictionary_encode()
    pair, n = np.unique(own * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary.take(pa.array(pair % len(coded.dictionary))), pair // len(coded.dictionary), n


def _tails(units: DataFrame, max_bytes: int, *cols: str) -> DataFrame:
    """(*cols, tail): up to max_bytes characters from each place of each unit. Long units go in stretches."""
    size = F.char_length("unit")
    cut = units.filter("unit <> ''").select(*cols, F.explode(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / STRETCH).cast("int")), lambda k: F.struct(F.substring("unit", k * STRETCH + 1, F.lit(STRETCH + max_bytes - 1)).alias("w"), F.least(F.lit(STRETCH), size - k * STRETCH).alias("m")))).alias("x"))
    return cut.select(*cols, F.explode(F.transform(F.sequence(F.lit(1), F.col("x.m")), lambda i: F.substring(F.col("x.w"), i, F.lit(max_bytes)))).alias("tail"))


def spans(units: DataFrame, max_bytes: int, *cols: str) -> DataFrame:
    """(token, *cols): each substring of each unit that has at most max_bytes bytes, as often as it is there.

    Long units go in stretches, so that no row holds more than STRETCH places.
    """
    starts = _tails(units, max_bytes, *cols)
    tokens = starts.select(*cols, F.explode(F.transform(F.sequence(F.lit(1), F.char_length("tail")), lambda k: F.substring(F.col("tail"), F.lit(1), k))).alias("token"))
    return tokens.filter(F.octet_length("token") <= max_bytes)


def prefix_counts(data: np.ndarray, at: np.ndarray, end: np.ndarray, n: np.ndarray, min_freq: int = 1, least: int = 1) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(place of each, its bytes, counts) of the distinct prefixes of data[at[i] : end[i]], each seen n[i] times, a byte a step.

    What is longer is never more frequent: of `least` characters or more, what is seen less than min_freq times is dropped with all
    that begins with it. Single characters and what has fewer characters than `least` always stay.
    """
    group, live, more = np.zeros(len(at), np.int64), np.flatnonzero(at < end), (data & 0xC0) == 0x80
    more = np.append(more, False)
    chars = np.zeros(len(at), np.int32)
    k = 0
    while len(live):
        here = at[live] + k
        _, first, group = np.unique(group[live] * 256 + data[here], return_index=True, return_inverse=True)
        cnt = np.bincount(group, weights=n[live]).astype(np.int64)
        chars[live] += ~more[here]
        k += 1
        after = here[first] + 1
        # a length in bytes may end within a character
        done = ~more[after]
        size = chars[live[first]]
        keep = (cnt >= min_freq) | (size < least) | ((size == 1) & done)
        out = np.flatnonzero(done & keep)
        yield at[live[first[out]]], k, cnt[out]
        on = (cnt >= min_freq) | (size < least) | ~done & (size == 1)
        go = on[group] & (at[live] + k < end[live])
        live, full = live[go], np.zeros(len(at), np.int64)
        full[live] = group[go]
        group = full


def _table(data: np.ndarray, found: Iterator[tuple[np.ndarray, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches (token, cnt) of prefix_counts()."""
    for place, k, cnt in found:
        for i in range(0, len(place), 1 << 18):
            some = place[i : i + (1 << 18)]
            off = np.arange(len(some) + 1, dtype=np.int32) * k
            token = pa.StringArray.from_buffers(len(some), pa.py_buffer(off), pa.py_buffer(data[ranges(some, np.full(len(some), k))]))
            yield pa.RecordBatch.from_arrays([token, pa.array(cnt[i : i + (1 << 18)])], names=["token", "cnt"])


_COUNTED = pa.schema([("token", pa.string()), ("cnt", pa.int64())])


def _of_units(units: pa.Table, max_bytes: int, min_freq: int) -> Iterator[pa.RecordBatch]:
    """Counts of all substrings of units (unit, n)."""
    data, off = text_buffer(units.column("unit"))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    which = np.searchsorted(off, at, side="right") - 1
    yield from _table(data, prefix_counts(data, at, np.minimum(off[which + 1], at + max_bytes), units.column("n").to_numpy()[which], min_freq))


def _all_spans(units: DataFrame, max_bytes: int, min_freq: int, *keys: str) -> DataFrame:
    """(*keys, token, cnt) of all substrings of (*keys, unit, n): a row for each place and what follows it goes where all rows with its
    first HEAD characters are; shorter tokens are added up after that."""
    tails = _tails(units, max_bytes, *keys, "n").repartition(*keys, F.substring("tail", 1, HEAD))
    names = [f.name for f in tails.select(*keys).schema]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(it)
        if not t.num_rows:
            return
        parts = [((), t)]
        for k in names:
            parts = [((*had, v), p.filter(pa.compute.is_null(p.column(k)) if v is None else pa.compute.equal(p.column(k), v))) for had, p in parts for v in pa.compute.unique(p.column(k)).to_pylist()]
        for had, p in parts:
            data, off = text_buffer(p.column("tail"))
            for b in _table(data, prefix_counts(data, off[:-1], np.minimum(off[1:], off[:-1] + max_bytes), p.column("n").to_numpy(), min_freq, HEAD)):
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * b.num_rows, t.schema.field(k).type) for k, v in zip(names, had)), *b.columns], names=[*names, *b.schema.names])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in tails.select(*keys).schema)
    return tails.mapInArrow(run, f"{types}token string, cnt long").groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt"))


def frequent(counts: DataFrame, min_freq: int) -> DataFrame:
    """Tokens seen often enough, and all single characters."""
    return counts.filter((F.col("cnt") >= min_freq) | (F.char_length("token") == 1))


def seed_counts(docs: DataFrame, max_bytes: int = 32, min_freq: int = 2, by_word: bool = False, batch: int | None = None, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """(token, cnt) of the substrings of all documents.

    batch: drop what is rare within each batch of so many documents (by order_col) before adding up, as an approximation
    that saves memory where there is no shuffle; the default is exact.
    """
    if not batch:
        return frequent(_all_spans(unit_counts(docs, by_word, text_col), max_bytes, min_freq), min_freq)
    d = docs.withColumn("batch", F.floor(docs[order_col] / batch))
    if batch > ONE_TASK:
        part = frequent(_all_spans(unit_counts(d, by_word, text_col, ("batch",)), max_bytes, min_freq, "batch"), min_freq)
    else:
        one = _part_counts(d, by_word, text_col, ("batch",)).groupBy("batch")
        part = one.applyInArrow(lambda t: pa.Table.from_batches(_of_units(t.group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"]), max_bytes, min_freq), _COUNTED), "token string, cnt long")
    counts = part.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return frequent(counts, min_freq)


def guaranteed_tokens(spark: SparkSession, symbols: bool = True) -> DataFrame:
    """(token): ASCII and the letters of common scripts, with pictographs or not."""
    cps = reduce(DataFrame.unionByName, (spark.range(a, b + 1) for a, b in (ASCII, *LETTERS, *(SYMBOLS if symbols else ()))))
    return cps.select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("token"))


def add_guaranteed(counts: DataFrame, symbols: bool = True) -> DataFrame:
    """counts, and each guaranteed token that it lacks with count 1."""
    more = guaranteed_tokens(counts.sparkSession, symbols).join(counts, "token", "left_anti")
    return counts.select("token", "cnt").unionByName(more.withColumn("cnt", F.lit(1).cast("long")))


def log_probs(counts: DataFrame) -> DataFrame:
    """(token, cnt, log_prob) of the tokens with a count: ln(cnt) - ln(sum of all)."""
    some = counts.filter("cnt > 0")
    total = some.agg(F.sum("cnt").alias("total"))
    return some.crossJoin(F.broadcast(total)).select("token", "cnt", (F.ln("cnt") - F.ln("total")).cast("float").alias("log_prob"))


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, 0.0) for t in SPECIALS], "token string, log_prob float")
