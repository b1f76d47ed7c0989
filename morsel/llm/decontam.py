"""Benchmark decontamination by pigeonhole edit matching (operator 6).

An item of m characters (lower-cased, white space collapsed) is found where some stretch of a document is within
k = floor(RATE * m) edits of it. The item is cut into k + 1 pieces; k edits leave at least one piece whole, so every match
holds an exact piece. All pieces of all items are found in one Aho-Corasick pass over the document, and the stretch around
each hit is verified with Myers' bit-parallel edit distance, a machine integer holding a whole column of the table.

The benchmark side is held by every worker while its normalized text is below MAX_ITEM_BYTES; a larger one is cut into
parts of that size, and documents pass once a part. Nothing is shuffled and no document is cut.

Cases: a null or blank item matches nothing; items with the same text are all reported; a null or empty document has no
match; a repeated row is reported as often as it is there; an item longer than the document is found only within its edits;
very long documents are searched whole; of equally near places the distance is the same; an id that is no number is a null id;
other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed a character of the item.
RATE = 0.05
MAX_ITEM_BYTES = 8 << 20


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """k + 1 pieces that make up the item, with their places; sizes differ by one at most."""
    m = len(item)
    k = min(int(rate * m + 1e-9), m - 1)
    cut = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


class Myers:
    """Least edit distance of a pattern to any stretch of a text that ends at each place (Myers 1999)."""

    def __init__(self, pattern: str):
        self.m, self.full = len(pattern), (1 << len(pattern)) - 1
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the nearest stretch; the first of equals."""
        full, top, get = self.full, 1 << (self.m - 1), self.eq.get
        pv, mv, score, least, at = full, 0, self.m, self.m, 0
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, at = score, j + 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
        return least, at


class Matcher:
    """Items, their pieces in one automaton, and a verifier an item."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, n) for i, t in items if t is not None and (n := normalize(t))]
        self.budget = [min(int(rate * len(n) + 1e-9), len(n) - 1) for _, n in self.items]
        self.auto, self.myers = ahocorasick.Automaton(), {}
        of: dict[str, list[tuple[int, int]]] = {}
        for x, (_, n) in enumerate(self.items):
            for at, p in pieces(n, rate):
                of.setdefault(p, []).append((x, at))
        for p, where in of.items():
            self.auto.add_word(p, (len(p), where))
        if of:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of the items found in a document, the nearest match of each."""
        if not self.items:
            return []
        doc = normalize(text)
        spots: dict[int, list[int]] = {}
        for end, (size, where) in self.auto.iter(doc):
            for x, at in where:
                spots.setdefault(x, []).append(end + 1 - size - at)
        found = []
        for x, starts in spots.items():
            item_id, n = self.items[x]
            k, least = self.budget[x], None
            for lo, hi in self.windows(sorted(set(starts)), len(n), k, len(doc)):
                stretch = doc[lo:hi]
                if n in stretch:
                    d = 0
                elif not k:
                    continue
                else:
                    if x not in self.myers:
                        self.myers[x] = Myers(n)
                    d = self.myers[x].best(stretch)[0]
                if d <= k and (least is None or d < least):
                    least = d
                    if not d:
                        break
            if least is not None:
                found.append((item_id, least))
        return found

    @staticmethod
    def windows(starts: list[int], m: int, k: int, size: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold every match whose piece lies where the starts say; those that overlap are joined."""
        lo = hi = None
        for s in starts:
            a, b = max(0, s - k), min(size, s + m + k)
            if hi is not None and a <= hi and b - lo <= 4 * (m + 2 * k):
                hi = b
            else:
                if hi is not None:
                    yield lo, hi
                lo, hi = a, b
        if hi is not None:
            yield lo, hi


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    key = (rate, hash(tuple(items)), len(items))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def item_parts(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", most: int = MAX_ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in parts of at most `most` bytes of text, read one part at a time."""
    part, size = [], 0
    for i, t in benchmark.select(F.col(id_col).try_cast("long"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(t.encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += n
    yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", most: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every item found in every document, with the edits of its nearest match."""
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    out = None
    for part in item_parts(benchmark, id_col=item_col, most=most):
        held = spark.sparkContext.broadcast(part)

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = _matcher(held.value, rate)
            for batch in it:
                rows = [(d.as_py(), *f) for d, t in zip(batch.column(0), batch.column(1)) for f in m.find(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "item_id", "distance"])

        found = slim.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", most: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found; rows with a null text stay. No shuffle."""
    out = docs
    for part in item_parts(benchmark, id_col=item_col, most=most):
        held = docs.sparkSession.sparkContext.broadcast(part)
        place = docs.columns.index(text_col)

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = _matcher(held.value, rate)
            for batch in it:
                keep = np.array([not t.is_valid or not m.find(t.as_py()) for t in batch.column(place)], dtype=bool)
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
