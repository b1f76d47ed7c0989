"""Repeated passages of MIN_WORDS words or more, by suffix arrays (operator 3).

A passage is repeated when the same MIN_WORDS words in a row (white space apart, case and marks as they are) stand at two or
more places of the corpus. One suffix array of a whole corpus fits no machine, so windows of MIN_WORDS words are first brought
together exactly: the least hash of the GRAM-word sequences inside a window is a function of its words alone, hence equal
windows have equal least hashes ("anchors"). Windows in a row with one anchor at one place make a run, so two equal windows
never stand in one run, not even where a text repeats itself.

1. Every document is read once for its runs: anchor, content hash, place. An anchor of one run has no repeat in it.
2. Where all runs of an anchor are equal, all their windows are repeated.
3. The others, the edges of copies, are read again, one copy of each distinct run. Runs of an anchor meet in one task,
   which builds the suffix array of its runs (morsel.llm.suffix_array) in parts of whole anchors; a window is repeated if
   the suffix from it shares MIN_WORDS words with a neighbour in the array. An anchor of more than HOT distinct runs, such as a
   phrase that a third of all documents put in ever new surroundings, would be too much for a task: its windows are counted
   by their hashes instead, as many tasks as it takes, with the same result.
4. Repeated windows become word spans a document, merged where they overlap or touch.

All windows of all documents take part; nothing is sampled or capped, and shuffles carry runs (about one in eighteen words),
never whole texts but for documents that hold an edge.

Cases: very long texts are read whole; null and shorter texts, and rows without a doc_id, have no windows; repeated rows, and rows that share a doc_id, are
places of their own; a passage twice in one document is repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morsel.llm.common import U64, Scratch, blocks, hash_spans, ranges, run_hash, text_buffer, words
from morsel.llm.suffix_array import common_prefixes, suffix_array

MIN_WORDS, GRAM = 50, 16
#: Words of one suffix array; anchors are never split between two.
PART = 150_000
#: Distinct runs of an anchor that meet in one task; a run has at most some 85 words.
HOT = 4096


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : len(x) - size + 1]) if size < w else m


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and n + 1 offsets."""
    raw, off = text_buffer(text)
    start, end, first = words(raw, off, spaced=True)
    return hash_spans(raw, start, end), first


def runs(h: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, word of the first window, windows, anchor, content) of every run; arrays as long as the runs."""
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return none, none, none, none.astype(U64), none.astype(U64)
    n = len(h)
    grams = run_hash(h, np.arange(n - gram + 1), np.arange(gram, n + 1))
    least = sliding_min(grams, size - gram + 1)
    doc = np.searchsorted(first, np.arange(len(least)), side="right") - 1
    inside = np.arange(len(least)) + size <= first[doc + 1]
    edge = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1]) | (grams[: len(least) - 1] == least[:-1]))
    begin = np.flatnonzero(edge)
    count = np.diff(np.append(begin, len(least)))
    begin, count = begin[inside[begin]], count[inside[begin]]
    content = run_hash(h, begin, begin + count + size - 1)
    return doc[begin], begin - first[doc[begin]], count, least[begin], content


def _run_batches(it: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j in blocks(np.diff(text_buffer(batch.column(1))[1]), 1 << 21):
            h, first = word_hashes(batch.column(1).slice(i, j - i))
            doc, pos, count, anchor, content = runs(h, first, size, gram)
            ids = batch.column(0).slice(i, j - i).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[doc]), pa.array(pos.astype(np.int32)), pa.array(count.astype(np.int32))], names=["anchor", "content", "doc_id", "pos", "n"])


def _fetch_batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Words of the wanted runs of each document: columns text, doc_id and want, an array of (anchor, content, pos, n)."""
    for batch in it:
        text = batch.column(0)
        for i, j in blocks(np.diff(text_buffer(text)[1]), 1 << 21):
            h, first = word_hashes(text.slice(i, j - i))
            want = batch.column(2).slice(i, j - i)
            doc = np.repeat(np.arange(j - i), np.array(want.value_lengths(), dtype=np.int64))
            flat = want.flatten()
            anchor, content, pos, n = (flat.field(k).to_numpy() for k in range(4))
            begin = first[doc] + pos
            end = begin + n + size - 1
            ok = end <= first[doc + 1]  # rows that share a doc_id are told apart by content
            ok[ok] = run_hash(h, begin[ok], end[ok]).view(np.int64) == content[ok]
            begin, end = begin[ok], end[ok]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), pa.array(h[ranges(begin, end - begin)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[ok]), pa.array(content[ok]), lists], names=["anchor", "content", "words"])


def repeated_windows(run_words: list[np.ndarray], many: np.ndarray, least_doc: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(run, first window, last window, least document) of the repeated windows of some runs.

    many: whether a run stands at several places; least_doc: the least document that holds it.
    """
    count = np.array([len(w) for w in run_words])
    if not len(count):
        return
    # each run ends with a symbol of its own, below all words
    begin = np.concatenate([[0], np.cumsum(count + 1)[:-1]])
    text = np.empty(int(count.sum()) + len(count), dtype=np.int64)
    ends = begin + count
    body = np.ones(len(text), dtype=bool)
    body[ends] = False
    text[body] = np.unique(np.concatenate(run_words), return_inverse=True)[1] + len(count)
    text[ends] = np.arange(len(count))
    run = np.repeat(np.arange(len(count)), count + 1)
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    same = lcp >= size
    group = np.cumsum(~same) - 1  # suffixes that share `size` words
    left = ends[run[sa]] - sa
    members = np.bincount(group)[group]
    hit = (left >= size) & ((members > 1) | many[run[sa]])
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, least_doc[run[sa]])
    pos, doc = sa[hit], low[group[hit]]
    order = np.argsort(pos)
    pos, doc = pos[order], doc[order]
    if len(pos):
        cut = np.flatnonzero(np.append(True, (np.diff(pos) != 1)))
        for a, b in zip(cut, np.append(cut[1:], len(pos))):
            r = int(run[pos[a]])
            yield r, int(pos[a] - begin[r]), int(pos[b - 1] - begin[r]), int(doc[a:b].min())


def _array_batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of runs that arrive in order of anchor."""
    held: list[tuple] = []
    total = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = list(repeated_windows([r[3] for r in rows], np.array([r[2] > 1 for r in rows]), np.array([r[4] for r in rows], dtype=np.int64), size))
        cols = [[rows[f[0]][0] for f in found], [rows[f[0]][1] for f in found], *([f[k] for f in found] for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["anchor", "content", "a", "b", "first_doc_id"])

    for batch in it:
        anchor, content, places, least = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
        lists = batch.column(3)
        off, flat = np.array(lists.offsets), lists.values.to_numpy()
        for k in range(len(anchor)):
            if total >= PART and anchor[k] != held[-1][0]:
                yield flush(held)
                held, total = [], 0
            w = flat[off[k] : off[k + 1]]
            held.append((anchor[k], content[k], places[k], w.copy(), least[k]))
            total += len(w)
    if held:
        yield flush(held)


def _window_batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of runs (anchor, content, places, words, least)."""
    for batch in it:
        off, h = np.array(batch.column(3).offsets, dtype=np.int64), batch.column(3).values.to_numpy().view(U64)
        count = np.diff(off) - size + 1
        run, begin = np.repeat(np.arange(len(count)), count), ranges(off[:-1], count)
        at = pa.array(run)
        cols = [*(batch.column(k).take(at) for k in (0, 1, 2, 4)), pa.array((begin - off[run]).astype(np.int32)), pa.array(run_hash(h, begin, begin + size).view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["anchor", "content", "places", "least", "a", "window"])


def _by_windows(known: DataFrame, size: int) -> DataFrame:
    """(anchor, content, a, b, first_doc_id): the repeated windows of runs, each by itself."""
    windows = known.dropDuplicates(["anchor", "content"]).mapInArrow(lambda it: _window_batches(it, size), "anchor long, content long, places long, least long, a int, window long")
    again = windows.groupBy("anchor", "window").agg(F.sum("places").alias("n"), F.min("least").alias("first_doc_id")).filter("n > 1").drop("n")
    return windows.join(again, ["anchor", "window"]).select("anchor", "content", "a", F.col("a").alias("b"), "first_doc_id")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, text_col: str = "text", id_col: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): the repeated passages of every document.

    Words count from 0, the end is the word after the last; first_doc_id is the least document that holds a part of at least
    min_words words of the passage, the document itself included.
    """
    gram = min(gram, min_words)
    scratch = Scratch(docs.sparkSession, "passages")
    slim = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("doc_id is not null and text is not null")
    every = scratch.write(slim.mapInArrow(lambda it: _run_batches(it, min_words, gram), "anchor long, content long, doc_id long, pos int, n int"), "runs")
    stats = every.groupBy("anchor").agg(F.count("*").alias("places"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("doc_id").alias("first_doc_id")).filter("places > 1")
    shared = scratch.write(every.join(stats, "anchor"), "shared")
    scratch.drop("runs")
    whole = shared.filter("low = high").select("doc_id", F.col("pos").alias("a"), (F.col("pos") + F.col("n") - 1).alias("b"), "first_doc_id")
    edges = shared.filter("low <> high").select("anchor", "content", "doc_id", "pos", "n")
    distinct = scratch.write(edges.groupBy("anchor", "content").agg(F.count("*").alias("places"), F.min(F.struct("doc_id", "pos")).alias("at"), F.first("n").alias("n")), "distinct")
    wanted = distinct.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "content", F.col("at.pos").alias("pos"), "n")).alias("want"))
    fetched = slim.join(wanted, "doc_id").select("text", "doc_id", "want").mapInArrow(lambda it: _fetch_batches(it, min_words), "anchor long, content long, words array<long>")
    known = fetched.join(distinct.select("anchor", "content", "places", F.col("at.doc_id").alias("least")), ["anchor", "content"]).select("anchor", "content", "places", "words", "least")
    many = scratch.write(distinct.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "hot")
    by_window = None
    if not many.isEmpty():
        known = scratch.write(known, "known")
        by_window = _by_windows(known.join(many, "anchor", "left_semi"), min_words)
        known = known.join(many, "anchor", "left_anti")
    # rows that share a doc_id and a text fetch a run twice; a second copy changes nothing but must not count as a place
    found = known.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(lambda it: _array_batches(_first_of_each(it), min_words), "anchor long, content long, a int, b int, first_doc_id long")
    found = found if by_window is None else found.unionByName(by_window)
    part = edges.join(scratch.write(found, "found"), ["anchor", "content"]).select("doc_id", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"), "first_doc_id")
    spans = whole.unionByName(part).withColumn("b", F.col("b") + min_words)
    before = Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    island = Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(before), F.lit(-1))).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(island))
    return spans.groupBy("doc_id", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).select("doc_id", "start_word", "end_word", "first_doc_id")


def _first_of_each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that repeat the (anchor, content) before them."""
    last = None
    for batch in it:
        a, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(a):
            continue
        keep = np.append((a[0], c[0]) != last, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
        last = (a[-1], c[-1])
        yield batch.filter(pa.array(keep)) if not keep.all() else batch


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """repeated_passages() as DuckDB SQL: every window of every document, grouped."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    t AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
    w AS MATERIALIZED (SELECT doc_id, i, hash(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)) AS k FROM t QUALIFY i + {min_words} <= n),
    c AS (SELECT k, min(doc_id) AS low FROM w GROUP BY k HAVING count(*) > 1),
    h AS (SELECT doc_id, i, min(low) AS low FROM w JOIN c USING (k) GROUP BY doc_id, i),
    s AS (SELECT *, CASE WHEN i > lag(i, 1, -{min_words} - 1) OVER (PARTITION BY doc_id ORDER BY i) + {min_words} THEN 1 ELSE 0 END AS fresh FROM h),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s)
    SELECT doc_id, min(i)::INT AS start_word, (max(i) + {min_words})::INT AS end_word, min(low) AS first_doc_id FROM g GROUP BY doc_id, island"""
