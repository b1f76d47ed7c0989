"""Perplexity under a class-based bigram model with exchange clustering (operator 7).

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

1. All words of all documents are counted, and every one is in the model. Those that make up at least MIN_SHARE of the corpus
   are frequent: never more than 1 / MIN_SHARE words, held by every worker. The others are a table that grows with the input;
   while the frequent ones are clustered they stand in one of KINDS classes by their length and letters.
2. All pairs of neighbours are counted, documents beginning and ending with a boundary.
3. Exchange clustering (Kneser and Ney; Martin, Liermann and Ney): a sweep takes the words from the most frequent down and
   moves each to the class that raises the likelihood of all pairs most. Counts of words with classes come from the pair
   table in Spark before each sweep; class counts follow every move. Sweeps go on until one gains less than GAIN of all that
   was gained, or the exact likelihood falls; the best classes are kept.
4. Then each rarer word moves by one exchange step, in Spark, to the class that raises the likelihood most while the counts of
   the clustering stay fixed; its neighbours that are rare themselves count as their kinds in that step.
5. Documents are written as classes, one byte a word: frequent words and the HELD_WORDS most frequent rare ones are looked up, a
   bounded table, the rest joined. Counts of class pairs are then taken anew from all words of all documents.
6. Class transitions are absolutely discounted towards class frequencies, and every word is emitted by its own count in its
   class. A word that training never saw has the class of its kind, which backing off alone leads to. build_vocabulary() and
   estimate() without a table emit a word of a kind with 1 / (distinct words + 1).

Cases: very long texts are read whole; of classes that are equally good the first is taken; a null text has null figures; an empty one only the boundary pair; repeated rows are counted and scored each; a null
doc_id is scored as any other; other columns are ignored; an empty table gives a uniform model and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.llm.common import U64, Scratch, blocks, hash_spans, segment_sum, text_buffer, words

MIN_SHARE, CLASSES, KINDS, DISCOUNT = 1e-5, 64, 8, 0.5
#: Sweeps end when one raises the likelihood by less than this share of what all of them have.
GAIN = 1e-4
#: Bits of an id in a pair; above the vocabulary's bound.
ID_BITS = 20
#: Distinct keys a task holds before it passes them on.
HELD = 2_000_000
#: Rare words that workers hold with their classes and counts; the others are joined.
HELD_WORDS = 1 << 20


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of every word of lower-cased texts, whose three low bits are its kind, and n + 1 offsets."""
    raw, off = text_buffer(text)
    start, end, first = words(raw, off, punctuation=True)
    h = hash_spans(raw, start, end)
    size = end - start
    kind = np.minimum((size - 1) // 4, 3) if len(size) else size
    if len(raw):
        kind = kind + 4 * (raw[start] < 97)  # digits and marks apart from letters
    return (h & ~U64(7)) | kind.astype(U64), first


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Keys and their counts, added up within a task as far as memory allows."""
    make = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["key", "n"])
    keys, counts, held = [], [], 0
    for p in parts:
        if not len(p):
            continue
        p = np.sort(p)
        at = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        keys.append(p[at])
        counts.append(np.diff(np.append(at, len(p))))
        held += len(at)
        if held > HELD:
            k, c = _merge(keys, counts)
            if len(k) > HELD // 2:
                yield make(k, c)
                k, c = k[:0], c[:0]
            keys, counts, held = [k], [c], len(k)
    if keys:
        k, c = _merge(keys, counts)
        for i in range(0, len(k), 1 << 18):
            yield make(k[i : i + (1 << 18)], c[i : i + (1 << 18)])


def _blocks_of(it: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.Array, pa.RecordBatch]]:
    for batch in it:
        text = batch.column(batch.num_columns - 1)
        for i, j in blocks(np.diff(text_buffer(text)[1]), most):
            yield text.slice(i, j - i), batch.slice(i, j - i)


@dataclass
class Vocabulary:
    """Codes of the frequent words in ascending order with their counts; counts and distinct words of each rare kind."""

    codes: np.ndarray
    counts: np.ndarray
    kind_counts: np.ndarray
    kind_types: np.ndarray
    docs: int = 0

    def ids(self, code: np.ndarray) -> np.ndarray:
        """Place in codes, or len(codes) + kind."""
        n = len(self.codes)
        if not n:
            return (code & U64(7)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), n - 1)
        return np.where(self.codes[at] == code, at, n + (code & U64(7)).astype(np.int64))

    @property
    def boundary(self) -> int:
        return len(self.codes) + KINDS


def _lowered(docs: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    cols = [docs[id_col].try_cast("long").alias("doc_id")] if id_col else []
    return docs.select(*cols, F.lower(docs[text_col].cast("string")).alias("text"))


def build_vocabulary(docs: DataFrame, scratch: Scratch, min_share: float = MIN_SHARE, text_col: str = "text") -> Vocabulary:
    """Frequent words. Exact counts of all words; what reaches the driver is bounded by 1 / min_share rows and KINDS sums."""
    slim = _lowered(docs, text_col).filter("text is not null")
    counted = slim.mapInArrow(lambda it: _counted(tokens(t)[0] for t, _ in _blocks_of(it)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = scratch.write(counted, "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(1, int(np.ceil(min_share * total)))
    top = counted.filter(F.col("n") >= least).toArrow()
    code, n = top["key"].to_numpy().view(U64), top["n"].to_numpy()
    order = np.argsort(code)
    kc, kt = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for r in counted.filter(F.col("n") < least).groupBy(F.col("key").bitwiseAND(7).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        kc[r["kind"]], kt[r["kind"]] = r["n"], r["types"]
    scratch.drop("words")
    return Vocabulary(code[order], n[order], kc, kt, slim.count())


def _pairs(texts: Iterator[tuple[pa.Array, pa.RecordBatch]], voc: Vocabulary) -> Iterator[np.ndarray]:
    for text, _ in texts:
        ids, first = _with_boundaries(text, voc)
        inner = np.ones(len(ids), dtype=bool)
        inner[first[1:] - 1] = False
        at = np.flatnonzero(inner)
        yield (ids[at] << ID_BITS) | ids[at + 1]


def _with_boundaries(text: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text between two boundaries, and n + 1 offsets."""
    code, first = tokens(text)
    n = len(first) - 1
    ids = np.full(len(code) + 2 * n, voc.boundary, dtype=np.int64)
    word = np.arange(len(code)) + 2 * np.repeat(np.arange(n), np.diff(first)) + 1
    ids[word] = voc.ids(code)
    return ids, first + 2 * np.arange(n + 1)


def count_pairs(docs: DataFrame, voc: Vocabulary, text_col: str = "text") -> DataFrame:
    """(key, n): the exact count of each pair of neighbouring ids, key = first << ID_BITS | second."""
    held = docs.sparkSession.sparkContext.broadcast(voc)
    slim = _lowered(docs, text_col).filter("text is not null")
    return slim.mapInArrow(lambda it: _counted(_pairs(_blocks_of(it), held.value)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def class_counts(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(after, before): counts of each id with the class after it, and with the class before it."""
    held = pairs.sparkSession.sparkContext.broadcast(classes.astype(np.int64))
    size = len(classes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one dense sum a task over a table that 1 / MIN_SHARE bounds
        both = np.zeros(2 * size * n_classes, dtype=np.int64)
        for batch in it:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = key >> ID_BITS, key & ((1 << ID_BITS) - 1)
            np.add.at(both, a * n_classes + held.value[b], n)
            np.add.at(both, (size + b) * n_classes + held.value[a], n)
        at = np.flatnonzero(both)
        for i in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 18)]), pa.array(both[at[i : i + (1 << 18)]])], names=["cell", "n"])

    got = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(2 * size * n_classes, dtype=np.int64)
    both[got["cell"].to_numpy()] = got["n"].to_numpy()
    both = both.reshape(2, size, n_classes)
    return both[0], both[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """The part of the log-likelihood of all pairs that depends on classes, for counts of class pairs."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(0)).sum() - _xlogx(grid.sum(1)).sum())


def sweep(classes: np.ndarray, order: np.ndarray, after: np.ndarray, before: np.ndarray, movable: int) -> np.ndarray:
    """One exchange sweep over the ids in `order`, among the first `movable` classes."""
    classes = classes.copy()
    total = after.shape[1]
    grid = np.zeros((total, total))
    np.add.at(grid, classes, after)
    rows, cols = grid.sum(1), grid.sum(0)
    for w in order:
        a = classes[w]
        out, into = after[w].astype(np.float64), before[w].astype(np.float64)
        so, si = out.sum(), into.sum()
        grid[a] -= out
        grid[:, a] -= into
        np.maximum(grid, 0, out=grid)
        rows[a] -= so
        cols[a] -= si
        row, col = grid[:movable], grid[:, :movable].T
        gain = (_xlogx(row + out) - _xlogx(row)).sum(1) + (_xlogx(col + into) - _xlogx(col)).sum(1)
        gain -= _xlogx(rows[:movable] + so) - _xlogx(rows[:movable]) + _xlogx(cols[:movable] + si) - _xlogx(cols[:movable])
        c = int(gain.argmax())
        if gain[c] <= gain[a] + 1e-9:
            c = a
        classes[w] = c
        grid[c] += out
        grid[:, c] += into
        rows[c] += so
        cols[c] += si
    return classes


def cluster(pairs: DataFrame, voc: Vocabulary, n_classes: int = CLASSES, sweeps: int | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every id, counts of class pairs, and the likelihood before and after each sweep that raised it.

    sweeps: at most so many; None: until they gain less than GAIN.
    """
    n = len(voc.codes)
    order = np.lexsort((voc.codes, -voc.counts)) if n else np.zeros(0, np.int64)
    total = n_classes + KINDS + 1
    classes = np.empty(n + KINDS + 1, dtype=np.int64)
    classes[order] = np.arange(n) % n_classes
    classes[n:] = n_classes + np.arange(KINDS + 1)
    history: list[float] = []
    best = None
    k = 0
    while True:
        after, before = class_counts(pairs, classes, total)
        grid = np.zeros((total, total), dtype=np.int64)
        np.add.at(grid, classes, after)
        now = likelihood(grid)
        if history and now <= history[-1] + 1e-9 * abs(history[-1]):
            break
        history.append(now)
        best = classes, grid
        if k == sweeps or k > 1 and history[-1] - history[-2] < GAIN * (history[-1] - history[0]):
            break
        k += 1
        classes = sweep(classes, order, after, before, n_classes)
    return *best, history


def _rare_neighbours(texts: Iterator[tuple[pa.Array, pa.RecordBatch]], voc: Vocabulary, classes: np.ndarray, total: int) -> Iterator[pa.RecordBatch]:
    """(key, near, n) of rare words: near is total * (class of the word after) + class of the word before."""
    n = len(voc.codes)
    for text, _ in texts:
        ids, code = _coded(text, voc)[:2]
        at = np.flatnonzero((ids >= n) & (ids < voc.boundary))
        key, near = code[at], total * classes[ids[at + 1]] + classes[ids[at - 1]]
        order = np.lexsort((near, key))
        key, near = key[order], near[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (near[1:] != near[:-1]))) if len(key) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(near[first].astype(np.int16)), pa.array(np.diff(np.append(first, len(key))).astype(np.int32))], names=["key", "near", "n"])


def _coded(text: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and word codes of each text between two boundaries, and n + 1 offsets."""
    code, first = tokens(text)
    n = len(first) - 1
    ids, codes = np.full(len(code) + 2 * n, voc.boundary, dtype=np.int64), np.zeros(len(code) + 2 * n, dtype=U64)
    word = np.arange(len(code)) + 2 * np.repeat(np.arange(n), np.diff(first)) + 1
    ids[word], codes[word] = voc.ids(code), code
    return ids, codes, first + 2 * np.arange(n + 1)


def place(key_of: np.ndarray, cell: np.ndarray, n: np.ndarray, words: int, grid: np.ndarray, movable: int) -> np.ndarray:
    """Class of each word by one exchange step against fixed counts of class pairs.

    Entries: the word (ascending), the class after it or total + the class before it, and the count.
    """
    total = len(grid)
    both = np.concatenate([grid[:movable].T, grid[:, :movable]]).astype(np.float64)
    base = _xlogx(both)
    gain = np.zeros((words, movable))
    first = np.flatnonzero(np.append(True, key_of[1:] != key_of[:-1])) if len(key_of) else np.zeros(0, np.int64)
    if len(first):
        gain[key_of[first]] = np.add.reduceat(_xlogx(both[cell] + n[:, None]) - base[cell], first, axis=0)
    for side, sums in ((cell < total, grid[:movable].sum(1)), (cell >= total, grid[:, :movable].sum(0))):
        s = np.bincount(key_of[side], weights=n[side], minlength=words)
        gain -= _xlogx(sums + s[:, None]) - _xlogx(sums)
    return gain.argmax(1)


def place_rare(docs: DataFrame, voc: Vocabulary, classes: np.ndarray, grid: np.ndarray, n_classes: int, text_col: str = "text") -> DataFrame:
    """(key, class, n) of all rare words."""
    total = len(grid)
    held = docs.sparkSession.sparkContext.broadcast((voc, classes, grid))
    slim = _lowered(docs, text_col).filter("text is not null")
    near = slim.mapInArrow(lambda it: _rare_neighbours(_blocks_of(it), *held.value[:2], total), "key long, near short, n int")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, len(batch), 4096):
                b = batch.slice(i, 4096)
                size = np.diff(b.column(1).offsets.to_numpy())
                x = b.column(1).flatten()
                both, n = x.field("near").to_numpy().astype(np.int64), x.field("n").to_numpy()
                word = np.repeat(np.arange(len(b)), size)
                order = np.argsort(np.concatenate([word, word]), kind="stable")
                cell, twice = np.concatenate([both // total, total + both % total])[order], np.concatenate([n, n])[order]
                to = place(np.concatenate([word, word])[order], cell, twice, len(b), held.value[2], n_classes)
                count = np.bincount(word, weights=n, minlength=len(b)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to.astype(np.int32)), pa.array(count)], names=["key", "class", "n"])

    # one exchange by word serves both steps; no word is frequent here, and its list has at most total ** 2 entries
    listed = near.repartition("key").groupBy("key", "near").agg(F.sum("n").alias("n")).groupBy("key").agg(F.collect_list(F.struct("near", "n")).alias("near"))
    return listed.mapInArrow(run, "key long, class int, n long")


@dataclass
class Model:
    """Log-probabilities of class transitions and of each id from its class; (key, class, emission) of rarer words if they have their own."""

    voc: Vocabulary
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    rare: DataFrame | None = None
    #: Words of each class; 1 where there are none and for classes that say what the word is.
    sizes: np.ndarray | None = None


def estimate(voc: Vocabulary, classes: np.ndarray, grid: np.ndarray, discount: float = DISCOUNT, rare: DataFrame | None = None, rare_sizes: np.ndarray | int = 0) -> Model:
    total = len(grid)
    n = len(voc.codes)
    back = (grid.sum(0) + 1.0) / (grid.sum() + total)
    rows = grid.sum(1, keepdims=True)
    seen = (grid > 0).sum(1, keepdims=True)
    p = np.where(rows > 0, (np.maximum(grid - discount, 0) + discount * seen * back) / np.maximum(rows, 1), back)
    size = np.bincount(classes[:n], weights=voc.counts, minlength=total) if n else np.zeros(total)
    size = np.maximum(size + rare_sizes, 1)
    emit = np.concatenate([np.log(voc.counts / size[classes[:n]]), -np.log(voc.kind_types + 1.0), [0.0]])
    if rare is not None:
        of = F.element_at(F.array(*(F.lit(float(x)) for x in size)), F.col("class") + 1)
        rare = rare.select("key", "class", "n", F.log(F.col("n") / of).alias("emission"))
    size[np.arange(total) >= total - KINDS - 1] = 1
    return Model(voc, classes, np.log(p), emit, rare, size)


def _fit(docs: DataFrame, min_share: float, n_classes: int, sweeps: int | None, text_col: str, id_col: str | None) -> tuple[Model, DataFrame | None]:
    """The model, and the documents in classes where it has rare words."""
    scratch = Scratch(docs.sparkSession, "brown")
    voc = build_vocabulary(docs, scratch, min_share, text_col)
    if len(voc.codes) + KINDS + 1 > 1 << ID_BITS:
        raise ValueError("min_share is too small: ids need more than ID_BITS bits")
    pairs = scratch.write(count_pairs(docs, voc, text_col), "pairs")
    classes, grid, _ = cluster(pairs, voc, n_classes, sweeps)
    scratch.drop("pairs")
    if not voc.kind_types.any():
        return estimate(voc, classes, grid), None
    rare = scratch.write(place_rare(docs, voc, classes, grid, n_classes, text_col), "rare")
    sizes = np.zeros(len(grid), dtype=np.int64)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    voc = replace(voc, kind_counts=np.zeros(KINDS, np.int64), kind_types=np.zeros(KINDS, np.int64))
    classed = class_documents(docs, voc, classes, rare, scratch, text_col, id_col)
    grid = class_pairs(classed, int(classes[voc.boundary]), len(grid))
    return estimate(voc, classes, grid, rare=rare, rare_sizes=sizes), classed


def fit(docs: DataFrame, min_share: float = MIN_SHARE, n_classes: int = CLASSES, sweeps: int | None = None, text_col: str = "text") -> Model:
    return _fit(docs, min_share, n_classes, sweeps, text_col, None)[0]


def fit_and_score(docs: DataFrame, min_share: float = MIN_SHARE, n_classes: int = CLASSES, sweeps: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """score_documents() of the documents that the model is made of; they are put in classes once for both."""
    model, classed = _fit(docs, min_share, n_classes, sweeps, text_col, id_col)
    return score_documents(docs, model, text_col, id_col) if classed is None else _score_classed(classed, model)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document; the closing boundary counts as a word of the perplexity."""
    if model.rare is not None:
        return _score_classed(class_documents(docs, model.voc, model.classes, model.rare, Scratch(docs.sparkSession, "brown_score"), text_col, id_col), model)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for text, rows in _blocks_of(it):
            ids, first = _with_boundaries(text, m.voc)
            c = m.classes[ids]
            step = np.zeros(len(ids))
            step[1:] = m.transition[c[:-1], c[1:]] + m.emission[ids[1:]]
            step[first[:-1]] = 0
            total, n = segment_sum(step, first), np.diff(first) - 2
            null = np.array(text.is_null())
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, mask=null) for x in (n, total, np.exp(np.minimum(-total / (n + 1), 700))))], names=["doc_id", "n_words", "log_prob", "perplexity"])

    return _lowered(docs, text_col, id_col).mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")


def held_words(rare: DataFrame, most: int = HELD_WORDS) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame]:
    """(codes in ascending order, classes, counts) of the rare words from some count on, at most `most` of them; and the others."""
    size, least = 0, None
    # distinct counts of rare words grow as the square root of the corpus at most
    for r in rare.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        size += r["words"]
        if size > most:
            break
        least = r["n"]
    if least is None:
        return (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)), rare
    got = rare.filter(F.col("n") >= least).select("key", "class", "n").toArrow()
    code = got["key"].to_numpy().view(U64)
    order = np.argsort(code)
    return (code[order], got["class"].to_numpy()[order].astype(np.int64), got["n"].to_numpy()[order]), rare.filter(F.col("n") < least)


#: Stands for a word whose class a join will tell.
LATER = 255


def class_documents(docs: DataFrame, voc: Vocabulary, classes: np.ndarray, rare: DataFrame, scratch: Scratch, text_col: str, id_col: str | None, most: int = HELD_WORDS) -> DataFrame:
    """(doc_id, empty, classes, log_n): the class of each word of each document, one byte each, and the sum of its words' log-counts.

    Workers hold the frequent words and at most HELD_WORDS of the rare ones; the others come by a join.
    """
    spark = docs.sparkSession
    known, rest = held_words(rare, most)
    if classes.max(initial=0) >= LATER:
        raise ValueError(f"classes must be fewer than {LATER}")
    held = spark.sparkContext.broadcast((voc, classes, known))

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, classes, (codes, to, count) = held.value
        log_count = np.log(np.concatenate([voc.counts, count, [1]]))
        for text, rows in _blocks_of(it):
            word, first = tokens(text)
            ids = voc.ids(word)
            own, place = classes[ids].astype(np.uint8), np.minimum(ids, len(voc.codes))
            at = np.flatnonzero(ids >= len(voc.codes))
            place[at] = len(log_count) - 1
            own[at] = LATER
            if len(codes):
                near = np.minimum(np.searchsorted(codes, word[at]), len(codes) - 1)
                hit = codes[near] == word[at]
                own[at[hit]], place[at[hit]] = to[near[hit]], len(voc.codes) + near[hit]
            later = np.flatnonzero(own == LATER)
            some = np.searchsorted(later, first)
            data = own.tobytes()
            cols = [pa.array([data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()), pa.array(segment_sum(log_count[place], first)), pa.ListArray.from_arrays(pa.array(some, pa.int32()), pa.array(word[later].view(np.int64)))]
            yield pa.RecordBatch.from_arrays([rows.column(0), text.is_null(), *cols], names=["doc_id", "empty", "classes", "log_n", "later"])

    slim = _lowered(docs, text_col, id_col) if id_col else docs.select(F.lit(None).cast("long").alias("doc_id"), F.lower(docs[text_col].cast("string")).alias("text"))
    coded = slim.mapInArrow(code, "doc_id long, empty boolean, classes binary, log_n double, later array<long>")
    coded = scratch.write(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    asked = coded.filter("size(later) > 0")
    told = asked.select("row", F.explode(F.array_distinct("later")).alias("key")).join(rest.select("key", "class", "n"), "key").groupBy("row").agg(F.collect_list(F.struct("key", "class", "n")).alias("told"))
    none = F.array().cast("array<struct<key:bigint,class:int,n:bigint>>")

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, classes, _ = held.value
        for b in it:
            own, logs = [], b.column(3).to_numpy().copy()
            for i, (data, later, told) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist())):
                c = np.frombuffer(data, np.uint8).copy()
                word = np.array(later, dtype=np.int64)
                # a word that training never saw has the class of its kind
                to, count = classes[len(voc.codes) + (word & 7)], np.ones(len(word))
                if told:
                    t = np.array(sorted((x["key"], x["class"], x["n"]) for x in told), dtype=np.int64)
                    at = np.minimum(np.searchsorted(t[:, 0], word), len(t) - 1)
                    hit = t[at, 0] == word
                    to[hit], count[hit] = t[at[hit], 1], t[at[hit], 2]
                c[c == LATER] = to
                logs[i] += np.log(count).sum()
                own.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary()), pa.array(logs)], names=["doc_id", "empty", "classes", "log_n"])

    filled = asked.join(told, "row", "left").select("doc_id", "empty", "classes", "log_n", "later", F.coalesce("told", none).alias("told")).mapInArrow(fill, "doc_id long, empty boolean, classes binary, log_n double")
    scratch.write(filled, "filled")
    whole = coded.filter("size(later) = 0").select("doc_id", "empty", "classes", "log_n")
    return whole.unionByName(spark.read.schema(whole.schema).parquet(f"{scratch.root}/filled"))


def class_pairs(classed: DataFrame, edge: int, total: int) -> np.ndarray:
    """Counts of class pairs in all documents, each between two boundaries."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, dtype=np.int64)
        for b in it:
            data = [x for x in b.column(0).to_pylist()]
            c = np.frombuffer(bytes([edge]) + b"".join(x + bytes([edge]) for x in data), np.uint8).astype(np.int64)
            sums += np.bincount(c[:-1] * total + c[1:], minlength=total * total)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["cell", "n"])

    grid = np.zeros(total * total, dtype=np.int64)
    for r in classed.filter("not empty").select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        grid[r["cell"]] = r["n"]
    return grid.reshape(total, total)


def _score_classed(classed: DataFrame, model: Model) -> DataFrame:
    edge, total = int(model.classes[model.voc.boundary]), len(model.transition)
    held = classed.sparkSession.sparkContext.broadcast((model.transition, np.log(model.sizes)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, log_size = held.value
        for b in it:
            data = b.column(2).to_pylist()
            n = np.array([len(x) for x in data], dtype=np.int64)
            c = np.frombuffer(b"".join(bytes([edge]) + x + bytes([edge]) for x in data), np.uint8).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n + 2)])
            step = np.zeros(len(c))
            step[1:] = transition[c[:-1], c[1:]] - log_size[c[1:]]
            step[first[:-1]] = 0
            whole = segment_sum(step, first) + b.column(3).to_numpy()
            empty = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, mask=empty) for x in (n, whole, np.exp(np.minimum(-whole / (n + 1), 700))))], names=["doc_id", "n_words", "log_prob", "perplexity"])

    return classed.mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")
