"""Segmentation into the fewest tokens, and of those the most probable.

The kernel is one narrow pass over Arrow batches: texts are cut into units, whose distinct ones Arrow finds; words are segmented all
at once (kernel.py), other units many at a time, and those remembered; ids are gathered as arrays. No rows are shuffled, so it also
runs on streams.
lattice_*() find edges by a join of spans with the vocabulary, and then the best path of each unit over its edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.functions.text import FLAG, UNIT, units
from morsel.operators.kernel import SPACE, Paths, Trie, char_length, cut_units, joined, ranges, slices, text_buffer, word_paths
from morsel.operators.vocabulary import check_size, insertion_lookup

#: Units remembered by a process, and the longest of them, and of words that grow together, in bytes; neither changes a result.
CACHE, LONGEST = 250_000, 64
#: Bytes of texts that are worked on together, so that a worker's memory doesn't grow with what a batch of rows holds.
SLICE = 1 << 21
#: Bytes that are segmented at a time. Stretches so long that fewer than FEW are side by side go one by one.
BLOCK, FEW = 1 << 18, 8
#: Edges of a lattice that are solved together.
EDGES = 1 << 18
#: The rule of cut_units() as a pattern.
_UNIT = re.compile(UNIT)


class _Memory:
    """Ids of units, held one after another."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> int:
        """The place of the first of so many units, given where each one's ids start."""
        self.start, self.size, self.ids = (self._room(x, n) for x, n in ((self.start, self.n + len(size)), (self.size, self.n + len(size)), (self.ids, self.used + len(ids))))
        n, used = self.n, self.used
        self.size[n : n + len(size)] = size
        self.start[n : n + len(size)] = used + start
        self.ids[used : used + len(ids)] = ids
        self.n, self.used = n + len(size), used + len(ids)
        return n

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        if n <= len(x):
            return x
        out = np.zeros(max(n, 2 * len(x)), x.dtype)
        out[: len(x)] = x
        return out


class Segmenter:
    """A vocabulary held by a worker. tokens: bytes to (id, log-probability); the latest of a repeated token counts.

    depth: longer tokens are kept apart from the trie, with the same result. byte_fallback: a stretch that no path spans gives the
    tokens of its bytes, or an error where one has none, in place of unknown characters.
    """

    def __init__(self, tokens: dict[bytes, tuple[int, float]], unknown: int = 0, depth: int | None = None, byte_fallback: bool = False):
        check_size(max((i for i, _ in tokens.values()), default=0))
        self.unknown, self.byte_fallback = unknown, byte_fallback
        self.names = list(tokens)
        self.ids = np.array([i for i, _ in tokens.values()], dtype=np.int32)
        self.logs = np.array([p for _, p in tokens.values()], dtype=np.float32)
        self.trie = Trie(self.names, depth)
        self.back = Trie([t[::-1] for t in self.names]) if depth is None else None
        self.longest = max(map(len, self.names), default=0)
        self.space = self.names.index(b" ") if b" " in tokens else None
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.names)
        self._fresh()

    def _fresh(self) -> None:
        self.memory = _Memory()
        self.heads: set[bytes] | None = None
        self._tokens: dict[bytes, tuple[int, np.float32]] | None = None

    @property
    def tokens(self) -> dict[bytes, tuple[int, np.float32]]:
        if self._tokens is None:
            self._tokens = dict(zip(self.names, zip(self.ids.tolist(), self.logs)))
        return self._tokens

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memory", "heads", "_tokens")}

    def __setstate__(self, s: dict) -> None:
        self.__dict__.update(s)
        self._fresh()

    def _paths(self, data: np.ndarray, off: np.ndarray) -> Paths:
        return Paths(self.trie, self.ids, self.logs, data, off, self.space)

    def segment(self, data: bytes) -> list[int]:
        """Ids of one stretch of bytes. Where nothing reaches the end, the furthest path is taken, the next character is
        unknown, and what follows it is segmented afresh."""
        out: list[int] = []
        whole = data
        while data:
            ids, done = self._reach(data)
            if done < len(data) and self.byte_fallback:
                return self._bytes(whole)
            out += ids
            if done == len(data):
                break
            out.append(self.unknown)
            data = data[done + char_length(data[done]) :]
        return out

    def _bytes(self, data: bytes) -> list[int]:
        if lacking := next((b for b in data if bytes([b]) not in self.tokens), None):
            raise ValueError(f"the vocabulary has no token for byte {lacking:#04x}")
        return [self.tokens[bytes([b])][0] for b in data]

    def _reach(self, data: bytes) -> tuple[list[int], int]:
        """One stretch by itself: ids of the furthest path, and where it ends."""
        if self.heads is None:
            self.heads = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        n, heads, get = len(data), self.heads, self.tokens.get
        count, cost, back, made = [-1] * (n + 1), [np.float32(0)] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        count[0] = 0

        def offer(i: int, end: int, token: int, p: np.float32) -> None:
            c, new = count[i] + 1, cost[i] - p
            if count[end] < 0 or c < count[end] or (c == count[end] and new < cost[end]):
                count[end], cost[end], back[end], made[end] = c, new, i, token

        space = get(b" ")
        far = 0
        for i in range(n):
            if count[i] < 0:
                if i > far:
                    break
                continue
            spaced = data[i] == SPACE and i + 1 < n
            start, flag = (i + 1, FLAG) if spaced else (i, 0)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = data[start:end]
                if piece not in heads:
                    break
                if (hit := get(piece)) is not None:
                    offer(i, end, hit[0] | flag, hit[1])
                    far = max(far, end)
            if spaced and space is not None:
                offer(i, i + 1, *space)
                far = max(far, i + 1)
        done = n
        while count[done] < 0:
            done -= 1
        ids, at = [], done
        while at:
            ids.append(made[at])
            at = back[at]
        return ids[::-1], done

    def segment_all(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many stretches, where those of each start, and how many it has."""
        length = np.array([len(p) for p in parts], dtype=np.int64)
        order = np.argsort(length, kind="stable")
        start, size, pool, used = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [], 0

        def put(some: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal used
            start[some], size[some] = used + np.cumsum(n) - n, n
            pool.append(ids)
            used += len(ids)

        total = np.cumsum(length[order])
        i = 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, side="right")))
            some = order[i:j]
            i = j
            if len(some) < FEW and length[some[-1]] > 4096:
                for k in some.tolist():
                    ids = np.array(self.segment(parts[k]), dtype=np.int32)
                    put(np.array([k]), ids, np.array([len(ids)]))
                continue
            p = self._paths(*joined([parts[k] for k in some])).solve()
            put(some, *p.ids()[:2])
            stuck = some[p.count[p.last] < 0]
            if len(stuck) and self.byte_fallback:
                for k in stuck.tolist():
                    ids = np.array(self._bytes(parts[k]), dtype=np.int32)
                    put(np.array([k]), ids, np.array([len(ids)]))
            elif len(stuck):
                put(stuck, *self._paths(*joined([parts[k] for k in stuck])).solve(unknown=self.unknown).ids()[:2])
        return np.concatenate(pool or [np.zeros(0, np.int32)]), start, size

    def _words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct stretches: (their bytes, n + 1 offsets, which one each stretch is), and of those that are words with at most one
        leading space (places of tokens, how many each has, gap) as word_paths(); others have 0."""
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        _, ends, data = coded.dictionary.buffers()
        off, data = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1], np.frombuffer(data, np.uint8)
        start, end = off[:-1], off[1:]
        spaced = (data[start] == SPACE) & (end - start > 1)
        start = start + spaced
        word = np.flatnonzero(~(spaced & (data[start] == SPACE)) & (end - start <= LONGEST)) if self.back else np.zeros(0, np.int64)
        size, gap = np.zeros(len(end), np.int64), np.full(len(end), -1, np.float32)
        token, size[word], gap[word] = word_paths(self.trie, self.back, self.logs, data, start[word], end[word]) if self.back else (np.zeros(0, np.int32), 0, 0)
        return data, off, coded.indices.to_numpy(), token, size, gap

    def _marked(self, token: np.ndarray, data: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of tokens of words, the first one of a word behind a space with its flag."""
        ids = self.ids[token]
        spaced = (size > 0) & (data[off[:-1]] == SPACE) & (np.diff(off) > 1)
        ids[(np.cumsum(size) - size)[spaced]] |= FLAG
        return ids

    def _whole(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_texts() of texts as one stretch each.

        Where no token holds a space after something else, every path passes the places where a space follows something else, so
        texts are cut there and all cuts grow together. What a cut has cost before decides ties by rounding. A word whose path is
        better than others by more than rounding can make of it has that path wherever it stands. For other cuts costs are those of
        the paths found, and their paths are found again until they stay the same. Then, cut by cut, all are those of one long walk.
        """
        data = raw.tobytes()
        n = len(off) - 1
        size, made = np.zeros(n, np.int64), [np.zeros(0, np.int32)] * n
        todo = np.flatnonzero(off[1:] > off[:-1])
        if self.cuts and len(todo):
            begin = np.zeros(len(raw), dtype=bool)
            begin[off[todo]] = True
            space = raw == SPACE
            begin[1:] |= space[1:] & ~space[:-1]
            at = np.append(np.flatnonzero(begin), len(raw))
            length = np.diff(at)
            first = np.append(np.searchsorted(at, off[todo]), len(length))
            words, word_off, which, token, count, gap = self._words(raw, at)
            pool, logs, start = self._marked(token, words, word_off, count), self.logs[token], np.cumsum(count) - count
            # what a text can cost; a step rounds by 2 ** -24 of it at most, and two paths of a word by twice their steps
            high = float(np.abs(self.logs).max(initial=0))
            cost = np.zeros(len(count))
            cost[count > 0] = -np.add.reduceat(logs.astype(float), start[count > 0]) if len(logs) else 0
            cost = np.where(count > 0, np.maximum(cost, 0) if not (self.logs > 0).any() else count * high, np.diff(word_off) * high)
            bound = 1.01 * (np.add.reduceat(cost[which], first[:-1]).max() + LONGEST * high)
            fixed = (count > 0) & (gap > 4 * 2.0**-24 * bound * (count + 1))
            open_ = ~fixed[which]
            # texts with a very long cut of no word go by themselves, and those with a cut that no path spans
            long = np.maximum.reduceat(np.where(open_, length, 0), first[:-1]) > 4096
            open_ &= ~np.repeat(long, np.diff(first))
            left = [todo[long]]
            weight = np.concatenate([[0], np.cumsum(np.where(open_, length, 0))])[first]
            i = 0
            while i < len(todo):
                j = max(i + 1, int(np.searchsorted(weight, weight[i] + BLOCK, side="right")) - 1)
                some, a, b = todo[i:j], first[i], first[j]
                begins = first[i : j + 1] - a
                i = j
                again = np.flatnonzero(open_[a:b])
                here, n_ids, from_ = which[a:b], count[which[a:b]], start[which[a:b]]
                all_ids, all_logs = pool, logs
                if len(again):
                    cut = np.concatenate([[0], np.cumsum(length[a + again])])
                    p = self._paths(raw[ranges(at[a + again], length[a + again])], cut).solve()
                    text = np.searchsorted(begins, again, side="right") - 1
                    left.append(some[np.unique(text[p.count[p.last] < 0])])
                    ids, n_again, log = p.ids()
                    while True:
                        all_ids, all_logs = np.concatenate([pool, ids]), np.concatenate([logs, log])
                        n_ids[again], from_[again] = n_again, len(pool) + np.cumsum(n_again) - n_again
                        before = np.zeros(len(again), np.float32)
                        for t in np.unique(text).tolist():
                            x, y = begins[t], begins[t + 1]
                            run = np.cumsum(-all_logs[ranges(from_[x:y], n_ids[x:y])], dtype=np.float32)
                            mine = slice(*np.searchsorted(text, (t, t + 1)))
                            done = (np.cumsum(n_ids[x:y]) - n_ids[x:y])[again[mine] - x]
                            before[mine] = np.where(done > 0, run[np.maximum(done - 1, 0)], 0) if len(run) else 0
                        new, n_again, log = p.solve(before).ids()
                        if np.array_equal(new, ids):
                            break
                        ids = new
                ends = np.concatenate([[0], np.cumsum(n_ids)])
                found = all_ids[ranges(from_, n_ids)]
                for k, x in enumerate(np.split(found, ends[begins[1:-1]])):
                    made[some[k]] = x
            todo = np.unique(np.concatenate(left))
        if len(todo):
            pool, start, count = self.segment_all([data[a:b] for a, b in zip(off[todo].tolist(), off[todo + 1].tolist())])
            for k, x, y in zip(todo.tolist(), start.tolist(), count.tolist()):
                made[k] = pool[x : x + y]
        size[:] = [len(m) for m in made]
        return np.concatenate(made or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(size)])

    def encode_texts(self, raw: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and n + 1 offsets; whole: each as one stretch, without cutting it into units."""
        if whole:
            return self._whole(raw, off)
        at = cut_units(raw, off)
        if len(at) == 1:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        data, word_off, which, token, size, _ = self._words(raw, at)
        ids, start = self._marked(token, data, word_off, size), np.cumsum(size) - size
        rest = np.flatnonzero(size == 0)
        if len(rest):
            held = data.tobytes()
            place = self._places([held[a:b] for a, b in zip(word_off[rest].tolist(), word_off[rest + 1].tolist())])
            m = self.memory
            size[rest] = m.size[place]
            start[rest] = len(ids) + np.cumsum(size[rest]) - size[rest]
            ids = np.concatenate([ids, m.ids[ranges(m.start[place], m.size[place])]])
        size = size[which]
        ids = ids[ranges(start[which], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.searchsorted(at, off)]

    def _places(self, distinct: list[bytes]) -> np.ndarray:
        """Where the memory holds units; those it lacks are segmented first."""
        m = self.memory
        if len(m.place) > CACHE or m.used > 32 * CACHE:
            m = self.memory = _Memory()
        get = m.place.get
        place = np.array([get(u, -1) for u in distinct], dtype=np.int64)
        new = np.flatnonzero(place < 0).tolist()
        if new:
            parts = [distinct[k] for k in new]
            n = m.add(*self.segment_all(parts))
            place[new] = n + np.arange(len(new))
            m.place.update((u, n + k) for k, u in enumerate(parts) if len(u) <= LONGEST)
        return place

    def encode(self, text: str, whole: bool = False) -> np.ndarray:
        """Ids of a text; whole: as one stretch, without cutting it into units."""
        data = text.encode()
        return self.encode_texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), whole)[0]


def collect_segmenter(vocab: DataFrame) -> Segmenter:
    """The vocabulary, whose size check_size() bounds, for sending to the workers."""
    rows = insertion_lookup(vocab).toArrow().to_pydict()
    tokens = {bytes(t): (i, p) for t, i, p in zip(rows["token"], rows["token_id"], rows["log_prob"])}
    return Segmenter(tokens, tokens.get(b"<unk>", (0, 0.0))[0])


def encode(df: DataFrame, segmenter: Segmenter | Broadcast, text_col: str = "text", into: str = "ids", mode: str = "unit") -> DataFrame:
    """df and a column of token ids. mode "unit" cuts texts at spaces first; "whole" does not. Null gives null."""
    held = segmenter if isinstance(segmenter, Broadcast) else df.sparkSession.sparkContext.broadcast(segmenter)
    if mode not in ("unit", "whole"):
        raise ValueError(f"mode is unit or whole, not {mode!r}")

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield id_lists(held.value, batch, mode == "whole")

    return df.withColumn(into, ids(df[text_col]))


def id_lists(s: Segmenter, texts: pa.Array, whole: bool = False) -> pa.ListArray:
    """A list of ids for each text; null for null."""
    raw, off = text_buffer(texts)
    parts = []
    for i, j in slices(off, SLICE):
        ids, ends = s.encode_texts(raw[off[i] : off[j]], off[i : j + 1] - off[i], whole)
        some = texts.slice(i, j - i)
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=some.is_null() if some.null_count else None))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def count_ids(df: DataFrame, segmenter: Segmenter | Broadcast, text_col: str = "text") -> DataFrame:
    """(x, n): how often each id comes in the units of all texts. Each task counts what it encodes, so only sums are shuffled."""
    held = segmenter if isinstance(segmenter, Broadcast) else df.sparkSession.sparkContext.broadcast(segmenter)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 0), dtype=np.int64)
        for b in it:
            raw, off = text_buffer(b.column(0))
            for i, j in slices(off, SLICE):
                ids = held.value.encode_texts(raw[off[i] : off[j]], off[i : j + 1] - off[i])[0]
                spaced = (ids & FLAG) != 0
                for k, x in enumerate((ids[~spaced], ids[spaced] & ~FLAG)):
                    if len(x) and x.max() >= total.shape[1]:
                        total = np.pad(total, ((0, 0), (0, int(x.max()) + 1 - total.shape[1])))
                    total[k] += np.bincount(x, minlength=total.shape[1])
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at | (k * FLAG)).astype(np.int32)), pa.array(total[k, at])], names=["x", "n"])

    return df.select(df[text_col].cast("string")).mapInArrow(run, "x int, n long").groupBy("x").agg(F.sum("n").alias("n"))


def lattice_edges(unit_table: DataFrame, vocab: DataFrame) -> DataFrame:
    """(unit, start, end, token_id, log_prob): every token that fits at every place of the units, counted in characters.

    A space before something else is skipped and marked in the id, or stands alone.
    """
    v = insertion_lookup(vocab).select(F.col("token").cast("string").alias("piece"), "token_id", "log_prob")
    longest = v.agg(F.max(F.char_length("piece")).alias("longest"))
    size = F.char_length("unit")
    at = unit_table.select("unit").crossJoin(F.broadcast(longest)).select("unit", "longest", F.explode(F.sequence(F.lit(0), size - 1)).alias("start")).withColumn("spaced", (F.substring(F.col("unit"), F.col("start") + 1, F.lit(1)) == " ") & (F.col("start") + 1 < F.char_length("unit")))
    at = at.withColumn("from", F.col("start") + F.col("spaced").cast("int"))
    ends = at.select("unit", "start", "spaced", "from", F.explode(F.sequence(F.col("from") + 1, F.least(F.char_length("unit"), F.col("from") + F.col("longest")))).alias("end"))
    fit = ends.withColumn("piece", F.substring(F.col("unit"), F.col("from") + 1, F.col("end") - F.col("from"))).join(v, "piece")
    marked = fit.select("unit", "start", "end", F.when(F.col("spaced"), F.col("token_id").bitwiseOR(FLAG)).otherwise(F.col("token_id")).alias("token_id"), "log_prob")
    alone = at.filter("spaced").join(F.broadcast(v.filter("piece = ' '"))).select("unit", "start", (F.col("start") + 1).alias("end"), "token_id", "log_prob")
    return marked.unionByName(alone)


def lattice_encode(unit_table: DataFrame, vocab: DataFrame) -> DataFrame:
    """(unit, ids): the best path over each unit's edges; ids are null where none reaches the end.

    unit_table is read more than once. Edges of a unit stay in the task that its row went to.
    """
    at = unit_table.select("unit").repartition("unit")
    # groups are sorted by numbers, which is quicker than by strings; units keep apart where their hashes don't
    edges = lattice_edges(at, vocab).groupBy(F.xxhash64("unit").alias("hash"), "unit").agg(F.collect_list(F.struct("start", "end", "token_id", "log_prob")).alias("edges")).drop("hash")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            for i, j in slices(np.append(0, np.cumsum(lists.value_lengths().to_numpy())), EDGES):
                unit, some = batch.column(0).slice(i, j - i), lists.slice(i, j - i)
                start, end, token, log = (x.to_numpy() for x in some.flatten().flatten())
                where = np.repeat(np.arange(j - i), some.value_lengths().to_numpy())
                p = Paths.of_edges(pa.compute.utf8_length(unit).to_numpy().astype(np.int64), where, start, end - start, token, log).solve()
                ids, n, _ = p.ids()
                found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids), mask=pa.array(p.count[p.last] < 0))
                yield pa.RecordBatch.from_arrays([unit, found], names=["unit", "ids"])

    return at.join(edges.mapInArrow(run, "unit string, ids array<int>"), "unit", "left")


def encode_by_units(df: DataFrame, vocab: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) without the trie: distinct units are segmented by the lattice and joined back in order."""
    at = df.select(id_col, F.posexplode(units(df[text_col])).alias("pos", "unit"))
    each = lattice_encode(at.select("unit").distinct(), vocab)
    return at.join(each, "unit").groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
