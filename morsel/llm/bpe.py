"""Byte-pair encoding and decoding with a published byte-level vocabulary (operator 4).

Each distinct short word is held as a contiguous row of part boundaries with the rank of every adjacent
pair beside it. A round scans the ranks of a row for the minimum (the leftmost of equals), deletes the
boundary between the two parts, and refreshes the ranks of the pairs on either side. A batch of words
makes each round together, as numpy rows. Words longer than LONG bytes use a heap over a linked list,
which gives the same parts in n log n instead of n squared.

Cases: a null text gives null ids (count null); an empty text no ids; repeated rows each their own row;
other columns, also ones named as those of the result, are ignored; very long texts and words are encoded whole; of equal ranks the
leftmost pair merges; a doc_id that is no number is a null id; an empty table gives no rows; an unknown id, or bytes that are no UTF-8, decode to null.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from morsel.llm.common import BLOCK, blocks, ranges

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes from which a word goes to the heap, and a bound on cached chunks; neither changes a result.
LONG, CACHE = 64, 300_000
NONE = np.int32(2**31 - 1)


class Encoder:
    """Ranks of a vocabulary file as arrays, with a bounded cache from text chunks to ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for t, r in self.ranks.items():
            self.bytes_of[r] = t
        self.lens = np.array([len(t) if t is not None else -1 for t in self.bytes_of], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(np.maximum(self.lens, 0))])
        self.flat = np.frombuffer(b"".join(t or b"" for t in self.bytes_of), dtype=np.uint8)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary must hold all 256 single bytes")
        key, rank = [], []
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None:
                    key.append(a * size + b)
                    rank.append(r)
        order = np.argsort(np.array(key, dtype=np.int64))
        self.size, self.pair_key = size, np.array(key, dtype=np.int64)[order]
        self.pair_rank = np.array(rank, dtype=np.int32)[order]
        self.slots = np.zeros(0, np.int32)
        self.build_table()
        self.pattern = regex.compile(PATTERN)
        self.reset()

    def build_table(self) -> None:
        """Open hash table of the pairs, probed for whole arrays at once."""
        bits = max(4, int(len(self.pair_key) * 4).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, NONE, dtype=np.int32)
        left = np.arange(len(self.pair_key))
        slot = self.slot_of(self.pair_key)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            win = np.flatnonzero(free)[first]
            self.slot_key[slot[win]], self.slot_rank[slot[win]] = self.pair_key[left[win]], self.pair_rank[left[win]]
            rest = np.ones(len(left), dtype=bool)
            rest[win] = False
            left, slot = left[rest], (slot[rest] + 1) & mask
        self.mask = mask

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.start, self.count, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0
        self.chunks = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair of tokens makes; NONE where it makes none or a part is missing (negative)."""
        bad = (a < 0) | (b < 0)
        key = np.where(bad, -2, a * self.size + b)
        slot = self.slot_of(key)
        out = np.full(len(key), NONE, dtype=np.int32)
        open_ = np.flatnonzero(~bad)
        slot = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            k = self.slot_key[slot]
            hit = k == key[open_]
            out[open_[hit]] = self.slot_rank[slot[hit]]
            more = ~hit & (k != -1)
            open_, slot = open_[more], (slot[more] + 1) & self.mask
        return out

    def merge_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of short words of one width class."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        part = np.full((n, width + 1), -1, dtype=np.int64)
        part[:, :width][np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full((n, width + 1), NONE, dtype=np.int32)
        rank[:, :width] = self.rank_of(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(n, width)
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        which = np.arange(n)
        cols = np.arange(width + 1)
        while len(which):
            rows = np.arange(len(which))
            best = rank.argmin(axis=1)
            low = rank[rows, best]
            end = low == NONE
            if end.any():
                for i in np.flatnonzero(end):
                    done[which[i]] = part[i, : size[i]].astype(np.int32)
                go = ~end
                which, part, rank, size, best, low = which[go], part[go], rank[go], size[go], best[go], low[go]
                rows = np.arange(len(which))
                if not len(which):
                    break
            part[rows, best] = low
            # delete the boundary after the merged part: what lies beyond moves one place to the left
            take = np.minimum(cols + (cols > best[:, None]), width)
            part, rank = np.take_along_axis(part, take, 1), np.take_along_axis(rank, take, 1)
            part[:, width], rank[:, width] = -1, NONE
            size = size - 1
            rank[rows, best] = self.rank_of(part[rows, best], part[rows, best + 1])
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.rank_of(part[left, best[left] - 1], part[left, best[left]])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, by a heap over a linked list of parts."""
        n = len(word)
        part = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda a, b: self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := pair(part[i], part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pair(r, part[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, part[after[i]]))
            if before[i] >= 0 and (x := pair(part[before[i]], r)) is not None:
                heapq.heappush(heap, (x, before[i], part[before[i]], r))
        return np.array([p for p in part if p >= 0], dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w)
            elif w:
                by.setdefault((len(w) + 3) // 4, []).append(i)
        for group in by.values():
            for k in range(0, len(group), 32768):
                part = group[k : k + 32768]
                for i, ids in zip(part, self.merge_rows([words[i] for i in part])):
                    out[i] = ids
        return out

    def learn(self, new: dict[str, None], cache: dict[str, int], lead: str) -> None:
        """Encode chunks that the cache lacks. Chunk = leading space and a run up to the next such space."""
        pieces = [self.pattern.findall(lead + c) for c in new]
        flat = list(dict.fromkeys(p for ps in pieces for p in ps))
        ids = dict(zip(flat, self.encode_words([p.encode() for p in flat])))
        made = [np.concatenate([ids[p] for p in ps]) if len(ps) > 1 else ids[ps[0]] if ps else np.zeros(0, np.int32) for ps in pieces]
        count = np.array([len(m) for m in made], dtype=np.int64)
        total, n = int(count.sum()), len(made)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * total, np.int32)])
        if self.chunks + n > len(self.start):
            grow = np.zeros(self.chunks + 2 * n, np.int64)
            self.start, self.count = np.concatenate([self.start[: self.chunks], grow]), np.concatenate([self.count[: self.chunks], grow])
        self.ids[self.used : self.used + total] = np.concatenate(made) if total else []
        self.start[self.chunks : self.chunks + n] = self.used + np.cumsum(count) - count
        self.count[self.chunks : self.chunks + n] = count
        cache.update(zip(new, range(self.chunks, self.chunks + n)))
        self.used, self.chunks = self.used + total, self.chunks + n

    def chunks_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cached chunk numbers of all texts, and the number of chunks of each.

        A space before a visible character always begins a piece of PATTERN, whatever precedes it, so texts are cut there
        and each distinct chunk is matched and merged once. Texts with other runs of white space take one regex pass.
        """
        if self.chunks > CACHE:
            self.reset()
        split, heads, counts = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            p = t.split(" ")
            if any(not x or x[0].isspace() for x in p[1:]):
                p = _cut(t)
            heads.append(p[0])
            counts[i] = len(p)
            split.append(p)
        new = dict.fromkeys(x for p in split for x in p[1:] if x not in self.cache)
        if new:
            self.learn(new, self.cache, " ")
        first = dict.fromkeys(h for h in heads if h not in self.first)
        if first:
            self.learn(first, self.first, "")
        get = self.cache.__getitem__
        out = np.empty(int(counts.sum()), dtype=np.int64)
        k = 0
        for h, p in zip(heads, split):
            out[k] = self.first[h]
            out[k + 1 : k + len(p)] = np.fromiter(map(get, p[1:]), dtype=np.int64, count=len(p) - 1)
            k += len(p)
        return out, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        chunk, counts = self.chunks_of(texts)
        acc = np.concatenate([[0], np.cumsum(self.count[chunk])])
        ends = np.cumsum(counts)
        return acc[ends] - acc[ends - counts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets."""
        chunk, counts = self.chunks_of(texts)
        n = self.count[chunk]
        acc = np.concatenate([[0], np.cumsum(n)])
        off = acc[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[ranges(self.start[chunk], n)], off

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str | None]:
        """Texts of id sequences; None where an id is unknown or the bytes are no UTF-8."""
        ids = np.asarray(ids, dtype=np.int64)
        good = (ids >= 0) & (ids < self.size)
        n = np.where(good, self.lens[np.where(good, ids, 0)], -1)
        bad = n < 0
        n = np.maximum(n, 0)
        raw = self.flat[ranges(self.at[np.where(bad, 0, ids)], n)].tobytes()
        cut = np.concatenate([[0], np.cumsum(n)])[off]
        wrong = np.concatenate([[0], np.cumsum(bad)])[off]
        out: list[str | None] = []
        for i in range(len(off) - 1):
            try:
                out.append(None if wrong[i + 1] > wrong[i] else raw[cut[i] : cut[i + 1]].decode())
            except UnicodeDecodeError:
                out.append(None)
        return out


_SPACED = regex.compile(r" (?=\S)")


def _cut(text: str) -> list[str]:
    """Chunks of a text with runs of white space: cut at each space before a visible character, the space itself dropped."""
    return _SPACED.split(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_batches(it: Iterator[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in it:
        key, text = batch.column(0), batch.column(1)
        size = np.diff(np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]) if len(text) else np.zeros(0, np.int32)
        for i, j in blocks(size.astype(np.int64), BLOCK):
            part = text.slice(i, j - i)
            texts = part.fill_null("").to_pylist()
            ids, off = enc.encode(texts)
            null = np.array(part.is_null())
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))
            cols = [key.slice(i, j - i), pa.array(np.diff(off), pa.int64(), mask=null), lists]
            if check:
                cols.append(pa.array([a == b for a, b in zip(texts, enc.decode(ids, off))], pa.bool_(), mask=null))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "lossless"][: len(cols)])


def encode_documents(docs: DataFrame, path: str = RANKS_PATH, text_col: str = "text", id_col: str = "doc_id", check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids[, lossless]) of every document; lossless: decoding the ids gave the text again.

    One narrow pass: no shuffle. See the module for nulls and empty texts.
    """
    slim = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids array<int>" + ", lossless boolean" * check
    return slim.mapInArrow(lambda it: _encode_batches(it, path, check), schema)


def decode_documents(encoded: DataFrame, path: str = RANKS_PATH, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of every id sequence; text is null for null ids, an unknown id (or a null one) or bytes that are no UTF-8."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            lists = batch.column(1)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)
            off = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0), dtype=np.int64))])
            texts = enc.decode(flat, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string(), mask=np.array(lists.is_null()))], names=["doc_id", "text"])

    slim = encoded.select(encoded[id_col].try_cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "doc_id long, text string")
