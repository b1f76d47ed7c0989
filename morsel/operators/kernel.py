"""Best segmentations of many stretches of bytes at once, in numpy.

Tokens stand in a trie whose edges are one open-addressing table. All places of all stretches walk it together, a byte a step, which
gives every token that fits anywhere. Then paths of all stretches grow together, a place a step: few tokens first, of those the
least cost in single precision, of those the path that was found first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from morsel.functions.text import FLAG

_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + count[i] - 1 of all i, one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer and n + 1 offsets."""
    off = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), off


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets into them; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def cut_units(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the units of texts begin, and the end: runs of two spaces and more apart, words with their one leading space."""
    if not len(raw):
        return np.zeros(1, np.int64)
    first = np.zeros(len(raw), dtype=bool)
    first[off[:-1][off[:-1] < off[1:]]] = True
    space = raw == SPACE
    begin = first.copy()
    begin[1:] |= space[1:] & ~space[:-1]
    # a word after a run of spaces, which is one unless the text begins with its second space
    begin[2:] |= ~space[2:] & space[1:-1] & space[:-2] & ~first[1:-1]
    return np.append(np.flatnonzero(begin), len(raw))


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of so many bytes together, or of one text."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


def char_length(byte: int) -> int:
    """Bytes of the character that begins with a byte; 1 for one that begins none."""
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


def _window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` bytes that stand together."""
    h = np.zeros(max(0, len(data) - size + 1), dtype=np.uint64)
    for k in range(size):
        h = h * _ODD + data[k : k + len(h)]
    return h


class Trie:
    """Tokens by their place in a list. depth: tokens of more bytes are looked up by themselves instead."""

    def __init__(self, tokens: list[bytes], depth: int | None = None):
        self.depth = max(map(len, tokens), default=0) if depth is None else depth
        by: dict[int, list[int]] = {}
        for k, t in enumerate(tokens):
            if len(t) > self.depth:
                by.setdefault(len(t), []).append(k)
        # of the tokens of each length their hashes, in order, with their places and bytes
        self.long: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, some in by.items():
            data = np.frombuffer(b"".join(tokens[k] for k in some), np.uint8)
            h = _window_hashes(data, n)[::n]
            order = np.argsort(h, kind="stable")
            self.long[n] = h[order], np.array(some, dtype=np.int64)[order], data.reshape(-1, n)[order]
        short = np.array([k for k, t in enumerate(tokens) if 0 < len(t) <= self.depth], dtype=np.int64)
        data, off = joined([tokens[k] for k in short])
        size = np.diff(off)
        at, live, n = np.zeros(len(short), dtype=np.int64), np.arange(len(short)), 1
        keys, ends = [], [np.full(1, -1, dtype=np.int64)]
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            key, which = np.unique(at[live] * 256 + data[off[live] + k], return_inverse=True)
            at[live] = n + which
            n += len(key)
            end = np.full(len(key), -1, dtype=np.int64)
            last = size[live] == k + 1
            end[which[last]] = short[live[last]]
            keys.append(key)
            ends.append(end)
        self.token = np.concatenate(ends).astype(np.int32)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        # an edge leads to the node of its own number, from 1
        bits = max(4, int(2 * len(key) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]] = key[free]
            mine = free[self.key[slot[free]] == key[free]]
            self.to[slot[mine]] = mine + 1
            todo = np.setdiff1d(todo, mine, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        self.more = np.zeros(n, dtype=bool)
        self.more[key // 256] = True
        self.one = np.full(256, -1, dtype=np.int32)
        self.one[key[key < 256]] = self._child(np.zeros((key < 256).sum(), np.int64), key[key < 256])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that a byte leads to, -1 if none."""
        key = node.astype(np.int64) * 256 + byte
        slot = self._slot(key)
        got = self.key[slot]
        out = self.to[slot]
        todo = np.flatnonzero((got != key) & (got >= 0))
        out[got != key] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.key[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.to[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def prefixes(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(which, bytes, place of the token) of the tokens that begin data[at[i] : end[i]], a length a step."""
        which = np.flatnonzero(at < end)
        node, k = self.one[data[at[which]]], 1
        while len(which):
            which, node = which[node >= 0], node[node >= 0]
            token = self.token[node]
            hit = np.flatnonzero(token >= 0)
            yield which[hit], k, token[hit]
            go = np.flatnonzero(self.more[node] & (at[which] + k < end[which]))
            which = which[go]
            node = self._child(node[go], data[at[which] + k])
            k += 1

    def matches(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, place of the token) of all that fits; limit: where the stretch of each byte ends."""
        at = np.arange(len(data), dtype=np.int32)
        node, k, found = self.one[data], 1, []
        while True:
            ok = node >= 0
            at, node = at[ok], node[ok]
            token = self.token[node]
            hit = np.flatnonzero(token >= 0)
            found.append((at[hit], at[hit] + k, token[hit]))
            go = np.flatnonzero(self.more[node] & (at + k < limit[at]))
            if not len(go):
                break
            at = at[go]
            node = self._child(node[go], data[at + k])
            k += 1
        for size, (known, token, text) in self.long.items():
            p = np.flatnonzero(np.arange(size, len(data) + 1) <= limit[: max(0, len(data) - size + 1)])
            h = _window_hashes(data, size)[p]
            i = np.searchsorted(known, h)
            while len(p):
                on = (i < len(known)) & (known[np.minimum(i, len(known) - 1)] == h)
                p, h, i = p[on], h[on], i[on]
                same = (data[p[:, None] + np.arange(size)] == text[i]).all(axis=1)
                found.append((p[same].astype(np.int32), (p[same] + size).astype(np.int32), token[i[same]].astype(np.int32)))
                # others may have the same hash
                p, h, i = p[~same], h[~same], i[~same] + 1
        return tuple(map(np.concatenate, zip(*found)))


def _least(group: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the least of each group, whose rows stand together, and how much dearer the next one is."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    new = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(new)
    if len(first) == len(group):
        return first, np.full(len(first), np.inf, np.float32)
    least = np.minimum.reduceat(cost, first)
    of = np.cumsum(new) - 1
    some = np.flatnonzero(cost == least[of])
    some = some[np.append(True, of[some[1:]] != of[some[:-1]])]
    others = cost.copy()
    others[some] = np.inf
    return some, np.minimum.reduceat(others, first) - least


def word_paths(trie: Trie, back: Trie, logs: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of tokens, how many for each, gap) of the words data[start[i] : end[i]], which follow each other and hold no space that
    is skipped: the paths of Paths, but all words grow by a token at once, and only places that a path of so many tokens reaches.

    back: the trie of the tokens spelled backwards, which finds those that end a word. A word that no path spans has 0 tokens. gap:
    by how much, at least, paths that were chosen were better than others of as many tokens.
    """
    n = len(start)
    tail = np.full(len(data), -1, dtype=np.int32)
    for which, k, token in back.prefixes(data[::-1], len(data) - end, len(data) - start):
        tail[end[which] - k] = token
    size, last, at, gap = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, np.inf, np.float32)
    seen = np.zeros(len(data), dtype=bool)
    word, place, cost, levels = np.flatnonzero(start < end), start[start < end], np.zeros(int((start < end).sum()), np.float32), []
    source, made = np.zeros(len(word), np.int64), np.zeros(len(word), np.int32)
    while len(word):
        levels.append((source, made))
        token = tail[place]
        over = np.flatnonzero(token >= 0)
        pick, more = _least(word[over], cost[over] - logs[token[over]])
        pick = over[pick]
        w = word[pick]
        size[w], last[w], at[w] = len(levels), token[pick], pick
        gap[w] = np.minimum(gap[w], more)
        live = np.flatnonzero(size[word] == 0)
        # the longest first, so that of those that end together the one from the earliest place is first
        hits = list(trie.prefixes(data, place[live], end[word[live]]))[::-1]
        if not hits:
            break
        which, to, token = np.concatenate([h[0] for h in hits]), np.concatenate([place[live[h[0]]] + h[1] for h in hits]), np.concatenate([h[2] for h in hits])
        fresh = np.flatnonzero(to < end[word[live[which]]])
        fresh = fresh[~seen[to[fresh]]]
        fresh = fresh[np.argsort(to[fresh], kind="stable")]
        source, to, token = live[which[fresh]], to[fresh], token[fresh]
        new = cost[source] - logs[token]
        pick, more = _least(to, new)
        word = word[source[pick]]
        np.minimum.at(gap, word, more)
        source, place, made, cost = source[pick], to[pick], token[pick], new[pick]
        seen[place] = True
    out, ends = np.empty(int(size.sum()), np.int32), np.cumsum(size)
    out[ends[size > 0] - 1] = last[size > 0]
    for k in range(len(levels) - 1, 0, -1):
        w = np.flatnonzero(size > k)
        source, made = levels[k]
        out[ends[w] - size[w] + k - 1] = made[at[w]]
        at[w] = source[at[w]]
    return out, size, gap


class Paths:
    """The best path to every place of every stretch. States: the places of a stretch and its end, one stretch after another."""

    def __init__(self, trie: Trie, ids: np.ndarray, logs: np.ndarray, data: np.ndarray, off: np.ndarray, space: int | None = None, spaced: bool = True):
        """ids and logs (log-probabilities, single precision) by place of a token.

        spaced: a space before something else is skipped and marked in the id, or, as the token in place `space`, stands alone.
        """
        self.data, self.off, self.size = data, off, np.diff(off)
        unit = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.first = off[:-1] + np.arange(len(self.size))
        self.last = self.first + self.size
        limit, begin = off[1:].astype(np.int32)[unit], off[:-1].astype(np.int32)[unit]
        start, end, token = trie.matches(data, limit)
        made, lp = ids[token], logs[token]
        if spaced:
            mark = (data == SPACE) & (np.arange(1, len(data) + 1, dtype=np.int32) < limit)
            if mark.any():
                plain = np.flatnonzero(~mark[start])
                behind = np.flatnonzero((start > begin[start]) & mark[start - 1])
                alone = np.flatnonzero(mark).astype(np.int32) if space is not None else np.zeros(0, np.int32)
                start, end, made, lp = (
                    np.concatenate([start[plain], start[behind] - 1, alone]),
                    np.concatenate([end[plain], end[behind], alone + 1]),
                    np.concatenate([made[plain], made[behind] | FLAG, np.full(len(alone), ids[space] if space is not None else 0, made.dtype)]),
                    np.concatenate([lp[plain], lp[behind], np.full(len(alone), logs[space] if space is not None else 0, np.float32)]),
                )
        self._arrange(unit[start], start - begin[start], start, end, made, lp)

    def _arrange(self, where: np.ndarray, rel: np.ndarray, start: np.ndarray, end: np.ndarray, made: np.ndarray, lp: np.ndarray) -> None:
        """Steps of edges: which stretch, how far in it, and places."""
        order = np.argsort(rel.astype(np.uint16) if rel.max(initial=0) < 65536 else rel, kind="stable")
        self.where = where[order]
        self.src, self.dst, self.edge_id, self.edge_log = start[order] + self.where, end[order] + self.where, made[order], lp[order]
        self.steps = np.concatenate([[0], np.cumsum(np.bincount(rel, minlength=1))]).tolist()

    @classmethod
    def of_edges(cls, size: np.ndarray, where: np.ndarray, rel: np.ndarray, length: np.ndarray, made: np.ndarray, lp: np.ndarray) -> Paths:
        """Paths of stretches of so many bytes over edges that were found elsewhere: which stretch, how far in it, and their bytes."""
        p = cls.__new__(cls)
        p.off = np.concatenate([[0], np.cumsum(size)])
        p.data, p.size = np.zeros(int(p.off[-1]), np.uint8), size
        p.first = p.off[:-1] + np.arange(len(size))
        p.last = p.first + size
        start = p.off[where] + rel
        p._arrange(where, rel, start, start + length, made, lp)
        return p

    def solve(self, cost: np.ndarray | None = None, unknown: int | None = None) -> Paths:
        """Find the paths. cost: what each stretch has cost before it begins.

        unknown: the id given to the character where a stretch gets stuck, after which it begins afresh.
        """
        n = len(self.data) + len(self.size)
        self.count, self.cost = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.float32)
        self.back, self.made, self.log = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.float32)
        count, total, steps = self.count, self.cost, self.steps
        count[self.first] = 0
        if cost is not None:
            total[self.first] = cost
        reach, most = self.first.copy(), len(steps) - 1
        for k in range(most if unknown is None else int(self.size.max(initial=0))):
            if k < most:
                i, j = steps[k], steps[k + 1]
                s, t, lp = self.src[i:j], self.dst[i:j], self.edge_log[i:j]
                c, new, old = count[s] + 1, total[s] - lp, count[t]
                take = np.flatnonzero((c > 0) & ((old < 0) | (c < old) | ((c == old) & (new < total[t]))))
                t = t[take]
                count[t], total[t], self.back[t], self.made[t], self.log[t] = c[take], new[take], s[take], self.edge_id[i:j][take], lp[take]
            if unknown is not None:
                if k < most:
                    np.maximum.at(reach, self.where[i:j][take], t)
                for u in np.flatnonzero((reach == self.first + k) & (self.size > k)).tolist():
                    here = int(reach[u])
                    to = min(here + char_length(int(self.data[self.off[u] + k])), int(self.last[u]))
                    count[to], total[to], self.back[to], self.made[to], reach[u] = count[here] + 1, 0, here, unknown, to
        return self

    def walk(self, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretches, states) from the given states back to the beginnings, a token a step."""
        which, at = np.arange(len(end)), end
        while True:
            some = np.flatnonzero(at > self.first[which])
            if not len(some):
                return
            which, at = which[some], at[some]
            yield which, at
            at = self.back[at]

    def ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all stretches, one after another, how many each has (of one that no path spans none), and their log-probabilities."""
        size = np.maximum(self.count[self.last], 0).astype(np.int64)
        out, logs = np.empty(int(size.sum()), dtype=np.int32), np.empty(int(size.sum()), dtype=np.float32)
        place = np.cumsum(size) - 1
        end = np.where(self.count[self.last] >= 0, self.last, self.first)
        for k, (which, at) in enumerate(self.walk(end)):
            out[place[which] - k], logs[place[which] - k] = self.made[at], self.log[at]
        return out, size, logs

    def furthest(self) -> np.ndarray:
        """The last state of each stretch that a path reaches."""
        at = np.where(self.count >= 0, np.arange(len(self.count)), -1)
        return np.maximum.reduceat(at, self.first) if len(self.first) else at
