"""Suffix sorting by grouping (Baier, 2016).

Phase one keeps suffixes in groups of equal prefix, at first the first symbol, in ascending order along one array. Groups are
taken from the highest down. For each suffix of a group, the nearest earlier suffix of a lower group, its previous-smaller
pointer, has the group's prefix behind its own: those pointed at leave their group for a new one just above it, the ones
pointed at more often higher. In the end the prefix of each group is a Lyndon word and groups are in order.

Phase two walks the array from its start: the suffix before the one just placed is the next of its group, and so on along
previous-smaller pointers until one is placed already. No symbol is renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer array in ascending order; a suffix precedes those it begins."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    by = text[order]
    edge = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    size_of = np.diff(np.append(edge, n))
    begin = np.empty(n, dtype=np.int64)
    begin[order] = np.repeat(edge, size_of)
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)
    group, at, place = begin.tolist(), order.tolist(), where.tolist()
    size = [0] * n
    for g, k in zip(edge.tolist(), size_of.tolist()):
        size[g] = k
    prev = [-1] * n
    stop = n
    while stop:
        start = group[at[stop - 1]]
        members = at[start:stop]
        if len(members) > 1:
            members.sort()
        points: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        if points:
            levels: dict[int, list[int]] = {}
            for p, c in points.items():
                levels.setdefault(c, []).append(p)
            for c in sorted(levels, reverse=True) if len(levels) > 1 else levels:
                moved: dict[int, list[int]] = {}
                for p in levels[c]:
                    moved.setdefault(group[p], []).append(p)
                for g, ps in moved.items():
                    left = size[g]
                    if left == len(ps):
                        continue  # the whole group moves: its place stays
                    e = g + left
                    for p in ps:
                        e -= 1
                        i, q = place[p], at[e]
                        at[i], at[e] = q, p
                        place[q], place[p] = i, e
                        group[p] = g + left - len(ps)
                    size[g] = left - len(ps)
                    size[e] = len(ps)
        stop = start
    # the empty suffix comes first of all, and what stands before it is the first to be placed
    out, done = [-1] * n, [False] * n
    free = group  # next free place of a group, kept at its start
    head = {}
    j = n - 1
    i = 0
    while True:
        while j >= 0 and not done[j]:
            g = free[j]
            k = head.get(g, g)
            out[k] = j
            head[g] = k + 1
            done[j] = True
            j = prev[j]
        if i == n:
            break
        j = out[i] - 1
        i += 1
    return np.array(out, dtype=np.int64)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: symbols that suffixes sa[i - 1] and sa[i] have in common (Kasai and others, 2001); lcp[0] is 0."""
    n = len(text)
    t, order = text.tolist(), sa.tolist()
    rank = [0] * n
    for i, s in enumerate(order):
        rank[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if r:
            p = order[r - 1]
            top = n - max(s, p)
            while h < top and t[s + h] == t[p + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return np.array(out, dtype=np.int64)
