"""Near-duplicate groups by SimHash and multi-index hashing (operator 5).

A fingerprint has BITS bits: each is the majority, over the distinct words of the lower-cased text, of that bit of the
word's hash; a tie of votes gives 0. Two documents are near-duplicates when their fingerprints differ in at most `radius` bits,
and groups are the connected components.

The fingerprint is cut into m segments. With radius = m * q + a, two fingerprints within the radius agree within q bits on
one of the first a + 1 segments or within q - 1 bits on one of the others (Norouzi, Punjani, Fleet), so the Hamming balls of
these sizes, enumerated in every segment, meet every pair: the search is exact. A node is a distinct fingerprint, so
thousands of exact copies are one node. A task has the table of one segment and one value of its high bits: those rows first,
then a stream of the queries whose high bits are a few flips away, which no task holds whole. Flips of low bits are enumerated
inside the task, where matches are table slices and full distances are popcounts. Only where the table of a value would be larger
than a task should hold, as when many fingerprints share it, is it cut into tiles, and its queries go to each of them.

Every pair within the radius is verified and counted exactly once, in the first segment that can find it: links are numbers of
documents. What a task emits are these sums and a spanning forest of its pairs, never the pairs.

Segment width follows the number of nodes, as the method asks: log2(n) - 2 within 16 and 32 bits. Rows moved for each node are
those of copies(): 18 for 10**5 nodes, 25 for 10**7, some 390 for 10**9, as a wide radius costs more flips in wider segments.

Cases: a null text, a text without visible characters or a null doc_id is in no group; a text without words is compared by
its whole visible text; very long texts are read whole; repeated rows are copies of each other; rows that share a doc_id are one
document, whose links are those of all its rows; an id that is no number is a null id; other columns are ignored; an empty table
has no groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.llm.common import BLOCK, U64, Scratch, blocks, hash_spans, mix64, ranges, text_buffer, words
from morsel.llm.components import connected_components

BITS, RADIUS = 128, 20
#: Rows of a table that a task should hold, and queries that it takes at a time.
MOST, CHUNK = 1 << 21, 1 << 18
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=U64)


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints of lower-cased texts, and whether each has one."""
    raw, off = text_buffer(text)
    n = len(off) - 1
    start, end, first = words(raw, off)
    h = hash_spans(raw, start, end)
    count = np.diff(first)
    bare = np.flatnonzero((count == 0) & (np.diff(off) > 0))
    doc = np.repeat(np.arange(n, dtype=U64), count)
    if len(bare):
        spans = [(i, t) for i in bare if (t := b" ".join(raw[off[i] : off[i + 1]].tobytes().split()))]
        if spans:
            joined = np.frombuffer(b"".join(t for _, t in spans), dtype=np.uint8)
            e = np.cumsum([len(t) for _, t in spans])
            h = np.concatenate([h, hash_spans(joined, np.concatenate([[0], e[:-1]]), e)])
            doc = np.concatenate([doc, np.array([i for i, _ in spans], dtype=U64)])
    out, has = np.zeros((n, 2), dtype=U64), np.zeros(n, dtype=bool)
    if not len(h):
        return out, has
    key = np.sort((doc << U64(44)) | (h >> U64(20)))
    key = key[np.append(True, key[1:] != key[:-1])]
    doc = (key >> U64(44)).astype(np.int64)
    has[doc] = True
    feature = mix64(key & U64((1 << 44) - 1))
    at = np.searchsorted(doc, np.arange(n + 1))
    some = np.flatnonzero(np.diff(at))
    # byte lanes hold 8 counters in a word; they are added up over runs of at most 255 features
    runs = -(-np.diff(at)[some] // 255)
    cut = np.concatenate([at[d] + 255 * np.arange(k) for d, k in zip(some, runs)]) if runs.max() > 1 else at[some]
    run0 = np.concatenate([[0], np.cumsum(runs)[:-1]])
    size = np.diff(at)[some]
    for side in range(2):
        octets = (feature if side == 0 else mix64(feature + U64(0x5851F42D4C957F2D))).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, b]], cut).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(lanes.astype(np.int64), run0, axis=0)
            bits = (2 * votes > size[:, None]).astype(U64)
            out[some, side] |= (bits << (np.arange(8, dtype=U64) + U64(8 * b))).sum(axis=1, dtype=U64)
    return out, has


def _fingerprint_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        size = np.diff(text_buffer(batch.column(1))[1])
        # rows without text count as some, so that a block has fewer rows than a key has places for
        for i, j in blocks(np.maximum(size, 4), BLOCK):
            fp, has = fingerprints(batch.column(1).slice(i, j - i))
            mask = pa.array(has)
            cols = [batch.column(0).slice(i, j - i), *(pa.array(fp[:, k].view(np.int64)) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in cols], names=["doc_id", "hi", "lo"])


def fingerprint_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, hi, lo) of every document that has a fingerprint; one narrow pass."""
    slim = docs.select(docs[id_col].try_cast("long").alias("doc_id"), F.lower(docs[text_col]).alias("text")).filter("doc_id is not null and text is not null")
    return slim.mapInArrow(_fingerprint_batches, "doc_id long, hi long, lo long")


def plan_segments(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment for n nodes; segments of a negative ball radius need no search."""
    want = min(32, max(16, int(max(n, 1)).bit_length() - 2))
    m = -(-BITS // want)
    q, a = divmod(radius, m)
    edge = [BITS * k // m for k in range(m + 1)]
    return [(edge[k], edge[k + 1] - edge[k], q - (k > a)) for k in range(m)]


def plan_high(n: int, segments: list[tuple[int, int, int]], most: int = MOST) -> int:
    """The high bits of a segment that name its tasks, so that a table has about `most` rows."""
    return min(12, min(w for _, w, _ in segments), max(2, math.ceil(math.log2(max(n, 1) / most))))


def copies(n: int, radius: int = RADIUS, most: int = MOST) -> float:
    """Rows that are moved for each of n nodes: itself in every segment, and half of the flips of high bits, as a pair needs one way."""
    segments = plan_segments(n, radius)
    high = plan_high(n, segments, most)
    return sum(1 + sum(math.comb(high, k) for k in range(1, min(ball, high) + 1)) / 2 for *_, ball in segments if ball >= 0)


def _segment(hi: np.ndarray, lo: np.ndarray, shift: int, width: int) -> np.ndarray:
    mask = U64((1 << width) - 1)
    if shift >= 64:
        return (lo >> U64(shift - 64)) & mask
    x = hi >> U64(shift)
    if shift + width > 64:
        x = x | (lo << U64(64 - shift))
    return x & mask


def _balls(bits: int, most: int) -> dict[int, np.ndarray]:
    """Masks over so many bits, by the number of bits set, up to `most`."""
    out = {0: np.zeros(1, dtype=np.int64)}
    for k in range(1, most + 1):
        out[k] = np.array(sorted({int(m) | (1 << b) for m in out[k - 1] for b in range(bits) if not int(m) >> b & 1}), dtype=np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) of the graph of edges a, b, without the least ones themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


class Table:
    """Fingerprints of one segment and value of its high bits, in the order of the low bits."""

    def __init__(self, plan: Plan, segment: int, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, docs: np.ndarray):
        self.plan, self.segment = plan, segment
        low = plan.low(segment, hi, lo)
        order = np.argsort(low, kind="stable")
        self.low, self.node, self.hi, self.lo, self.docs = low[order], node[order], hi[order], lo[order], docs[order]
        self.links = np.zeros(len(node), dtype=np.int64)

    def ask(self, hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, spent: np.ndarray | None, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, places of rows) of the verified pairs; spent None: the rows themselves ask."""
        ball = self.plan.segments[self.segment][2]
        low = self.plan.low(self.segment, hi, lo)
        for flips, masks in _balls(self.plan.low_bits(self.segment), ball).items():
            ask = np.arange(len(hi)) if spent is None else np.flatnonzero(spent + flips <= ball)
            if not len(ask) or not len(self.node):
                continue
            for mask in masks:
                want, q = low[ask] ^ mask, ask
                if spent is None and mask:
                    # of two rows either finds the other: one asks
                    once = want > low[ask]
                    q, want = ask[once], want[once]
                start, end = np.searchsorted(self.low, want, "left"), np.searchsorted(self.low, want, "right")
                if spent is None and not mask:
                    start = q + 1
                count = end - start
                some = np.flatnonzero(count)
                q, start, count = q[some], start[some], count[some]
                for i, j in blocks(count, most):
                    left, right = np.repeat(q[i:j], count[i:j]), ranges(start[i:j], count[i:j])
                    x, y = hi[left] ^ self.hi[right], lo[left] ^ self.lo[right]
                    ok = np.flatnonzero(np.bitwise_count(x) + np.bitwise_count(y) <= self.plan.radius)
                    if len(ok):
                        # the first segment that can find a pair counts it
                        ok = ok[self.plan.first(x[ok], y[ok]) == self.segment]
                    if len(ok):
                        left, right = left[ok], right[ok]
                        self.links += np.bincount(right, weights=docs[left], minlength=len(self.node)).astype(np.int64)
                        yield left, right


class Plan:
    """Segments, the high bits that name tasks, and the tiles of each segment and high value, tasks being numbered in their order."""

    def __init__(self, n: int, radius: int, most: int = MOST):
        self.radius, self.most, self.segments = radius, most, plan_segments(n, radius)
        self.high = plan_high(n, self.segments, most)
        self.tiles = np.ones((len(self.segments), 1 << self.high), dtype=np.int64)
        self.number()

    def number(self) -> None:
        flat = self.tiles.ravel()
        self.base = np.concatenate([[0], np.cumsum(flat)[:-1]]).reshape(self.tiles.shape)
        self.segment_of = np.repeat(np.arange(len(self.segments)), self.tiles.sum(1))

    def cut(self, sizes: dict[tuple[int, int], int]) -> None:
        """Tiles for tables of so many rows, by segment and high value."""
        for (s, h), n in sizes.items():
            self.tiles[s, h] = max(1, -(-n // (2 * self.most)))
        self.number()

    def low_bits(self, s: int) -> int:
        return self.segments[s][1] - self.high

    def high_of(self, s: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shift, width, _ = self.segments[s]
        return (_segment(hi, lo, shift, width) >> U64(width - self.high)).astype(np.int64)

    def low(self, s: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shift, width, _ = self.segments[s]
        return (_segment(hi, lo, shift, width) & U64((1 << (width - self.high)) - 1)).astype(np.int64)

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first segment whose ball holds these differences."""
        out = np.full(len(x), len(self.segments), dtype=np.int64)
        for s in range(len(self.segments) - 1, -1, -1):
            shift, width, ball = self.segments[s]
            out[np.bitwise_count(_segment(x, y, shift, width)).astype(np.int64) <= ball] = s
        return out


_ROW = "task int, spent byte, node long, hi long, lo long, docs long"
#: In the place of the flips that a query has spent: a row of the table.
HOME = -1


def _rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """For each node its row in the table of every segment, and a query for each flip of high bits that a nearer value may lie behind."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            node, docs = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            hi, lo = (batch.column(k).to_numpy().view(U64) for k in (1, 2))
            spread = (mix64(hi ^ (lo * U64(0x9E3779B97F4A7C15))) >> U64(1)).astype(np.int64)
            for s, (_, _, ball) in enumerate(plan.segments):
                if ball < 0:
                    continue
                high = plan.high_of(s, hi, lo)
                own = spread % plan.tiles[s, high]
                every = np.arange(len(node))
                task, spent, row = [plan.base[s, high] + own], [np.full(len(node), HOME, np.int8)], [every]
                # rows of other tiles of their table ask in the later ones
                more = plan.tiles[s, high] - 1 - own
                if more.any():
                    row.append(np.repeat(every, more))
                    task.append(ranges(plan.base[s, high] + own + 1, more))
                    spent.append(np.zeros(len(row[-1]), np.int8))
                for flips, masks in _balls(plan.high, min(ball, plan.high)).items():
                    for mask in masks if flips else ():
                        to = high ^ mask
                        # a pair in two tasks is found in the one of the larger value only
                        go = np.flatnonzero(to > high)
                        size = plan.tiles[s, to[go]]
                        row.append(np.repeat(go, size))
                        task.append(ranges(plan.base[s, to[go]], size))
                        spent.append(np.full(len(row[-1]), flips, np.int8))
                at = np.concatenate(row)
                cols = [np.concatenate(task).astype(np.int32), np.concatenate(spent), node[at], hi[at].view(np.int64), lo[at].view(np.int64), docs[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["task", "spent", "node", "hi", "lo", "docs"])

    return nodes.select("node", "hi", "lo", "docs").mapInArrow(run, _ROW)


def _parts(it: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[int, bool, tuple[np.ndarray, ...]]]:
    """(task, whether it is the table, columns) of rows in the order of task and spent: tables whole, queries in pieces of at most about `most`."""
    held: list[tuple[np.ndarray, ...]] = []
    key, size = None, 0
    for b in it:
        cols = [c.to_numpy() for c in b.columns]
        cols[3], cols[4] = cols[3].view(U64), cols[4].view(U64)
        mark = cols[0].astype(np.int64) * 2 + (cols[1] != HOME)
        cut = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
        for i, j in zip(cut[:-1], cut[1:]):
            if i == j:
                continue
            now = int(mark[i])
            if held and (now != key or key & 1 and size >= most):
                yield key >> 1, not key & 1, tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
            key = now
            held.append(tuple(c[i:j] for c in cols[1:]))
            size += j - i
    if held:
        yield key >> 1, not key & 1, tuple(map(np.concatenate, zip(*held)))


def near_links(nodes: DataFrame, n: int, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b, hi, lo, links) of nodes (node, hi, lo, docs) of distinct fingerprints: rows with a and b are pairs that join the
    near-duplicates; the others say how many documents of other nodes near a fingerprint have been found, to be added up."""
    plan = Plan(n, radius, most)

    def sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.tiles.shape, dtype=np.int64)
        for b in it:
            hi, lo = (b.column(k).to_numpy().view(U64) for k in (0, 1))
            for s in range(len(plan.segments)):
                total[s] += np.bincount(plan.high_of(s, hi, lo), minlength=1 << plan.high)
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[total > 0])], names=["s", "h", "n"])

    # at most 2 ** 12 values of each segment
    plan.cut({(r["s"], r["h"]): r["n"] for r in nodes.select("hi", "lo").mapInArrow(sizes, "s long, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("n")).collect()})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "hi", "lo", "links"]
        null = lambda n: pa.nulls(n, pa.int64())
        pairs = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), null(len(a)), null(len(a)), null(len(a))], names=names)
        sums = lambda hi, lo, n: pa.RecordBatch.from_arrays([null(len(n)), null(len(n)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n)], names=names)
        table, at = None, -1

        def asked(spent, node, hi, lo, docs) -> Iterator[pa.RecordBatch]:
            if spent is not None:
                order = np.argsort(table.plan.low(table.segment, hi, lo), kind="stable")
                spent, node, hi, lo, docs = (x[order] for x in (spent, node, hi, lo, docs))
            links = np.zeros(len(node), dtype=np.int64)
            for left, right in table.ask(hi, lo, docs, spent):
                links += np.bincount(left, weights=table.docs[right], minlength=len(node)).astype(np.int64)
                yield pairs(*_forest(node[left], table.node[right]))
            some = np.flatnonzero(links)
            yield sums(hi[some], lo[some], links[some])

        def done() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(table.links)
            yield sums(table.hi[some], table.lo[some], table.links[some])

        for task, home, (spent, node, hi, lo, docs) in _parts(it):
            if home:
                if table is not None:
                    yield from done()
                table, at = Table(plan, int(plan.segment_of[task]), node, hi, lo, docs), task
                yield from asked(None, table.node, table.hi, table.lo, table.docs)
            elif at == task:  # else the table is empty
                yield from asked(spent, node, hi, lo, docs)
        if table is not None:
            yield from done()

    moved = _rows(nodes, plan)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return moved.repartitionById(parts, F.col("task") % parts).sortWithinPartitions("task", "spent").mapInArrow(run, "a long, b long, hi long, lo long, links long")


def near_pairs(nodes: DataFrame, n: int, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): pairs that join the near-duplicates among nodes (node, hi, lo) of distinct fingerprints."""
    return near_links(nodes.withColumn("docs", F.lit(1).cast("long")), n, radius, most).filter("b is not null").select("a", "b").distinct()


def _groups(scratch: Scratch, docs: DataFrame, radius: int, text_col: str, id_col: str, last: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, group_id), fingerprints of documents, distinct ones, and what near_links() finds among them. The groups lie in `last`, if given.

    Narrow rows of many tasks are put together before they are written. For each folder and file that a task makes, Hadoop's local
    file system starts chmod, and until that runs, a sum over processes counts the executor's memory twice.
    """
    fp = scratch.write(fingerprint_documents(docs, text_col, id_col).hint("rebalance"), "fp")
    nodes = scratch.write(fp.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("docs")), "nodes")
    found = scratch.write(near_links(nodes, nodes.count(), radius).hint("rebalance"), "found")
    # copies, and further rows of a doc_id, tie fingerprints together
    ties = fp.join(nodes, ["hi", "lo"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = connected_components(last or scratch, scratch.write(found.filter("b is not null").select("a", "b").unionByName(ties).distinct(), "pairs"))
    return groups, fp, nodes, found


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, group_id, group_size, n_links) of the documents that have a near-duplicate.

    group_id is the smallest doc_id of the group, which is the document to keep; group_size counts documents; n_links counts the other
    documents that are within the radius of this one, copies among them.
    Texts are read once, by the fingerprint pass; all that is shuffled is fingerprints.
    """
    groups, fp, nodes, found = _groups(Scratch(docs.sparkSession, "simhash"), docs, radius, text_col, id_col)
    sized = groups.join(groups.groupBy("group_id").agg(F.count("*").alias("group_size")), "group_id")
    links = nodes.select("hi", "lo", (F.col("docs") - 1).alias("links")).unionByName(found.filter("b is null").select("hi", "lo", "links")).groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    each = fp.join(links.filter("links > 0"), ["hi", "lo"]).groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    return sized.join(each, "doc_id", "left").select("doc_id", "group_id", "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, but one document of each group only: that of the smallest doc_id.

    Rows that are in no group stay, those with a null doc_id among them. Rows that share a doc_id are one document and stay or go
    together. The ids to drop are those of the groups, a written table, which Spark broadcasts only if its size allows.
    """
    work = Scratch(docs.sparkSession, "simhash")
    groups = _groups(work, docs, radius, text_col, id_col, Scratch(docs.sparkSession, "simhash-drop"))[0]
    work.clear()
    drop = groups.filter("doc_id <> group_id").select(F.col("doc_id").alias("__drop"))
    return docs.join(drop, docs[id_col].try_cast("long") == drop["__drop"], "left_anti")
