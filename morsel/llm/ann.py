"""Nearest neighbours by additive quantisation (operator 2): for each row whose id EVERY divides, the k nearest of all rows.

A vector is the sum of one full-dimensional codeword from each of BOOKS codebooks of WORDS words, and an error.

1. The index is started on a bounded sample, the START rows of least hashed id: centres of about sqrt(n) / 32 cells (START / 16
   at most), and codebooks by residual k-means. Then, ROUNDS times, every row is encoded by beam search and all codebooks are
   solved together by least squares over the counts of all rows.
2. Each row x is stored as its code, the squared norm of the sum s of its codewords, and the norm of its error e = x - s, in
   its cell; cells of more than BLOCK rows are cut into parts by hashed id.
3. Each query asks its own part first. Dot products with all codewords make its lookup table; the score of a row is
   |q - s|^2 = |q|^2 + |s|^2 - 2 * (table sums). Exact distances of the k best scores bound the k-th distance. As
   |q - x| >= |q - s| - |e| whatever e depends on, only rows with |q - s| - |e| within that bound are compared exactly.
4. Then it asks the parts of every cell that can hold a nearer row: those for which (distance to centre - radius) is within
   its k-th distance.

Both bounds are exact, so the neighbours are those of brute force (recall 1), copies included, and SQL can check them. Rows move
twice, once for each step, however many queries there are: a part goes to one task for each QUERIES queries that ask it, counted
beforehand, and a query to the parts that it asks. On clustered vectors those are few. On vectors without any cluster structure
no cell can be ruled out: every query meets every part, so queries moved and scores grow as n * n / EVERY there.

Cases: a null vector or id, another dimension than the most common (the least of equals), null, infinite or NaN elements: no
row, neither as query nor as neighbour; so is an id that is no number; rows that share an id are one vector, the least; ties in
distance go to the smaller id; fewer than k others give fewer rows; other columns are ignored; an empty table gives no rows.
Vectors have no text; very long ones only make fewer rows a part, as BLOCK_MB bounds their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morsel.llm.common import Scratch, ranges

BOOKS, WORDS, BEAM, ROUNDS = 16, 64, 8, 2
START, BLOCK, QUERIES, BLOCK_MB, EVERY = 8192, 65536, 65536, 32, 100
#: Relative rounding error allowed to single precision.
ROUNDING = 1e-5


@dataclass
class Codec:
    """Codebooks (BOOKS, WORDS, d) and centres of cells."""

    books: np.ndarray
    centres: np.ndarray


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, less the norm of x."""
    return (c * c).sum(1) - 2 * (x @ c.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres from evenly spaced rows; an empty one stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].astype(np.float64)
    for _ in range(rounds):
        at = _squares(x, c).argmin(1)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def start_books(x: np.ndarray, books: int, words: int) -> np.ndarray:
    r, out = x.astype(np.float64), []
    for _ in range(books):
        c = kmeans(r, words)
        out.append(c)
        r = r - c[_squares(r, c).argmin(1)]
    return np.stack(out).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, most: int = 4096) -> np.ndarray:
    """Codes of the rows of x by beam search: each step extends the best `beam` partial sums by every word of a book."""
    m, k, _ = books.shape
    out = np.zeros((len(x), m), dtype=np.uint8)
    for i in range(0, len(x), most):
        res = x[i : i + most].astype(np.float32)[:, None, :]
        n = len(res)
        cost, code = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        for b in books:
            h = res.shape[1]
            step = (cost[:, :, None] + _squares(res.reshape(n * h, -1), b).reshape(n, h, k)).reshape(n, h * k)
            w = min(beam, h * k)
            best = np.argpartition(step, w - 1, axis=1)[:, :w]
            cost = np.take_along_axis(step, best, 1)
            from_, word = best // k, best % k
            res = np.take_along_axis(res, from_[:, :, None], 1) - b[word]
            code = np.concatenate([np.take_along_axis(code, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        out[i : i + n] = code[np.arange(n), cost.argmin(1)]
    return out


def decode(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.zeros((len(code), books.shape[2]), np.float32)
    for j, b in enumerate(books):
        out += b[code[:, j]]
    return out


def _exact(base: np.ndarray, row: np.ndarray, q: np.ndarray, col: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Squared distances of pairs in double precision, a bounded number of pairs at a time."""
    out = np.empty(len(row))
    step = max(1, most // base.shape[1])
    for i in range(0, len(row), step):
        gap = base[row[i : i + step]].astype(np.float64) - q[col[i : i + step]]
        out[i : i + step] = np.einsum("ij,ij->i", gap, gap)
    return out


def search_block(base: np.ndarray, code: np.ndarray, norm: np.ndarray, err: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, tau: np.ndarray | None, k: int, books: np.ndarray, chunk: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, squared distances, ids): the k nearest rows of a block for each query, itself apart.

    tau: squared distances that are of interest for each query, None if not known; those of the k first by score bound them too.
    """
    m, words, d = books.shape
    flat = books.reshape(m * words, d)
    place = code.astype(np.int64) + words * np.arange(m)
    base_norm = (base.astype(np.float64) ** 2).sum(1).astype(np.float32)
    # codewords may be longer than their sums, and rounding goes by their lengths
    longest = float(np.linalg.norm(books, axis=2).max(1).sum())
    for i in range(0, len(q), chunk):
        part = q[i : i + chunk].astype(np.float32)
        lut = flat @ part.T
        score = lut[place[:, 0]]
        for j in range(1, m):
            score += lut[place[:, j]]
        qn = (part * part).sum(1)
        score *= -2
        score += norm[:, None]
        score += qn
        own = ids[:, None] == q_ids[None, i : i + chunk]
        score[own] = np.inf
        w = min(k, len(base))
        first = np.argpartition(score, w - 1, axis=0)[:w] if w < len(base) else np.arange(len(base))[:, None].repeat(len(part), 1)
        exact = _exact(base, first.ravel(), part, np.tile(np.arange(len(part)), w)).reshape(first.shape)
        exact[np.take_along_axis(own, first, 0)] = np.inf
        limit = exact.max(0) if w == k else np.full(len(part), np.inf)
        if tau is not None:
            limit = np.minimum(limit, tau[i : i + chunk])
        slack = ROUNDING * (longest + np.sqrt(qn)) ** 2
        ok = score <= (np.sqrt(limit).astype(np.float32) + err[:, None]) ** 2 + slack
        ok &= ~own
        # where many rows are left, one product rules out those that rounding leaves no doubt about
        if np.count_nonzero(ok) > ok.size // 32:
            near = base @ part.T
            near *= -2
            near += base_norm[:, None]
            near += qn
            ok &= near <= limit + ROUNDING * (base_norm[:, None] + qn)
        col, row = np.nonzero(ok.T)
        dist = _exact(base, row, part, col)
        order = np.lexsort((ids[row], dist, col))
        col, row, dist = col[order], row[order], dist[order]
        edge = np.searchsorted(col, np.arange(len(part) + 1))
        for c in range(len(part)):
            s = slice(edge[c], min(edge[c] + k, edge[c + 1]))
            yield i + c, dist[s], ids[row[s]]


def _matrix(col: pd.Series, d: int, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=kind).reshape(-1, d)


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that count."""
    v = vectors.select(vectors[id_col].try_cast("long").alias("vec_id"), vectors[vec_col].cast("array<float>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    v = v.filter(~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    d = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return v.join(F.broadcast(d), F.size("embedding") == F.col("d"), "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(b), -1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "v"])


def _refine(rows: DataFrame, codec: Codec) -> Codec:
    """Codebooks of least squares for the codes that all rows have under the present ones."""
    m, k, d = codec.books.shape
    held = rows.sparkSession.sparkContext.broadcast(codec.books)

    def stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((m * k, m * k + d))
        for b in it:
            x = _matrix(b.column(1).to_pylist(), d)
            place = encode(x, held.value).astype(np.int64) + k * np.arange(m)
            for i in range(0, len(x), 4096):
                p = place[i : i + 4096]
                hot = np.zeros((len(p), m * k), np.float32)
                hot[np.arange(len(p))[:, None], p] = 1
                both += hot.T @ np.concatenate([hot, x[i : i + 4096]], axis=1)
        # one fixed-size sum a task, by book
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array([both[k * i : k * (i + 1)].tobytes() for i in range(m)], pa.binary())], names=["book", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in pdf["sums"])
        return pd.DataFrame({"book": [pdf["book"].iloc[0]], "sums": [total.tobytes()]})

    got = rows.select("vec_id", "v").mapInArrow(stats, "book int, sums binary").groupBy("book").applyInPandas(add, "book int, sums binary").collect()
    both = np.concatenate([np.frombuffer(r["sums"]).reshape(k, m * k + d) for r in sorted(got, key=lambda r: r["book"])])
    gram, right = both[:, : m * k], both[:, m * k :]
    # a small ridge towards the present words decides what the rows leave open
    ridge = 1e-3 * max(1.0, np.trace(gram) / (m * k))
    books = np.linalg.solve(gram + ridge * np.eye(m * k), right + ridge * codec.books.reshape(m * k, d))
    return Codec(books.reshape(m, k, d).astype(np.float32), codec.centres)


def fit(rows: DataFrame, n: int, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, start: int = START) -> Codec:
    """Codec of packed rows (vec_id, v)."""
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(start).toPandas()
    x = _matrix(first["v"], len(first["v"].iloc[0]) // 4)
    cells = min(max(1, round(math.sqrt(n) / 32)), max(1, start // 16))
    codec = Codec(start_books(x, books, words), kmeans(x, cells).astype(np.float32))
    for _ in range(rounds):
        codec = _refine(rows, codec)
    return codec


def encode_rows(rows: DataFrame, codec: Codec) -> DataFrame:
    """(vec_id, v, code, norm, err, cell, away): what is stored of each row; norm and err are those of its codewords' sum and of the rest, away its distance from the centre of its cell."""
    held = rows.sparkSession.sparkContext.broadcast(codec)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in it:
            x = _matrix(b.column(1).to_pylist(), c.books.shape[2])
            code = encode(x, c.books)
            near = decode(code, c.books)
            err = np.linalg.norm(x - near, axis=1)
            cell = _squares(x, c.centres).argmin(1)
            away = np.linalg.norm(x.astype(np.float64) - c.centres[cell], axis=1)
            cols = [b.column(0), b.column(1), pa.array([r.tobytes() for r in code], pa.binary()), pa.array((near * near).sum(1)), pa.array(err.astype(np.float32)), pa.array(cell.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "code", "norm", "err", "cell", "away"])

    return rows.mapInArrow(run, "vec_id long, v binary, code binary, norm float, err float, cell int, away double")


_FOUND = "found array<struct<distance:double,neighbour_id:long>>"


def _block(pdf: pd.DataFrame, d: int, m: int) -> tuple[np.ndarray, ...]:
    return _matrix(pdf["v"], d), _matrix(pdf["code"], m, np.uint8), pdf["norm"].to_numpy(), pdf["err"].to_numpy(), pdf["vec_id"].to_numpy()


def plan_tiles(asked: int, queries: int = QUERIES) -> int:
    """Tasks that a part goes to when so many queries ask it: one, but for more queries than a task should hold."""
    return max(1, -(-asked // queries))


def neighbours(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, every: int = 1, queries: int = QUERIES) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others, by Euclidean distance, of every vector whose id `every` divides."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.write(clean_vectors(vectors, id_col, vec_col).mapInArrow(_packed, "vec_id long, v binary"), "rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    codec = fit(rows, n)
    m, _, d = codec.books.shape
    block = max(1, min(block, (BLOCK_MB << 20) // (4 * d)))
    held = spark.sparkContext.broadcast(codec)
    stored = scratch.write(encode_rows(rows, codec), "stored")
    # at most START / 16 rows
    cells = [(r["cell"], -(-r["n"] // block), r["radius"]) for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()]
    parts = spark.createDataFrame([c[:2] for c in cells], "cell int, parts int")
    placed = stored.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts", "away")
    asking = placed.filter(F.col("vec_id") % every == 0).select("cell", "part", "vec_id", "v", F.lit(float("inf")).alias("tau"))

    def search(base_pdf: pd.DataFrame, q_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(base_pdf) or not len(q_pdf):
            return pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "v": pd.Series(dtype="object"), "cell": pd.Series(dtype="int32"), "part": pd.Series(dtype="int32"), "tau": pd.Series(dtype="float64"), "found": pd.Series(dtype="object")})
        found, tau = [], []
        ids = q_pdf["vec_id"].to_numpy()
        for _, dist, near in search_block(*_block(base_pdf, d, m), _matrix(q_pdf["v"], d), ids, q_pdf["tau"].to_numpy(), k, held.value.books):
            found.append([{"distance": a, "neighbour_id": b} for a, b in zip(dist.tolist(), near.tolist())])
            tau.append(float(dist[-1]) if len(dist) == k else float("inf"))
        return pd.DataFrame({"vec_id": ids, "v": q_pdf["v"].to_numpy(), "cell": q_pdf["cell"].to_numpy(), "part": q_pdf["part"].to_numpy(), "tau": tau, "found": found})

    def ask(asked: DataFrame, name: str) -> DataFrame:
        """Answers of the parts to the queries that ask them; each part goes to as many tasks as its queries need."""
        asked = scratch.write(asked, f"asked_{name}")
        tiles = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / F.lit(queries)).cast("int").alias("tiles"))
        mine = asked.join(tiles, ["cell", "part"]).withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(1)), "tiles").cast("int")).drop("tiles")
        spread = placed.join(tiles, ["cell", "part"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        key = ["cell", "part", "tile"]
        return scratch.write(spread.groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(search, "vec_id long, v binary, cell int, part int, tau double, " + _FOUND), name)

    first = ask(asking, "own")
    number, count, radius = (np.array(x) for x in zip(*sorted(cells)))

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value.centres[number]
        for b in it:
            x = _matrix(b.column(1).to_pylist(), d).astype(np.float64)
            away = np.stack([np.linalg.norm(centres - r, axis=1) for r in x]) if len(x) else np.zeros((0, len(number)))
            tau = np.sqrt(b.column(4).to_numpy())
            ask, to = np.nonzero(away - radius <= tau[:, None] + 1e-6)
            size = count[to]
            ask, to = np.repeat(ask, size), np.repeat(to, size)
            part = ranges(np.zeros(len(size), np.int64), size)
            keep = (number[to] != b.column(2).to_numpy()[ask]) | (part != b.column(3).to_numpy()[ask])
            at = pa.array(ask[keep])
            cols = [pa.array(number[to[keep]].astype(np.int32)), pa.array(part[keep].astype(np.int32)), b.column(0).take(at), b.column(1).take(at), b.column(4).take(at)]
            yield pa.RecordBatch.from_arrays(cols, names=["cell", "part", "vec_id", "v", "tau"])

    rest = ask(first.select("vec_id", "v", "cell", "part", "tau").mapInArrow(route, "cell int, part int, vec_id long, v binary, tau double"), "others")
    for name in ("rows", "stored", "asked_own", "asked_others"):
        scratch.drop(name)
    best = first.select("vec_id", "found").unionByName(rest.select("vec_id", "found")).select("vec_id", F.explode("found").alias("x"))
    order = Window.partitionBy("vec_id").orderBy("x.distance", "x.neighbour_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "x.neighbour_id", F.sqrt("x.distance").alias("distance"))


def oracle_sql(k: int = 10, every: int = EVERY) -> str:
    """neighbours() by comparing each query with every row; distances to 6 places."""
    return f"""WITH v AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
    p AS (SELECT q.vec_id, v.vec_id AS neighbour_id, list_distance(q.e::DOUBLE[], v.e::DOUBLE[]) AS distance FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM p)
    SELECT vec_id, rank::INT AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""
