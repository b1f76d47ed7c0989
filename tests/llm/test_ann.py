import numpy as np
import pytest

from morsel.llm import ann


def brute(x, k):
    d = ((x[:, None, :].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(f) for f in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>")


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["distance"]))
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "flat"])
def test_recall_over_many_parts(spark, kind):
    g = np.random.default_rng(3)
    x = g.normal(size=(1500, 24))
    if kind == "clusters":
        x = g.normal(size=(30, 24))[g.integers(0, 30, 1500)] * 3 + 0.2 * x
    if kind == "flat":
        x = x * (0.7 ** np.arange(24))
    x = x.astype(np.float32)
    want, _ = brute(x, 10)
    got = found(ann.neighbours(frame(spark, x), 10, block=400))
    assert len(got) == 1500 and all(len(v) == 10 for v in got.values())
    assert np.mean([len({n for n, _ in got[i]} & set(want[i])) / 10 for i in range(1500)]) > 0.97


def test_ties_copies_and_distances(spark):
    x = np.repeat(np.eye(4, dtype=np.float32), 5, axis=0)
    got = found(ann.neighbours(frame(spark, x), 3))
    assert [n for n, _ in got[0]] == [1, 2, 3] and [n for n, _ in got[7]] == [5, 6, 8]
    assert all(d == 0 for v in got.values() for _, d in v)
    got = found(ann.neighbours(frame(spark, x[[0, 5]]), 3))
    assert got[0] == [(1, pytest.approx(2**0.5))]


def test_rows_that_do_not_count(spark):
    rows = [(0, [1.0, 0.0], 9), (1, [0.0, 1.0], 9), (2, None, 9), (None, [1.0, 1.0], 9), (3, [1.0], 9), (4, [float("nan"), 1.0], 9), (5, [None, 1.0], 9), (6, [], 9), (7, [float("inf"), 0.0], 9), (0, [1.0, 0.0], 9), (0, [2.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    assert {k: [n for n, _ in v] for k, v in found(ann.neighbours(df)).items()} == {0: [1], 1: [0]}
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 1")).count() == 0


def test_query_set_over_several_tiles(spark):
    """Every third row asks all; a part is copied only for more queries than a task holds."""
    g = np.random.default_rng(8)
    x = g.normal(size=(900, 16)).astype(np.float32)
    want, _ = brute(x, 10)
    got = found(ann.neighbours(frame(spark, x), 10, block=200, every=3, queries=7))
    assert sorted(got) == list(range(0, 900, 3)) and all([n for n, _ in got[i]] == list(want[i]) for i in got)


def test_parts_are_not_copied_as_rows_grow():
    """On clustered vectors a part is asked by the queries of a few cells, a share of its own rows, so it goes to one task at every size."""
    for n in (10**5, 10**6, 10**7, 10**8, 10**9):
        part = min(n, ann.BLOCK)
        assert ann.plan_tiles(40 * part // ann.EVERY) == 1
    assert ann.plan_tiles(0) == 1 and ann.plan_tiles(10**6) == 16


def test_against_sql(spark):
    import duckdb

    from morsel.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT vec_id, rank, neighbour_id, distance FROM ({queries.ORACLES['op2_additive_ann']})").fetchall())
    got = sorted(map(tuple, queries.op2_additive_ann(spark, sf).select("vec_id", "rank", "neighbour_id", "distance").collect()))
    assert got == want and len(got) == 50


def test_beam_search_is_no_worse_than_greedy():
    g = np.random.default_rng(0)
    x = g.normal(size=(600, 16)).astype(np.float32)
    books = ann.start_books(x, 6, 16)
    loss = lambda beam: ((x - ann.decode(ann.encode(x, books, beam), books)) ** 2).sum(1).mean()
    assert loss(8) < loss(1) < (x * x).sum(1).mean()


@pytest.mark.parametrize("d, block", [(64, 500), (256, ann.BLOCK)])
def test_groups_of_more_than_k_copies(spark, monkeypatch, d, block):
    # few words leave errors as large as those of many rows
    monkeypatch.setattr(ann, "fit", lambda rows, n, fit=ann.fit: fit(rows, n, 2, 4))
    g = np.random.default_rng(5)
    x = np.concatenate([np.repeat(g.normal(size=(40, d)), 15, axis=0), g.normal(size=(900, d))]).astype(np.float32)
    got = found(ann.neighbours(frame(spark, x), 10, block=block))
    assert len(got) == 1500 and all(len(v) == 10 for v in got.values())
    # copies first, by id; then exactly the neighbours of brute force
    for i in range(600):
        own = i - i % 15
        assert got[i] == [(j, 0.0) for j in range(own, own + 15) if j != i][:10]
    for i in range(600, 1500):
        dist = np.delete(np.linalg.norm(x.astype(np.float64) - x[i], axis=1), i)
        assert np.allclose([y for _, y in got[i]], np.sort(dist)[:10])
