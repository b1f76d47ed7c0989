import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from morsel.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_features_by_definition():
    text = ["One two two!", None, "", "two two"]
    place, off = Q.features(pa.array(text))
    assert np.diff(off).tolist() == [7, 0, 0, 3]  # One, two, two, ! and three pairs
    a, b = place[off[0] : off[1]].tolist(), place[off[3] : off[4]].tolist()
    assert a[2:5] == b  # two, repeat, two
    again = Q.features(pa.array(["x y", *text]))[0]
    assert again[3:].tolist() == place.tolist()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = Q.score_documents(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    q, t = got.quality_score >= 0.5, got.toxic_score >= 0.5
    assert (q == (got.quality == 1)).mean() > 0.99 and q[got.quality == 1].mean() > 0.995
    assert t[got.toxic == 1].mean() > 0.75 and t[got.toxic == 0].mean() < 0.01


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    w = np.where(rng.random(1 << Q.BITS) < 0.3, rng.normal(size=1 << Q.BITS), 0).astype(np.float32)
    text = ["a b c a b", "", None, "z! z! z!", "a b c a b"]
    place, off = Q.features(pa.array(text))
    q, t = Q.scores(pa.array(text), [Q.Model(w, 0.2), Q.Model(w, -0.1, True)])
    for i in range(len(text)):
        p = place[off[i] : off[i + 1]]
        assert q[i] == pytest.approx(1 / (1 + np.exp(-(w[p].sum() / max(1, len(p)) ** 0.5 + 0.2))), rel=1e-5)
        assert t[i] == pytest.approx(1 / (1 + np.exp(-(w[np.unique(p)].sum() - 0.1))), rel=1e-5)


def test_cases(spark):
    rows = [(1, "good text here"), (2, "BAD!!! BAD!!!"), (3, None), (4, ""), (None, "good text"), (1, "good text here"), (5, "word " * 200000)]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 0, 1), (3, 1, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = Q.score_documents(docs, model).collect()
    assert len(got) == len(rows) and {r.doc_id: r.keep for r in got}[1] and not {r.doc_id: r.keep for r in got}[2]
    kept = Q.drop_low_quality(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    none = Q.fit(docs, labels.limit(0))
    assert all(r.keep for r in Q.score_documents(docs, none).collect())
    assert Q.drop_low_quality(docs.limit(0), none).count() == 0
    assert Q.fit(docs.limit(0), labels.drop("toxic"))["toxic"].bias < 0


@pytest.mark.parametrize("head", ["quality", "toxic"])
def test_ftrl_against_a_scalar_version(head):
    """McMahan and others (2013), one coordinate at a time."""
    h = Q.HEADS[head]
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 40, rng.integers(1, 30)).astype(np.int32), float(rng.random() < 0.5)) for _ in range(60)]
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def w(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= h.l1 else (np.sign(zi) * h.l1 - zi) / ((Q.BETA + n.get(i, 0.0) ** 0.5) / h.alpha + Q.L2)

    for _ in range(h.epochs):
        for place, y in rows:
            x = {int(i): 1.0 if h.presence else float((place == i).sum()) / len(place) ** 0.5 for i in place}
            b = -bz / ((Q.BETA + bn**0.5) / h.alpha)
            now = {i: w(i) for i in x}
            d = 1 / (1 + np.exp(-(sum(now[i] * v for i, v in x.items()) + b))) - y
            for i, v in x.items():
                g, old = d * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / h.alpha * now[i]
                n[i] = old + g * g
            bz += d - ((bn + d * d) ** 0.5 - bn**0.5) / h.alpha * b
            bn += d * d
    m = Q.train(rows, h)
    assert m.bias == pytest.approx(-bz / ((Q.BETA + bn**0.5) / h.alpha), rel=1e-4)
    assert all(m.weights[i] == pytest.approx(w(i), rel=1e-3, abs=1e-5) for i in range(40)) and not m.weights[40:].any()


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("d1", "good text"), ("2", "more text")], "doc_id string, text string")
    labels = spark.createDataFrame([("d1", 1, 0), ("2", 0, 1)], "doc_id string, quality int, toxic int")
    got = Q.score_documents(docs, Q.fit(docs, labels)).collect()
    assert {r.doc_id for r in got} == {None, 2}


def _peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_scores_hold_few_bytes_of_a_batch():
    rng = np.random.default_rng(6)
    text = pa.array([" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(3000)])
    models = [Q.Model(rng.normal(size=1 << Q.BITS).astype(np.float32), 0.1), Q.Model(np.zeros(1 << Q.BITS, np.float32), -1.0, True)]
    assert text.nbytes > 6e6
    (q, t), peak = _peak(lambda: Q._scored(text, models))
    assert peak < 40e6 and len(q) == len(t) == 3000
    assert q == pytest.approx(Q.scores(text, models)[0])


def test_order_of_training_rows_holds_no_copy():
    """Places decide only among rows that are equal otherwise, and only theirs are copied."""
    rng = np.random.default_rng(7)
    place = [rng.integers(0, 1 << 20, 5000).astype(np.int32) for _ in range(400)]
    key, quality = [i // 2 if i < 20 else i for i in range(400)], [1.0 if i % 4 < 2 else None for i in range(400)]
    pdf = pd.DataFrame({"key": key, "quality": quality, "place": place})
    want = sorted(range(400), key=lambda i: (key[i], place[i].tobytes()))
    for seed in range(3):
        got, peak = _peak(lambda: Q._ordered(pdf.sample(frac=1, random_state=seed), ["quality"]))
        assert [x.tobytes() for x in got["place"]] == [place[i].tobytes() for i in want]
        assert peak < 4e6
