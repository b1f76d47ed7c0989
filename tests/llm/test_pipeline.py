"""Every stage against what it should keep, on small tables with planted cases."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    g = np.random.default_rng(5)
    word = lambda: "".join(g.choice(list("abcdefghilmnorst"), g.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    good = [text(int(g.integers(40, 200))) for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in text(60).split()) for _ in range(30)]
    item = text(25)
    docs = [(i, t) for i, t in enumerate(good + bad)]
    docs += [(100, good[0]), (101, good[1] + " extra"), (102, text(30) + " " + item + " " + text(30)), (103, good[3][:-1] + " mail a.b@c.example.com here."), (104, None), (105, ""), (None, text(50))]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, good, item


def test_stages_take_effect(spark, tables, tmp_path):
    d, good, item = tables
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] >= set(range(60)) | {100, 101, 102, 103, None} and not kept[0] & set(range(60, 90))
    assert kept[1] == kept[0] - {100, 101, 103}
    assert kept[2] == kept[1] - {102}
    assert kept[3] == kept[2] == kept[4]
    got = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["lossless"] in (True, None) for r in got.values())
    assert sorted(map(str, (x["doc_id"] for x in corpus_pipeline.run(spark, d).collect()))) == sorted(map(str, kept[4]))


def test_order_of_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_cases_of_every_stage(spark, tables):
    """Empty tables, clashing columns, ids that are no numbers, no n_chars."""
    d, good, _ = tables
    plain = spark.createDataFrame([("1", good[0], 7, 0.5), ("x", good[1], 7, 0.5), (None, None, 7, 0.5), ("4", "", 7, 0.5), ("5", good[2] * 200, 7, 0.5)], "doc_id string, text string, group_id int, keep double")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, plain.limit(0), d)
        assert empty.count() == 0, name
        out = stage(spark, plain, d)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == plain.columns and empty.columns == plain.columns, name
        assert {r["doc_id"] for r in out.collect()} <= {"1", "x", None, "4", "5", 1, 4, 5}, name
        if name in ("near_duplicates", "decontamination", "personal_data"):
            assert out.count() == 5, name
