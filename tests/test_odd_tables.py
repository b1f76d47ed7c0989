"""Queries on tables with empty and null texts, large ids and characters that stand for something."""

import duckdb
import pytest

from morsel.plans import catalog, more  # noqa: F401


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = ["", None, "", " ", "\n", "x   \n the a", "👩‍👩‍👧 é\r\n the  b", "a\t b", "\ue000 a \ue000 b\n\ue000"]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["letter_bytes", "code_pieces"])
def test_odd_texts_as_in_sql(spark, odd, name):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
        want = c.execute(catalog.ORACLES[name]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES[name](spark, odd).collect())) == sorted(want)


def test_flags_of_large_ids(spark, tmp_path):
    ids = [0, 80, 20_585, 20_586, 51_281, 2**40 + 7, 2**62, -3]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["marked"], r["spaced"], r["plain"]) for r in catalog.QUERIES["space_flags"](spark, str(tmp_path)).collect()}
    word = {i: (i * 104729 - 8388608 + 2**31) % 2**32 - 2**31 for i in ids}
    assert got == {i: (x | 1 << 22, x & 1 << 22 != 0, x & ~(1 << 22)) for i, x in word.items()}
