"""Queries against their SQL, as rows sorted by value."""

import os

import duckdb
import pytest

import __spark_entry__
from morsel.plans import catalog

SMALL = "/root/testdata/sf0.001"
SOME = ("normalize_docs", "indent_units", "seed_counts_batched", "vocab_ids", "missing_ascii", "encode_lattice", "encode_docs", "decode_by_join", "parity_vs_en", "page_text", "interleave_weighted", "read_text", "read_jsonl_gz", "vocab_file", "code_pieces", "encode_shallow", "encode_unknown", "training_round", "interleave_credit", "stress_audit")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("the given tables are not here")
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is None, x) for x in r)
    rows = [tuple(dict(zip(want.columns, r))[c] for c in cols) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(rows, key=key)


def test_entry_and_names(spark, con):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_counts_are_made_once(spark, con):
    plan = catalog.counts_of(spark, SMALL)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_lattice_counts_units_once_and_folds_no_maps(spark, con):
    plan = catalog.encode_lattice(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "map_concat" not in plan
