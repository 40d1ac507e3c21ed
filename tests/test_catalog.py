"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

from retrova.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    names = sorted(df.columns)
    text = lambda v: "null" if pd.isna(v) is True else format(v, ".6f") if isinstance(v, float) else str(v)
    return names, sorted(tuple(text(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, os.fspath(SF)).toPandas()) == plain(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_approximate_search_against_the_exact_one(spark):
    sweep = {r.spec: r for r in catalog.QUERIES["hnsw_ef_sweep"](spark, os.fspath(SF)).collect()}
    assert sweep["flat"].recall == 1 and sweep["hnsw-8-64-64"].recall >= 0.95 and sweep["hnsw-8-64-16"].scored < sweep["hnsw-8-64-64"].scored
    assert all(r.same for r in catalog.QUERIES["hnsw_persist"](spark, os.fspath(SF)).collect())
    assert [r.missed for r in catalog.QUERIES["embed_cache"](spark, os.fspath(SF)).orderBy("round").collect()][1] == 0


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_recall_of_the_graph_over_all_rows(spark):
    row = catalog.QUERIES["ann_recall"](spark, os.fspath(SF)).first()
    assert row.wanted == 10 * catalog.asked(spark, os.fspath(SF)).count() and row.recall >= 0.9


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_bench_row_of_the_graph(spark):
    row = catalog.QUERIES["bench_graph"](spark, os.fspath(SF)).first()
    assert row.n == 500 and row.recall >= 0.9 and 0 < row.scored <= 700 and 0 < row.p50_ms <= row.p99_ms and row.qps > 0 and row.build_s > 0
