"""A sample of registered queries against DuckDB, and rules every registered query has to follow."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, rows

SAMPLE = ("t04_sparse_top_k", "t07_hybrid_retrieve", "t15_auto_merge", "c13_context_build", "e15_related_papers", "m05_align_pairs", "n05_duplicates", "v12_compare_rankings",
          "d02_numeric_profile", "w01_sync_stream", "w02_assemble_stream", "w03_rollup_stream")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    cur = duck.execute(entry_points.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_operator_is_registered():
    ids = {m.group(1) for n in entry_points.queries() if (m := re.match(r"([a-z]\d\d)_", n))}
    counts = {"s": 25, "i": 23, "t": 22, "r": 14, "e": 17, "p": 17, "c": 13, "m": 10, "n": 16, "a": 6, "v": 26, "x": 14, "d": 13, "g": 6, "w": 4}
    assert ids == {f"{k}{i:02d}" for k, n in counts.items() for i in range(1, n + 1)}


def test_oracles_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
