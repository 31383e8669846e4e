"""Periodic runs: transforms, all runs against brute force, odd documents, the query against its twin."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import catalog_llm, periods


def every_run(w):
    """All (start, length, smallest period), by comparing words at every distance."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and not any(q % p == 0 and all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    a = rng.integers(0, int(periods.PRIME), (5, 128), dtype=np.uint64)
    assert (periods.restore(periods.transform(a)) == a).all()
    blocks, windows = rng.integers(0, 3, (40, 4), dtype=np.uint64), rng.integers(0, 3, (40, 11), dtype=np.uint64)
    want = [[((b.astype(int) - w[d:d + 4].astype(int)) ** 2).sum() == 0 for d in range(8)] for b, w in zip(blocks, windows)]
    assert (periods.zero_distances(blocks, windows) == np.array(want)).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.integers(0, 60), st.integers(1, 40))
def test_runs_are_those_of_brute_force(w, a, p):
    assert periods.find_runs(np.array(w, np.int64)) == every_run(w)
    tail = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)) if i < a or a + (i - a) % p < len(w)]
    assert periods.find_runs(np.array(tail, np.int64)) == every_run(tail)


def test_long_runs():
    assert periods.find_runs(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]
    assert periods.find_runs(np.tile(np.arange(3001), 4)) == [(0, 12_004, 3001)]
    assert periods.find_runs(np.concatenate([np.arange(9, 999), np.tile(np.arange(7), 30), np.arange(2000, 2100)])) == [(990, 210, 7)]


def test_odd_documents(odd, empty):
    got = periods.periodic_runs(odd, "doc_id", "text", with_runs=True, with_text=True).collect()
    assert len(got) == odd.count()
    assert periods.periodic_runs(empty, "doc_id", "text").count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    by_id = {r["doc_id"]: r for r in got}
    for i in (0, 1, 2):
        r = by_id[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (0, None, None, None, None)
        assert r["runs_sha256"] == r["collapsed_sha256"] == nothing
    long = next(r for r in got if r["n_words"] == 30_000)
    assert [tuple(x) for x in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "wort" and long["exponent_milli"] == 30_000_000


def test_texts_do_not_join(spark):
    """Two texts that would make a run together make none."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (None, " ".join(["x y"] * 6))], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_runs"] for r in periods.periodic_runs(docs, "doc_id", "text", periods.repeated_tail).collect()}
    assert got == {1: 0, 2: 0, None: 1}


@pytest.mark.parametrize("name", ["op13_block_convolution_runs"])
def test_twin(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cur = con.execute(catalog_llm.ORACLES[name])
    columns = sorted(c[0] for c in cur.description)
    want = sorted(map(repr, (con.execute(f"select {', '.join(columns)} from ({catalog_llm.ORACLES[name]})").fetchall())))
    got = sorted(repr(tuple(r)) for r in catalog_llm.QUERIES[name](spark, sf).select(*columns).collect())
    assert got == want
