"""Passage removal: the automaton and the whole operator against brute force, many small shards, odd documents, the query against its twin."""

import glob
import hashlib
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from corpusflow.llm import catalog_llm, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs):
    """(doc_id, words, removed, digest, kept words) of (doc_id, text) rows, from a table of all windows."""
    n, low = passages.WINDOW, {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            if d is not None:
                low[tuple(w[i:i + n])] = min(d, low.get(tuple(w[i:i + n]), d))
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - n + 1) if d is not None and low[tuple(w[i:i + n])] < d for j in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed=5, n=160):
    """Texts of few words put together from shared passages, with copies, near copies, one passage in half of all texts and long texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choice(vocabulary, int(k))) for k in rng.integers(3, 60, 25)]
    docs = []
    for i in range(n):
        parts = [shared[int(rng.integers(25))] if rng.random() < 0.5 else " ".join(rng.choice(vocabulary, int(rng.integers(1, 30)))) for _ in range(int(rng.integers(0, 8)))]
        if i % 2:
            parts.insert(len(parts) // 2, shared[0] + " " + shared[1])
        docs.append((i * 3 % n, "\t".join(parts)))
    near = docs[7][1].split()
    for i in range(40):
        w = list(near)
        if w:
            w[int(rng.integers(len(w)))] = "other"
        docs.append((1000 - i, " ".join(w)))
    return docs + [docs[3], (2000, docs[3][1]), (2001, None), (None, docs[3][1]), (2002, ""), (2003, "a b c"), (0, "x " * 40), (0, "x " * 41), (5, "x " * 90_000)]


def test_automaton():
    rng = np.random.default_rng(1)
    for _ in range(30):
        docs = [[str(x) for x in rng.integers(0, 3, int(rng.integers(0, 60)))] for _ in range(6)]
        a = passages.Automaton()
        for owner, d in enumerate(docs):
            a.add(d, owner)
        arrays = a.arrays()
        stream = passages.Stream(*(arrays[n] if n == "words" else pa.array(arrays[n]) for n in passages.AUTOMATON))
        where = {}
        for owner, d in enumerate(docs):
            for i in range(len(d) - 12):
                where.setdefault(tuple(d[i:i + 13]), owner)
        asked = [str(x) for x in rng.integers(0, 4, 400)] + docs[0] + docs[4]
        for owner in (0, 3, 9):
            want = [i + 12 for i in range(len(asked) - 12) if where.get(tuple(asked[i:i + 13]), 99) < owner]
            assert stream.ends(asked, owner) == want


@pytest.mark.parametrize("shard,stream,group", [(60_000, 400_000, 400_000), (40, 300, 500)])
def test_against_all_windows(spark, monkeypatch, shard, stream, group):
    monkeypatch.setattr(passages, "SHARD", shard)
    monkeypatch.setattr(passages, "STREAM", stream)
    monkeypatch.setattr(passages, "GROUP", group)
    docs = made_up()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = passages.without_repeats(table, "doc_id", "text", with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain(docs)
    for r in got:
        if r["kept"] is not None:
            assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_odd_documents(odd, empty):
    got = passages.without_repeats(odd, "doc_id", "text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert passages.without_repeats(empty, "doc_id", "text").count() == 0


def test_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    name = "op12_suffix_automata_passages"
    got = catalog_llm.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog_llm.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_hashes_of_words():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé"), int(n))) for n in rng.integers(1, 200, 3000)] + ["a", "a" * 8, "a" * 9, "a" * 64, "a" * 65, "a" * 64 + "b"]
    h = passages.hashed(pa.array(["x", *words])[1:])
    assert (h == passages.hashed(pa.array(words[::-1]))[::-1]).all()
    assert len(np.unique(h)) == len(set(words))
    texts = pa.array([" a\tb ", None, "", "c  a"])
    got, counts = passages.words_in(texts)
    assert passages.joined(got, counts).to_pylist() == ["a b", "", "", "c a"]


def test_passing_data_is_left_out_or_removed(spark, monkeypatch):
    """No automata in tables, and no shuffle that outlives the table it made."""
    kept, labels = passages.stored, []
    monkeypatch.setattr(passages, "stored", lambda df, label, *by: labels.append(label) or kept(df, label, *by))
    assert passages.without_repeats(spark.createDataFrame(made_up(), "doc_id long, text string"), "doc_id", "text").count() == 209
    assert "passage-documents" in labels and "passage-automata" not in labels

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = shuffles()
    table = kept(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("c")), "few")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == 97
