"""What a Python worker holds doesn't grow with the batch, the vocabulary or the pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corpusflow.functions import text as tx
from corpusflow.operators import sparse


def test_batches_are_cut(spark, monkeypatch):
    b = pa.RecordBatch.from_pydict({"i": list(range(2 * sparse.ROWS_AT_ONCE + 1))})
    small = list(sparse.small_batches([b, b.slice(0, 0)]))
    assert [x.num_rows for x in small] == [sparse.ROWS_AT_ONCE, sparse.ROWS_AT_ONCE, 1] and pa.Table.from_batches(small).to_batches()[0].schema == b.schema
    assert pa.Table.from_batches(small)["i"].to_pylist() == list(range(b.num_rows))
    docs = spark.createDataFrame([(i, f"red word{i} blue word{i % 3} red") for i in range(20)], "id long, text string")
    get = lambda: sorted((r.id, r.dl, sorted(zip(r.terms, r.tfs))) for r in sparse.term_vectors(docs, "id", "text", tx.index_words, tx.index_pieces).collect())
    want = get()
    monkeypatch.setattr(sparse, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(sparse, "KNOWN_WORDS", 2)
    assert get() == want and len(want) == 20


def test_working_arrays_are_bounded():
    n_docs, n_terms, n_queries = 200, 100, 400
    words = [f"w{i}" for i in range(n_terms)]
    entries = pa.table({"query_id": np.repeat(np.arange(n_queries), n_terms), "term": words * n_queries, "w": np.tile(np.arange(n_terms) % 7 + 1.0, n_queries), "qlen": np.zeros(n_queries * n_terms)})
    terms = pa.array([words] * n_docs)
    weights = np.tile(np.arange(n_terms) % 5 + 1.0, n_docs) * np.repeat(np.arange(n_docs) + 1.0, n_terms)
    queries, best = sparse._queries(entries), sparse.Best(n_queries, 3)
    tracemalloc.start()
    sparse._score(queries, best, np.arange(n_docs), np.zeros(n_docs), terms, weights, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.i.tolist() == [n_docs - 1, n_docs - 2, n_docs - 3] * n_queries
    assert peak < 80e6


def test_words_are_taken_apart_once(monkeypatch):
    asked = []
    known = sparse.Known(lambda w: asked.append(w) or tx.index_pieces(w))
    words = "the red_-x red a.b 1 a 机器学习v2 red the é".split()
    assert [known[w] for w in words] == [[], ["red_x"], ["red"], ["a.b"], ["1"], [], ["机器", "器学", "学习", "v2"], ["red"], [], []]
    assert len(asked) == len(set(words))
    monkeypatch.setattr(sparse, "KNOWN_WORDS", 4)
    assert all(known[f"w{i}"] == [f"w{i}"] and len(known) <= 8 for i in range(20)) and len(known) <= 4
