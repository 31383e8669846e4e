"""Top-k of sparse scores. Documents stay where they are; only the best rows per query move.

A join on terms would turn every shared frequent term into a row per (query, document). Here the
queries, a bounded batch, meet the document vectors inside the tasks: partial sums are arrays, and a task
emits at most ``k`` rows per query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.skew import top_k

DIGITS = 9
MAX_ENTRIES = 8_000_000  # query terms of a batch that is sent to every task
PAIRS_AT_ONCE = 500_000  # of a document term and a query term in the working arrays
ROWS_AT_ONCE = 1_000  # documents of a batch that are worked on together
KNOWN_WORDS = 100_000  # of which a task remembers the terms


class Best:
    """Running top-k per query number: score descending, ties by id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), None
        self.edge = np.full(n, -np.inf)

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        fits = s >= self.edge[q]
        q, s, i = q[fits], s[fits], i[fits]
        if not len(q):
            return
        if self.i is not None:
            q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.edge[q[last]] = s[last]
        keep = place < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def ids_of(column) -> np.ndarray:
    a = np.asarray(column)
    return a.astype(str) if a.dtype == object else a


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``ROWS_AT_ONCE``, so that what a worker makes of a batch stays small however long the texts are."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


class Known(dict):
    """The terms of the words that a task has met, at most ``KNOWN_WORDS`` of them."""

    def __init__(self, pieces: Callable[[str], list[str]]):
        self.pieces = pieces

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = self.pieces(word)
        return found


def term_vectors(docs: DataFrame, id_col: str, text_col: str, words: Callable[[str], list[str]], pieces: Callable[[str], list[str]]) -> DataFrame:
    """(id, dl, terms, tfs) of whole texts; row-local, nothing is shuffled.

    ``words`` cuts a text, ``pieces`` turns a word into its terms and is asked once per distinct word and task.
    """
    t = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(pieces)
        for b in small_batches(batches):
            terms, tfs, ends, dl = [], [], [0], []
            for text in b.column(1).to_pylist():
                c = Counter(chain.from_iterable(map(known.__getitem__, words(text)))) if text else {}
                terms.extend(c)
                tfs.extend(c.values())
                ends.append(len(terms))
                dl.append(sum(c.values()))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(dl, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.string())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=[id_col, "dl", "terms", "tfs"])

    return docs.select(id_col, text_col).mapInArrow(count, f"{id_col} {t}, dl long, terms array<string>, tfs array<int>")


def _queries(entries: pa.Table) -> tuple:
    """Queries grouped by term: term list, offsets, query numbers, weights, query lengths, query ids."""
    ids, q = np.unique(ids_of(entries["query_id"].to_numpy()), return_inverse=True)
    coded = entries["term"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    t = coded.indices.to_numpy()
    order = np.argsort(t, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(coded.dictionary)))])
    qlen = np.zeros(len(ids))
    qlen[q] = entries["qlen"].to_numpy()
    return coded.dictionary, offsets, q[order], entries["w"].to_numpy()[order], qlen, ids


def _score(queries: tuple, best: Best, ids, lens, terms: pa.Array, weights: np.ndarray, jaccard: bool) -> None:
    """Add the scores of a batch of document vectors to the running best."""
    words, offsets, qn, qw, qlen, _ = queries
    n_q = len(qlen)
    hit = pc.index_in(terms.flatten(), value_set=words)
    known = hit.is_valid().to_numpy(zero_copy_only=False)
    doc = pc.list_parent_indices(terms).to_numpy()[known]
    t = hit.fill_null(0).to_numpy()[known]
    w = weights[known]
    n = offsets[t + 1] - offsets[t]
    done = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(t):
        # whole documents whose pairs fit the working arrays
        b = max(np.searchsorted(done, done[a] + PAIRS_AT_ONCE, side="right") - 1, a + 1)
        if b < len(t):
            b = np.searchsorted(doc, doc[b])
            if b <= a:
                b = np.searchsorted(doc, doc[a], side="right")
        first = doc[a]
        reps = n[a:b]
        total = int(reps.sum())
        row = np.repeat(np.arange(a, b), reps)
        at = np.arange(total) - np.repeat(done[a:b] - done[a], reps) + np.repeat(offsets[t[a:b]], reps)
        cell = (doc[row] - first).astype(np.int64) * n_q + qn[at]
        val = w[row] * qw[at]
        size = int(doc[b - 1] - first + 1) * n_q
        if size <= 8 * total:
            s = np.bincount(cell, weights=val, minlength=size)
            found = np.flatnonzero(s > 0)
            s = s[found]
        else:
            found, back = np.unique(cell, return_inverse=True)
            s = np.bincount(back, weights=val)
            found, s = found[s > 0], s[s > 0]
        q, d = found % n_q, found // n_q + first
        if jaccard:
            s = s / (lens[d] + qlen[q] - s) * 10.0
        best.add(q, np.round(s, DIGITS), ids[d])
        a = b


def _table(best: Best, queries: tuple, names_types) -> pa.RecordBatch:
    qid = queries[5][best.q]
    ids = best.i if best.i is not None else np.zeros(0, np.int64)
    cols = [pa.array(qid.tolist(), names_types[0]), pa.array(ids.tolist(), names_types[1]), pa.array(best.s)]
    return pa.RecordBatch.from_arrays(cols, names=["query_id", "chunk_id", "score"])


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def sparse_top_k(vectors: DataFrame, entries: DataFrame, k: int, jaccard: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): best ``k`` documents per query by sparse inner product.

    ``vectors``: chunk_id, dl, terms, weights (arrays). ``entries``: query_id, term, w, qlen. With ``jaccard`` the
    sums are overlaps and become ten times the Jaccard index of the two term sets.

    Queries are cut into batches of at most ``MAX_ENTRIES`` terms by a hash of their id, one batch as a rule. A batch goes to
    every task, and the vectors are read in place, once for each batch.
    """
    vectors = vectors.select("chunk_id", F.col("dl").cast("double").alias("dl"), "terms", F.col("weights").cast("array<double>").alias("weights"))
    entries = entries.select("query_id", "term", F.col("w").cast("double").alias("w"), F.col("qlen").cast("double").alias("qlen"))
    qt, ct = entries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {qt}, chunk_id {ct}, score double"
    types = (_ARROW[qt], _ARROW[ct])
    batches = max(1, -(-entries.count() // MAX_ENTRIES))
    batch_of = F.pmod(F.xxhash64("query_id"), F.lit(batches))

    def best_of(number: int) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(_queries(entries.where(batch_of == number).toArrow()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = Best(len(queries[5]), k)
            for b in small_batches(batches):
                if best.n:
                    _score(queries, best, ids_of(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy(), b.column(2),
                           b.column(3).flatten().to_numpy(), jaccard)
            yield _table(best, queries, types)

        return vectors.mapInArrow(scan, schema)

    local = reduce(DataFrame.unionAll, map(best_of, range(batches)))
    return top_k(local, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
