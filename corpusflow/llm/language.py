"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams (within words, with their edges) are hashed into a fixed number of buckets. Document frequencies cover every
document that may be learned from. The weights are fitted by follow-the-regularised-leader with L1 and L2 penalties on a
bounded sample of labelled documents, in which every label has its share and rare ones a number of their own, and a
temperature is fitted on a part of the sample that the weights haven't seen. Every whole text is scored: the score of a distinct word is computed once, a text's is the mean over its n-grams.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; without labelled documents all
are ``und``; null labels aren't learned from; equal scores go to the first language in order; repeated rows are judged
alike; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.features import distinct_per_text, expand, sums, word_grams, words_of
from corpusflow.llm.tables import fresh, pieces

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SAMPLE = 3000       # labelled documents, of all labels, that the weights and the temperature are fitted on
EACH = 100          # documents of every label that are among them or added to them
HELD = 5            # every fifth of a label is for the temperature
UNKNOWN = "und"
PIECE, WORDS_AT_A_TIME = 1_500_000, 10_000  # bytes of text, and words, that one step works on
LAST = (1 << 63) - 1  # the greatest hash
SCALE = 64.0        # brings mean frequencies to the size of ordinary feature values


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray          # per bucket
    weights: np.ndarray      # bucket x language
    bias: np.ndarray
    temperature: float


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, n = word_grams(words, ORDERS)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), n


def word_scores(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of ``table`` over each word's n-grams, and their number; some words at a time, so memory is bounded."""
    parts = [(np.zeros((0, table.shape[1])), np.zeros(0, np.int64))]
    for i in range(0, len(words), WORDS_AT_A_TIME):
        buckets, n = grams(words[i:i + WORDS_AT_A_TIME])
        parts.append((sums(table[buckets], n), n))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def document_counts(docs: DataFrame, text_column: str) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each bucket, over the whole table. One row per bucket reaches the driver."""

    def run(batches):
        n, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, text_column, PIECE):
            words, number, counts = words_of(batch.column(text_column))
            buckets, per_word = grams(words)
            each, k = distinct_per_text(number, counts, max(1, len(words)))
            ends = np.cumsum(k)
            for i in range(0, len(k), 64):
                part = k[i:i + 64]
                values, m = expand(buckets, per_word, each[ends[i] - k[i]:ends[i + len(part) - 1]], part)
                mark = np.zeros((len(part), BUCKETS), bool)
                mark[np.repeat(np.arange(len(part)), m), values] = True
                seen += mark.sum(axis=0)
            n += len(batch)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(seen[some], n), pa.int64())], names=["bucket", "n"])

    got = docs.select(text_column).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return int(out[-1]), out[:-1]


def sample_features(docs: DataFrame, id_column: str, text_column: str, label_column: str, bound: int, each: int = EACH) -> list:
    """Term frequencies of labelled documents: the ``bound`` with the smallest hash of their ids, and the ``each`` smallest of every label.

    A label's documents below a hash that about twice ``each`` of them stay under are read, so no label goes through one task.
    """
    key, label, order = fresh(docs, "key", "label", "order")
    labelled = docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.xxhash64(F.col(id_column).cast("string")).alias(order), F.col(id_column).alias(key), F.col(label_column).cast("string").alias(label), text_column)
    top = labelled.select(order).orderBy(order).limit(bound).agg(F.max(order)).first()[0]
    if top is None:
        return []
    n_of = labelled.groupBy(label).agg(F.approx_count_distinct(order).alias("n")).collect()
    below = F.create_map(*(F.lit(v) for r in n_of for v in (r[0], LAST if r[1] <= 2 * each else -LAST - 1 + (2 << 64) * each // r[1])))

    def run(batches):
        for batch in pieces(batches, text_column, PIECE):
            words, number, counts = words_of(batch.column(text_column))
            buckets, per_word = grams(words)
            values, n = expand(buckets, per_word, number, counts)
            at, rows = 0, []
            for k in n.tolist():
                b, tf = np.unique(values[at:at + k], return_counts=True)
                rows.append((b.astype("<u4").tobytes(), (tf / max(1, k)).astype("<f4").tobytes()))
                at += k
            yield pa.RecordBatch.from_arrays([batch.column(label), batch.column(order), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["label", "place", "buckets", "tf"])

    chosen = labelled.where((F.col(order) <= top) | (F.col(order) <= below[F.col(label)])).groupBy(order).agg(F.min(label).alias(label), F.min(text_column).alias(text_column))  # one row of a repeated id
    rows = chosen.select(label, order, text_column).mapInArrow(run, "label string, place long, buckets binary, tf binary").collect()
    rows.sort(key=lambda r: (r["place"], r["label"], len(r["buckets"])))
    places = within(r["label"] for r in rows)
    return [(r["label"], r["place"], np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["tf"], "<f4")) for r, k in zip(rows, places) if r["place"] <= top or k < each]


def within(labels: Iterable[str]) -> list[int]:
    """How many of the same label are ahead of each."""
    seen: Counter = Counter()
    out = []
    for c in labels:
        out.append(seen[c])
        seen[c] += 1
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader with a rate per weight and elastic-net penalties."""

    def __init__(self, size: int, classes: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(0, np.abs(z) - self.l1)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[y] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list, idf: np.ndarray, epochs: int = 4) -> Model:
    """Fit on (label, place, buckets, term frequencies)."""
    languages = sorted({r[0] for r in rows})
    number = {c: i for i, c in enumerate(languages)}
    leader = Leader(BUCKETS + 1, len(languages))
    data = [(np.append(b, np.uint32(BUCKETS)), np.append((tf * idf[b] * SCALE).astype(np.float32), np.float32(1)), number[label]) for label, _, b, tf in rows]
    last = [k % HELD == HELD - 1 for k in within(r[0] for r in rows)]  # a label of few documents is learned from all of them
    learn = [d for d, h in zip(data, last) if not h]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            leader.step(*learn[i])
    w = leader.weights()
    held = [d for d, h in zip(data, last) if h] or data
    logits, y = np.array([x @ w[b] for b, x, _ in held]), np.array([d[2] for d in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.mean(np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(y)), y]))) for t in grid]
    return Model(languages, idf, w[:-1].astype(np.float32), w[-1], float(grid[int(np.argmin(loss))]))


def train(docs: DataFrame, id_column: str, text_column: str, label_column: str, bound: int = SAMPLE, each: int = EACH) -> Model | None:
    """A model from the labelled rows of ``docs``; none if there are none."""
    rows = sample_features(docs, id_column, text_column, label_column, bound, each)
    if not rows:
        return None
    n, seen = document_counts(docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()), text_column)
    return fit(rows, np.log((1 + n) / (1 + seen)) + 1)


def predict(docs: DataFrame, text_column: str, model: Model | None, keep: list[str], language: str, score: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and, under the given names, the language and its calibrated probability."""
    kept = docs.select(*keep, text_column) if text_column not in keep else docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + f", `{language}` string, `{score}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the table's size

    def run(batches):
        m = shared.value
        table = (m.weights * (m.idf[:, None] * SCALE)).astype(np.float32) if m else None
        for batch in pieces(batches, text_column, PIECE):
            texts = pc.fill_null(batch.column(text_column), "")
            letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            if m is None:
                named, best = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                words, number, counts = words_of(texts)
                of_word, per_word = word_scores(words, table)
                size = sums(per_word[number].astype(np.float64), counts)
                logits = sums(of_word[number], counts) / np.maximum(1, size)[:, None] + m.bias
                p = softmax(logits / m.temperature)
                top = p.argmax(axis=1)
                named = [m.languages[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), letters)]
                best = np.where(letters, p[np.arange(len(top)), top], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(named, pa.string()), pa.array(best, pa.float64())], names=[*keep, language, score])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """The query: learn from the documents that aren't held out, judge all."""
    learn = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).select("doc_id", "text", "lang")
    model = train(learn, "doc_id", "text", "lang")
    got = predict(docs, "text", model, ["doc_id"], "lang_pred", "score")
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The filter: documents whose language is known with at least ``min_score``, with all their columns."""
    text = "text"
    model = train(docs.select("doc_id", text, "lang"), "doc_id", text, "lang")
    language, score = fresh(docs, "lang_pred", "lang_score")
    got = predict(docs, text, model, docs.columns, language, score)
    return got.where((F.col(language) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
