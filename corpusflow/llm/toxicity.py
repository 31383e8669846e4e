"""Toxicity as ordered severity grades: cumulative-link regression on sparse text features.

Features are the presence of words and of their first letters (3 to 6), as 64-bit hashes. P(grade > k) is the logistic of
w.x - t[k]: one weight per feature for all thresholds, thresholds in ascending order. The expected severity is the sum of
these probabilities. The model is fitted by proximal gradients with elastic-net penalties on a bounded sample of
labelled documents; features are chosen among those of the sample by how their frequency differs between grades.
Every whole text is scored; only features with a weight are looked up.

Defined results: null and empty texts have no features and so the base rates; without graded documents every severity
is 0 and nothing is rejected; null grades aren't learned from; of several grades of a document the highest counts;
repeated rows are judged alike; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.features import distinct_per_text, expand, sums, word_grams, words_of
from corpusflow.llm.tables import fresh, pieces, stored

SAMPLE = 20_000      # graded documents that the model is fitted on
FEATURES = 4096      # that may get a weight
MIN_DOCS = 4         # documents of the sample that have a feature
PREFIXES = (4, 5, 6, 7)  # letters of a word's beginning, with its edge
PIECE = 1_500_000    # bytes of text that one step works on
REJECT = 0.5         # probability of a grade above 0 from which a document is rejected


@dataclass
class Model:
    features: np.ndarray     # ascending hashes
    weights: np.ndarray
    thresholds: np.ndarray   # ascending

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for scores x, a column per threshold."""
        return sigmoid(x[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word without its outer punctuation: the word, and its first letters."""
    bare = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in words]
    return word_grams(bare, (), whole=True) if not PREFIXES else _prefixes(bare)


def _prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, n = word_grams(words, (), whole=True)
    parts, counts = [h], [n]
    for k in PREFIXES:
        part, m = word_grams([w[:k - 1] + "\x02" if len(w) >= k - 1 else "" for w in words], (), whole=True)
        parts.append(part)
        counts.append(m)
    owner = np.concatenate([np.repeat(np.arange(len(words)), c) for c in counts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.sum(counts, axis=0)


def doc_features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, as hashes or, with ``known`` (ascending), as places in it; and their number."""
    words, number, counts = words_of(texts)
    h, per_word = word_features(words)
    if known is None:
        pool, place = np.unique(h, return_inverse=True)
    else:
        pool = known
        place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        ok = known[place] == h if len(known) else np.zeros(len(h), bool)
        per_word = sums(ok.astype(np.float64), per_word).astype(np.int64)
        place = place[ok]
    useful = per_word[number] > 0
    counts = sums(useful.astype(np.float64), counts).astype(np.int64)
    values, n = expand(place, per_word, number[useful], counts)
    each, k = distinct_per_text(values, n, max(1, len(pool)))
    return (pool[each] if known is None else each), k


def graded_sample(docs: DataFrame, grades: DataFrame, id_column: str, text_column: str, bound: int) -> DataFrame:
    """Texts and grades of at most ``bound`` graded documents, those with the smallest hash of their ids, as a stored table.

    ``grades``: (``doc_id``, ``grade``). Only the chosen ids, at most ``bound`` of them, are broadcast.
    """
    key, grade = fresh(docs, "key", "grade")
    top = grades.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("grade").alias(grade))
    top = top.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(bound).select(F.col("doc_id").alias(key), grade)
    texts = docs.select(F.col(id_column), F.col(text_column)).join(F.broadcast(top), F.col(id_column) == F.col(key))
    one = texts.groupBy(F.col(key).alias("doc_id"), F.col(grade).cast("int").alias("grade")).agg(F.min(text_column).alias("text"))  # of a repeated id
    return stored(one, "toxicity-sample")


def choose_features(sample: DataFrame, levels: int) -> np.ndarray:
    """Features of the sample whose share differs most between grade 0 and the grades above, at most ``FEATURES``."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            h, n = doc_features(batch.column("text"))
            bad = np.repeat(batch.column("grade").to_numpy() > 0, n)
            pool, place = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pool.view(np.int64)), pa.array(np.bincount(place, minlength=len(pool))), pa.array(np.bincount(place, bad, len(pool)).astype(np.int64))],
                                             names=["feature", "n", "bad"])

    totals = sample.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("long"))).first()
    good, bad = (totals[0] - (totals[1] or 0)) or 1, totals[1] or 1
    counted = sample.select("grade", "text").mapInArrow(run, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    a, b = (F.col("bad") + 0.5) / (bad + 1), (F.col("n") - F.col("bad") + 0.5) / (good + 1)
    z = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    top = counted.where(F.col("n") >= MIN_DOCS).orderBy(z.desc(), "feature").limit(FEATURES).select("feature").toArrow()["feature"].to_numpy()
    return np.sort(top.view(np.uint64))


def fit(at: np.ndarray, counts: np.ndarray, grades: np.ndarray, features: np.ndarray, l1: float | None = None, l2: float = 1e-4, rounds: int = 400) -> Model:
    """Accelerated proximal gradients on the cumulative-link loss. ``at``: features of each document, one after the other."""
    levels = int(grades.max()) if len(grades) else 0
    if not levels:
        return Model(features, np.zeros(len(features)), np.zeros(0))
    n, owner = len(grades), np.repeat(np.arange(len(grades)), counts)
    l1 = 0.02 / n ** 0.5 if l1 is None else l1  # the noise of a mean gradient shrinks with the root of the sample
    above = grades[:, None] > np.arange(levels)[None, :]
    share = np.clip(above.mean(axis=0), 1 / (n + 1), n / (n + 1))
    t = -np.log(share / (1 - share))
    w = np.zeros(len(features))
    step = 4.0 / (levels * max(1.0, np.bincount(owner, minlength=n).mean()))

    def score(w):
        return np.bincount(owner, w[at], n)

    def gradient(w, t):
        # log P(y) = log(P(y > g-1) - P(y > g)): in terms of the two neighbouring thresholds
        p = np.concatenate([np.ones((n, 1)), sigmoid(score(w)[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        hi, lo = p[rows, grades], p[rows, grades + 1]
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        by_score = -(dhi - dlo) / like
        by_t = np.bincount(grades, dhi / like, levels + 1)[1:] - np.bincount(grades, dlo / like, levels + 1)[:-1]
        return np.bincount(at, by_score[owner], len(w)) / n, by_t / n

    v, u, k = w.copy(), t.copy(), 1.0
    for _ in range(rounds):
        gw, gt = gradient(v, u)
        w2 = v - step * n ** 0.25 * gw
        size = step * n ** 0.25
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - size * l1) / (1 + size * l2)
        t2 = np.maximum.accumulate(u - gt)
        k2 = (1 + (1 + 4 * k * k) ** 0.5) / 2
        if ((v - w2) * (w2 - w)).sum() > 0:  # restart when it overshoots
            k2 = 1.0
        v, u = w2 + (k - 1) / k2 * (w2 - w), np.maximum.accumulate(t2 + (k - 1) / k2 * (t2 - t))
        w, t, k = w2, t2, k2
    some = w != 0
    return Model(features[some], w[some], t)


def train(docs: DataFrame, grades: DataFrame, id_column: str, text_column: str, bound: int = SAMPLE) -> Model:
    sample = graded_sample(docs, grades, id_column, text_column, bound)
    levels = sample.agg(F.max("grade")).first()[0]
    if not levels:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    features = choose_features(sample, levels)

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            at, n = doc_features(batch.column("text"), features)
            ends = np.cumsum(n)
            packed = [at[e - k:e].astype("<u2").tobytes() for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("grade"), pa.array(packed, pa.binary())], names=["doc", "grade", "at"])

    got = sample.select("doc_id", "grade", "text").mapInArrow(run, "doc string, grade int, at binary").collect()  # at most as many rows as the bound, of few numbers
    got = sorted(got, key=lambda r: (r["doc"], r["grade"], r["at"]))
    each = [np.frombuffer(r["at"], "<u2").astype(np.int64) for r in got]
    return fit(np.concatenate(each), np.array([len(x) for x in each]), np.array([r["grade"] for r in got]), features)


def grade(docs: DataFrame, text_column: str, model: Model, keep: list[str], severity: str, level: str, toxic: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and, under the given names, expected severity, likeliest grade and P(grade > 0)."""
    kept = docs.select(*keep, text_column) if text_column not in keep else docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep) + f", `{severity}` double, `{level}` int, `{toxic}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches):
        m = shared.value
        for batch in pieces(batches, text_column, PIECE):
            if len(m.thresholds):
                at, n = doc_features(batch.column(text_column), m.features)
                above = m.above(sums(m.weights[at], n))
            else:
                above = np.zeros((len(batch), 1))
            p = np.concatenate([np.ones((len(batch), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(batch), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0])],
                                             names=[*keep, severity, level, toxic])

    return kept.mapInArrow(run, schema)


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades from the labels table: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a poor one."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: expected severity of every document, and whether it is rejected."""
    model = train(docs, severity_grades(labels), "doc_id", "text")
    got = grade(docs, "text", model, ["doc_id"], "expected_severity", "grade", "p_toxic")
    return got.withColumn("toxic", F.col("p_toxic") >= REJECT)


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filter: documents that aren't rejected, with all their columns."""
    model = train(docs, severity_grades(labels), "doc_id", "text")
    severity, level, toxic = fresh(docs, "severity", "grade", "p_toxic")
    return grade(docs, "text", model, docs.columns, severity, level, toxic).where(F.col(toxic) < REJECT).select(*docs.columns)
