"""Fingerprints, near-duplicates and the pipeline against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import fingerprints as fp
from corpusflow.llm import near_dedup as nd
from corpusflow.llm import pii

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, low=lambda t: t.translate(UPPER), pattern=r"[^\x20\x09-\x0D]+"):
    w = re.findall(pattern, low(text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def true_components(texts: dict, per_hundred=85):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= per_hundred * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for i in rng.integers(0, len(out), n):
        out[i] = f"new{rng.integers(0, 10**9)}"
    return out


@pytest.mark.parametrize("per_hundred", [85, 80])
def test_components_against_all_pairs(spark, per_hundred):
    rng = np.random.default_rng(11)
    texts = {}
    for g in range(12):  # groups whose members lie around the threshold, and chains whose ends don't touch
        words = [f"w{rng.integers(0, 5000)}" for _ in range(150)]
        for _ in range(18):
            texts[len(texts)] = " ".join(words if rng.random() < 0.2 else edited(rng, words, int(rng.integers(1, 5))))
            if g % 2:
                words = edited(rng, words, 2)
    for i in range(40):
        texts[len(texts)] = " ".join(f"u{i}_{k}" for k in range(60))
    texts |= {1000: "One two three", 1001: "one TWO three", 1002: "", 1003: None, 1004: " \n\t", 1005: "", 1006: "one two three four five", 1007: "One two\tthree  four\nfive", 1008: "É a", 1009: "é a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = nd.near_duplicates(docs, "doc_id", "text", per_hundred).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == true_components(texts, per_hundred) and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowded_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 1 << 11)
    rng = np.random.default_rng(12)
    words = [f"w{rng.integers(0, 5000)}" for _ in range(120)]
    texts = {i: " ".join(edited(rng, words, int(rng.integers(2, 4)))) for i in range(150)}
    got = nd.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == true_components(texts)


def test_pruning_keeps_links():
    needed = nd.least_matches()
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (3000, nd.VALUES)).astype(np.uint16)
    for similarity, least, most in ((0.9, 0.999, 1.0), (0.85, 0.999, 1.0), (0.2, 0.0, 0.01)):
        b = np.where(rng.random(a.shape) < similarity, a, a + np.uint16(1))
        assert least <= len(nd.survivors(a, b, needed)) / len(a) <= most
    for p in (80, 85, 95):
        r = nd.band_rows(p)
        assert (1 - (p / 100) ** r) ** (nd.VALUES // r) <= nd.UNSEEN


def test_long_chain_of_links(spark):
    links = spark.range(1, 400).selectExpr("id a", "id - 1 b").union(spark.range(1001, 1400).selectExpr("id a", "cast(1000 as long) b"))
    got = dict(nd.components(links).collect())
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1400)}


def test_ids_with_several_texts(spark):
    """Such rows are documents of their own: no text is lost, and each has one row in its component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, c), (4, c + " more"), (5, None), (5, c), (6, a)], "doc_id long, text string")
    got = sorted(tuple(r) for r in nd.near_duplicates(docs, "doc_id", "text").select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted([(1, 36, 1, True), (2, 36, 1, False), (2, 36, 2, True), (3, 36, 2, False), (4, 36, 4, True), (4, 37, 4, True), (5, 0, 5, True), (5, 36, 4, False), (6, 36, 1, False)])
    left = nd.one_of_each_group(docs, "doc_id", "text")
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(repr, (tuple(r) for r in left.collect()))) == sorted(map(repr, [(1, a), (2, b), (4, c), (4, c + " more"), (5, None)]))


def test_near_duplicates_defined_cases(odd, empty):
    got = nd.near_duplicates(odd, "doc_id", "text").collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert all(by[i].kept and by[i].n_shingles == 0 for i in (0, 1, 2, 3) if by[i].n_shingles == 0)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert nd.near_duplicates(empty, "doc_id", "text").count() == 0
    kept = nd.one_of_each_group(odd, "doc_id", "text")
    assert kept.columns == odd.columns and 7 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id is null").count() == 1


def sketch(text, k=fp.K):
    w = [x for x in re.split(r"\s+", (text or "").lower(), flags=re.ASCII) if x]

    def h(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    each = [h([x.encode()]) for x in w]
    all_ = [h(each[i:i + 5]) for i in range(len(each) - 4)] if len(each) >= 5 else [h(each)] if each else []
    return sorted({x & ((1 << fp.BITS) - 1) for x in all_})[:k]


def test_sketches_and_estimates(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 3000, 2000)]
    texts = [" ".join(words), " ".join(words[:1500]), " ".join(words[:3]), "", None, " \n", "Über A b c D e", "x " * 9]
    df = spark.createDataFrame([(i, t, texts[0]) for i, t in enumerate(texts)], "i int, t string, u string")
    a, b = fp.sketch(F.col("t")), fp.sketch(F.col("u"))
    got = df.select("i", a.alias("a"), fp.resemblance(a, b).alias("r"), fp.containment(a, b).alias("c"), fp.distinct_shingles(a).alias("n")).orderBy("i").collect()
    true = [shingles(t, str.lower, r"\S+") for t in texts]
    for r, t, s in zip(got, texts, true):
        assert r.a == sketch(t)
        assert abs(r.r - (len(s & true[0]) / len(s | true[0]))) < 0.15
        assert abs(r.n - len(s)) <= 0.3 * len(s)
        assert abs(r.c - (len(s & true[0]) / len(s) if s else 1.0)) < 0.2
    parts = spark.createDataFrame([(i // 500, " ".join(words[i:i + 504])) for i in range(0, 2000, 500)], "p int, t string").select(F.lit(1).alias("k"), fp.sketch(F.col("t")).alias("s"))
    assert fp.merged_by(parts, ["k"], "s").first().sketch == sketch(texts[0])


def test_edited_fingerprints(spark, documents, odd, empty):
    rows = documents.orderBy("doc_id").collect()
    got = fp.edited_fingerprints(documents.repartition(4)).orderBy("doc_id").collect()
    line = lambda t: "".join(f"{x:012x}" for x in sketch(t))
    for i, (r, d) in enumerate(zip(got, rows, strict=True)):
        t, u = d.text or "", rows[(i + 1) % len(rows)].text or ""
        k = len(t) // 4
        e = t[:len(t) - k] + u[:k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (line(t), line(e)) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fp.edited_fingerprints(odd).count() == odd.count()
    assert fp.edited_fingerprints(empty).count() == 0
    one = fp.edited_fingerprints(documents.limit(1)).first()
    assert one.near_next == 1.0


def test_pipeline(spark, sf, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == documents.columns
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        if name == "pii":
            assert out.count() == docs.count() and not set(out.where(F.col("text").rlike(pii.KINDS["phone"])).select("text").collect()) & set(docs.select("text").collect())
        if name == "near_dedup":
            true = true_components({r.doc_id: r.text for r in docs.collect()}, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in true.items() if i == c}
        docs = out
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_pipeline_defined_cases(spark, sf, odd, empty):
    for docs in (odd, empty, documents_of_one(odd)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def documents_of_one(odd):
    return odd.where("doc_id = 5")
