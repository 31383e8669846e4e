import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import cache, dense, fusion, graph, lexical, memory, neighbours, sparse


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, score double")


def test_rrf_order_and_scores(spark):
    a = ranked(spark, [(1, c, i + 1, 0.0) for i, c in enumerate("ab")])
    b = ranked(spark, [(1, c, i + 1, 0.0) for i, c in enumerate("cd")])
    got = fusion.rrf(a, b).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "c", "b", "d"]
    both = fusion.rrf(a, ranked(spark, [(1, "a", 1, 0.0)])).where("chunk_id = 'a'").first()
    assert both.hits == 2 and both.score == pytest.approx(1 / 30)


def test_rrf_passes_a_single_list_through(spark):
    a = ranked(spark, [(1, "x", 1, 0.1), (1, "y", 2, 0.9)])
    got = fusion.rrf(a, ranked(spark, [(2, "z", 1, 0.5)]), limit=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in got] == [(1, "x", 0.1), (1, "y", 0.9), (2, "z", 0.5)]


def test_parent_merge_needs_threshold_and_parent(spark):
    hits = spark.createDataFrame([(1, "c1", "p", 0.5, 1), (1, "c2", "p", 0.9, 2), (1, "c3", "q", 0.7, 3), (1, "c4", "x", 0.1, 4), (1, "c5", "x", 0.2, 5)],
                                 "query_id int, chunk_id string, parent_chunk_id string, score double, rank int")
    parents = spark.createDataFrame([("p", "r"), ("q", "r")], "chunk_id string, parent_chunk_id string")
    got = {r.chunk_id: (r.score, r.replaced) for r in fusion.merge_parents(hits, parents).collect()}
    assert got == {"p": (0.9, 2), "c3": (0.7, 0), "c4": (0.1, 0), "c5": (0.2, 0)}
    meta = fusion.auto_merge_meta(hits, parents).first()
    assert meta.applied and meta.replaced_chunks == 2 and meta.steps == 1


def test_image_hits(spark):
    hits = spark.createDataFrame([(1, "a", "text", 0.5)], "query_id int, chunk_id string, text string, score double")
    img = spark.createDataFrame([(1, "a", "/u", "cap", "", 0.9), (1, "b", "/v", "cap", "<<IMAGE:00000000>>", 0.8), (1, "c", "/w", "", "", 0.7)],
                                "query_id int, chunk_id string, image_url string, caption string, image_placeholder string, image_score double")
    got = {r.chunk_id: r for r in fusion.merge_image_hits(hits, img).collect()}
    assert set(got) == {"a", "b"} and got["a"].image_urls == ["/u"] and got["a"].score == 0.5
    assert got["b"].chunk_type == "image" and got["b"].score == 0.8


def brute(q, c, k):
    out = set()
    for i, v in enumerate(q):
        s = np.round(c @ v, 9)
        for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-s[j], j))[:k]):
            out.add((i, j, r + 1))
    return out


@pytest.mark.parametrize("limit", [16_000_000, 40])
def test_dense_top_k_in_batches(spark, monkeypatch, limit):
    monkeypatch.setattr(dense, "BROADCAST_VALUES", limit)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 8)
    g = np.random.default_rng(1)
    c = np.round(g.standard_normal((90, 5)), 1)
    c[40:60] = c[0:20]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "chunk_id int, embedding array<double>").repartition(3)
    q = df.where("chunk_id < 30").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r.chunk_id, r.rank) for r in dense.exact_top_k(q, df, 4, "query_id", "chunk_id").collect()}
    assert got == brute(c[:30], c, 4)


@pytest.mark.parametrize("dim,clusters,shard", [(4, 0, 8192), (8, 0, 300), (32, 12, 300), (64, 0, 8192)])
def test_approximate_recall_is_measured(spark, monkeypatch, dim, clusters, shard):
    """Queries that are not in the table, vectors in tight clusters, many copies of one vector, and several shards."""
    monkeypatch.setattr(neighbours, "SHARD", shard)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1200, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, 1200)] + x / 20
    x[200:500] = x[200]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(5000, None), (5001, [1.0])], "chunk_id long, embedding array<float>")
    asked = x[rng.integers(500, 1200, 30)] + rng.normal(size=(30, dim)) / 5
    q = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    found = neighbours.search(neighbours.build(df, "chunk_id"), q, "query_id", 5)
    got, truth = neighbours.best(found, 5), dense.exact_top_k(q, df.where("size(embedding) > 1"), 5, "query_id", "chunk_id", metric="cosine")
    # of equal copies any may be found
    edge = {r.query_id: r.score for r in truth.where("rank = 5").collect()}
    assert sum(r.score >= edge[r.query_id] - 1e-9 for r in got.collect()) >= 0.9 * 150
    true_scores = {(r.query_id, r.chunk_id): r.score for r in dense.exact_top_k(q, df.where("size(embedding) > 1"), 1200, "query_id", "chunk_id", metric="cosine").collect()}
    assert all(abs(true_scores[r.query_id, r.chunk_id] - r.score) < 1e-8 for r in got.collect())
    assert neighbours.effort(found).first().visits < 30 * 1200


def test_graph_reaches_every_vector():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 6)), 25, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ends, near = neighbours.linked(x)
    seen = set(neighbours.entry_points(ends, near).tolist())
    open_ = list(seen)
    while open_:
        at = open_.pop()
        new = set(near[ends[at - 1] if at else 0:ends[at]].tolist()) - seen
        seen |= new
        open_ += new
    assert len(seen) == len(x)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert neighbours.search(neighbours.build(none, "chunk_id"), q, "query_id", 5).count() == 0
    one = spark.createDataFrame([(7, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.best(neighbours.search(neighbours.build(one, "chunk_id"), q, "query_id", 5), 5).collect()] == [(1, 7, 0.0, 1)]


@pytest.mark.parametrize("limit", [8_000_000, 10])
def test_sparse_top_k_in_batches(spark, monkeypatch, limit):
    monkeypatch.setattr(sparse, "MAX_ENTRIES", limit)
    monkeypatch.setattr(sparse, "PAIRS_AT_ONCE", 25)
    g = np.random.default_rng(3)
    docs = [(f"d{i:02d}", " ".join(f"w{x}" for x in g.zipf(1.6, 12) if x < 40)) for i in range(60)]
    queries = [(i, " ".join(f"w{x}" for x in g.zipf(1.6, 6) if x < 40)) for i in range(12)]
    d = spark.createDataFrame(docs, "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, text string")
    idx = lexical.LexicalIndex(d, "chunk_id")
    got = {(r.query_id, r.chunk_id, r.rank) for r in idx.search(q, "query_id", 5).collect()}
    n, tok = len(docs), {i: t.split() for i, t in docs}
    avg = sum(map(len, tok.values())) / n
    df = lambda t: sum(t in x for x in tok.values())

    def weight(t, x):
        f, k = x.count(t), df(t)
        i = math.log((n - k + .5) / (k + .5) + 1) if k else math.log(n + 1)
        return i * f * 2.5 / (f + 1.5 * (.25 + .75 * len(x) / max(avg, 1)))

    want = set()
    for qi, text in queries:
        qt = text.split()
        s = {i: round(sum(weight(t, qt) * weight(t, x) for t in set(qt) & set(x)), 9) for i, x in tok.items()}
        best = sorted((i for i in s if s[i] > 0), key=lambda i: (-s[i], i))[:5]
        want |= {(qi, i, r + 1) for r, i in enumerate(best)}
    assert got == want


def test_memory_recall_brute_force(spark):
    mem = [(i, f"title {w}", f"about {w} and {v}") for i, (w, v) in enumerate([("rag", "x"), ("deadline", "rag"), ("slides", "y")])]
    m = spark.createDataFrame(mem, "memory_id int, title string, description string")
    q = spark.createDataFrame([(1, "rag deadline"), (2, "nothing here")], "query_id int, text string")
    got = memory.recall(m, q, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 1), (1, 0)]
    assert got[0].score == pytest.approx(2 / 5 * 10)


def test_duplicates_brute_force(spark):
    g = np.random.default_rng(4)
    rows = [(i, "t" + str(i % 2), "".join(chr(97 + x) for x in g.integers(0, 9, g.integers(3, 14)))) for i in range(80)]
    got = {r.id for r in memory.duplicates(spark.createDataFrame(rows, "id int, title string, content string"), "id").collect()}
    want = set()
    for j, tj, cj in rows:
        for i, ti, ci in rows:
            if i < j and ti == tj and (ci == cj or len(set(ci) & set(cj)) / len(set(ci) | set(cj)) > 0.8):
                want.add(j)
    assert got == want


def test_cache_prefers_exact_and_respects_ttl(spark):
    c = spark.createDataFrame([(1, "old", [1.0, 0.0], 0.0), (2, "new", [0.0, 1.0], 90.0), (3, "new2", [0.0, 1.0], 95.0)], "entry_id int, answer string, embedding array<double>, created_at double")
    c = c.withColumn("query_hash", cache.key(F.when(F.col("entry_id") == 1, "Q one").otherwise("q  TWO")))
    q = spark.createDataFrame([(1, "q one", [1.0, 0.0]), (2, " Q two ", [1.0, 0.0]), (3, "else", [0.1, 1.0])], "query_id int, text string, embedding array<double>")
    got = {r.query_id: (r.cache_type, r.entry_id) for r in cache.lookup(q, c, F.lit(100.0), 50).collect()}
    assert got == {1: ("miss", None), 2: ("exact", 3), 3: ("semantic", 2)}


def test_entity_search_matches_containment(spark):
    names = ["Graph Search", "graph", "ñandú Ñ", "a", "", "deep graphs", "search engine", "x" * 500] + [f"common {i}" for i in range(40)]
    ents = spark.createDataFrame([(f"t/{i}-{n.lower()}", n, "t" if i % 2 else "u", i) for i, n in enumerate(names)], "slug string, display_name string, type string, mention_count long")
    asked = ["graph", "ñ", "a", "ch e", "common", "mmon 39", "zzz", "", None, "xx", "t/1", " Graph Search "]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    for kind in (None, "t"):
        want = set()
        for i, t in enumerate(asked):
            t = (t or "").strip().lower()
            hit = [(n, f"t/{n}-{x.lower()}") for n, x in enumerate(names) if t and (kind is None or n % 2) and (t in x.lower() or t in f"t/{n}-{x.lower()}")]
            want |= {(i, s, n, r + 1) for r, (n, s) in enumerate(sorted(hit, key=lambda h: (-h[0], h[1]))[:5])}
        assert {tuple(r) for r in graph.search_entities(ents, q, 5, kind).collect()} == want
