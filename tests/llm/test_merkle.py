"""Merkle manifest: against a plain tree in memory, several stages of superblocks, odd rows, the query against its twin."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import catalog_llm, merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append(nodes[at ^ 1] if at ^ 1 < len(nodes) else None)
        at //= 2
    return out


def fold(h, way, at):
    for s in way:
        h = digest(h if s is None else s + h if at & 1 else h + s)
        at //= 2
    return h


def plain(rows):
    """The manifest of (doc_id, source, lang, n_chars, text) rows, in memory."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    groups = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in groups:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[g] = climb([leaf(r) for r in trees[g]])
    top = climb([built[g][-1][0] for g in groups])
    out = []
    for j, g in enumerate(groups):
        for i, r in enumerate(trees[g]):
            seen = leaf(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                seen = leaf((*r[:3], r[3] + 1, r[4]))
            low, high = siblings(built[g], i), siblings(top, j)
            end = fold(fold(seen, low, i), high, j)
            out.append((r[0], leaf(r), built[g][-1][0], top[-1][0], digest("".join(x for x in low + high if x)), end, end == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("height", [1, 2, 5])
def test_stages(documents, height):
    """Superblocks of two to thirty-two nodes, so trees of several stages, and 23 groups."""
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 31 < 23, F.concat(F.lit("é"), (F.col("doc_id") % 31 % 23).cast("string"))))
    got = merkle.manifest(docs, altered=merkle.one_more_character(), height=height)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows_of(docs))


def test_odd_rows(odd, empty, spark):
    docs = odd.unionByName(odd.limit(4)).withColumn("n_chars", F.when(F.col("doc_id") == 4, F.lit(2 ** 63 - 1)).otherwise(F.col("n_chars")))
    got = merkle.manifest(docs, altered=merkle.one_more_character(), height=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows_of(docs))
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(odd.where("doc_id = 5")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == digest("") and one["verified"]
    big = spark.createDataFrame([(None, "a"), (2 ** 62 + 1, "b"), (2 ** 62 + 3, "c")], "doc_id long, lang string")
    assert {r["doc_id"] for r in merkle.manifest(big.withColumn("lang", F.lit("x")), columns=("doc_id", "lang")).collect()} == {None, 2 ** 62 + 1, 2 ** 62 + 3}


def test_paths_prove_rows(documents):
    for r in merkle.manifest(documents, with_path=True, height=3).collect():
        way = merkle.unpack_path(bytes(r["path"]))
        assert merkle.fold(r["leaf"], way) == r["root"] == r["folded_root"]
        assert merkle.fold(digest("other"), way) != r["root"]


def test_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    name = "op11_superblock_manifest"
    got = catalog_llm.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog_llm.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
