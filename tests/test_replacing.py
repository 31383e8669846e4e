"""Replaced sources: stored rows aren't shuffled to tell which of them go."""

from pyspark.sql import functions as F

from corpusflow.operators import ingest


def test_rows_of_other_sources_stay_without_a_shuffle(spark, monkeypatch):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("s"), F.col("id") % 100)).alias("s"), F.col("id").alias("v"))
    gone = spark.createDataFrame([("s7",), ("s13",), (None,), ("other",)], "s string")
    for bits in (ingest.GONE_BITS, 3):  # with three places most names that stay share one with a gone name
        monkeypatch.setattr(ingest, "GONE_BITS", bits)
        got = ingest.without_sources(rows, gone, "s")
        assert sorted(r.v for r in got.collect()) == [i for i in range(1000) if i % 10 and i % 100 not in (7, 13)]
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_placed_rows_replace_like_others(spark, tmp_path):
    docs = spark.range(60).select(F.concat(F.lit("f"), "id").alias("f"), "id")
    names = [*(f"f{i}" for i in range(60)), None]
    docs = docs.unionByName(spark.createDataFrame([(None, 60)], "f string, id long"))
    dealt = ingest.dealt(docs, "f", 4)
    made = lambda rows, v: rows.select("f", "id", F.explode(F.sequence(F.lit(1), F.lit(v + 1))).alias("n"), F.lit(v).alias("v"))
    a, b = str(tmp_path / "placed"), str(tmp_path / "shuffled")
    for path, rows, placed in ((a, dealt, True), (b, docs, False)):
        ingest.write_replacing(made(rows, 1), path, "f", 4, placed=placed)
        ingest.write_replacing(made(rows.where("id % 3 = 0"), 2), path, "f", 4, placed=placed)
    want = sorted((i, n, 2 if i % 3 == 0 else 1) for i in range(61) for n in range(1, (3 if i % 3 == 0 else 2) + 1))
    for path in (a, b):
        got = spark.read.parquet(path)
        assert sorted((r.id, r.n, r.v) for r in got.collect()) == want
        assert {r.id: r.f for r in got.collect()} == dict(enumerate(names))
        assert got.select("f", "_source_bucket").distinct().count() == 61
