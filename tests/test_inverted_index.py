from pyspark.sql import functions as F

from corpusflow.operators import papers


def test_an_index_is_made_in_its_row(spark):
    df = spark.createDataFrame([(1, "de", " b  a\tb\n"), (2, None, ""), (3, "en", None), (4, "en", "x"), (4, "fr", "y x"), (None, "fr", "z")], "id long, lang string, text string")
    got = papers.inverted_index(df, "id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(0, "fr", {"z": [0]}, "z"), (1, "de", {"b": [0, 2], "a": [1]}, "b a b"), (2, "", {}, ""), (3, "en", None, None), (4, "en", {"x": [0]}, "x"), (4, "fr", {"y": [0], "x": [1]}, "y x")]
    rows = got.withColumn("back", papers.abstract_from_index(F.col("index"))).collect()
    assert sorted(((r.id or 0, r.lang or "", r["index"], r.back) for r in rows), key=lambda r: r[:2]) == want
