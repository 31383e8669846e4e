"""Keywords are counted in place, links and entities combine by hash, entity search asks every word once."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from corpusflow.functions.skew import distinct_top_k
from corpusflow.operators import graph
from corpusflow.plans import catalog_graph


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keywords_leave_no_row(spark):
    t = "beta alpha beta 2024 gamma alpha the zeta 7 Beta"
    p = spark.createDataFrame([(1, t), (2, None), (3, ""), (None, "solo word")], "id long, text string")
    kw = graph.keywords(p, "id", "text", 3)
    assert "Exchange" not in _plan(kw)
    # 2024 is among the best six and drops out, gamma moves up
    assert sorted((r.id or 0, r["rank"], r.term, r.tf) for r in kw.collect()) == [
        (0, 1, "solo", 1), (0, 2, "word", 1), (1, 1, "beta", 3), (1, 2, "alpha", 2), (1, 3, "gamma", 1)]


def test_keywords_of_papers_in_several_rows(spark):
    p = spark.createDataFrame([(1, "red blue blue"), (1, "red red"), (2, "blue green"), (None, "four"), (None, "four five")], "id long, text string")
    got = sorted((r.id or 0, r["rank"], r.term, r.tf) for r in graph.keywords(p, "id", "text").collect())
    assert got == [(0, 1, "four", 2), (0, 2, "five", 1), (1, 1, "red", 3), (1, 2, "blue", 2), (2, 1, "blue", 1), (2, 2, "green", 1)]


def test_equal_links_and_mentions_combine_by_hash(spark):
    links = spark.createDataFrame([("a", "b", "r", "x", "z"), ("a", "b", "r", "w", "z"), ("a", "b", "r", "x", "z"), ("a", "c", "r", "x", "y")], [*graph.LINK_KEY, "from_type", "to_type"])
    up = graph.upsert_links(links)
    assert sorted(map(tuple, up.collect())) == [("a", "b", "r", "w", "z"), ("a", "c", "r", "x", "y")]
    m = spark.createDataFrame([("s", "Late", "k", 2, 9), ("s", "First", "p", 3, 1), ("s", "First", "p", 4, 5), ("t", "T", "k", 1, 2)], "slug string, display_name string, type string, mention_count long, seq long")
    ents = graph.upsert_entities(m)
    assert sorted(map(tuple, ents.collect())) == [("s", "First", "p", 9), ("t", "T", "k", 1)]
    for df, rows in ((up, links), (ents, m)):
        lowest = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x][-1]
        assert "min(from_type" not in lowest and "min_by" not in lowest


def test_smallest_distinct_values_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "3"), ("a", "1"), ("a", "1"), ("a", "2"), ("b", "9")], "k string, v string")
    got = distinct_top_k(df, ["k"], "v", 2)
    assert sorted(map(tuple, got.collect())) == [("a", "1", 1), ("a", "2", 2), ("b", "9", 1)]
    assert "WindowGroupLimit" in _plan(got)


def test_equal_query_texts_are_looked_up_once(spark):
    ents = spark.createDataFrame([("k/alpha", "Alpha", 3), ("k/alps", "Alps", 5), ("k/beta", "beta", 1)], "slug string, display_name string, mention_count long")
    q = spark.createDataFrame([("1/alp", " ALP"), ("2/alp", "alp"), ("3/t", "t"), ("4/none", "zzz"), ("5/", " ")], "query_id string, text string")
    got = graph.search_entities(ents, q, 5)
    assert sorted(map(tuple, got.collect())) == [("1/alp", "k/alpha", 3, 2), ("1/alp", "k/alps", 5, 1), ("2/alp", "k/alpha", 3, 2), ("2/alp", "k/alps", 5, 1), ("3/t", "k/beta", 1, 1)]


def test_every_word_of_a_text_is_asked(spark, sf, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(7, "Año de 3 Áé, de-la\nfin."), (8, "..."), (9, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {tuple(r) for r in catalog_graph._word_queries(spark, d).collect()}
    assert got == {(f"7/{w}", w) for w in ("año", "de", "áé", "la", "fin")}
    asked = {r.query_id.split("/")[0] for r in entry_points.queries()["e13_entity_search"](spark, sf).select("query_id").distinct().collect()}
    assert len(asked) > 1
    assert spark.read.parquet(f"{sf}/benchmark.parquet").where(F.length("text") > 0).count() >= len(asked)
