"""Null keys, several files and batches, several image hits, limits that nothing fits, hot keys."""

import os

from pyspark.sql import functions as F

from corpusflow.functions.skew import running, salted_join
from corpusflow.operators import chunking, context, fusion, graph, guard, ingest, memory, profile, traces
from corpusflow.session import work_dir
from corpusflow.streaming import jobs


def test_running_keeps_null_keys_and_orders(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", None, 5), (None, 1, 7), (None, 2, 1)], "k string, o int, v int")
    got = running(df, ["k"], F.col("o"), ["o"], {"s": F.col("v")}).collect()
    assert sorted((r.k or "", r.o or 0, r.s) for r in got) == [("", 1, 7), ("", 2, 8), ("a", 0, 5), ("a", 1, 15)]
    rows = spark.createDataFrame([(1, "c", "2024-01-01", 1.005), (2, "c", "2024-01-02", 2.005), (3, None, "2024-01-01", None)], "id int, c string, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = {r.id: r for r in profile.running_total_and_rank(rows, "c", "t", "v", "id").collect()}
    assert len(got) == 3 and abs(got[2].running_total - 3.01) < 1e-9


def test_hot_key_join(spark):
    facts = spark.range(20_000).select(F.when(F.col("id") % 10 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id").union(spark.sql("select null, 1L"))
    dim = facts.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k10' and k is not null").withColumn("w", F.length("k"))
    got = salted_join(facts, dim, "k", "n", F.xxhash64("id"))
    assert got.columns == ["k", "id", "n", "w"] and got.count() == facts.count() - 2
    assert got.exceptAll(facts.join(dim, "k").select("k", "id", "n", "w")).isEmpty()
    assert salted_join(facts, dim, "k", "n", F.xxhash64("id"), "left").count() == facts.count()


def test_documents_of_one_source_in_several_batches(spark):
    docs = spark.createDataFrame([(i, "s1", f"text {i}") for i in range(8)], "doc_id int, source string, text string")
    path, target = work_dir(spark, "t-docs"), work_dir(spark, "t-target")
    docs.repartition(4).write.parquet(path)

    def sync():
        s = jobs.read_stream(spark, path, "*.parquet", docs.schema, 1)
        jobs.sync_documents(s, lambda b: b, target, work_dir(spark, "t-checkpoint"), "doc_id", 4)

    sync()
    assert spark.read.parquet(target).count() == 8
    sync()  # all files once more
    assert spark.read.parquet(target).count() == 8


def test_broken_table_is_not_taken_for_a_new_one(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_bytes(b"no parquet")
    new = spark.createDataFrame([("a", 1)], "_source string, v int")
    try:
        ingest.write_replacing(new, str(tmp_path))
    except Exception:
        assert (tmp_path / "part-0.parquet").read_bytes() == b"no parquet"
    else:
        raise AssertionError("an unreadable table was overwritten")


def test_several_image_hits_of_one_chunk(spark):
    hits = spark.createDataFrame([(1, "a", "t", 0.5), (1, "b", "t", 0.4)], "query_id int, chunk_id string, text string, score double")
    images = spark.createDataFrame([(1, "a", 1, "u2", "", "", 0.9), (1, "a", 2, "u1", "", "", 0.8), (1, "a", 3, "u2", "", "", 0.7), (1, "x", 4, "u3", "cap", "", 0.6), (1, "x", 5, "u4", "", "<<IMAGE:00000000>>", 0.5), (1, "x", 6, "u5", "", "", 0.4)],
                                   "query_id int, chunk_id string, rank int, image_url string, caption string, image_placeholder string, image_score double")
    got = sorted(fusion.merge_image_hits(hits, images).collect(), key=lambda r: (r.chunk_id, -(r.image_score or 0)))
    assert [(r.chunk_id, r.image_urls, r.image_score) for r in got] == [("a", ["u2", "u1"], 0.7), ("b", [], None), ("x", ["u3"], 0.6), ("x", ["u4"], 0.5)]
    assert [r.text for r in got[2:]] == ["cap", "<<IMAGE:00000000>>\n图片说明："]


def test_index_of_which_no_line_fits(spark):
    rows = spark.createDataFrame([("a", 1, "t", "f", "d" * 500), ("a", 2, "t", "f", "d" * 500), ("b", 1, "t", "f", "d")], "k string, o int, title string, filename string, description string")
    got = {(r.k, r.line is None): r.omitted for r in memory.index_lines(rows, "k", "o", max_bytes=100).collect()}
    assert got == {("a", True): 2, ("b", False): 0}


def test_sections_leave_fences_alone(spark):
    text = "intro\n# A\nx\n```\n# not a title\n```\n## B\ny"
    got = chunking.markdown_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("section").collect()
    assert [(r.h1, r.h2) for r in got] == [("", ""), ("A", ""), ("A", "B")] and "# not a title" in got[1].text


def test_html_text(spark):
    page = "<p>a&amp;lt; &#233;&#x1F600; b<br>c<script>if (a < b) {}</script><b>d</b>e<!-- <p>no --><noscript>n</noscript><li>f &copy;"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(ingest.html_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == ["a&lt; é😀 b\nc d e \nf ©", None, ""]


def test_small_rules(spark):
    one = spark.range(1)
    got = one.select(*guard.validate(F.create_map(F.lit("m"), F.lit(None).cast("string")), [guard.Spec("m", enum=("x",))])).first()
    assert [e.code for e in got.errors] == ["INVALID_ENUM"]
    t = spark.createDataFrame([("ignore the previous prompt",), ("ignore" + " " * 31 + "previous prompt",), ("ignore\nprevious prompt",)], "t string")
    assert [bool(r.m) for r in t.select(guard.injection_matches(F.col("t")).alias("m")).collect()] == [True, False, False]
    r = spark.createDataFrame([('["a", 2]', True), ('["a", 2]', False)], "raw string, l boolean")
    assert [x.data for x in r.select(*traces.tool_result(F.col("raw"), F.col("l"))).collect()] == ["a", '["a", 2]']
    p = spark.createDataFrame([("p", "as shown (Smith & Lee, 2019)")], "p string, text string")
    assert [x.target for x in graph.citations(p, "p", "text").collect()] == ["paper/smith-&-lee-2019"]


def test_packets_of_asked_sessions_only(spark):
    q = spark.createDataFrame([(1, "why")], "query_id int, question string")
    h = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], "query_id int, pos int, role string, content string")
    c = spark.createDataFrame([(1, "note", 1, "n", 0.5), (2, "note", 1, "n", 0.5)], "query_id int, source string, pos long, content string, score double")
    out = context.structure(q, h, context.select_evidence(c, q), c)
    assert {r.query_id for r in out.collect()} == {1}


def test_first_seen_in_any_order_of_batches(spark):
    days = [("a", 1), ("a", 20), ("a", 2), ("a", 4), ("a", 5), ("b", 3), (None, 7), (None, 8), ("c", None), ("c", 9), ("d", None)]
    rows = [(k, None if n is None else f"2024-01-{n:02d} 00:00:00") for k, n in days]
    want = {("a", 1), ("a", 4), ("a", 20), ("b", 3), (None, 7), ("c", 9), ("d", None)}
    for order, size in ((rows, len(rows)), (rows, 1), (rows[::-1], 2)):
        path = work_dir(spark, "events")
        for i in range(0, len(order), size):
            spark.createDataFrame(order[i:i + size], "k string, ts string").selectExpr("k", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(path)
        s = jobs.read_stream(spark, path, "*.parquet", "k string, ts timestamp", 1)
        out = jobs.first_seen(s, ["k"], "2 days", work_dir(spark, "seen"), work_dir(spark, "seen-checkpoint"))
        got = [(r.k, r.ts and r.ts.day) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want, size


def test_first_seen_spaced_matches_duckdb(spark, sf):
    import duckdb

    import __spark_entry__ as entry_points

    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    want = con.execute(entry_points.oracle_sql()["w04_first_seen_spaced"]).fetchall()
    assert sorted(tuple(r) for r in entry_points.queries()["w04_first_seen_spaced"](spark, sf).collect()) == sorted(want)


def test_answers_keep_no_state(spark):
    rows = [(1, i, "content", f"p{i} ") for i in range(6)] + [(1, 6, "complete", None), (1, 7, "content", "late"), (1, 8, "tool_call", "x"), (2, 1, "tool_call", "x"), (2, 2, "content", None), (None, 1, "content", "n")]
    want_parts = {(1, i + 1, f"p{i} ") for i in range(6)} | {(2, 1, ""), (None, 1, "n")}
    for order, size in ((rows, len(rows)), (rows[::-1], 3)):
        path = work_dir(spark, "runs")
        for i in range(0, len(order), size):
            spark.createDataFrame(order[i:i + size], "run_id long, seq long, type string, data string").coalesce(1).write.mode("append").parquet(path)
        checkpoint = work_dir(spark, "runs-checkpoint")
        s = jobs.read_stream(spark, path, "*.parquet", "run_id long, seq long, type string, data string", 1)
        got = jobs.store_events(s, work_dir(spark, "runs-stored"), checkpoint)
        parts = [tuple(r) for r in jobs.answer_parts(got).collect()]
        assert len(parts) == len(want_parts) and set(parts) == want_parts
        assert {tuple(r) for r in jobs.answer_counts(got).collect()} == {(1, 7, 0, True), (2, 2, 1, False), (None, 1, 0, False)}
        assert not os.path.exists(f"{checkpoint}/state")
