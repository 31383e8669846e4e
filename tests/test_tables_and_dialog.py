import json

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.skew import running, salted_join
from corpusflow.operators import conversation, evaluate, graph, guard, ingest, memory, profile, ranking, traces
from corpusflow.session import work_dir
from corpusflow.sources import files, payloads, tables

CALLS = "array<struct<id:string,name:string,args:string>>"
MSG = f"session_id int, seq int, role string, content string, tool_name string, tool_call_id string, tool_calls {CALLS}"


def messages(spark, rows):
    return spark.createDataFrame([(1, i, r, c, "t" if r == "tool" else "", tid, [(k, "search", "x" * 200) for k in ids]) for i, (r, c, tid, ids) in enumerate(rows)], MSG)


def test_running_equals_one_window(spark):
    rows = [(i % 3, i, (i * 7) % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    for reverse in (False, True):
        r = running(df, ["k"], F.floor(F.col("o") / 16), [F.desc("o") if reverse else "o"], {"s": F.col("v"), "n": F.lit(1)}, reverse=reverse)
        for x in r.collect():
            before = [v for k, o, v in rows if k == x.k and (o >= x.o if reverse else o <= x.o)]
            assert (x.s, x.n) == (sum(before), len(before))


def test_salted_join_with_a_hot_key(spark):
    facts = spark.range(40_000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50 + 1).alias("k"), "id")
    dim = facts.groupBy("k").agg(F.count("*").alias("w"))
    got = salted_join(facts, dim, "k", "w", F.xxhash64("id"))
    assert got.count() == 40_000 and got.groupBy("k", "w").count().where("count <> w").count() == 0


def test_prune_and_orphans(spark):
    m = messages(spark, [("user", "q", "", []), ("assistant", "", "", ["a"]), ("tool", "big ERROR text", "a", []), ("assistant", "", "", ["b"]), ("tool", "big ERROR text", "b", []),
                         ("assistant", "", "", ["c"]), ("tool", "last", "c", []), ("tool", "orphan", "zz", [])])
    p = {r.seq: r for r in conversation.prune_tools(m).collect()}
    assert 4 not in p and p[2].content.startswith("[t] ERROR | 14 chars") and p[6].content == "last"
    assert len(p[1].tool_calls[0].args) == 120 and len(p[5].tool_calls[0].args) == 200
    o = {r.seq for r in conversation.remove_orphans(m.where("seq <> 4")).collect()}
    assert o == {0, 1, 2, 5, 6}


def test_zones_keep_last_message_and_align(spark):
    m = messages(spark, [("user", "q" * 20, "", []), ("assistant", "a" * 20, "", []), ("assistant", "", "", ["h"]), ("tool", "r" * 20, "h", []), ("user", "u" * 20, "", []),
                         ("assistant", "", "", ["x"]), ("tool", "t" * 200, "x", [])])
    z = {r.seq: r.zone for r in conversation.align_pairs(conversation.zones(m, 3, 10)).collect()}
    assert z == {0: "head", 1: "head", 2: "head", 3: "head", 4: "middle", 5: "tail", 6: "tail"}


def test_memory_gates(spark):
    rows = [("ok thanks a lot", "x", True), ("this history matters", "x", False), ("short", "x", True), ("好的，我知道这个安排了吗", "x", True), ("好的人都在这里工作并且学习", "x", False)]
    df = spark.createDataFrame(rows, "u string, a string, want boolean")
    assert all(r.low == r.want for r in df.select(memory.is_low_value(F.col("u")).alias("low"), "want").collect())
    t = spark.createDataFrame([("Please don't do that", ""), ("I prefer short answers", ""), ("The deadline is near", ""), ("nothing special", "")], "u string, a string")
    assert [r[0] for r in t.select(memory.memory_type(F.col("u"), F.col("a"))).collect()] == ["feedback", "user", "project", "project"]


def test_note_replay_and_frontmatter(spark):
    log = spark.createDataFrame([(1, "add", 1, "a", "x", 1), (1, "update", 2, None, "y", 2), (2, "add", 1, "b", "z", 1), (2, "delete", 3, None, None, 3)],
                                "note_id int, op string, seq int, title string, content string, created_at int")
    r = memory.replay_notes(log).collect()
    assert [(x.note_id, x.title, x.content, x.created_at) for x in r] == [(1, "a", "y", 1)]
    f = spark.createDataFrame([("---\nname: N\ndescription: D: x\ntype: User\n---\n\nbody --- more",), ("no",), ("---\nname: N\ndescription: D\ntype: bad\n---\nb",)], "raw string")
    got = memory.parse_frontmatter(f).collect()
    assert [(x.name, x.description, x.type, x.content) for x in got] == [("N", "D: x", "user", "body --- more")]


def test_entity_upsert_and_hops(spark):
    L = "from_entity string, to_entity string, relation string, from_type string, to_type string"
    links = spark.createDataFrame([("p1", "k1", "has_keyword", "paper", "keyword"), ("p2", "k2", "has_keyword", "paper", "keyword"), ("p3", "k2", "has_keyword", "paper", "keyword"),
                                   ("k1", "k2", "co_occurs", "keyword", "keyword"), ("k1", "p9", "x", "keyword", "paper")], L)
    r = graph.related_papers(links, 2).where("slug = 'k1'").orderBy("rank").collect()
    assert [x.paper for x in r] == ["p1", "p2"]
    assert {x.paper for x in graph.related_papers(links, 9).where("slug = 'k1'").collect()} == {"p1", "p2", "p3", "p9"}


def test_prefer_recent_drops_filter_only_when_empty(spark):
    p = spark.createDataFrame([(1, 1, "2019", 5), (1, 2, "2024", 1), (2, 3, "2018", 9), (2, 4, "bad", 1)], "query_id int, paper_id int, year string, citation_count int")
    got = ranking.prefer_recent(p, 5, 2020).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.paper_id) for r in got] == [(1, 2), (2, 3), (2, 4)]


def test_failure_rules_and_empty_summary(spark):
    s = evaluate.summarize(spark.createDataFrame([], "score double, route_correct boolean, tool_correct boolean, tool_args_correct boolean, keyword_hit boolean, evidence_hit boolean, latency_ms double")).first()
    assert s.total_cases == 0 and s.avg_score == 0.0
    p = spark.createDataFrame([], "should_trigger boolean, triggers int, runs int")
    r = evaluate.precision_recall(p).first()
    assert (r.precision, r.recall, r.accuracy) == (1.0, 1.0, 0.0)


def test_validate_records(spark):
    df = spark.createDataFrame([({"n": "five"},), ({"n": "7", "x": "1"},), ({"n": "99"},), ({},)], "a map<string,string>")
    specs = [guard.Spec("n", "bigint", required=True, lo=1, hi=10), guard.Spec("flag", "boolean", required=True, default="true")]
    got = [([(e.field, e.code) for e in r.errors], r.coerced) for r in df.select(*guard.validate(F.col("a"), specs)).collect()]
    assert got == [([("n", "WRONG_TYPE")], {"flag": "true"}), ([("x", "UNKNOWN_FIELD")], {"n": "7", "flag": "true"}), ([("n", "OUT_OF_RANGE")], {"flag": "true"}), ([("n", "MISSING")], {"flag": "true"})]


def test_numeric_summary_matches_exact_quantiles(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 1000.0, None]
    r = profile.numeric_summary(spark.createDataFrame([(v,) for v in vals], "v double"), slices=7).first()
    assert (r.n, r.nulls, r.q25, r.median, r.q75) == (6, 1, 2.0, 2.5, 8.25)


def test_names_and_sql_hint(spark):
    assert tables.distinct_names(["1 a", "1_a", "b"]) == {"1 a": "t_1_a", "1_a": "t_1_a_1", "b": "b"}
    names = tables.register(spark, {"my data": spark.range(3)})
    assert tables.run_sql(spark, 'select count(*) as n from "my data"', names).first().n == 3
    with pytest.raises(tables.QueryError, match="id bigint"):
        tables.run_sql(spark, 'select nope from "my data"', names)


def test_export_formats(spark):
    df = spark.createDataFrame([(1, "a|b", bytearray(b"\x01\xff"))], "i int, s string, b binary")
    for fmt in ("csv", "json", "md"):
        path = work_dir(spark, fmt)
        tables.export(df, path, fmt)
        text = "\n".join(r.value for r in spark.read.option("recursiveFileLookup", True).text(path).collect())
        assert "01ff" in text
        assert fmt != "md" or "| 1 | a\\|b | 01ff |" in text


def test_replace_by_source_is_repeatable(spark):
    path = work_dir(spark, "chunks")
    row = lambda s, v: spark.createDataFrame([(s, v)], "_source string, v int")
    ingest.write_replacing(row("a", 1).unionByName(row("b", 2)), path, buckets=4)
    for _ in range(2):
        ingest.write_replacing(row("a", 3), path, buckets=4)
    assert sorted((r._source, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_coverage_is_fatal_when_strict(spark):
    p = spark.createDataFrame([("x",)], "placeholder string")
    none = spark.createDataFrame([], "placeholder string, caption string")
    assert ingest.image_coverage(p, none, none).first().with_neither == 1
    with pytest.raises(Exception, match="placeholder without"):
        ingest.image_coverage(p, none, none, strict=True).collect()


def test_nested_json(spark):
    j = json.dumps({"a": {"Token_X": 1, "error_code": "E"}, "b": [{"token_usage": {"prompt_tokens": 2, "completion_tokens": 3}}, {"total_tokens": 4}]})
    r = spark.createDataFrame([(j,), ("not json",)], "j string").select(traces.nested_facts("j").alias("f"), traces.redact_json("j").alias("r")).collect()
    assert r[0].f.error_codes == ["E"] and r[0].f.total_tokens == 9 and json.loads(r[0].r)["a"]["Token_X"] == "***"
    assert r[1].f.total_tokens == 0 and r[1].r == "not json"


def test_cases_and_runs(spark, tmp_path):
    p = tmp_path / "cases.json"
    p.write_text(json.dumps([{"id": " c1 ", "question": "q", "must_include": ["x"], "expected_tool_args": {"s": {"q": "v"}}}]))
    c = files.evaluation_cases(spark, str(p), multiline=True).first()
    assert (c.id, c.mode, c.must_include, c.expected_tool_args["s"]["q"]) == ("c1", "deep", ["x"], "v")
    assert files.evaluation_cases(spark, str(p), legacy=True, multiline=True).first().must_include == []
    path = work_dir(spark, "runs")
    files.write_runs(spark.createDataFrame([("r1", "s1", "2024-01-01"), ("r2", "s1", "2024-01-02"), ("r3", "s2", "2024-01-03")], "run_id string, session_id string, started_at string"), path)
    assert [r.run_id for r in files.runs(spark, path, "s1").collect()] == ["r2", "r1"]


def test_fallback_chain(spark):
    f = lambda rows: spark.createDataFrame(rows, "query_id int, v string")
    got = payloads.fallback_chain(f([(1, "a")]), f([(1, "b"), (2, "b")]), f([(2, "c"), (3, "c")]))
    assert sorted((r.query_id, r.v) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]
