"""File scans: text corpora, listings, evaluation cases, traces, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules


def text_files(spark: SparkSession, path: str, extensions=(".txt", ".text", ".md")) -> DataFrame:
    """(path, raw): one row per text file below a folder; other files are left out by the scan."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, mtime) of the files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def allowed(path: Column, extensions=rules.TEXT_EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(list(extensions))


CASE_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in ("id", "question", "mode", "expected_route", "expected_answer_type", "difficulty", "expected_context_mode")
] + [
    T.StructField(n, T.ArrayType(T.StringType())) for n in ("expected_tools", "expected_keywords", "expected_evidence", "must_include", "must_not_include")
] + [
    T.StructField("expected_tool_args", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
    T.StructField("expected_notes_used", T.BooleanType()),
])
CASE_DEFAULTS = {"id": "", "question": "", "mode": "deep", "expected_route": "deep", "expected_answer_type": "analysis", "difficulty": "medium"}


def evaluation_cases(spark: SparkSession, path: str, legacy: bool = False, multiline: bool = False) -> DataFrame:
    """Cases with defaults for what is missing. ``legacy`` leaves the content checks empty, so that they pass."""
    df = spark.read.schema(CASE_SCHEMA).option("multiLine", multiline).json(path)
    text = {n: F.trim(F.coalesce(F.col(n), F.lit(d))).alias(n) for n, d in CASE_DEFAULTS.items()}
    empty = F.array().cast("array<string>")
    cols = []
    for f in CASE_SCHEMA.fields:
        if f.name in text:
            cols.append(text[f.name])
        elif isinstance(f.dataType, T.ArrayType):
            v = F.coalesce(F.col(f.name), empty)
            cols.append((empty if legacy and f.name.startswith("must") else v).alias(f.name))
        else:
            v = F.lit(None).cast(f.dataType) if legacy and f.name in ("expected_notes_used", "expected_context_mode") else F.col(f.name)
            cols.append(v.alias(f.name))
    return df.select(*cols)


TOOL_CASE_SCHEMA = "id string, tool_name string, args map<string,string>, expect_ok boolean, expected_error_code string, description string"


def tool_cases(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    df = spark.read.schema(TOOL_CASE_SCHEMA).option("multiLine", multiline).json(path)
    s = lambda n: F.trim(F.coalesce(F.col(n), F.lit(""))).alias(n)
    return df.select(s("id"), s("tool_name"), F.coalesce("args", F.create_map().cast("map<string,string>")).alias("args"),
                     F.coalesce("expect_ok", F.lit(True)).alias("expect_ok"), s("expected_error_code"), s("description"))


RUN_SCHEMA = (
    "run_id string, session_id string, route string, question string, status string, started_at string, ended_at string, error string, "
    "steps array<struct<step_id:string,step_name:string,step_type:string,status:string,latency_ms:double,input:string,output:string,error:string>>"
)
SESSION_BUCKETS = 256


def session_bucket(session: Column) -> Column:
    """Partition of a session: a bounded number of folders instead of one per session."""
    return F.pmod(F.xxhash64(session), F.lit(SESSION_BUCKETS)).cast("int")


def write_runs(runs: DataFrame, path: str) -> None:
    runs.withColumn("bucket", session_bucket(F.col("session_id"))).repartition("bucket").write.mode("append").partitionBy("bucket").json(path)


def runs(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Run traces, corrupt lines left out, newest first; one session reads one bucket."""
    df = spark.read.schema(RUN_SCHEMA + ", bucket int, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.where("_corrupt is null and run_id is not null").drop("_corrupt")
    if session_id is not None:
        b = spark.range(1).select(session_bucket(F.lit(session_id))).first()[0]
        df = df.where((F.col("bucket") == b) & (F.col("session_id") == session_id))
    return df.drop("bucket").orderBy(F.desc("started_at"), "run_id")


def reports(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Catalogue of report files: name, time, size, embedded summary; newest first."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("modificationTime").alias("updated_at"), F.col("length").alias("size_bytes"),
        F.from_json(F.get_json_object(F.decode("content", "UTF-8"), "$.summary"), "map<string,string>").alias("summary"),
    ).orderBy(F.desc("updated_at"), "name")


def report_lines(summary: DataFrame, counts: DataFrame, failed: DataFrame) -> DataFrame:
    """Markdown report as ordered lines: totals, failure categories, one line per failed case."""
    s = lambda c: F.col(c).cast("string")
    labels = [("Total Cases", "total_cases"), ("Passed Cases", "passed_cases"), ("Route Accuracy", "route_accuracy"), ("Tool Accuracy", "tool_accuracy"),
              ("Keyword Hit Rate", "keyword_hit_rate"), ("Evidence Hit Rate", "evidence_hit_rate"), ("Avg Latency(ms)", "avg_latency_ms"), ("Avg Score", "avg_score")]
    head = ["# Evaluation Report", "", "## Summary"]
    items = [F.struct(F.lit(i).alias("o"), F.lit(t).alias("line")) for i, t in enumerate(head)]
    items += [F.struct(F.lit(10 + i).alias("o"), F.concat(F.lit(f"- {t}: "), s(c)).alias("line")) for i, (t, c) in enumerate(labels)]
    items += [F.struct(F.lit(30 + i).alias("o"), F.lit(t).alias("line")) for i, t in enumerate(["", "## Failure Categories"])]
    items += [F.struct(F.lit(50 + i).alias("o"), F.lit(t).alias("line")) for i, t in enumerate(["", "## Failed Cases"])]
    a = summary.select(F.inline(F.array(*items))).select("o", F.lit("").alias("k"), "line")
    b = counts.select(F.lit(40).alias("o"), F.col("failure_category").alias("k"), F.concat(F.lit("- "), "failure_category", F.lit(": "), s("n")).alias("line"))
    c = failed.select(F.lit(60).alias("o"), s("case_id").alias("k"), F.concat(
        F.lit("- `"), s("case_id"), F.lit("` | score="), s("score"), F.lit(" | category="), F.col("failure_category"), F.lit(" | reason="), F.col("failure_reason")).alias("line"))
    return a.unionByName(b).unionByName(c)


def write_report(summary: DataFrame, counts: DataFrame, failed: DataFrame, path: str) -> None:
    """JSON results and a Markdown text, both written by the tasks; lines are range-sorted over the parts."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    failed.write.mode("overwrite").json(f"{path}/failed_cases")
    report_lines(summary, counts, failed).orderBy("o", "k").select("line").write.mode("overwrite").text(f"{path}/markdown")


def trajectory_cases(cases: DataFrame) -> DataFrame:
    """Cases as trajectory records: reference answer as JSON text, tags without empty ones.

    ``cases``: id, question, mode, expected_route, expected_tools, expected_tool_args, must_include, expected_keywords, difficulty.
    """
    none = F.create_map().cast("map<string,string>")
    call = F.transform("expected_tools", lambda t: F.to_json(F.struct(
        F.lit("tool_call").alias("type"), t.alias("tool_name"), F.coalesce(F.try_element_at(F.col("expected_tool_args"), t), none).alias("tool_args"))))
    words = F.when(F.size("must_include") > 0, F.col("must_include")).otherwise(F.col("expected_keywords"))
    content = F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.lit("answer"))
    final = F.to_json(F.struct(F.lit("final").alias("type"), content.alias("content")))
    steps = F.concat(F.lit('{"steps":['), F.array_join(F.concat(call, F.array(final)), ","), F.lit('],"success":true}'))
    tags = F.filter(F.array("mode", "expected_route", "id"), lambda t: t.isNotNull() & (t != ""))
    return cases.select(F.lit("agent_trajectory").alias("case_type"), F.col("question").alias("input"), steps.alias("reference_answer"), tags.alias("tags"),
                        "difficulty", F.col("id").alias("source_case_id"))


def material_rows(rows: DataFrame) -> DataFrame:
    """Materials under one spelling: snake or camel keys, tags as a list, the URL as title where there is none.

    ``rows``: session_id and ``entry`` (map of text).
    """
    g = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(F.col("entry"), F.lit(n)), F.lit("")) for n in names])
    clean = lambda *names: F.trim(F.coalesce(g(*names), F.lit("")))
    raw = F.trim(F.coalesce(g("tags"), F.lit("")))
    many = F.from_json(raw, "array<string>")
    tags = F.when(F.startswith(raw, F.lit("[")), F.filter(F.transform(many, lambda t: F.trim(t)), lambda t: t != "")).when(raw != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    title = clean("title")
    return rows.select(
        "session_id", F.coalesce(g("source_type", "sourceType"), F.lit("paste")).alias("source_type"), F.coalesce(g("material_type", "materialType"), F.lit("text")).alias("material_type"),
        F.when(title == "", clean("url")).otherwise(title).alias("title"), clean("content").alias("content"), clean("url").alias("url"),
        clean("file_path", "filePath").alias("file_path"), clean("mime_type", "mimeType").alias("mime_type"), tags.alias("tags"))


def research_branches(queries: DataFrame, as_of_year: int) -> DataFrame:
    """Each query fanned out to the branch templates, with the year from which sources are recent."""
    q = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("研究主题"))
    b = F.array(*[F.struct(F.lit(f"branch_{i + 1}").alias("branch_id"), F.lit(t).alias("t"), F.lit(g).alias("goal")) for i, (t, g) in enumerate(rules.BRANCH_TEMPLATES)])
    return queries.select("query_id", q.alias("_q"), F.inline(b)).select(
        "query_id", "branch_id", F.concat_ws(" ", "_q", "t").alias("branch_query"), F.concat("goal", F.lit("。优先近三年（2024-2026）文献")).alias("branch_goal"),
        F.lit(max(2024, as_of_year - 2)).alias("min_year"))
