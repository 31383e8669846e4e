"""Run traces: roll-ups, token accounting, redaction, replay, checkpoints, event routing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import first_per_key, running

# spans: run_id, seq, step_name, step_type, status, latency_ms, output (JSON text), error


def is_tool() -> Column:
    n = F.col("step_name")
    return F.col("step_type").isin("tool", "mcp_tool") | F.startswith(n, F.lit("tool:")) | F.startswith(n, F.lit("mcp:"))


def is_remote_tool() -> Column:
    return (F.col("step_type") == "mcp_tool") | F.startswith("step_name", F.lit("mcp:"))


def run_summary(spans: DataFrame) -> DataFrame:
    """Counts and latency per run. The step names behind the counts are rows of :func:`noted_steps`."""
    code = F.get_json_object("output", "$.error_code")
    return spans.groupBy("run_id").agg(
        F.count("*").alias("step_count"), F.count_if(F.col("status") == "failed").alias("failed_steps"), F.count_if(is_tool()).alias("tool_steps"),
        F.count_if(is_remote_tool()).alias("remote_tool_steps"), F.count_if(F.coalesce(code, F.lit("")) != "").alias("error_codes"),
        F.coalesce(F.sum(F.floor("latency_ms")), F.lit(0)).alias("total_latency_ms"))


def noted_steps(spans: DataFrame) -> DataFrame:
    """(run_id, seq, list, value): failed, tool and remote steps and error codes in step order, as rows."""
    code = F.get_json_object("output", "$.error_code")
    cell = lambda cond, name, v: F.when(cond, F.struct(F.lit(name).alias("list"), v.alias("value")))
    cells = F.array_compact(F.array(
        cell(F.col("status") == "failed", "failed_steps", F.col("step_name")), cell(is_tool(), "tool_steps", F.col("step_name")),
        cell(is_remote_tool(), "remote_tool_steps", F.col("step_name")), cell(F.coalesce(code, F.lit("")) != "", "error_codes", code)))
    return spans.select("run_id", "seq", F.inline_outer(cells)).where("list is not null")


# ---- nested payloads -----------------------------------------------------------------

_FOUND = T.StructType([T.StructField("error_codes", T.ArrayType(T.StringType())), T.StructField("total_tokens", T.LongType())])


def _number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _walk(v, codes):
    """Tokens below a value; error codes are added to ``codes`` on the way."""
    if isinstance(v, list):
        return sum(_walk(x, codes) for x in v)
    if not isinstance(v, dict):
        return 0
    if v.get("error_code"):
        codes.append(str(v["error_code"]))
    below = sum(_walk(x, codes) for x in v.values())
    usage = v.get("token_usage")
    if isinstance(usage, dict):
        parts = [usage.get(k) for k in ("prompt_tokens", "completion_tokens")]
        if _number(usage.get("total_tokens")):
            return int(usage["total_tokens"])
        if any(_number(p) for p in parts):
            return sum(int(p or 0) for p in parts)
    return int(v["total_tokens"]) if _number(v.get("total_tokens")) else below


@F.pandas_udf(_FOUND)
def nested_facts(payload: pd.Series) -> pd.DataFrame:
    """Error codes (distinct, in order) and token total at any depth of a JSON text."""
    rows = []
    for p in payload:
        codes = []
        try:
            total = _walk(json.loads(p), codes) if p else 0
        except ValueError:
            total = 0
        rows.append((list(dict.fromkeys(codes)), total))
    return pd.DataFrame(rows, columns=["error_codes", "total_tokens"])


def _hide(v):
    if isinstance(v, dict):
        return {k: "***" if any(s in k.lower() for s in rules.SENSITIVE_KEYS) else _hide(x) for k, x in v.items()}
    return [_hide(x) for x in v] if isinstance(v, list) else v


@F.pandas_udf(T.StringType())
def redact_json(payload: pd.Series) -> pd.Series:
    """JSON text with the values of sensitive keys hidden at any depth."""
    def one(p):
        try:
            return json.dumps(_hide(json.loads(p)), ensure_ascii=False, separators=(",", ":")) if p else p
        except ValueError:
            return p

    return payload.map(one)


def redact_map(m: Column) -> Column:
    """The same for a flat map, in the JVM."""
    return F.transform_values(m, lambda k, v: F.when(tx.contains_any(F.lower(k), rules.SENSITIVE_KEYS), "***").otherwise(v))


# ---- tokens ------------------------------------------------------------------------


def token_usage(payload: Column, source: Column) -> Column:
    """Prompt, completion and total tokens by alias names; null when none is given."""
    pick = lambda names: F.coalesce(*[F.get_json_object(payload, f"$.{n}").try_cast("bigint") for n in names])
    p, c = pick(rules.PROMPT_TOKEN_NAMES), pick(rules.COMPLETION_TOKEN_NAMES)
    zero = F.lit(0).cast("long")
    t = F.coalesce(pick(rules.TOTAL_TOKEN_NAMES), F.when(p.isNotNull() | c.isNotNull(), F.coalesce(p, zero) + F.coalesce(c, zero)))
    return F.when(t.isNotNull(), F.struct(
        F.coalesce(p, zero).alias("prompt_tokens"), F.coalesce(c, zero).alias("completion_tokens"), t.alias("total_tokens"),
        F.lit(False).alias("estimated"), source.alias("source")))


def usage_per_run(messages: DataFrame) -> DataFrame:
    """Usage of the last message that has any, else an estimate from characters.

    ``messages``: run_id, seq, role, content, usage (JSON text).
    """
    u = token_usage(F.col("usage"), F.lit("model_usage_metadata"))
    answer = F.col("role") == "answer"
    n = tx.rough_tokens(F.coalesce("content", F.lit("")))
    m = messages.withColumns({"_u": u, "_n": n, "_a": answer}).groupBy("run_id").agg(
        F.max_by("_u", F.when(F.col("_u").isNotNull(), F.col("seq"))).alias("u"),
        F.sum(F.when(~F.col("_a"), F.col("_n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("_a"), F.col("_n")).otherwise(0)).alias("c"))
    est = F.struct(F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"), (F.col("p") + F.col("c")).alias("total_tokens"),
                   F.lit(True).alias("estimated"), F.lit("char_estimate").alias("source"))
    return m.select("run_id", F.coalesce("u", est).alias("u")).select("run_id", "u.*")


def totals(spans: DataFrame) -> DataFrame:
    return spans.agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("total_tokens"), F.round(F.sum(F.coalesce("latency_ms", F.lit(0))), 2).alias("total_latency_ms"))


# ---- replay and pairing -----------------------------------------------------------------


def replay(runs: DataFrame, spans: DataFrame, slice_: Column) -> DataFrame:
    """Header, numbered steps and run totals side by side; a step is a row, so runs may be of any length."""
    numbered = running(spans, ["run_id"], slice_, ["seq"], {"step_no": F.lit(1)})
    return numbered.join(runs, "run_id").join(run_summary(spans), "run_id")


def step_latency(opened: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end rows of a step paired by id: milliseconds and status (running when not closed)."""
    j = opened.join(closed.select(*keys, F.col("at").alias("_end"), F.col("status").alias("_status")), keys, "left")
    ms = (F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1000
    return j.select(*keys, F.round(ms, 3).alias("latency_ms"), F.coalesce("_status", F.lit("running")).alias("status"))


def tool_output(payload: Column) -> list[Column]:
    """Summary columns of a tool result in JSON."""
    g = lambda p: F.get_json_object(payload, p)
    yes = lambda p: F.coalesce(g(p) == "true", F.lit(False))
    s = lambda p, n: F.coalesce(g(p), F.lit("")).alias(n)
    return [yes("$.ok").alias("ok"), s("$.summary", "summary"), s("$.error", "error"), s("$.error_code", "error_code"),
            F.coalesce(F.length(g("$.data")), F.lit(0)).alias("data_size"), yes("$.truncated").alias("truncated"),
            F.coalesce(g("$.truncated_from").try_cast("int"), F.lit(0)).alias("truncated_from")]


def tool_result(raw: Column, is_list: Column | None = None) -> list[Column]:
    """Any raw result as ok flag and data: objects with ``ok`` as they are, lists by their first item, text as text.

    A text is parsed only where it begins with a brace; ``is_list`` marks results that came as lists, not as texts.
    """
    t = tx.strip(F.coalesce(raw, F.lit("")))
    v = F.try_parse_json(t)
    kind = F.when(v.isNotNull(), F.substring(F.schema_of_variant(v), 1, 5))
    obj = (kind == "OBJEC") & F.startswith(t, F.lit("{"))
    has_ok = obj & F.get_json_object(t, "$.ok").isNotNull()
    lst = (kind == "ARRAY") & F.coalesce(is_list, F.lit(False)) if is_list is not None else F.lit(False)
    ok = F.when(has_ok, F.get_json_object(t, "$.ok") == "true").otherwise(True)
    data = tx.first_match([(has_ok, F.coalesce(F.get_json_object(t, "$.data"), F.lit(""))), (obj, t), (lst, F.coalesce(F.get_json_object(t, "$[0]"), F.lit("")))],
                          F.coalesce(raw, F.lit("")))
    return [F.coalesce(ok, F.lit(True)).alias("ok"), data.alias("data")]


def distinct_tools(calls: DataFrame, run: str = "run_id", seq: str = "seq", name: str = "name") -> DataFrame:
    """(run, name, first): the tools of a run, ``first`` gives their order of appearance."""
    return calls.groupBy(run, F.coalesce(F.col(name), F.lit("unknown")).alias("name")).agg(F.min(seq).alias("first"))


def resume_points(checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Latest checkpoint, step to resume from and progress per workflow."""
    last = F.max(F.struct("step_index", "seq", "step_name", "status", "error"))
    g = checkpoints.groupBy(*keys).agg(last.alias("l"), F.count_if(F.col("status") == "completed").alias("completed_steps"),
                                       F.count_if(F.col("status") == "failed").alias("failed_steps"), F.count("*").alias("total_steps"))
    st = F.col("l.status")
    return g.select(*keys, st.alias("status"), "completed_steps", "failed_steps", "total_steps", F.col("l.step_index").alias("latest_step"),
                    F.col("l.step_name").alias("latest_step_name"), F.coalesce("l.error", F.lit("")).alias("error"), st.isin("failed", "in_progress").alias("can_resume"),
                    F.when(st == "completed", F.col("l.step_index") + 1).otherwise(F.col("l.step_index")).alias("resume_step"))


def route_events(messages: DataFrame) -> DataFrame:
    """Message rows to stream events: one tool_call per call, else debug or content by role, node and name.

    ``messages``: session_id, seq, role, node, name, content, tool_calls array<struct<id, name, args>>.
    """
    text = tx.strip(F.coalesce("content", F.lit("")))
    calls = (F.col("role") == "assistant") & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)
    ev = lambda ty, data: F.struct(ty.alias("type"), data.alias("data"))
    internal = F.col("node").isin(*rules.DEBUG_NODES) | F.col("name").isin(*rules.DEBUG_NAMES)
    none = F.array().cast("array<struct<type:string,data:string>>")
    events = tx.first_match([
        (calls, F.transform("tool_calls", lambda c: ev(F.lit("tool_call"), F.coalesce(c["name"], F.lit("unknown"))))),
        (F.col("role").isin("tool", "user"), none),
        ((F.col("role") == "assistant") & (text == ""), none),
        ((F.col("role") == "assistant") & internal, F.array(ev(F.lit("debug"), text))),
        (F.col("role") == "assistant", F.array(ev(F.lit("content"), text)))], F.array(ev(F.lit("debug"), text)))
    return messages.select("session_id", "seq", "node", F.inline_outer(events)).where("type is not null")


def assemble_stream(events: DataFrame, slice_size: int = 256) -> DataFrame:
    """Answer text and event counts per run up to its first ``complete`` event.

    Content parts are joined slice by slice before they meet, so the last step handles few long pieces.
    """
    done = events.where("type = 'complete'").groupBy("run_id").agg(F.min("seq").alias("_end"))
    e = events.join(done, "run_id", "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    part = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda s: s["d"]), "")
    content = F.when(F.col("type") == "content", F.struct(F.col("seq").alias("o"), F.coalesce("data", F.lit("")).alias("d")))
    sl = e.groupBy("run_id", F.floor(F.col("seq") / slice_size).alias("_s")).agg(
        part(content).alias("d"), F.count("*").alias("n"), F.count_if(F.col("type") == "tool_call").alias("t"))
    return sl.groupBy("run_id").agg(tx.strip(part(F.struct(F.col("_s").alias("o"), F.col("d")))).alias("answer"), F.sum("n").alias("event_count"), F.sum("t").alias("tool_event_count"))
