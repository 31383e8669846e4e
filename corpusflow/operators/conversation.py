"""Conversation tables: turns, token totals, zones, pruning, summaries, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.functions import text as tx
from corpusflow.functions.skew import first_per_key, running, top_k

SLICE = 4096


def _slice(seq: str) -> Column:
    return F.floor(F.col(seq) / SLICE)


def turn_numbers(messages: DataFrame, session: str, seq: str) -> DataFrame:
    """User messages with the number of user turns so far."""
    r = running(messages.select(session, seq, "role"), [session], _slice(seq), [seq], {"turn_number": (F.col("role") == "user").cast("long")})
    return r.where("role = 'user'")


# ---- tokens ------------------------------------------------------------------
# messages: session_id, seq, role (user/assistant/system/tool), content, tool_name, tool_call_id,
# tool_calls array<struct<id, name, args>> with args as JSON text


def message_tokens() -> Column:
    calls = F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,args:string>>"))
    extra = F.aggregate(calls, F.lit(0).cast("long"), lambda s, c: s + tx.rough_tokens(c["args"]) + tx.rough_tokens(c["name"]))
    return tx.rough_tokens(F.col("content")) + extra


def session_tokens(messages: DataFrame, window: int = 32000, ratio: float = 0.5) -> DataFrame:
    """Token total per session and whether it is large enough to compress."""
    trigger = max(1, int(window * ratio))
    t = messages.groupBy("session_id").agg(F.sum(message_tokens()).alias("tokens"), F.count("*").alias("n_messages"))
    return t.withColumn("triggered", F.col("tokens") >= trigger)


# ---- pruning -----------------------------------------------------------------


def tool_summary() -> Column:
    """One line for a tool result: name, status, size, start of the text."""
    c, low = F.coalesce("content", F.lit("")), F.lower(F.coalesce("content", F.lit("")))
    status = F.when(tx.contains_any(low, ("error", "exception")), "ERROR").when(tx.contains_any(low, ("failed", "timeout")), "FAILED").otherwise("ok")
    start = tx.strip(F.replace(F.left(c, F.lit(80)), F.lit("\n"), F.lit(" ")))
    start = F.concat(start, F.when(F.length(c) > 80, "...").otherwise(""))
    name = F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.lit("tool"))
    return F.concat(F.lit("["), name, F.lit("] "), status, F.lit(" | "), F.length(c).cast("string"), F.lit(" chars | "), start)


def _has_calls() -> Column:
    return F.coalesce(F.size("tool_calls"), F.lit(0)) > 0


def prune_tools(messages: DataFrame, arg_max: int = 120) -> DataFrame:
    """Keep the last tool round; older results become one line each, repeated ones go, long arguments are cut.

    The last round per session is an aggregate; duplicates are found by hash with an aggregate as well.
    """
    last = messages.where(_has_calls()).groupBy("session_id").agg(
        F.max("seq").alias("_last"), F.max_by(F.transform("tool_calls", lambda c: c["id"]), "seq").alias("_ids"))
    m = messages.join(last, "session_id", "left")
    old_tool = (F.col("role") == "tool") & F.col("_last").isNotNull() & ~F.coalesce(F.array_contains("_ids", F.col("tool_call_id")), F.lit(False))
    cut = lambda s: F.when(F.length(s) > arg_max, F.concat(F.left(s, F.lit(arg_max - 3)), F.lit("..."))).otherwise(s)
    args = F.transform("tool_calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), cut(c["args"]).alias("args")))
    m = m.withColumn("_old", old_tool).withColumn(
        "tool_calls", F.when(_has_calls() & (F.col("seq") < F.col("_last")), args).otherwise(F.col("tool_calls")))
    keep = m.where("not _old").drop("_last", "_ids", "_old")
    cols = keep.columns
    old = m.where("_old").withColumn("_h", F.md5(F.coalesce("content", F.lit(""))))
    first = first_per_key(old.select("seq", *[c for c in cols if c != "seq"], "_h"), [F.col("session_id").alias("_s"), F.col("_h").alias("_k")], ["seq"])
    return keep.unionByName(first.withColumn("content", tool_summary()).select(*cols))


# ---- zones -------------------------------------------------------------------


def zones(messages: DataFrame, head: int = 3, tail_tokens: int = 20000) -> DataFrame:
    """Zone of every message: the first ``head``, a tail that fits the budget, the middle between.

    The last message always belongs to the tail. Both running values are built in slices of ``seq``.
    """
    t = messages.withColumn("tokens", message_tokens())
    t = running(t, ["session_id"], _slice("seq"), ["seq"], {"_no": F.lit(1)})
    t = running(t, ["session_id"], _slice("seq"), [F.desc("seq")], {"_back": F.col("tokens"), "_rno": F.lit(1)}, reverse=True)
    z = F.when(F.col("_no") <= head, "head").when((F.col("_back") <= tail_tokens) | (F.col("_rno") == 1), "tail").otherwise("middle")
    return t.withColumn("zone", z).drop("_no", "_back", "_rno")


def align_pairs(zoned: DataFrame) -> DataFrame:
    """Move call and result partners to the same side of a zone boundary."""
    call_ids = F.transform("tool_calls", lambda c: c["id"])
    z = F.col("zone")
    facts = zoned.groupBy("session_id").agg(
        F.min_by(F.struct("role", "tool_call_id"), F.when(z == "tail", F.col("seq"))).alias("_t0"),
        F.max_by(F.struct(F.col("seq").alias("s"), call_ids.alias("ids")), F.when(z == "head", F.col("seq"))).alias("_h1"),
        F.max(F.when((z == "middle") & (F.col("role") == "assistant") & _has_calls(), F.col("seq"))).alias("_m1"))
    orphan = facts.where("_t0.role = 'tool' and _t0.tool_call_id <> ''").select("session_id", F.col("_t0.tool_call_id").alias("_id"), "_m1")
    calls = zoned.where((z == "tail") & (F.col("role") == "assistant")).select("session_id", F.explode(call_ids).alias("_id"))
    pull = orphan.join(calls, ["session_id", "_id"], "left_anti").where("_m1 is not null").select("session_id", F.col("_m1").alias("seq"), F.lit(True).alias("_pull"))
    heads = facts.select("session_id", F.col("_h1.ids").alias("_head_ids"))
    j = zoned.join(pull, ["session_id", "seq"], "left").join(heads, "session_id", "left")
    to_head = (z == "middle") & (F.col("role") == "tool") & F.coalesce(F.array_contains("_head_ids", F.col("tool_call_id")), F.lit(False))
    return j.withColumn("zone", F.when(F.col("_pull"), "tail").when(to_head, "head").otherwise(z)).drop("_pull", "_head_ids")


HANDOFF = "[Earlier conversation, summarized]"


def middle_summary(zoned: DataFrame, prefix: str = HANDOFF) -> DataFrame:
    """Rule-based summary of the middle zone per session: open request, goal, tools used, last statement."""
    m = zoned.where("zone = 'middle'")
    t = F.left(tx.strip(F.coalesce("content", F.lit(""))), F.lit(200))
    user, ai = (F.col("role") == "user") & (t != ""), (F.col("role") == "assistant") & (t != "")
    facts = m.groupBy("session_id").agg(
        F.max_by(t, F.when(user, F.col("seq"))).alias("last_user"), F.min_by(t, F.when(user, F.col("seq"))).alias("first_user"),
        F.count_if(user).alias("n_user"), F.max_by(t, F.when(ai, F.col("seq"))).alias("last_ai"))
    calls = m.select("session_id", "seq", F.explode(F.transform("tool_calls", lambda c: F.coalesce(c["name"], F.lit("?")))).alias("name"))
    names = top_k(calls.groupBy("session_id", "name").agg(F.min("seq").alias("s")), ["session_id"], [F.asc("s"), F.asc("name")], 8)
    tools = names.groupBy("session_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: F.concat(F.lit("- Called tool: "), s["name"])), "\n").alias("tools"))
    none = F.lit("(none)")
    j = facts.join(tools, "session_id", "left")
    last = F.coalesce("last_user", none)
    text = F.concat_ws(
        "\n", F.lit(prefix), F.lit("## Active Task"), last, F.lit(""), F.lit("## Goal / Constraints"),
        F.when(F.col("n_user") > 1, F.col("first_user")).otherwise(none), F.lit(""), F.lit("## Completed Actions"), F.coalesce("tools", none),
        F.lit(""), F.lit("## In Progress / Blocked"), none, F.lit(""), F.lit("## Key Decisions"), none, F.lit(""), F.lit("## Resolved Questions"),
        F.coalesce("last_ai", none), F.lit(""), F.lit("## Pending User Asks"), last, F.lit(""), F.lit("## Relevant Files / Remaining Work"), none)
    return j.select("session_id", text.alias("summary"))


def remove_orphans(messages: DataFrame) -> DataFrame:
    """Drop tool results without their call, and calls without a result; empty messages left over go too."""
    calls = messages.select("session_id", "seq", F.posexplode("tool_calls").alias("p", "c"))
    call_ids = calls.select("session_id", F.col("c.id").alias("tool_call_id")).distinct()
    results = messages.where("role = 'tool'").select("session_id", F.col("tool_call_id").alias("_id")).distinct()
    valid = calls.withColumn("_id", F.col("c.id")).join(results, ["session_id", "_id"], "left_semi").groupBy("session_id", "seq").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p", "c"))), lambda s: s["c"]).alias("_calls"))
    tools = messages.where("role = 'tool'").join(call_ids, ["session_id", "tool_call_id"], "left_semi").select(*messages.columns)
    rest = messages.where("role <> 'tool'").join(valid, ["session_id", "seq"], "left")
    had = _has_calls()
    rest = rest.where(~had | F.col("_calls").isNotNull() | (F.coalesce("content", F.lit("")) != ""))
    empty = F.array().cast(messages.schema["tool_calls"].dataType)
    rest = rest.withColumn("tool_calls", F.when(had, F.coalesce("_calls", empty)).otherwise(F.col("tool_calls")))
    return rest.select(*messages.columns).unionByName(tools)


def savings(zoned: DataFrame, summary: DataFrame) -> DataFrame:
    """Share of tokens saved when the middle zone is replaced by its summary."""
    t = zoned.groupBy("session_id").agg(F.sum("tokens").alias("before"), F.sum(F.when(F.col("zone") != "middle", F.col("tokens")).otherwise(0)).alias("kept"))
    j = t.join(summary.select("session_id", tx.rough_tokens(F.col("summary")).alias("_s")), "session_id", "left")
    after = F.col("kept") + F.coalesce("_s", F.lit(0))
    return j.select("session_id", "before", after.alias("after"), F.when(F.col("before") > 0, 1 - after / F.col("before")).otherwise(0.0).alias("savings"))


def thrash_flags(events: DataFrame, key: str, seq: str, slice_: Column, value: str, low: float = 0.1, limit: int = 2) -> DataFrame:
    """Whether the last ``limit`` values in a row, this one included, were all below ``low``."""
    is_low = F.col(value) < low
    r = running(events, [key], slice_, [seq], {"_island": (~is_low).cast("int")})
    # within a streak the n-th low value is the n-th row after the last high one
    streak = running(r.where(is_low), [key, "_island"], slice_, [seq], {"streak": F.lit(1)})
    high = r.where(~is_low).withColumn("streak", F.lit(0).cast("long"))
    out = high.unionByName(streak.select(*high.columns))
    return out.withColumn("thrashing", F.col("streak") >= limit).drop("_island")


def preservation(texts: DataFrame, terms: DataFrame, key: str = "session_id") -> DataFrame:
    """Whether each expected term of a session is still in its text."""
    return terms.join(texts, key).select(key, "term", F.contains(F.lower("text"), F.lower("term")).alias("kept"))


def latest_texts(messages: DataFrame, internal_prefix: str = "[internal]") -> DataFrame:
    """Latest user question and last assistant answer that is not internal, per session."""
    t = tx.strip(F.coalesce("content", F.lit("")))
    user = F.col("role") == "user"
    ai = (F.col("role") == "assistant") & (t != "") & ~F.startswith(t, F.lit(internal_prefix))
    return messages.groupBy("session_id").agg(
        F.coalesce(F.max_by(t, F.when(user, F.col("seq"))), F.lit("")).alias("question"),
        F.coalesce(F.max_by(t, F.when(ai, F.col("seq"))), F.lit("")).alias("answer"))


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with new messages numbered after the last one of their session."""
    last = history.groupBy("session_id").agg(F.max("seq").alias("_last"))
    n = running(new, ["session_id"], _slice("pos"), ["pos"], {"_n": F.lit(1)}).join(last, "session_id", "left")
    n = n.withColumn("seq", F.coalesce("_last", F.lit(-1)) + F.col("_n"))
    return history.unionByName(n.select(*history.columns))
