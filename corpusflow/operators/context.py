"""Context assembly for many questions at once: gather, select, structure, fit to a budget, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import top_k
from corpusflow.operators.fusion import apply_rerank

CANDIDATE = ["query_id", "source", "pos", "content", "score"]


def last_history(messages: DataFrame, session: str, seq: str, n: int = rules.MAX_HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages of every session, roles normalised, empty ones dropped."""
    role = F.when(F.col("role").isin("human", "user"), "user").otherwise("assistant")
    last = top_k(messages.select(session, seq, role.alias("role"), F.col("text").alias("content")), [session], [F.desc(seq)], n)
    return last.where(F.coalesce(tx.strip(F.col("content")), F.lit("")) != "").drop("rank")


def candidate_score(rerank: Column, relevance: Column, score: Column, rrf_rank: Column, own: Column) -> Column:
    """The first numeric of rerank, relevance and plain score, else 1/rank, else the item's own score."""
    num = [c.cast("string").try_cast("double") for c in (rerank, relevance, score)]
    r = rrf_rank.cast("string").try_cast("double")
    return F.coalesce(*num, F.when(r > 0, 1 / r), own.cast("string").try_cast("double"), F.lit(0.0))


def gather(history: DataFrame, knowledge: DataFrame, parents: DataFrame | None, notes: DataFrame, memories: DataFrame | None) -> DataFrame:
    """Candidates (query_id, source, pos, content, score) from five kinds of input, each keyed by query.

    ``pos`` orders the candidates of a query: history first, then knowledge, parents, notes, memories.
    """
    def part(df, name, base, content, score):
        return df.select("query_id", F.lit(name).alias("source"), (F.col("pos") + base).cast("long").alias("pos"),
                         content.alias("content"), score.cast("double").alias("score"))

    titled = lambda t, c: F.when(F.coalesce(t, F.lit("")) != "", F.concat(t, F.lit(": "), c)).otherwise(c)
    step = 1 << 40  # more candidates of a kind than a query can have
    out = part(history, "history", 0, F.concat_ws(": ", "role", "content"), F.lit(0.0))
    out = out.unionByName(part(knowledge, "knowledge", step, F.col("content"), F.col("score")))
    if parents is not None:
        out = out.unionByName(part(parents, "parent_chunk", 2 * step, F.col("content"), F.col("score")))
    out = out.unionByName(part(notes, "note", 3 * step, titled(F.col("title"), F.col("content")), F.coalesce("importance", F.lit(0.5))))
    if memories is not None:
        m = F.concat(F.lit("[Memory:"), F.col("kind"), F.lit("] "), F.col("title"), F.lit(": "), F.col("content"))
        out = out.unionByName(part(memories, "memory", 4 * step, m, F.coalesce("importance", F.lit(0.9))))
    return out


def overlap_score(question: Column, content: Column) -> Column:
    """Shared words plus their share of the question's words."""
    q, c = tx.word_set(question), tx.word_set(content)
    n = F.size(F.array_intersect(q, c))
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).otherwise(n + n / F.greatest(F.size(q), F.lit(1)))


def select_evidence(candidates: DataFrame, questions: DataFrame, k: int = 6, min_score: float = 0.0) -> DataFrame:
    """Best ``k`` candidates per query: their own score when positive, else word overlap; stable order."""
    j = candidates.join(questions.select("query_id", "question"), "query_id")
    own = F.col("score") > 0
    s = F.when(own, F.col("score")).otherwise(overlap_score(F.col("question"), F.col("content")))
    rows = j.select("query_id", "source", "pos", "content", F.round(s, 9).alias("score"),
                    F.when(own, "rerank_or_metadata").otherwise("heuristic").alias("score_source")).where(F.col("score") >= min_score)
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("pos")], k, "selected_rank")


def select_reranked(candidates: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Candidates in the order of an external ranking (query_id, index, relevance, pos)."""
    old = candidates.select("query_id", F.col("pos").alias("chunk_id"), "score",
                            F.row_number().over(W.partitionBy("query_id").orderBy("pos")).alias("rank"))
    return apply_rerank(old, ranked, k).where("rerank_applied").select(
        "query_id", F.col("chunk_id").alias("pos"), F.coalesce("rerank_score", "score").alias("score"), F.col("rank").alias("selected_rank"))


def _joined(df: DataFrame, order: str, line: Column, out: str, sep: str = "\n") -> DataFrame:
    return df.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda s: s["t"]), sep).alias(out),
        F.count("*").alias("items"))


def history_text(history: DataFrame, n: int = rules.MAX_HISTORY_TURNS) -> DataFrame:
    """The last ``n`` history lines per query as one text (``pos`` orders the messages)."""
    last = top_k(history, ["query_id"], [F.desc("pos")], n, "_r")
    return _joined(last, "pos", F.concat(F.lit("- "), F.col("role"), F.lit(": "), tx.strip(F.col("content"))), "content")


def structure(questions: DataFrame, history: DataFrame, evidence: DataFrame, candidates: DataFrame, mode: str = "deep") -> DataFrame:
    """Packets (query_id, ordinal, kind, source, content, tokens, relevance) per question."""
    rel = rules.RELEVANCE
    asked = questions.select("query_id").distinct()
    history, candidates, evidence = (t.join(asked, "query_id", "left_semi") for t in (history, candidates, evidence))
    q = questions.select("query_id", F.lit(0).alias("ordinal"), F.lit("user_question").alias("kind"), F.lit("question").alias("source"),
                         F.col("question").alias("content"), F.lit(rel["user_question"]).alias("relevance"))
    h = history_text(history).select("query_id", F.lit(1).alias("ordinal"), F.lit("conversation_history").alias("kind"), F.lit("history").alias("source"),
                                     "content", F.lit(rel["conversation_history"]).alias("relevance"))
    e = evidence.where((F.col("selected_rank") <= rules.MAX_EVIDENCE) & (F.col("score") >= rules.MIN_RELEVANCE)).select(
        "query_id", (1 + F.col("selected_rank")).alias("ordinal"), F.lit("evidence").alias("kind"), F.concat(F.lit("evidence:"), F.col("source")).alias("source"),
        tx.strip(F.col("content")).alias("content"), F.col("score").alias("relevance"))
    top = top_k(candidates, ["query_id"], [F.asc("pos")], 3, "n").where(tx.strip(F.col("content")) != "")
    s = _joined(top, "n", F.concat(F.col("n").cast("string"), F.lit(". ["), F.col("source"), F.lit("] "), tx.strip(F.col("content"))), "content").select(
        "query_id", F.lit(100).alias("ordinal"), F.lit("candidate_summary").alias("kind"), F.lit("candidate_summary").alias("source"), "content",
        F.lit(rel["candidate_summary"]).alias("relevance"))
    m = questions.select("query_id", F.lit(101).alias("ordinal"), F.lit("mode_hint").alias("kind"), F.lit("mode_hint").alias("source"),
                         F.lit(rules.MODE_HINTS[mode]).alias("content"), F.lit(rel["mode_hint"]).alias("relevance"))
    out = q.unionByName(h).unionByName(e).unionByName(s).unionByName(m)
    return out.withColumn("tokens", tx.rough_tokens(F.col("content")))


def compress_lines(lines: Column, head: int = 2, tail: int = 3) -> Column:
    """Distinct trimmed lines; when there are many, the first and last ones around an ellipsis."""
    c = F.array_distinct(F.filter(F.transform(lines, tx.strip), lambda l: l != ""))
    short = F.concat(F.slice(c, 1, head), F.array(F.lit("...")), F.slice(c, -tail, tail))
    return F.when(F.size(c) <= head + tail + 1, c).otherwise(short)


def digests(packets: DataFrame) -> DataFrame:
    """History packets become a line digest, summaries a tail digest; other packets stay."""
    c = F.col
    lines = F.transform(compress_lines(F.split("content", "\n")), lambda l: F.concat(F.lit("- "), l))
    hist = F.concat(F.lit("最近会话摘要：\n"), F.array_join(lines, "\n"))
    flat = tx.strip(F.replace(c("content"), F.lit("\n"), F.lit(" ")))
    snip = F.when(F.length(flat) > 72, F.concat(F.left(flat, F.lit(69)), F.lit("..."))).otherwise(flat)
    tail = F.concat(F.lit("其余相关内容摘要：\n- ["), c("source"), F.lit("] "), snip)
    is_h, is_t = c("kind") == "conversation_history", c("kind") == "candidate_summary"
    return packets.select(
        "query_id", "ordinal",
        F.when(is_h, "history_digest").when(is_t, "compressed_tail").otherwise(c("kind")).alias("kind"),
        F.when(is_h, "history_digest").when(is_t, "compressed_tail").otherwise(c("source")).alias("source"),
        F.when(is_h, hist).when(is_t, tail).otherwise(c("content")).alias("content"),
        F.when(is_h, F.greatest(F.lit(0.6), c("relevance"))).when(is_t, F.greatest(F.lit(0.3), c("relevance") * 0.7)).otherwise(c("relevance")).alias("relevance"),
    ).withColumn("tokens", tx.rough_tokens(c("content")))


def usable_tokens(max_tokens: int = rules.MAX_TOKENS, reserve: float = rules.RESERVE_RATIO) -> int:
    return max(1, int(max_tokens * (1.0 - reserve)))


def fit_budget(packets: DataFrame, budget: int | None = None) -> DataFrame:
    """Keep packets in priority order until the token budget is full; the one that overflows is cut.

    Priority: question, mode hint, history digest, evidence by relevance (later first on ties), tail. A query
    has a handful of packets, so its running sum is a small window.
    """
    budget = usable_tokens() if budget is None else budget
    prio = tx.first_match([(F.col("kind") == k, i) for i, k in enumerate(("user_question", "mode_hint", "history_digest", "evidence"))], 4)
    w = W.partitionBy("query_id").orderBy("_prio", F.desc("_rel"), F.desc("ordinal"))
    p = packets.withColumn("_prio", prio).withColumn("_rel", F.when(F.col("_prio") == 3, F.col("relevance")).otherwise(0.0))
    p = p.withColumn("_before", F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    p = p.withColumn("position", F.row_number().over(w)).where(F.col("_before") < budget)
    room = (budget - F.col("_before")).cast("int")
    fits = F.col("tokens") <= room
    cut = F.concat(F.left("content", F.greatest(F.lit(1), room * 2 - 3)), F.lit("..."))
    p = p.withColumn("was_cut", ~fits).withColumn("content", F.when(fits, F.col("content")).otherwise(cut))
    return p.withColumn("tokens", tx.rough_tokens(F.col("content"))).drop("_prio", "_rel", "_before")


def assemble(questions: DataFrame, history: DataFrame, evidence: DataFrame, packets: DataFrame, candidates: DataFrame,
             mode: str = "deep", max_chars: int = rules.MAX_CHARS) -> DataFrame:
    """The final context text per question, with the counts that went into it."""
    h = history_text(history).select("query_id", F.col("content").alias("_h"), F.col("items").alias("history_used"))
    ev = evidence.where((F.col("selected_rank") <= rules.MAX_EVIDENCE) & (tx.strip(F.col("content")) != ""))
    num = lambda i: F.concat(F.col(i).cast("string"), F.lit(". ["), F.col("source"), F.lit("] "), tx.strip(F.col("content")))
    e = _joined(ev, "selected_rank", num("selected_rank"), "_e").withColumnRenamed("items", "evidence_count")
    p = _joined(packets, "position", num("position"), "_p").withColumnRenamed("items", "packet_count")
    dg = packets.groupBy("query_id").agg(F.bool_or(F.col("kind") == "history_digest").alias("_digest"))
    n = candidates.groupBy("query_id").agg(F.count_if(F.col("source") == "note").alias("note_count"))
    j = questions
    for x in (h, e, p, dg, n):
        j = j.join(x, "query_id", "left")
    none = F.lit("无")
    hist = F.when(F.col("_digest"), "已压缩为结构化摘要，请直接查看下方【结构化上下文】中的 history_digest。").otherwise(F.coalesce("_h", none))
    text = F.concat_ws(
        "\n", F.lit(f"【模式】{mode}"), F.concat(F.lit("【会话ID】"), F.col("session_id").cast("string")), F.concat(F.lit("【用户问题】"), F.col("question")),
        F.lit(""), F.lit("【会话历史】"), hist, F.lit(""), F.lit("【关键证据】"), F.coalesce("_e", none), F.lit(""),
        F.lit("【结构化上下文】"), F.coalesce("_p", none), F.lit(""), F.lit("【处理要求】"), F.lit(rules.MODE_DEMANDS[mode]))
    text = tx.strip(text)
    final = F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.left(text, F.lit(max_chars - 3)), F.lit("...")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("query_id", final.alias("final_context"), F.length(final).alias("final_chars"), zero("history_used"),
                    zero("evidence_count"), zero("packet_count"), zero("note_count"))


def build(questions: DataFrame, history: DataFrame, candidates: DataFrame, mode: str = "deep", k: int = 6, budget: int | None = None) -> DataFrame:
    """The whole chain for a batch of questions (query_id, session_id, question)."""
    ev = select_evidence(candidates, questions, k)
    packets = fit_budget(digests(structure(questions, history, ev, candidates, mode)), budget)
    return assemble(questions, history, ev, packets, candidates, mode)
