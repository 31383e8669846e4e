"""Evaluation: metrics per case, scores, failure classes, summaries, ranking metrics, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import running, top_k


def _empty(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) == 0


def keyword_hit(text: Column, keywords: Column) -> Column:
    """True when no keywords are asked for, or any of them or of their synonyms occurs."""
    t = tx.cache_key_text(F.coalesce(text, F.lit("")))
    syn = F.create_map(*[x for k, v in rules.SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    none = F.array().cast("array<string>")
    words = F.flatten(F.transform(keywords, lambda k: F.concat(F.array(k), F.coalesce(F.try_element_at(syn, F.lower(k)), none))))
    return _empty(keywords) | F.exists(words, lambda w: F.contains(t, tx.cache_key_text(w)))


def must_include(text: Column, terms: Column) -> Column:
    t = tx.cache_key_text(F.coalesce(text, F.lit("")))
    return _empty(terms) | F.forall(terms, lambda w: F.contains(t, tx.cache_key_text(w)))


def must_not_include(text: Column, terms: Column) -> Column:
    t = tx.cache_key_text(F.coalesce(text, F.lit("")))
    return _empty(terms) | ~F.exists(terms, lambda w: F.contains(t, tx.cache_key_text(w)))


def _low(a: Column) -> Column:
    return F.transform(F.filter(a, lambda x: x.isNotNull() & (x != "")), lambda x: F.lower(F.trim(x)))


def tool_hit(actual: Column, expected: Column) -> Column:
    """Whether all expected tools were used, whatever their case."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(_low(F.coalesce(expected, none)), _low(F.coalesce(actual, none)))) == 0


def tool_args_hit(cases: DataFrame, expected: DataFrame, calls: DataFrame) -> DataFrame:
    """(case_id, hit): for every expected (case_id, tool, args) some call of the case has all arguments.

    Arguments are maps of text; an expected value must occur in the actual one. Calls stay rows.
    """
    e = expected.select("case_id", F.lower("tool").alias("_t"), F.col("args").alias("_want"))
    c = calls.select("case_id", F.lower("name").alias("_t"), "args")
    ok = F.forall(F.map_entries("_want"), lambda w: F.contains(
        F.lower(F.coalesce(F.try_element_at(F.col("args"), w["key"]), F.lit(""))), F.lower(w["value"])))
    per = e.join(c, ["case_id", "_t"], "left").groupBy("case_id", "_t").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("h"))
    hit = per.groupBy("case_id").agg(F.bool_and("h").alias("hit"))
    return cases.select("case_id").join(hit, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(True)).alias("hit"))


def notes_used(actual: Column, expected: Column) -> Column:
    return F.when(expected.isNull(), True).otherwise(actual == expected)


def context_mode(actual: Column, expected: Column) -> Column:
    norm = lambda c: F.lower(tx.strip(F.coalesce(c, F.lit(""))))
    return F.when(F.coalesce(expected, F.lit("")) == "", True).otherwise(norm(actual) == norm(expected))


def score() -> Column:
    """Weighted score over the metric columns, rounded to four digits."""
    s = F.lit(0.0)
    for name, w in rules.SCORE_WEIGHTS.items():
        s = s + F.when(F.col(name), w).otherwise(0.0)
    return F.round(s, 4)


def _share(c: Column) -> Column:
    return F.coalesce(F.round(F.avg(c.cast("double")), 4), F.lit(0.0))


def _mean_score(c: Column) -> Column:
    """Mean of four-digit scores, rounded half up to four digits in whole numbers, so that no order of adding matters."""
    s, n = F.sum(F.round(c * 10000).cast("long")), F.count(c)
    return F.coalesce(F.when(n > 0, F.floor((2 * s + n) / (2 * n)) / 10000), F.lit(0.0))


def summarize(results: DataFrame) -> DataFrame:
    """One row of totals, rates and means; zeros when there are no results."""
    c = F.col
    yes = lambda n: F.when(c(n), 1).otherwise(0)
    return results.agg(
        F.count("*").alias("total_cases"), F.count_if(c("score") >= rules.PASS_SCORE).alias("passed_cases"),
        _share(yes("route_correct")).alias("route_accuracy"), _share(yes("tool_correct")).alias("tool_accuracy"),
        _share(yes("tool_args_correct")).alias("tool_args_accuracy"), _share(yes("keyword_hit")).alias("keyword_hit_rate"),
        _share(yes("evidence_hit")).alias("evidence_hit_rate"),
        F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"), _mean_score(c("score")).alias("avg_score"))


def failure_class() -> list[Column]:
    """Category and reason of a failed case by ordered rules.

    Columns used: score, tool_failed, tool_error_codes, error, trace_status, the metric columns, expects_tools,
    missing_tools, expects_args (names), expects_evidence, evidence_count, token_usage, latency_ms.
    """
    c = F.col
    no = lambda n: ~F.coalesce(c(n), F.lit(False))
    codes = F.coalesce("tool_error_codes", F.lit(""))
    missed = F.concat_ws(", ", F.when(no("keyword_hit"), "keyword"), F.when(no("must_include_hit"), "must_include"))
    rows = [
        (c("score") >= rules.PASS_SCORE, "none", F.lit("")),
        (c("tool_failed") | (codes != ""), "tool_error", F.concat(F.lit("tool step failed"), F.when(codes != "", F.concat(F.lit(": "), codes)).otherwise(""))),
        (F.coalesce("error", F.lit("")) != "", "runtime_error", c("error")),
        (F.lower("trace_status") == "failed", "runtime_error", F.lit("trace status is failed")),
        (c("expects_tools") & no("tool_correct"), "tool_selection_error", F.concat(F.lit("missing expected tools: "), c("missing_tools"))),
        ((F.coalesce("expects_args", F.lit("")) != "") & no("tool_args_correct"), "tool_argument_error",
         F.concat(F.lit("tool arguments did not match expected args for: "), c("expects_args"))),
        (c("expects_evidence") & no("evidence_hit"), "retrieval_miss",
         F.when(c("evidence_count") <= 0, "expected evidence was not found and trace has no retrieved evidence").otherwise("expected evidence was not present in answer")),
        (~no("evidence_hit") & (missed != ""), "evidence_ignored", F.concat(F.lit("evidence was present but answer missed: "), missed)),
        (no("must_not_include_hit"), "hallucination_or_format_error", F.lit("answer contained forbidden terms")),
        (c("token_usage") > rules.HIGH_TOKENS, "high_cost", F.concat(F.lit("token_usage "), c("token_usage").cast("string"), F.lit(f" exceeded {rules.HIGH_TOKENS}"))),
        (c("latency_ms") > rules.HIGH_LATENCY_MS, "high_cost", F.concat(F.lit("latency_ms "), c("latency_ms").cast("string"), F.lit(f" exceeded {rules.HIGH_LATENCY_MS}"))),
    ]
    return [tx.first_match([(r, n) for r, n, _ in rows], "low_answer_quality").alias("failure_category"),
            tx.first_match([(r, t) for r, _, t in rows], "score below pass threshold").alias("failure_reason")]


def failure_counts(classified: DataFrame) -> DataFrame:
    f = classified.where(F.col("score") < rules.PASS_SCORE)
    return f.groupBy(F.coalesce(F.nullif("failure_category", F.lit("")), F.lit("uncategorized")).alias("failure_category")).agg(F.count("*").alias("n"))


# ---- ranking metrics --------------------------------------------------------------


def _first_rank(ranked: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, term_no, rank): first result of the case that holds the term in title or abstract."""
    hit = F.contains(F.lower("title"), F.lower("term")) | F.contains(F.lower("abstract"), F.lower("term"))
    return ranked.join(terms, "case_id").where(hit).groupBy("case_id", "term_no").agg(F.min("rank").alias("rank"))


def _terms(cases: DataFrame, column: str) -> DataFrame:
    return cases.select("case_id", F.posexplode(column).alias("term_no", "term"))


def hits_at(cases: DataFrame, ranked: DataFrame, ks=(3, 5)) -> DataFrame:
    """Per case: any loose term and all strict terms found within the first k results (or all there are)."""
    loose = _first_rank(ranked, _terms(cases, "terms_loose")).groupBy("case_id").agg(F.min("rank").alias("_l"))
    strict = _first_rank(ranked, _terms(cases, "terms_strict")).groupBy("case_id").agg(F.max("rank").alias("_s"), F.count("*").alias("_n"))
    j = cases.join(loose, "case_id", "left").join(strict, "case_id", "left")
    all_ = F.coalesce("_n", F.lit(0)) == F.size("terms_strict")
    cols = []
    for k in ks:
        cols.append(F.coalesce(F.col("_l") <= k, F.lit(False)).alias(f"loose_top{k}"))
        cols.append((all_ & F.coalesce(F.col("_s") <= k, F.size("terms_strict") == 0)).alias(f"strict_top{k}"))
    return j.select("case_id", *cols)


def title_ranks(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, expected_title, rank): first result equal to the title or a prefix of it either way."""
    norm = lambda c: F.lower(tx.strip(F.coalesce(c, F.lit(""))))
    e = expected.select("case_id", "expected_title", norm(F.col("expected_title")).alias("_e"))
    j = e.join(ranked.select("case_id", "rank", norm(F.col("title")).alias("_t")), "case_id", "left")
    ok = F.startswith("_t", F.col("_e")) | F.startswith("_e", F.col("_t"))
    return j.groupBy("case_id", "expected_title").agg(F.min(F.when(ok, F.col("rank"))).alias("rank"))


def mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("mrr"))


def compare_rankings(cases: DataFrame, base: DataFrame, enhanced: DataFrame, ks=(3, 5)) -> DataFrame:
    """Hit rates of two rankings, their differences and the number of cases that improved."""
    b, e = hits_at(cases, base, ks), hits_at(cases, enhanced, ks)
    names = [c for c in b.columns if c != "case_id"]
    j = b.select("case_id", *[F.col(n).cast("int").alias(f"b_{n}") for n in names]).join(
        e.select("case_id", *[F.col(n).cast("int").alias(f"e_{n}") for n in names]), "case_id", "full")
    better = F.lit(False)
    for n in names:
        better = better | (F.col(f"e_{n}") > F.col(f"b_{n}"))
    rate = lambda p, n: F.avg(f"{p}_{n}")
    return j.agg(F.count("*").alias("n_cases"), F.count_if(better).alias("improved"),
                 *[F.round(rate(p, n), 3).alias(f"{w}_{n}") for n in names for p, w in (("b", "baseline"), ("e", "enhanced"))],
                 *[F.round(rate("e", n) - rate("b", n), 3).alias(f"delta_{n}") for n in names])


def rank_change(expected: DataFrame, base: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Expected items within the first 3 and 5 of two rankings, and their mean rank gain."""
    j = expected.select("case_id", "item").join(base.select("case_id", "item", F.col("rank").alias("b")), ["case_id", "item"], "left").join(
        enhanced.select("case_id", "item", F.col("rank").alias("e")), ["case_id", "item"], "left")
    both = F.when(F.col("b").isNotNull() & F.col("e").isNotNull(), F.col("b") - F.col("e"))
    c = lambda col, k: F.count_if(F.col(col) <= k)
    return j.agg(F.count("*").alias("n_expected"), c("b", 3).alias("baseline_top3"), c("e", 3).alias("enhanced_top3"), c("b", 5).alias("baseline_top5"),
                 c("e", 5).alias("enhanced_top5"), F.round(F.coalesce(F.avg(both), F.lit(0.0)), 4).alias("mean_rank_gain"))


# ---- gate and recall reports ---------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def gate_confusion(cases: DataFrame) -> DataFrame:
    """``cases``: should_save, saved, expected_type, actual_type."""
    should, saved = F.col("should_save"), F.col("saved")
    typed = should & saved & F.col("expected_type").isNotNull()
    right = typed & (F.col("actual_type") == F.col("expected_type"))
    low = F.count_if(~should)
    return cases.agg(
        F.count("*").alias("total"), F.count_if(saved & ~should).alias("false_saves"), F.count_if(should & ~saved).alias("false_rejections"),
        _ratio(F.count_if(right), F.count_if(typed)).alias("type_accuracy"), _ratio(F.count_if(~should & ~saved), low).alias("interception_rate"))


def recall_report(expectations: DataFrame, recalled: DataFrame) -> DataFrame:
    """``expectations``: query_id, keyword, should_recall; ``recalled``: query_id, rank, content."""
    hit = F.contains(F.lower("content"), F.lower("keyword"))
    j = expectations.join(recalled, "query_id", "left").groupBy("query_id", "should_recall").agg(F.min(F.when(hit, F.col("rank"))).alias("r"))
    s, r = F.col("should_recall"), F.col("r")
    n_pos, n_neg = F.count_if(s), F.count_if(~s)
    return j.agg(F.count("*").alias("n"), _ratio(F.count_if(s & (r <= 3)), n_pos).alias("recall_top3"), _ratio(F.count_if(s & (r <= 5)), n_pos).alias("recall_top5"),
                 _ratio(F.count_if(~s & (r <= 5)), n_neg).alias("false_positive_rate"),
                 _ratio(F.count_if(s & F.coalesce(r > 5, F.lit(True))), n_pos).alias("false_negative_rate"))


def duplicate_rate(pairs: DataFrame) -> DataFrame:
    """``pairs``: files_before, files_after, stored content, second content."""
    ok = (F.col("files_after") == F.col("files_before")) & (F.col("stored") == F.col("second"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(ok).alias("updated_in_place"), _ratio(F.count_if(ok), F.count("*")).alias("handled_rate"))


def run_statistics(runs: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation (zero for one run), minimum and maximum per configuration and metric."""
    long = runs.select(config, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy(config, "metric").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("stddev"),
        F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"))


def statistics_delta(stats: DataFrame, config: str, first: str, second: str) -> DataFrame:
    pick = lambda v: F.max(F.when(F.col(config) == v, F.col("mean")))
    return stats.groupBy("metric").agg(F.round(F.coalesce(pick(first), F.lit(0.0)) - F.coalesce(pick(second), F.lit(0.0)), 4).alias("delta"))


def trigger_rates(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rate per query against the threshold. ``runs``: query, should_trigger, triggered."""
    g = runs.groupBy("query").agg(F.bool_or("should_trigger").alias("should_trigger"), F.count_if(F.col("triggered")).alias("triggers"), F.count("*").alias("runs"))
    rate = F.col("triggers") / F.col("runs")
    return g.select("*", F.round(rate, 6).alias("trigger_rate"), F.when(F.col("should_trigger"), rate >= threshold).otherwise(rate < threshold).alias("passed"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Accuracy, mean duration, mean and total tool calls."""
    return runs.agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("duration"), 6).alias("mean_duration"),
                    F.round(F.avg("tool_calls"), 6).alias("mean_tool_calls"), F.sum("tool_calls").alias("total_tool_calls"))


def tool_case_results(cases: DataFrame, payloads: DataFrame, traces: DataFrame) -> DataFrame:
    """Pass and reason per tool case. ``payloads``: case_id, run_id, ok, error_code, error; ``traces``: run_id, remote_steps."""
    j = cases.join(payloads, "case_id", "left").join(traces, "run_id", "left")
    ok, code, err = F.coalesce("ok", F.lit(False)), F.coalesce("error_code", F.lit("")), F.coalesce("error", F.lit(""))
    ok_m, code_m = ok == F.col("expect_ok"), code == F.col("expected_error_code")
    trace = F.coalesce(F.col("remote_steps") > 0, F.lit(False))
    s = lambda c: c.cast("string")
    reason = tx.first_match([
        (~ok_m, F.concat(F.lit("expected ok="), s(F.col("expect_ok")), F.lit(", got ok="), s(ok))),
        (~code_m, F.concat(F.lit("expected error_code="), F.col("expected_error_code"), F.lit(", got error_code="), code)),
        (~trace, "trace run or remote tool step missing"), (err != "", err)], "")
    passed = ok_m & code_m & trace & (err == "")
    return j.select("case_id", passed.alias("passed"), F.when(passed, 1.0).otherwise(0.0).alias("score"), reason.alias("failure_reason"))


def recovery_audit(steps: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Steps skipped or run again after recovery. ``steps``: scenario, step, completed_upto, actual (CP_value_n, value_n or empty)."""
    want = F.concat(F.lit("value_"), F.col("step").cast("string"))
    done, a = F.col("step") < F.col("completed_upto"), F.coalesce("actual", F.lit(""))
    skipped, again = done & (a == F.concat(F.lit("CP_"), want)), done & (a == want)
    bad = (done & ~skipped) | (~done & (a == ""))
    return steps.groupBy(scenario).agg(F.count("*").alias("n_steps"), F.count_if(skipped).alias("skipped"), F.count_if(again).alias("re_executed"),
                                       F.count_if(bad).alias("violations"), (F.count_if(bad) == 0).alias("recovered"))


def tool_calls(events: DataFrame, id_cols: list[str], payload: str = "payload") -> DataFrame:
    """Tool name and arguments (map) of a result or stream event in JSON; arguments may be an object or JSON text."""
    g = lambda p: F.get_json_object(payload, p)
    name = F.coalesce(*[F.nullif(g(p), F.lit("")) for p in ("$.data.tool_name", "$.data.name", "$.name")])
    args = F.coalesce(g("$.data.arguments"), g("$.data.args"), g("$.args"), g("$.arguments"))
    kind = F.lower(F.trim(F.coalesce(g("$.type"), F.lit("tool_call"))))
    empty = F.create_map().cast("map<string,string>")
    return events.where((kind == "tool_call") & name.isNotNull()).select(
        *id_cols, name.alias("name"), F.coalesce(F.from_json(args, "map<string,string>"), empty).alias("args"))


def trajectories(messages: DataFrame, key: str, seq: str) -> DataFrame:
    """Steps of a session as rows: tool calls in order, the final answer last, with character-based tokens."""
    call = F.col("role") == "tool_call"
    last = messages.groupBy(key).agg(
        F.coalesce(F.max_by("text", F.when(F.col("role") == "assistant", F.col(seq))), F.lit("")).alias("answer"),
        F.coalesce(F.max_by("text", F.when(F.col("role") == "user", F.col(seq))), F.lit("")).alias("question"), F.count_if(call).alias("n_calls"))
    steps = running(messages.where(call), [key], F.floor(F.col(seq) / 4096), [seq], {"step": F.lit(1)}).select(
        key, "step", F.lit("tool_call").alias("type"), F.col("text").alias("content"))
    final = last.select(key, (F.col("n_calls") + 1).alias("step"), F.lit("final").alias("type"), F.col("answer").alias("content"))
    tok = last.select(key, (F.length("answer") > 0).alias("success"), F.floor(F.length("question") / 2).alias("prompt_tokens"),
                      F.floor(F.length("answer") / 2).alias("completion_tokens"), F.floor((F.length("question") + F.length("answer")) / 2).alias("total_tokens"))
    return steps.unionByName(final).join(tok, key)


def stratified_split(items: DataFrame, item_id: str, label: str, holdout: float, seed: int = 42) -> DataFrame:
    """Train or test per item, by the order of a seeded hash in each label; at least one test item per label.

    Ranks in a label come from hash slices, so a label with most of the rows is not sorted in one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item_id).cast("string")))
    n = items.groupBy(label).agg(F.count("*").alias("_n"))
    r = running(items.withColumn("_h", h), [label], F.substring("_h", 1, 3), ["_h"], {"_r": F.lit(1)})
    test = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * holdout))
    return r.join(n, label).withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_r", "_n")


def precision_recall(results: DataFrame) -> DataFrame:
    """Over repeated runs: ``results`` has should_trigger, triggers, runs. One when undefined."""
    pos = F.col("should_trigger")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    tp, fp = s(F.when(pos, F.col("triggers"))), s(F.when(~pos, F.col("triggers")))
    p, n = s(F.when(pos, F.col("runs"))), s(F.when(~pos, F.col("runs")))
    ratio = lambda a, b, d: F.round(F.when(b > 0, a / b).otherwise(d), 6)
    return results.agg(ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, p, 1.0).alias("recall"), ratio(tp + n - fp, p + n, 0.0).alias("accuracy"))


def best_iteration(history: DataFrame, key: str) -> DataFrame:
    """Iteration with most test passes (train passes without a test set); the first one wins ties."""
    s = F.coalesce("test_passed", F.when(F.col("test_total").isNull(), F.col("train_passed")), F.lit(0))
    return history.groupBy(key).agg(F.min(F.struct((-s).alias("s"), F.col("iteration").alias("i"))).alias("b")).select(key, F.col("b.i").alias("iteration"), (-F.col("b.s")).alias("passed"))
