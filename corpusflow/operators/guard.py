"""Record validation, injection risk, redaction, policies, snippet cleanup."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx


@dataclass(frozen=True)
class Spec:
    """Rules of one field; ``type`` is a Spark SQL type name."""

    name: str
    type: str = "string"
    required: bool = False
    default: str | None = None
    lo: float | None = None
    hi: float | None = None
    enum: tuple[str, ...] = field(default=())


def _coerce(raw: Column, type_: str) -> Column:
    if type_ == "boolean":
        low = F.lower(F.trim(raw))
        return F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")
    if type_ == "bigint":
        return F.when(F.trim(raw).rlike(r"^[+-]?[0-9]+$"), F.trim(raw).try_cast("bigint").cast("string"))
    if type_ == "double":
        return raw.try_cast("double").cast("string")
    return raw


def validate(args: Column, specs: list[Spec]) -> list[Column]:
    """Errors (array of field and code) and coerced arguments of a text map, as generated column expressions."""
    errors, values = [], []
    err = lambda name, code: F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"))
    for s in specs:
        raw = F.try_element_at(args, F.lit(s.name))
        has = F.coalesce(F.map_contains_key(args, F.lit(s.name)), F.lit(False))
        val = _coerce(raw, s.type)
        num = val.try_cast("double")
        out = F.lit(False)
        if s.lo is not None:
            out = out | (num < s.lo)
        if s.hi is not None:
            out = out | (num > s.hi)
        bad_type = has & raw.isNotNull() & val.isNull()
        bad_range = F.coalesce(out, F.lit(False))
        bad_enum = val.isNull() | ~val.isin(*s.enum) if s.enum else F.lit(False)  # null isn't one of them
        missing = ~has & F.lit(s.required and s.default is None)
        errors.append(tx.first_match([(missing, err(s.name, "MISSING")), (bad_type, err(s.name, "WRONG_TYPE")), (has & bad_range, err(s.name, "OUT_OF_RANGE")),
                                      (has & F.coalesce(bad_enum, F.lit(False)), err(s.name, "INVALID_ENUM"))], F.lit(None).cast("struct<field:string,code:string>")))
        good = has & ~bad_type & ~bad_range & ~F.coalesce(bad_enum, F.lit(False))
        final = F.when(good, val).when(~has, F.lit(s.default).cast("string"))
        values.append(F.when(final.isNotNull(), F.struct(F.lit(s.name).alias("key"), final.alias("value"))))
    unknown = F.transform(F.array_except(F.map_keys(args), F.array(*[F.lit(s.name) for s in specs])), lambda k: F.struct(k.alias("field"), F.lit("UNKNOWN_FIELD").alias("code")))
    all_errors = F.concat(F.array_compact(F.array(*errors)), unknown)
    return [all_errors.alias("errors"), (F.size(all_errors) == 0).alias("ok"), F.map_from_entries(F.array_compact(F.array(*values))).alias("coerced")]


def injection_matches(c: Column) -> Column:
    """Names of the matching injection patterns."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), n) for n, p, _ in rules.INJECTION_RULES]))


def instruction_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rules.INSTRUCTION_WORDS))


def excessive_instructions(c: Column) -> Column:
    """More than five instruction words in a text of more than 500 characters."""
    return (F.length(c) > 500) & (instruction_words(c) > 5)


def injection_report(texts: DataFrame, id_col: str, text: str = "text", source: str = "args", block: float = 0.7) -> DataFrame:
    """Risk (highest matching weight), matched patterns and whether to block."""
    t = texts.select(id_col, injection_matches(F.col(text)).alias("m"), (excessive_instructions(F.col(text)) if source == "args" else F.lit(False)).alias("x"))
    risk = F.lit(0.0)
    for n, _, w in rules.INJECTION_RULES:
        risk = F.greatest(risk, F.when(F.array_contains("m", n), w).otherwise(0.0))
    risk = F.greatest(risk, F.when(F.col("x"), 0.6).otherwise(0.0))
    names = F.concat("m", F.when(F.col("x"), F.array(F.lit("excessive_instruction_keywords"))).otherwise(F.array().cast("array<string>")))
    return t.select(id_col, F.round(risk, 2).alias("risk_score"), F.array_join(names, ",").alias("matched"), (risk >= block).alias("blocked"))


def redact(c: Column, max_chars: int = 2000) -> Column:
    """Text with matching spans replaced by a marker, cut to ``max_chars``."""
    for _, p, _ in rules.INJECTION_RULES:
        c = F.regexp_replace(c, p, rules.FILTERED.replace("$", r"\$"))
    return F.when(F.length(c) > max_chars, F.concat(F.left(c, F.lit(max_chars)), F.lit("...[truncated]"))).otherwise(c)


def authorized(calls: DataFrame, blocked: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Calls that are not blocked and, where a session has an allow list, on it.

    ``blocked``/``allowed``: session_id, tool.
    """
    out = calls.join(blocked, ["session_id", "tool"], "left_anti")
    if allowed is None:
        return out
    listed = out.join(allowed.select("session_id").distinct(), "session_id", "left_semi").join(allowed, ["session_id", "tool"], "left_semi")
    free = out.join(allowed.select("session_id").distinct(), "session_id", "left_anti")
    return free.select(*calls.columns).unionByName(listed.select(*calls.columns))


def clean_snippet(c: Column, max_chars: int = 320) -> Column:
    """Web text without Markdown marks, links and navigation phrases."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " ")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"[#*_`>]+", " ")
    for p in rules.WEB_NOISE:
        c = F.regexp_replace(c, rf"(?i)(^|[^0-9A-Za-z_]){re.escape(p)}(?=[^0-9A-Za-z_]|$)", "$1 ")
    c = F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .|-"))
    return F.when(F.length(c) > max_chars, F.concat(tx.rstrip(F.left(c, F.lit(max_chars - 3))), F.lit("..."))).otherwise(c)
