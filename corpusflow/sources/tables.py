"""User tables: CSV files as views, safe view names, SQL over them, exports."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_name(name: str) -> str:
    """A name usable in SQL: other characters become ``_``; no digit in front."""
    name = re.sub(r"\W", "_", name)
    return f"t_{name}" if name[:1].isdigit() else name


def safe_name_column(c: Column) -> Column:
    s = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)


def distinct_names(names: list[str]) -> dict[str, str]:
    """Original to safe name; a taken name gets ``_1``, ``_2`` and so on."""
    out: dict[str, str] = {}
    for n in names:
        base = safe_name(n)
        candidate, i = base, 1
        while candidate in out.values():
            candidate, i = f"{base}_{i}", i + 1
        out[n] = candidate
    return out


def register(spark: SparkSession, frames: dict[str, DataFrame]) -> dict[str, str]:
    """Register frames as temporary views; returns original to view name."""
    names = distinct_names(list(frames))
    for original, df in frames.items():
        df.createOrReplaceTempView(names[original])
    return names


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> dict[str, DataFrame]:
    """CSV files with a header; types are inferred when no schema is given."""
    out = {}
    for p in paths:
        reader = spark.read.option("header", True).option("multiLine", False)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        out[os.path.splitext(os.path.basename(p.rstrip("/")))[0]] = reader.csv(p)
    return out


class QueryError(ValueError):
    """A query that does not resolve, with the columns the user could have meant."""


def run_sql(spark: SparkSession, sql: str, names: dict[str, str]) -> DataFrame:
    """Run SQL in which tables may be called by their original (quoted or bare) names."""
    for original in sorted(names, key=len, reverse=True):
        view = names[original]
        for q in (f'"{original}"', f"`{original}`"):
            sql = sql.replace(q, view)
        if original != view:
            sql = re.sub(rf"(?<![\w\"'`]){re.escape(original)}(?![\w\"'`])", view, sql)
    try:
        return spark.sql(sql)
    except AnalysisException as e:
        hint = "; ".join(
            f"{o} ({v}): " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(v).schema.fields)
            for o, v in names.items()
        )
        raise QueryError(f"{e}\navailable tables: {hint}") from e


def _text_cell(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(f.dataType, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table."""
    cells = [F.replace(F.coalesce(_text_cell(f), F.lit("None")), F.lit("|"), F.lit("\\|")) for f in df.schema.fields]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |"


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Write a result as ``csv``, ``json`` or ``md``; parts are written by the tasks, in parallel."""
    plain = df.select([
        (_text_cell(f).alias(f.name) if not isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.col(f"`{f.name}`"))
        for f in df.schema.fields
    ])
    if fmt == "csv":
        plain.write.option("header", True).option("escape", '"').csv(path)  # quotes are doubled
    elif fmt == "json":
        typed = df.select([
            (_text_cell(f).alias(f.name)
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.BinaryType)) else F.col(f"`{f.name}`"))
            for f in df.schema.fields
        ])
        typed.write.option("ignoreNullFields", False).json(path)
    elif fmt == "md":
        lines = markdown_rows(df)
        head = df.sparkSession.createDataFrame([(l,) for l in markdown_header(df).split("\n")], "value string")
        head.coalesce(1).write.mode("append").text(f"{path}/part=0-header")
        lines.write.mode("append").text(f"{path}/part=1-rows")
    else:
        raise ValueError(f"unsupported output format: {fmt}")
