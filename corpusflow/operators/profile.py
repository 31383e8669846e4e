"""Profiles of a table: schema and fill counts, numeric and categorical summaries, token scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusflow.functions.skew import in_slices, running, top_k

QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
ERROR_TOKENS = ("#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "text" if isinstance(t, T.StringType) else "other"


def inspect(df: DataFrame) -> DataFrame:
    """One row per column: position, kind, row count and non-null count; one pass over the data."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(_kind(f.dataType)).alias("kind"),
                F.col("_n").alias("n_rows"),
                F.col(f.name).alias("non_null"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(cells))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, columns: list[str], type_: str) -> DataFrame:
    return df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(type_).alias("value")) for c in columns]))
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Count, nulls, mean, sample deviation, extremes and exact interpolated quartiles per column.

    Values are counted first; the running counts that locate a quartile are built in slices of about equal numbers of
    distinct values (:func:`in_slices`), so one far value can't put all others into one task.
    """
    long = _long(df, columns or numeric_columns(df), "double")
    stats = long.groupBy("column_name").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    hist = long.where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("c"))
    hist = in_slices(hist, ["column_name", "value"], "value-counts", slices=slices)
    # the slices that hold the quartiles' neighbours, at most six a column, are found by their totals and sorted alone
    places = []
    for name, q in QUANTILES.items():
        pos = (F.col("n") - 1) * q
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            places.append(F.struct(F.lit(f"{name}_{side}").alias("place"), at.alias("at")))
    wanted = stats.select("column_name", F.inline(F.array(*places)))  # six rows a column
    order = W.partitionBy("column_name").orderBy("_slice")
    totals = hist.groupBy("column_name", "_slice").agg(F.sum("c").alias("t")).withColumn("before", F.sum("t").over(order) - F.col("t"))
    within = totals.join(wanted, "column_name").where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("t")))
    within = within.groupBy("column_name", "_slice").agg(F.collect_list(F.struct("place", (F.col("at") - F.col("before")).alias("at"))).alias("places"))
    cum = hist.join(F.broadcast(within), ["column_name", "_slice"]).withColumn(
        "upto", F.sum("c").over(W.partitionBy("column_name", "_slice").orderBy("value")))
    cum = cum.select("column_name", "value", "c", "upto", F.inline("places")).where((F.col("upto") - F.col("c") <= F.col("at")) & (F.col("at") < F.col("upto")))
    found = cum.groupBy("column_name").agg(
        *[F.max(F.when(F.col("place") == n, F.col("value"))).alias(n) for n in (f"{q}_{side}" for q in QUANTILES for side in ("lo", "hi"))])
    out = stats.join(found, "column_name")
    cols = ["column_name", "n", "nulls", "mean", "std", "min"]
    res = [F.col(c) for c in cols]
    for name, q in QUANTILES.items():
        pos = (F.col("n") - 1) * q
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        res.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*res, "max")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency of every value per column, nulls included as null."""
    return _long(df, columns, "string").groupBy("column_name", "value").agg(F.count("*").alias("freq"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, distinct count, most frequent value (ties: smallest) and nulls per column."""
    vc = value_counts(df, columns or text_columns(df))
    known = F.col("value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("freq")).alias("f"), F.col("value").alias("v"))))
    return vc.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(known, F.col("freq"))), F.lit(0)).alias("n"),
        F.count_if(known).alias("n_unique"),
        best["v"].alias("top"),
        F.coalesce(F.sum(F.when(~known, F.col("freq"))), F.lit(0)).alias("nulls"),
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column with their share of all rows."""
    vc = value_counts(df, columns or text_columns(df))
    total = vc.groupBy("column_name").agg(F.sum("freq").alias("n_rows"))
    best = top_k(vc.where("value is not null"), ["column_name"], [F.desc("freq"), F.asc("value")], k)
    return best.join(total, "column_name").select(
        "column_name", "rank", "value", "freq", F.round(F.col("freq") / F.col("n_rows") * 100, 4).alias("pct")
    )


def value_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency and share of all rows of every value per column, nulls included."""
    vc = value_counts(df, columns)
    total = vc.groupBy("column_name").agg(F.sum("freq").alias("_n"))
    return vc.join(total, "column_name").select("column_name", "value", "freq", F.round(F.col("freq") / F.col("_n") * 100, 4).alias("pct"))


def sample_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by a key; every task keeps ``n`` rows."""
    return df.orderBy(order).limit(n)


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count_distinct(column).alias("n_distinct"), F.min(column).alias("first"), F.max(column).alias("last")
    )


def running_total_and_rank(df: DataFrame, key: str, time: str, amount: str, row_id: str) -> DataFrame:
    """Running total by time (peers share it, as in SQL's default frame) and rank by amount, per key.

    Both are built on sums per (key, value), in slices of the order (:func:`running`). The slices hold about equal
    numbers of these sums (:func:`in_slices`), so a hot key is dealt over many.
    """
    per_time = df.groupBy(key, time).agg(F.sum(F.col(amount).cast("decimal(38,12)")).alias("_a"))
    per_time = in_slices(per_time, [key, time], "sums-by-time")
    totals = running(per_time, [key], F.col("_slice"), [time], {"running_total": F.col("_a")}).drop("_slice")
    per_amount = in_slices(df.groupBy(key, amount).agg(F.count("*").alias("_c")), [key, amount], "counts-by-amount")
    ranks = running(
        per_amount, [key], F.col("_slice"), [F.desc(amount)], {"_upto": F.col("_c")}, reverse=True
    ).select(key, amount, (F.col("_upto") - F.col("_c") + 1).alias("amount_rank"))
    return (
        df.select(row_id, key, time, amount)
        .join(totals.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col("running_total").cast("double").alias("running_total")),
              F.col(key).eqNullSafe(F.col("_k")) & F.col(time).eqNullSafe(F.col("_t"))).drop("_k", "_t")
        .join(ranks.select(F.col(key).alias("_k"), F.col(amount).alias("_v"), "amount_rank"),
              F.col(key).eqNullSafe(F.col("_k")) & F.col(amount).eqNullSafe(F.col("_v"))).drop("_k", "_v")
    )


def token_scan(df: DataFrame, row_id: str, tokens=ERROR_TOKENS, columns: list[str] | None = None, first: int = 20) -> DataFrame:
    """Per token: how many text cells hold it, and its first locations (row id, column)."""
    columns = columns or text_columns(df)
    cells = df.select(
        F.col(row_id).alias("row_id"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])),
    )
    hit = F.array_compact(F.array(*[F.when(F.contains(F.col("value"), F.lit(t)), F.lit(t)) for t in tokens]))
    hits = cells.select("row_id", "column_name", F.explode(hit).alias("token"))
    counts = hits.groupBy("token").agg(F.count("*").alias("n_cells"))
    places = top_k(hits, ["token"], [F.asc("row_id"), F.asc("column_name")], first)
    listed = places.groupBy("token").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("row_id", "column_name"))),
                        lambda s: F.concat_ws(":", s["row_id"].cast("string"), s["column_name"])), ",").alias("locations")
    )
    return counts.join(listed, "token")


def content_set_hash(df: DataFrame, key: str, content: Column) -> DataFrame:
    """One hash for a set of files: hashes combined in a tree, so no list of all files is built."""
    leaf = df.select(F.sha2(F.col(key).cast("string"), 256).alias("k"), F.sha2(content, 256).alias("h"))
    for width in (4, 2, 0):
        leaf = (
            leaf.groupBy(F.substring("k", 1, width).alias("p"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), "").alias("h"))
            .select(F.col("p").alias("k"), F.sha2(F.col("h"), 256).alias("h"))
        )
    return leaf.select(F.col("h").alias("set_hash"))
