"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.session import materialize

HOT_SHARE = 10_000  # a key with more than one ten-thousandth of all rows is hot; there are fewer than that many


def salted_join(facts: DataFrame, dim: DataFrame, key: str, weight: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join many ``facts`` to the one row per key of ``dim`` without a hot partition.

    ``weight`` is the number of fact rows a key of ``dim`` meets. Hot keys are fewer than ``HOT_SHARE`` at any scale, so
    their rows of ``dim`` are broadcast and hot facts aren't shuffled by their key: having found their row they are
    dealt by ``spread`` in the join of the other keys. Facts are read once.
    """
    values = [c for c in dim.columns if c != key]
    total = dim.agg(F.sum(weight).alias("t")).scalar()
    is_hot = F.coalesce(F.col(weight) * HOT_SHARE > total, F.lit(False))
    hot = dim.where(is_hot).select(F.col(key).alias("_hot"), F.struct(*values).alias("_a"))
    # a literal would be folded into a condition on the facts alone, and the salt would be lost as a join key
    place = F.when(F.coalesce(F.col(weight), F.lit(0)) >= 0, -1).otherwise(-2)
    cold = dim.where(~is_hot).select(F.col(key).alias("_cold"), place.alias("_place"), F.struct(*values).alias("_b"))
    first = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    first = first.withColumn("_salt", F.when(F.col("_hot").isNull(), -1).otherwise(F.pmod(spread, F.lit(1 << 20)).cast("int")))
    both = first.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_place")), "left").withColumn("_row", F.coalesce("_a", "_b"))
    if how == "inner":
        both = both.where("_hot is not null or _cold is not null")
    return both.select(*facts.columns, *(F.col(f"_row.{c}").alias(c) for c in values))


def first_per_key(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; an aggregate, so it combines before the shuffle."""
    names = df.columns
    rest = [c for c in names if c not in order]
    keyed = df.select(*[k if isinstance(k, Column) else F.col(k) for k in keys], F.struct(*order, *rest).alias("_row"))
    key_names = keyed.columns[:-1]
    best = keyed.groupBy(*key_names).agg(F.min("_row").alias("_row"))
    return best.select([F.col(f"_row.{c}").alias(c) for c in names])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their rank.

    Spark limits every group inside each map task before the shuffle (WindowGroupLimit),
    so a hot key sends at most ``k`` rows per task.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def distinct_top_k(df: DataFrame, keys: list[str], value: str, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` smallest distinct values of ``value`` per key with their rank; ``df`` has no other columns.

    The tasks limit their groups before the shuffle as in :func:`top_k`, so equal rows are only told apart among what is left.
    """
    near = df.withColumn("_dense", F.dense_rank().over(W.partitionBy(*keys).orderBy(value))).where(F.col("_dense") <= k).drop("_dense")
    return near.distinct().withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(value)))


def in_slices(df: DataFrame, order: list[str], label: str, name: str = "_slice", slices: int | None = None) -> DataFrame:
    """``df`` with a slice number that grows with ``order``, written to the shared folder.

    Spark samples the rows for its range partitions, so the slices hold about equal numbers of rows whatever the range of the
    values, and are as many as ``slices`` says, else ``spark.sql.shuffle.partitions``. The number is written, as a lost task that ran again could
    sample others. Rows equal in ``order`` share a slice: aggregate them first.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), label)


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    sums: dict[str, Column],
    reverse: bool = False,
) -> DataFrame:
    """Running sums per key, in two levels so that no group is sorted in one task.

    ``bucket`` maps a row to a slice of the order (it must grow with ``order``). Slice totals
    are added up first, then each slice is summed on its own and shifted by what came before.
    ``sums`` names the outputs; a sum of ``lit(1)`` gives the row number. Null values add nothing.
    """
    df = df.withColumn("_b", bucket)
    tmp = {n: f"_v_{n}" for n in sums}
    for n, c in sums.items():
        df = df.withColumn(tmp[n], c)
    slices = df.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"{v}_t") for v in tmp.values()])
    ws = W.partitionBy(*keys).orderBy(F.desc("_b") if reverse else F.asc("_b")).rowsBetween(W.unboundedPreceding, -1)
    before = slices.select(
        *keys, "_b", *[F.sum(f"{v}_t").over(ws).alias(f"{v}_p") for v in tmp.values()]
    )
    wi = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = df
    for n, v in tmp.items():
        inner = inner.withColumn(n, F.sum(v).over(wi))
    # a null key or order is a group like any other
    at = {k: f"_j_{i}" for i, k in enumerate([*keys, "_b"])}
    before = before.select(*[F.col(k).alias(j) for k, j in at.items()], *[f"{v}_p" for v in tmp.values()])
    same = F.lit(True)
    for k, j in at.items():
        same = same & F.col(k).eqNullSafe(F.col(j))
    out = inner.join(before, same).drop(*at.values())
    for n, v in tmp.items():
        # a sum is null only if there is no value so far, in this slice and before
        out = out.withColumn(n, F.coalesce(F.col(n) + F.col(f"{v}_p"), F.col(n), F.col(f"{v}_p")))
    return out.drop("_b", *tmp.values(), *[f"{v}_p" for v in tmp.values()])
