"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 48-bit hashes of a text's shingles (five lower-cased words; a
shorter text is one shingle). Sketches of parts merge into that of the whole. From two sketches follow resemblance
and containment, from one the number of distinct shingles.

Defined results: null and empty texts, and texts of white space alone, have an empty sketch; two empty sketches resemble
each other by 1, an empty and another one by 0; equal texts have equal sketches; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.tables import fresh

K = 128
WORDS = 5
BITS = 48
BLOCKS_PER_PARTITION = 4


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word shingles of a text, in order."""
    mask = F.lit((1 << BITS) - 1)
    each = F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""), lambda w: F.xxhash64(w))
    return bound(each, lambda h: F.when(F.size(h) >= words, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*(h[i + j] for j in range(words))).bitwiseAND(mask))
    ).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(mask))).otherwise(F.array().cast("array<bigint>")))


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all: that share among the k smallest of both."""
    return bound(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal text, twelve digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def merged_by(df: DataFrame, keys: list[str], sketch_column: str, out: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of all parts of each key. Parts are merged before the shuffle; a hot key stays one row of k hashes per task."""
    h = fresh(df, "hash")[0]
    exploded = df.select(*keys, F.explode(sketch_column).alias(h)).distinct()
    w = Window.partitionBy(*keys).orderBy(h)
    n = fresh(exploded, "n")[0]
    low = exploded.withColumn(n, F.row_number().over(w)).where(F.col(n) <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list(h)).alias(out))


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are smaller than ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
    return F.transform(F.array(F.array(*map(F.lit, bounds))), lambda b: F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.element_at(b, F.least(at + s, F.lit(len(bounds)))) < value), at + s).otherwise(at)))[0]


def with_next(docs: DataFrame, id_column: str, columns: dict[str, Column], derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each document with columns of the next one in ascending id order (after the last one: the first).

    Ids are cut into blocks of about as many rows, so no task sorts the table; a block also gets a copy of the first
    document of the next block. Only as many ids as there are blocks reach the driver. ``columns``: new names and what they
    hold of the next document; ``derive`` adds columns before a second round of ``columns`` whose names begin with "next_of_".
    """
    spark = docs.sparkSession
    block, copy = fresh(docs, "block", "copy")
    n = BLOCKS_PER_PARTITION * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ",".join(str(i / n) for i in range(1, n))
    bounds = sorted(set(docs.select(F.expr(f"percentile_approx(`{id_column}`, array({cuts}), 20000)").alias("b")).first()[0] or []))
    number = F.coalesce(_below(bounds, F.col(id_column)), F.lit(0)).cast("int")
    firsts = docs.groupBy(number.alias(block)).agg(F.min(id_column)).orderBy(block).collect()  # one row per block
    placed = docs.withColumns({block: number, copy: F.lit(0)})
    if firsts:
        before = [firsts[i - 1][0] for i in range(len(firsts))]
        heads = spark.createDataFrame([(b, f[1], int(i == 0)) for i, (b, f) in enumerate(zip(before, firsts))], "b int, first long, around int")
        copies = docs.join(F.broadcast(heads), F.col(id_column).eqNullSafe(F.col("first"))).select(*docs.columns, F.col("b").alias(block), (F.col("around") + 1).alias(copy))
        placed = placed.unionByName(copies)
    order = Window.partitionBy(block).orderBy(copy, F.col(id_column).asc_nulls_first(), *(c for c in docs.columns if c != id_column))
    out = placed.withColumns({k: F.lead(v).over(order) for k, v in columns.items() if not k.startswith("next_of_")})
    if derive:
        out = derive(out)
    out = out.withColumns({k: F.lead(v).over(order) for k, v in columns.items() if k.startswith("next_of_")})
    return out.where(F.col(copy) == 0).drop(block, copy)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The query: sketches of all texts and of their edited forms, and the likeness of neighbours."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def derive(df: DataFrame) -> DataFrame:
        n = F.char_length("text")
        cut = F.floor(n / 4).cast("int")
        return df.select(*(c for c in df.columns if c not in ("_next_text",)), n.cast("long").alias("n_chars"), sketch(F.col("text")).alias("a"),
                         F.concat(F.substr("text", F.lit(1), n - cut), F.substr("_next_text", F.lit(1), cut)).alias("edited"))

    both = with_next(plain, "doc_id", {"_next_text": F.col("text"), "next_of_a": F.col("a")}, derive)
    found = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", sketch(F.col("edited")).alias("b"), "next_of_a")
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
                        resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("next_of_a")).alias("near_next"),
                        F.round(distinct_shingles(F.col("a"))).cast("long").alias("n_shingles"))
