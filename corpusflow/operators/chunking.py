"""Chunks of texts: fixed windows, three levels, Markdown sections, merging, ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules
from corpusflow.functions import text as tx


def chunk_id(filename: Column, page: Column, level: int | Column, index: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat(filename, F.lit("::p"), page.cast("string"), F.lit("::l"), level.cast("string"), F.lit("::"), index.cast("string"))


def file_columns(path: Column) -> list[Column]:
    """Source path, file name and extension of a path (with ``/`` between folders)."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(p, "/"), -1)
    return [p.alias("_source"), name.alias("_file_name"), F.regexp_extract(name, r"[^.](\.[^.]+)$", 1).alias("_extension")]


def fixed_windows(docs: DataFrame, id_col: str, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """Windows of ``size`` characters that share ``overlap`` with the one before; whole texts, no UDF.

    Output: the other columns, chunk_idx, start_index, text. The last window is the first one to reach the end.
    """
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = docs.where(n > 0).select("*", F.explode_outer(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    at = F.col("chunk_idx") * step
    keep = [c for c in docs.columns if c != text_col]
    return starts.select(
        *keep, F.col("chunk_idx").cast("long").alias("chunk_idx"), at.cast("long").alias("start_index"),
        F.substring(F.col(text_col), at + 1, F.lit(size)).alias("text"))


def split_with_offsets(text: str, size: int, overlap: int, separators=rules.CHUNK_SEPARATORS) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters, cut after the strongest separator that fits.

    Each next span starts up to ``overlap`` characters back, at a separator when there is one.
    Together the spans cover the text without gaps.
    """
    spans, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + size)
        if end < n:
            for sep in separators:
                if not sep:
                    break
                cut = text.rfind(sep, start + overlap + 1, end)
                if cut > start + overlap:
                    end = min(end, cut + len(sep))
                    break
        spans.append((start, end))
        if end >= n:
            break
        back = max(start + 1, end - overlap)
        for sep in separators:
            if not sep:
                break
            cut = text.find(sep, back, end)
            if cut >= 0 and cut + len(sep) < end:
                back = cut + len(sep)
                break
        start = back
    return spans


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start_index", T.LongType()), T.StructField("stop", T.LongType())]))


def recursive_split(docs: DataFrame, id_col: str, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """(id, chunk_idx, start_index, text): spans of at most ``size`` characters, cut at the strongest separator that fits.

    Only the spans come from Python, in Arrow batches; the texts are cut in the JVM.
    """
    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start_index": a, "stop": b} for a, b in split_with_offsets(t, size, overlap)] if t else [])

    ex = docs.select(id_col, text_col, F.posexplode(spans(F.col(text_col))).alias("chunk_idx", "s"))
    return ex.select(id_col, F.col("chunk_idx").cast("long").alias("chunk_idx"), "s.start_index",
                     F.substr(text_col, F.col("s.start_index") + 1, F.col("s.stop") - F.col("s.start_index")).alias("text"))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    piece = text[a:b]
    lead = len(piece) - len(piece.lstrip())
    return a + lead, a + len(piece.rstrip())


CHUNK_TYPE = T.ArrayType(T.StructType([
    T.StructField("chunk_level", T.IntegerType()),
    *[T.StructField(n, T.LongType()) for n in ("level_idx", "parent_idx", "root_idx", "start_index")],
    T.StructField("text", T.StringType()),
]))


@F.pandas_udf(CHUNK_TYPE)
def _three_levels(texts: pd.Series) -> pd.Series:
    (s1, o1), (s2, o2), (s3, o3) = rules.CHUNK_LEVELS

    def pieces(text, lo, hi, size, overlap):
        for a, b in split_with_offsets(text[lo:hi], size, overlap):
            a, b = _trimmed(text, lo + a, lo + b)
            if a < b:
                yield a, b

    def one(text):
        out, n = [], [0, 0, 0]
        for a1, b1 in pieces(text, 0, len(text), s1, o1):
            i1 = n[0]
            n[0] += 1
            out.append((1, i1, None, i1, a1, text[a1:b1]))
            for a2, b2 in pieces(text, a1, b1, s2, o2):
                i2 = n[1]
                n[1] += 1
                out.append((2, i2, i1, i1, a2, text[a2:b2]))
                for a3, b3 in pieces(text, a2, b2, s3, o3):
                    out.append((3, n[2], i2, i1, a3, text[a3:b3]))
                    n[2] += 1
        keys = ("chunk_level", "level_idx", "parent_idx", "root_idx", "start_index", "text")
        return [dict(zip(keys, r)) for r in out]

    return texts.map(lambda t: one(t) if t else [])


def three_levels(docs: DataFrame, filename: str, page: str = "page_number", text_col: str = "text") -> DataFrame:
    """Chunks of about 2000, 1000 and 500 characters with parent and root ids and real offsets.

    Row-local: documents are spread by Spark and nothing is shuffled. ``chunk_idx`` runs through
    all levels of a document in reading order.
    """
    keep = [c for c in docs.columns if c != text_col]
    ex = docs.select(*keep, F.posexplode(_three_levels(tx.strip(F.col(text_col)))).alias("chunk_idx", "c"))
    f, p = F.col(filename), F.col(page)
    lvl = F.col("c.chunk_level")
    parent = F.when(lvl > 1, chunk_id(f, p, lvl - 1, F.col("c.parent_idx"))).otherwise("")
    return ex.select(
        *keep, F.col("chunk_idx").cast("long").alias("chunk_idx"), lvl.alias("chunk_level"),
        chunk_id(f, p, lvl, F.col("c.level_idx")).alias("chunk_id"), parent.alias("parent_chunk_id"),
        chunk_id(f, p, 1, F.col("c.root_idx")).alias("root_chunk_id"),
        F.col("c.start_index").alias("start_index"), F.col("c.text").alias("text"))


def markdown_sections(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Sections that start at ``#`` and ``##`` lines, with both headings carried down.

    Row-local array code: the text is cut before ``#`` lines, each of those parts before ``##`` lines, so a section finds both
    headings in its own part and the work is linear in the text.
    """
    # header lines outside of code fences start a section; the marks are code points that no text may hold
    part, sub = "\ufdd0", "\ufdd1"
    fenced = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n(?=```)", -1)
    # every second piece begins with an opening fence
    mark = lambda p: F.regexp_replace(F.regexp_replace(p, r"\n(?=# )", "\n" + part), r"\n(?=## )", "\n" + sub)
    marked = F.array_join(F.transform(fenced, lambda p, i: F.when(i % 2 == 0, mark(p)).otherwise(p)), "\n")
    h1 = lambda s: F.trim(F.regexp_extract(s, r"^# ([^\n]*)", 1))
    h2 = lambda s: F.trim(F.regexp_extract(s, r"^## ([^\n]*)", 1))

    bodies = lambda p: F.filter(F.transform(F.split(p, sub), lambda s: tx.strip(s)), lambda s: s != "")
    headed = lambda b: F.struct(F.coalesce(h1(F.try_element_at(b, F.lit(1))), F.lit("")).alias("h1"), b.alias("bodies"))
    groups = F.transform(F.transform(F.split(marked, part), bodies), headed)
    cut = F.flatten(F.transform(groups, lambda g: F.transform(g["bodies"], lambda s: F.struct(g["h1"].alias("h1"), h2(s).alias("h2"), s.alias("body")))))
    return docs.select(F.col(id_col), F.posexplode(cut).alias("section", "s")).select(
        id_col, F.col("section").cast("long").alias("section"), "s.h1", "s.h2", F.col("s.body").alias("text"))


def merge_small(chunks: DataFrame, group: str, order: str, min_size: int = 300, max_size: int = 1000) -> DataFrame:
    """Append a chunk shorter than ``min_size`` to the one before while that is below ``max_size``.

    The rule looks at the merged length so far, so it is a fold along a document's chunks. Only lengths
    are folded; texts are joined per resulting group.
    """
    lens = chunks.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.length("text").alias("n")))).alias("l"))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (x["n"] < min_size) & (last["len"] < max_size)
        row = F.struct(
            x["o"].cast("long").alias("o"),
            F.when(joins, last["g"]).otherwise(F.coalesce(last["g"], F.lit(-1)) + 1).alias("g"),
            F.when(joins, last["len"] + 2 + x["n"]).otherwise(x["n"]).alias("len"))
        return F.concat(acc, F.array(row))

    empty = F.array().cast("array<struct<o:bigint,g:int,len:int>>")
    ids = lens.select(group, F.explode(F.aggregate("l", empty, step)).alias("r")).select(group, F.col("r.o").alias(order), F.col("r.g").alias("merged_idx"))
    return chunks.join(ids, [group, order]).groupBy(group, "merged_idx").agg(
        F.count("*").alias("n_parts"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s["t"]), "\n\n").alias("text"))
