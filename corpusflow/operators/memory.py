"""Memories and notes: gates, types, deduplication, recall, index limits, change logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import first_per_key, salted_join, top_k
from corpusflow.operators.sparse import sparse_top_k
from corpusflow.session import materialize

WORD = r"0-9A-Za-z_一-鿿"


def _whole_words(words) -> str:
    """Any of the words, not inside a longer run of ASCII word characters or CJK."""
    return rf"(?:^|[^{WORD}])(?:" + "|".join(words) + rf")(?:[^{WORD}]|$)"


def is_low_value(c: Column) -> Column:
    t = tx.cache_key_text(c)
    return (F.length(t) < 10) | t.rlike(_whole_words(rules.LOW_VALUE))


def is_derivable(c: Column) -> Column:
    return tx.contains_any(F.lower(c), rules.DERIVABLE)


def memory_type(user: Column, assistant: Column) -> Column:
    t = F.lower(F.concat(user, F.lit(" "), assistant))
    return tx.first_match([(tx.contains_any(t, [w.lower() for w in ws]), n) for n, ws in rules.MEMORY_TYPES], "project")


def _short(c: Column, n: int) -> Column:
    t = tx.collapse(tx.strip(F.coalesce(c, F.lit(""))))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t)


def entry_texts(user: Column, type_: Column, as_of: str) -> list[Column]:
    """Title, description and body of a memory; the date is given, never the clock's."""
    advice = tx.first_match([(type_ == n, a) for n, a in rules.MEMORY_ADVICE.items()], "")
    body = F.concat_ws("\n", tx.strip(F.coalesce(user, F.lit(""))), F.lit(""), F.lit(f"**Why:** Extracted from conversation on {as_of}"), advice)
    return [_short(user, 60).alias("title"), F.concat(F.lit("["), type_, F.lit("] "), _short(user, 100)).alias("description"), body.alias("content")]


def norm_key(title: Column, content: Column) -> Column:
    """First 12 hex digits of the md5 over normalised title and content."""
    return F.left(F.md5(F.concat(tx.cache_key_text(title), F.lit("|"), tx.cache_key_text(content))), F.lit(12))


def _chars(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(c, ""), "")))


def duplicates(rows: DataFrame, id_col: str, title: str = "title", content: str = "content", threshold: float = 0.8, block: int = 1024) -> DataFrame:
    """Ids of rows with an earlier near copy: same hash, or same title and character Jaccard above the threshold.

    Rows are first reduced to distinct (title, character set): all later rows of a set are copies of its
    first. Sets are then compared by prefix filtering: two sets this similar must share a character among the
    few rarest of either and differ little in size, so (title, character, size band) is the join key. What follows the
    shared character bounds how much they can have in common (positional filter). A key with more than ``block`` sets is dealt
    into blocks that meet pairwise, so no task holds a hot title; pairs are judged inside the join and never leave it, only the
    ids that have an earlier copy do. Null titles or contents equal nothing.
    """
    n = rows.select(F.col(id_col).alias("id"), tx.cache_key_text(F.col(title)).alias("t"), _chars(tx.cache_key_text(F.col(content))).alias("s"))
    n = n.withColumn("sig", F.array_join("s", "")).where("t is not null and sig is not null")
    n = materialize(n.select("id", "t", "sig"), "titles")
    sets = materialize(n.groupBy("t", "sig").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "character-sets")
    key = F.struct("t", "sig")
    several = sets.where("copies > 1").select(key.alias("k"), "first", "copies")
    repeated = salted_join(n.select("id", key.alias("k")), several, "k", "copies", F.xxhash64("id")).where("id <> first").select("id")
    # characters from the rarest on; their table has a row per character in use, at most Unicode
    chars = sets.select("t", "first", F.explode(F.array_remove(F.split("sig", ""), "")).alias("c"))
    freq = chars.groupBy("c").agg(F.count("*").alias("f"))
    rare_first = F.transform(F.sort_array(F.collect_list(F.struct("f", "c"))), lambda x: x["c"])
    s = chars.join(F.broadcast(freq), "c").groupBy("t", "first").agg(rare_first.alias("s")).withColumn("n", F.size("s"))
    # a set of n characters shares at least one of its n - ceil(0.8 n) + 1 rarest with any set that similar
    head = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    # sizes of similar sets differ by at most the factor 1 / 0.8, so their bands are equal or neighbours
    band = F.floor(F.log("n") / math.log(1 / threshold))
    pre = materialize(s.select("t", "first", "s", "n", band.alias("band"), F.posexplode(head).alias("r", "c")), "prefixes")
    meet = F.struct("t", "c", "band").alias("k")
    a = pre.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).select(
        meet, F.col("first").alias("fa"), F.col("s").alias("sa"), F.col("n").alias("na"), F.col("r").alias("ra"))
    b = pre.select(meet, F.col("first").alias("fb"), F.col("s").alias("sb"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    a, b = _in_blocks(a, b, block)
    common = F.size(F.array_intersect("sa", "sb"))
    left = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    near = (F.col("fa") < F.col("fb")) & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    near = near & (left >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6)
    near = near & (common / (F.col("na") + F.col("nb") - common) > threshold)
    copies = a.join(b, ["k", "x", "y"]).where(near).select(F.col("fb").alias("id"))
    return repeated.unionByName(copies).distinct().select(F.col("id").alias(id_col))


def _in_blocks(a: DataFrame, b: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``k`` with block numbers ``x`` and ``y``: each pair of rows of a key meets in one (x, y), where
    about ``block`` rows of either side are."""
    counts = a.groupBy("k").agg(F.count("*").alias("na")).join(b.groupBy("k").agg(F.count("*").alias("nb")), "k")
    big = materialize(counts.where((F.col("na") > block) | (F.col("nb") > block)).select(
        "k", (F.col("na") + F.col("nb")).alias("w"), F.ceil(F.col("na") / block).alias("xs"), F.ceil(F.col("nb") / block).alias("ys")), "big-keys")

    none_big = big.isEmpty()

    def dealt(side: DataFrame, first: str, own: str, other: str) -> DataFrame:
        if none_big:  # every key is one block
            return side.withColumns({"x": F.lit(0), "y": F.lit(0)})
        h = F.xxhash64(first)
        out = salted_join(side, big, "k", "w", h, "left")
        parts = lambda c: F.coalesce(F.col(f"{c}s"), F.lit(1))
        out = out.withColumn(own, F.pmod(h, parts(own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1)))
        return out.drop("w", "xs", "ys")

    return dealt(a, "fa", "x", "y"), dealt(b, "fb", "y", "x")


def turns(messages: DataFrame, session: str, seq: str) -> DataFrame:
    """(session, seq, user_message, assistant_response): a user message with the answer right after it.

    The next message is found by an equi-join on the sequence number, so long sessions are not sorted.
    """
    u = messages.where("role = 'user'").select(session, seq, F.col("text").alias("user_message"))
    a = messages.where("role = 'assistant'").select(session, (F.col(seq) - 1).alias(seq), F.col("text").alias("assistant_response"))
    return u.join(a, [session, seq])


def memories_from_turns(t: DataFrame, as_of: str) -> DataFrame:
    """Turns that pass the gates, with type, title, description and body (duplicates not yet removed)."""
    both = F.concat("user_message", F.lit("\n"), "assistant_response")
    t = t.where(~is_low_value(F.col("user_message")) & ~is_derivable(both))
    t = t.withColumn("type", memory_type(F.col("user_message"), F.col("assistant_response")))
    return t.select("*", *entry_texts(F.col("user_message"), F.col("type"), as_of)).where("title <> '' and content <> ''")


def upsert_memories(store: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by normalised title: the latest content wins, the first type and description stay."""
    both = store.select("name", "description", "type", "content", "updated_at").unionByName(
        new.select("name", "description", "type", "content", "updated_at"))
    g = both.groupBy(tx.cache_key_text(F.col("name")).alias("_k")).agg(
        F.min_by(F.struct("name", "description", "type"), "updated_at").alias("f"),
        F.max_by("content", "updated_at").alias("content"), F.max("updated_at").alias("updated_at"))
    return g.select("f.name", "f.description", "f.type", "content", "updated_at")


def index_lines(rows: DataFrame, key: str, order: str, max_entries: int = rules.INDEX_MAX_ENTRIES, max_bytes: int = rules.INDEX_MAX_BYTES,
                header_bytes: int = 0) -> DataFrame:
    """Index lines per key, newest first, within the entry and byte limits, and how many were left out.

    A key of which no line fits has one row without a line, so its count isn't lost.
    """
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("filename"), F.lit(") — "), F.col("description"))
    top = top_k(rows.select(key, order, line.alias("line")), [key], [F.desc(order)], max_entries)
    w = W.partitionBy(key).orderBy("rank")
    used = top.withColumn("bytes", F.sum(F.octet_length("line") + 1).over(w))
    total = rows.groupBy(key).agg(F.count("*").alias("_n"))
    kept = used.where(F.col("bytes") <= max_bytes - header_bytes)
    kept = kept.withColumn("_k", F.count("*").over(W.partitionBy(key))).withColumnRenamed(key, "_key")
    return total.join(kept, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, order, "rank", "line", "bytes", (F.col("_n") - F.coalesce("_k", F.lit(0))).alias("omitted"))


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def recall(memories: DataFrame, queries: DataFrame, k: int = 3, memory_id: str = "memory_id") -> DataFrame:
    """(query_id, memory, score, rank): ten times the Jaccard overlap of words, best ``k`` per query."""
    m = memories.select(F.col(memory_id).alias("chunk_id"), words(F.concat_ws(" ", "title", "description")).alias("terms"))
    m = m.select("chunk_id", F.size("terms").alias("dl"), "terms", F.transform("terms", lambda t: F.lit(1.0)).alias("weights"))
    q = queries.select("query_id", words(F.col("text")).alias("w"))
    e = q.select("query_id", F.size("w").alias("qlen"), F.explode_outer("w").alias("term"), F.lit(1.0).alias("w")).where("term is not null")
    return sparse_top_k(m, materialize(e, "query-terms"), k, jaccard=True)


# ---- notes ---------------------------------------------------------------------


def filter_notes(notes: DataFrame, key: str, kinds=None, min_importance: float | None = None, limit: int | None = None) -> DataFrame:
    """Notes of the wanted kinds and importance, most important then newest first."""
    imp = F.coalesce(F.col("importance").cast("string").try_cast("double"), F.lit(0.0))
    n = notes.withColumn("_i", imp)
    if kinds is not None:
        n = n.where(F.trim("kind").isin(list(kinds)))
    if min_importance is not None:
        n = n.where(F.col("_i") >= min_importance)
    return top_k(n, [key], [F.desc("_i"), F.desc("updated_at"), F.asc("note_id")], limit or 2**31 - 1).drop("_i")


def is_high_value_note(title: Column, content: Column, kind: Column, importance: Column, tags: Column, pinned: Column,
                       min_importance: float = 0.65, word_bounds: bool = False) -> Column:
    """Whether a note is worth keeping. Fillers match as substrings unless ``word_bounds``."""
    t, c = (tx.strip(F.coalesce(x, F.lit(""))) for x in (title, content))
    both = tx.cache_key_text(F.concat(t, F.lit(" "), c))
    low = both.rlike(_whole_words(rules.LOW_VALUE_NOTES)) if word_bounds else tx.contains_any(both, rules.LOW_VALUE_NOTES)
    k = F.lower(tx.strip(F.coalesce(F.nullif(kind, F.lit("")), F.lit("note"))))
    imp = F.coalesce(importance.cast("double"), F.lit(0.0))
    tag_text = tx.cache_key_text(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    return tx.first_match([
        ((t == "") & (c == ""), False), (F.coalesce(pinned, F.lit(False)), True), (low, False),
        (k.isin(list(rules.HIGH_VALUE_KINDS)), (imp >= max(0.4, min_importance - 0.1)) | (F.length(c) >= 24)),
        (imp < min_importance, False), (tx.contains_any(both, rules.HIGH_VALUE_HINTS), True),
        ((F.length(c) >= 80) & (imp >= 0.8), True), (tx.contains_any(tag_text, rules.HIGH_VALUE_HINTS), True)], False)


def distinct_notes(notes: DataFrame, order: str) -> DataFrame:
    """The first note per normalised kind, title and content."""
    keys = [tx.cache_key_text(F.coalesce(c, F.lit(""))).alias(f"_k{i}") for i, c in enumerate(("kind", "title", "content"))]
    return first_per_key(notes, keys, [order])


def note_from_turn(t: DataFrame) -> DataFrame:
    """Note kind, importance, title and content for answered turns with a strong signal."""
    q, a = tx.collapse(tx.strip(F.coalesce("user_message", F.lit("")))), tx.collapse(tx.strip(F.coalesce("assistant_response", F.lit(""))))
    low = F.lower(F.concat(q, F.lit(" "), a))
    rule = lambda n, imp: F.struct(F.lit(n).alias("kind"), F.lit(imp).alias("importance"))
    long = (F.length(a) >= 220) & tx.contains_any(low, rules.NOTE_SUMMARY_WORDS)
    found = tx.first_match([*[(tx.contains_any(low, ws), rule(n, imp)) for n, imp, ws in rules.NOTE_RULES], (long, rule("summary", 0.7))],
                           F.lit(None).cast("struct<kind:string,importance:double>"))
    short = lambda c, n: F.when(F.length(c) > n, F.concat(tx.rstrip(F.left(c, F.lit(n - 3))), F.lit("..."))).otherwise(c)
    out = t.where(a != "").withColumn("_f", found).where("_f is not null").select("*", "_f.kind", "_f.importance").drop("_f")
    head = F.coalesce(F.nullif(q, F.lit("")), a)
    return out.select("*", F.concat("kind", F.lit(": "), short(head, 72)).alias("title"),
                      short(F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a), 1200).alias("content"))


def kind_to_type(kind: Column) -> Column:
    return tx.first_match([(kind == k, v) for k, v in rules.KIND_TO_TYPE.items()], "project")


def replay_notes(log: DataFrame) -> DataFrame:
    """Current notes from a change log (note_id, op add/update/delete, seq, title, content, created_at).

    The latest given title and content win, deleted notes are gone, creation time is the first one's.
    """
    g = log.groupBy("note_id").agg(
        F.max_by("op", "seq").alias("_op"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"),
        F.max_by("content", F.when(F.col("content").isNotNull(), F.col("seq"))).alias("content"),
        F.min("created_at").alias("created_at"), F.max("seq").alias("version"))
    return g.where("_op <> 'delete'").drop("_op")


def parse_frontmatter(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Memories from ``---`` blocks of ``key: value`` lines; bad types and missing fields are rejected."""
    ok = F.startswith(raw, F.lit("---"))
    parts = F.split(F.col(raw), "---", 3)
    block = F.transform(F.split(F.get(parts, F.lit(1)), "\n"), tx.strip)
    pairs = F.filter(block, lambda l: F.contains(l, F.lit(":")))
    get = lambda name: F.coalesce(tx.strip(F.regexp_extract(
        F.element_at(F.concat(F.array(F.lit("")), F.filter(pairs, lambda l: F.trim(F.substring_index(l, ":", 1)) == name)), -1), r"^[^:]*:(.*)$", 1)), F.lit(""))
    type_ = F.lower(get("type"))
    return files.where(ok & (F.size(parts) == 3)).select(
        *[c for c in files.columns if c != raw], get("name").alias("name"), get("description").alias("description"), type_.alias("type"),
        tx.strip(F.get(parts, F.lit(2))).alias("content"),
    ).where((F.col("name") != "") & (F.col("description") != "") & F.col("type").isin(*[n for n, _ in rules.MEMORY_TYPES]))
