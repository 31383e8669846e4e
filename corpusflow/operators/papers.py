"""Paper and report tables: abstracts, DOIs, deduplication, quality scores, learnings, outlines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import first_per_key, in_slices, running, top_k
from corpusflow.operators.sparse import small_batches


def abstract_from_index(index: Column) -> Column:
    """Text from a map of word to positions."""
    pos = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.trim(F.array_join(F.transform(F.array_sort(pos), lambda s: s["w"]), " "))


def inverted_index(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The other columns and ``index``, word to positions: made where the text is read, no word leaves its row. A null text has none."""
    keep = [c for c in docs.columns if c not in (text, id_col)]
    schema = T.StructType([*(docs.schema[c] for c in (id_col, *keep)), T.StructField("index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            starts, words, ends, places = [], [], [0], []
            for t in b.column(b.num_columns - 1).to_pylist():
                found: dict[str, list[int]] = {}
                for i, w in enumerate(t.split(" ") if t else ()):
                    found.setdefault(w, []).append(i)
                starts.append(None if t is None else len(words))
                words.extend(found)
                for at in found.values():
                    places.extend(at)
                    ends.append(len(places))
            at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            maps = pa.MapArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), pa.array(words, pa.string()), at)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], maps], names=schema.names)

    return docs.select(id_col, *keep, tx.collapse(F.col(text)).alias("_words")).mapInArrow(index, schema)


def doi_from_url(url: Column) -> Column:
    """DOI of a preprint page (version cut off) or the DOI inside the URL, else empty."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    path = F.btrim(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    last = F.regexp_replace(F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".pdf"), F.lit("")), r"v[0-9]+$", "")
    found = F.rtrim(F.regexp_extract(url, r"(?:^|[^0-9A-Za-z_])(10\.[0-9]{4,9}/[^\s\"<>]+)", 1), F.lit(").,;"))
    return F.when(F.contains(host, F.lit("arxiv.org")), F.when(last != "", F.concat(F.lit("10.48550/arXiv."), last)).otherwise("")).otherwise(found)


def title_key(c: Column) -> Column:
    return F.lower(tx.strip(F.coalesce(c, F.lit(""))))


def dedup_titles(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per title and ``key`` in the given order; rows without a title all stay."""
    t = title_key(F.col("title"))
    named = first_per_key(rows.where(t != ""), [F.col(key).alias("_k"), t.alias("_t")], order)
    return named.unionByName(rows.where(t == ""))


def citation_pool(rows: DataFrame, key: str, order: str, max_papers: int = 5) -> DataFrame:
    """Distinct titles among a topic's first papers (1 to 10)."""
    n = max(1, min(int(max_papers or 5), 10))
    first = top_k(rows, [key], [F.asc(order)], n).drop("rank")
    return dedup_titles(first.where(title_key(F.col("title")) != ""), key, [order])


# ---- quality of a paper ----------------------------------------------------------


def section_signals(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    out = {n: tx.contains_any(low, ws) for n, ws in rules.SECTION_SIGNALS.items()}
    out["references"] = out["references"] | c.rlike(r"\[[0-9]{1,3}\]")
    return out


def rating_band(score: Column) -> Column:
    return F.when(score >= 8, "较强").when(score >= 6, "中等").otherwise("偏弱")


def paper_quality(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Heuristic review: score of at most 10, missing sections, bands, strengths and weaknesses."""
    t = docs.select(id_col, tx.strip(F.col(text)).alias("_t"))
    sig = section_signals(F.col("_t"))
    t = t.withColumns({f"_{n}": c for n, c in sig.items()})
    s = F.lit(4.0)
    for n in sig:
        s = s + F.when(F.col(f"_{n}"), 0.8).otherwise(0.0)
    s = s + F.when(F.length("_t") > 2500, 0.5).otherwise(0.0)
    s = s + F.when(tx.contains_any(F.lower("_t"), rules.ABLATION_WORDS), 0.5).otherwise(0.0)
    t = t.withColumn("score", F.round(F.least(s, F.lit(10.0)), 1)).withColumn("ok", F.length("_t") >= 80)
    has = ("method", "experiment", "references")
    pick = lambda yes: F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{n}") if yes else ~F.col(f"_{n}"), F.lit(n)) for n in has])), ",")
    sound = F.when(F.col("_experiment"), F.col("score")).otherwise(F.col("score") - 1)
    return t.select(
        id_col, "ok", F.when(F.col("ok"), F.col("score")).alias("score"),
        F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_{n}"), F.lit(n)) for n in sig])), ",").alias("missing_sections"),
        pick(True).alias("strengths"), pick(False).alias("weaknesses"),
        rating_band(F.col("score")).alias("novelty"), rating_band(sound).alias("soundness"))


# ---- learnings and reports --------------------------------------------------------


def source_learning(venue: Column, title: Column, abstract: Column, url: Column) -> Column:
    clean = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    v, t, a, u = clean(venue), clean(title), clean(abstract), clean(url)
    t = F.when(t == "", "来源").otherwise(t)
    a = F.when(F.length(a) > 120, F.concat(tx.rstrip(F.left(a, F.lit(120))), F.lit("..."))).otherwise(a)
    head = F.concat(F.when(v != "", F.concat(F.lit("["), v, F.lit("] "))).otherwise(""), t)
    return F.concat_ws(": ", head, F.nullif(a, F.lit("")), F.nullif(u, F.lit("")))


def branch_learnings(branches: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """Per branch (session_id, branch_id, goal): its first ``k`` learnings, distinct by abstract.

    ``sources``: session_id, branch_id, pos, venue, title, abstract, url. A branch without any gets one
    line saying so.
    """
    key = ["session_id", "branch_id"]
    l = sources.select(*key, "pos", source_learning(*[F.col(c) for c in ("venue", "title", "abstract", "url")]).alias("learning"), "abstract")
    dk = title_key(F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.col("learning")))
    d = first_per_key(l, [*[F.col(c).alias(f"_{c}") for c in key], dk.alias("_d")], ["pos"])
    best = top_k(d, key, [F.asc("pos")], k).select(*key, "rank", "learning")
    j = branches.join(best, key, "left")
    none = F.concat(F.col("goal"), F.lit("：暂无可用来源，需要继续检索。"))
    return j.select(*key, F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("learning", none).alias("learning"))


def global_learnings(learnings: DataFrame) -> DataFrame:
    """Distinct learnings per session, whatever their case, in branch order."""
    rows = learnings.where(tx.strip(F.col("learning")) != "")
    return first_per_key(rows.select("branch_id", "rank", "session_id", "learning"),
                         [F.col("session_id").alias("_s"), title_key(F.col("learning")).alias("_l")], ["branch_id", "rank"])


def report_counts(branches: DataFrame, sources: DataFrame, learnings: DataFrame) -> DataFrame:
    """Branches, sources and learnings per session."""
    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    return n(branches, "branch_count").join(n(sources, "source_count"), "session_id", "left").join(
        n(learnings, "learning_count"), "session_id", "left").fillna(0)


def report_quality(sessions: DataFrame, branches: DataFrame, sources: DataFrame, learnings: DataFrame, reports: DataFrame) -> DataFrame:
    """Issues, warnings and the verdict per session."""
    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    venue, url = F.lower(F.coalesce("venue", F.lit(""))), F.coalesce("url", F.lit(""))
    s = sources.groupBy("session_id").agg(
        F.count("*").alias("source_count"), F.count_if(venue == "github").alias("_gh"),
        F.count_if(~venue.isin("", "github") & F.startswith(url, F.lit("http"))).alias("_web"))
    j = sessions.join(s, "session_id", "left").join(n(branches, "branch_count"), "session_id", "left").join(
        n(learnings, "learning_count"), "session_id", "left").join(
        reports.select("session_id", F.length(tx.strip(F.col("report"))).alias("report_length")), "session_id", "left").fillna(0)
    c = F.col
    tags = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(t)) for cond, t in pairs])), ",")
    issues = tags([(c("source_count") == 0, "no_sources"), (c("branch_count") == 0, "no_branches"),
                   (c("learning_count") == 0, "no_learnings"), (c("report_length") == 0, "empty_report")])
    warnings = tags([((c("source_count") > 0) & (c("source_count") < 3), "few_sources"),
                     ((c("report_length") > 0) & (c("report_length") < 200), "short_report"),
                     (c("_gh") == 0, "no_repositories"), (c("_web") == 0, "no_web_results")])
    return j.select("session_id", (issues == "").alias("passed"), issues.alias("issues"), warnings.alias("warnings"),
                    "source_count", "branch_count", "learning_count", "report_length")


def references(sources: DataFrame) -> DataFrame:
    """Numbered distinct references per session in order of appearance, counted in slices of about equal numbers of rows."""
    d = dedup_titles(sources.where(title_key(F.col("title")) != ""), "session_id", ["branch_id", "pos"])
    return _numbered(d, ["branch_id", "pos"], "number")


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    return running(in_slices(rows, ["session_id", *order], name), ["session_id"], F.col("_slice"), order, {name: F.lit(1)}).drop("_slice")


def report_lines(sessions: DataFrame, learnings: DataFrame, sources: DataFrame) -> DataFrame:
    """Markdown reports as rows: session_id, section, ordinal, line. ``sessions``: session_id, title, answer.

    Sections: 0 title, 1 and 2 heading and learnings, 3 conclusion, 4 and 5 heading and references; those without rows are left
    out. A reference with a url and an answer may hold line breaks. No session is gathered, so a report may be of any length.
    """
    def fixed(rows: DataFrame, *lines) -> DataFrame:
        cells = [F.struct(F.lit(s).alias("section"), F.lit(o).cast("long").alias("ordinal"), t.alias("line")) for s, o, t in lines]
        return rows.select("session_id", F.inline(F.array(*cells)))

    known = lambda df: df.join(sessions.select("session_id"), "session_id", "left_semi")
    listed = lambda df, section, ordinal, line: df.select("session_id", F.lit(section).alias("section"), F.col(ordinal).cast("long").alias("ordinal"), line.alias("line"))
    kind = F.when(F.col("source").isin("github", "repository"), " [GitHub]").when(F.col("source").isin("web", "webpage"), " [Web]").otherwise("")
    opt = lambda c, a, b: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(a), c, F.lit(b))).otherwise("")
    ref = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), tx.strip(F.col("title")),
                   opt(F.col("authors"), " — ", ""), opt(F.col("year").cast("string"), " (", ")"), opt(F.col("url"), "\n    ", ""), kind)
    answer = F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit("本轮未产出有效研究结论。"))
    g = known(_numbered(global_learnings(learnings), ["branch_id", "rank"], "ordinal"))
    r = known(references(sources))
    title = F.concat(F.lit("# "), F.coalesce("title", F.lit("")))
    parts = [
        fixed(sessions, (0, 1, title), (0, 2, F.lit("")), (3, 1, F.lit("## 研究结论")), (3, 2, answer)),
        fixed(g.where("ordinal = 1"), (1, 1, F.lit("## 核心发现")), (3, 0, F.lit(""))),
        listed(g, 2, "ordinal", F.concat(F.lit("- "), F.col("learning"))),
        fixed(r.where("number = 1"), (4, 1, F.lit("")), (4, 2, F.lit("## 参考文献")), (4, 3, F.lit(""))),
        listed(r, 5, "number", ref),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_reports(lines: DataFrame, path: str) -> None:
    """Reports as JSON rows of session_id and line, range-sorted over the parts: read in order they are the texts."""
    lines.orderBy("session_id", "section", "ordinal").select("session_id", "line").write.mode("overwrite").json(path)


def report_markdown(sessions: DataFrame, learnings: DataFrame, sources: DataFrame) -> DataFrame:
    """One Markdown text per session, for reports that fit into a cell; :func:`report_lines` has no such bound."""
    lines = F.sort_array(F.collect_list(F.struct("section", "ordinal", "line")))
    text = F.array_join(F.transform(lines, lambda s: s["line"]), "\n")
    return report_lines(sessions, learnings, sources).groupBy("session_id").agg(F.concat(tx.strip(text), F.lit("\n")).alias("report"))


def paper_text(number: Column, max_abstract: int = 1600) -> Column:
    """Display text of a paper row (title, authors, venue, year, citation_count, url, abstract)."""
    c = F.col
    a = F.when(F.length("abstract") > max_abstract, F.concat(F.left("abstract", F.lit(max_abstract)), F.lit("..."))).otherwise(c("abstract"))
    opt = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(name), v))
    return F.concat_ws(
        "\n", F.concat(number.cast("string"), F.lit(". "), c("title")), F.concat(F.lit("Authors: "), c("authors")),
        F.trim(F.concat(F.lit("Venue/Year: "), c("venue"), F.lit(" "), c("year").cast("string"))),
        F.concat(F.lit("Citations: "), c("citation_count").cast("string")), opt("URL: ", c("url")), opt("Abstract: ", a))


def paper_list(papers: DataFrame, key: str, k: int) -> DataFrame:
    """One text per query with its best ``k`` papers (by rank)."""
    best = papers.where(F.col("rank") <= k).select(key, F.struct(F.col("rank"), paper_text(F.col("rank")).alias("t")).alias("s"))
    return best.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("paper_list"))


def compact_payload(papers: DataFrame, key: str) -> DataFrame:
    """The best three papers per query with abstracts of at most 280 characters."""
    a = tx.collapse(F.coalesce("abstract", F.lit("")))
    return papers.where("rank <= 3").select(
        key, "rank", "title", "year", "citation_count",
        F.when(F.length(a) <= 280, a).otherwise(F.concat(tx.rstrip(F.left(a, F.lit(280))), F.lit("..."))).alias("abstract"))


# ---- outlines and slides ------------------------------------------------------------

OUTLINE_FIELDS = ("snippet", "summary", "content", "title", "url", "file_path")


def is_noise(c: Column, noise_tokens=rules.SLIDE_PLACEHOLDERS) -> Column:
    low = F.lower(c)
    return (low == "") | low.rlike(r"^[{}\[]") | tx.contains_any(low, noise_tokens)


def outline_items(entries: DataFrame, key: str, order: str, fields=OUTLINE_FIELDS) -> DataFrame:
    """Sentences of the first filled field of every entry; noise dropped, distinct per key in order."""
    present = [f for f in fields if f in entries.columns]
    text = F.coalesce(*[F.nullif(tx.collapse(F.col(f)), F.lit("")) for f in present])
    raw = F.coalesce(*[F.when(tx.collapse(F.col(f)) != "", tx.collapse(F.col(f))) for f in present])
    parts = F.filter(F.transform(F.split(raw, "[。\n\r;；]+"), tx.strip), lambda p: p != "")
    rows = entries.where(text.isNotNull()).select(key, F.col(order).alias("_o"), F.posexplode_outer(parts).alias("_p", "item")).where("item is not null")
    rows = rows.where(~is_noise(F.col("item")))
    return first_per_key(rows, [F.col(key).alias("_k"), F.col("item").alias("_i")], ["_o", "_p"]).select(key, F.col("_o").alias(order), F.col("_p").alias("part"), "item")


def report_sections(reports: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, section, title, bullet, bullet text): second-level sections with their lines, row-local."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), r"\n[ \t]*(?=## )", "\n\x1e")
    secs = F.slice(F.split(marked, "\x1e"), F.lit(2), F.lit(1_000_000_000))
    s = reports.select(id_col, F.posexplode_outer(secs).alias("section", "_s")).where("_s is not null")
    lines = F.transform(F.split("_s", "\n"), tx.collapse)
    title = F.trim(F.substring(F.element_at(lines, 1), 4, 1_000_000))
    rest = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda l: (l != "") & ~l.rlike("^#"))
    bullets = F.transform(rest, lambda l: F.regexp_replace(l, r"^- ", ""))
    return s.where(title != "").select(id_col, "section", title.alias("title"), F.posexplode_outer(bullets).alias("bullet", "text"))


def layout(purpose: Column, n_items: Column, n_images: Column, text_length: Column, is_first: Column, is_last: Column) -> Column:
    """Layout class of a page by position, images, density and purpose."""
    return tx.first_match(
        [(is_first, "cover"), (is_last & tx.contains_any(purpose, rules.CLOSING_WORDS), "closing"),
         ((n_images > 0) & (n_items <= 3), "image_text"),
         ((n_items >= 4) | ((n_items >= 2) & (text_length >= 110)), "two_column"),
         (tx.contains_any(purpose, rules.OVERVIEW_WORDS), "overview")], "single_column_text")


def page_layouts(pages: DataFrame, deck: str, order: str) -> DataFrame:
    """Layout per page of a deck. First and last page come from an aggregate, not from a sort."""
    ends = pages.groupBy(deck).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    c = F.col
    lay = layout(c("purpose"), c("n_items"), c("n_images"), c("text_length"), c(order) == c("_a"), c(order) == c("_b"))
    return pages.join(ends, deck).withColumn("layout", lay).drop("_a", "_b")


def text_quality(lines: DataFrame, id_cols: list[str]) -> DataFrame:
    """Findings per text line. ``lines``: ids, part (title, bullet or manuscript), text."""
    t = tx.collapse(F.col("text"))
    low, n, part = F.lower(t), F.length(t), F.col("part")
    man = part == "manuscript"
    ph = F.when(man, tx.contains_any(low, (*rules.SLIDE_PLACEHOLDERS, *rules.MANUSCRIPT_PLACEHOLDERS))).otherwise(tx.contains_any(low, rules.SLIDE_PLACEHOLDERS))
    checks = [
        (ph & man, "warning", "internal_text"), (ph & ~man, "issue", "placeholder_text"),
        ((part == "bullet") & (n > 160), "issue", "long_bullet"), ((part == "title") & (n > 80), "warning", "long_title"),
        (man & (n > 220), "warning", "long_line"),
        (man & (F.contains(t, F.lit('{"')) | F.contains(t, F.lit('"}')) | F.contains(low, F.lit("{debug"))), "warning", "structured_text"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))) for cond, sev, code in checks]))
    return lines.where(t != "").select(*id_cols, "part", n.alias("length"), F.inline_outer(found)).where("code is not null")


def page_count_alignment(counts: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Whether all non-zero page counts of the artifacts agree with the first one."""
    first = F.col(columns[0])
    ok = F.lit(True)
    for c in columns:
        ok = ok & ((F.col(c) <= 0) | (F.col(c) == first))
    return counts.select(id_col, ok.alias("aligned"))
