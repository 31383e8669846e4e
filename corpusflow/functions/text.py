"""Column helpers for text; all of them stay inside generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import rules

BLANKS = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Trim white space at both ends (``trim`` alone only cuts blanks)."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Drop NUL, collapse blanks, keep at most one empty line in a row, trim."""
    c = F.replace(c, F.lit("\x00"), F.lit(""))
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(c, r"\n\s*\n\s*", "\n\n"))


def preview(c: Column, n: int, lo: int = 1, hi: int = 20000) -> Column:
    """The text, or its first ``n`` characters and ``...`` when it is longer."""
    n = max(lo, min(int(n), hi))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(rstrip(F.substring(c, 1, n)), F.lit("...")))


def rough_tokens(c: Column) -> Column:
    """Character based token estimate: half the length, at least one, zero for empty."""
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).cast("long")


def cache_key_text(c: Column) -> Column:
    """Case- and space-insensitive form of a question."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def index_characters(c: Column) -> Column:
    """Lower-case text in which everything that cannot be part of an index term is a blank."""
    c = F.lower(strip(c))
    for phrase in rules.BM25_PHRASES:
        c = F.replace(c, F.lit(phrase), F.lit(phrase.replace(" ", "_")))
    # everything but 一-鿿 a-z 0-9 _ - . as ranges: Java matches them several times faster than the negated class
    return F.regexp_replace(c, r"[\x00-,/:-^`{-\u4dff\ua000-\x{10ffff}]+", " ")


_WORD = re.compile(r"[一-鿿a-z0-9_\-.]+")


def index_words(text: str) -> list[str]:
    """Blank-free pieces of a text, the words of :func:`index_characters`."""
    text = text.strip().lower()
    if " usage" in text:
        for phrase in rules.BM25_PHRASES:
            text = text.replace(phrase, phrase.replace(" ", "_"))
    return _WORD.findall(text)


_PART = re.compile("[一-鿿]+|[^一-鿿]+")
_SEPARATORS = re.compile(r"[_\-.]{2,}")
_STOP_WORDS = frozenset(rules.BM25_STOP_WORDS)


def index_pieces(word: str) -> list[str]:
    """Index terms of one blank-free piece of :func:`index_characters`; the Python twin of :func:`index_text`."""
    if word.isascii() and word.isalnum():  # most words have nothing to take apart
        return [] if word in _STOP_WORDS or (len(word) == 1 and word.isalpha()) else [word]
    out = []
    for part in _PART.findall(word):
        if "一" <= part[0] <= "鿿":
            out.extend([part] if len(part) == 1 else [part[i:i + 2] for i in range(len(part) - 1)])
            continue
        part = _SEPARATORS.sub("_", part).strip("_.-")
        if part and part not in _STOP_WORDS and not (len(part) == 1 and part.isalpha()):
            out.append(part)
    return out


def index_text(c: Column) -> Column:
    """Index terms of a text, separated by single blanks.

    CJK runs become overlapping character pairs (no dictionary segmenter is needed);
    other terms are runs of ``a-z0-9_-.`` without separators at their ends.
    """
    c = index_characters(c)
    han = r"[一-鿿]"
    c = F.regexp_replace(c, f"({han})(?=({han}))|(?<={han}){han}(?!{han})", " $1$2 ")
    c = F.regexp_replace(c, r"[_\-.]{2,}", "_")
    c = F.regexp_replace(c, r"(?<![^ ])[_\-.]+|[_\-.]+(?![^ ])", "")
    stop = "|".join(rules.BM25_STOP_WORDS)
    c = F.regexp_replace(c, f"(?<![^ ])(?:{stop}|[a-z])(?![^ ])", "")
    return F.trim(F.regexp_replace(c, " +", " "))


def index_terms(c: Column) -> Column:
    """:func:`index_text` as an array (empty for a text without terms)."""
    return F.array_remove(F.split(index_text(c), " "), "")


def keyword_text(c: Column) -> Column:
    """Lower-case words of two or more characters that are no stop words, separated by single blanks."""
    c = F.regexp_replace(c, r"(?<![0-9A-Za-z_])10\.\d{4,9}/[^\s\"<>]*[0-9A-Za-z_]", " ")
    c = F.regexp_replace(c, r"https?://\S+", " ")
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")
    han = r"[一-鿿]"
    c = F.regexp_replace(c, f"({han})(?=({han}))|(?<={han}){han}(?!{han})", " $1$2 ")
    stop = "|".join(rules.KEYWORD_STOP_WORDS)
    c = F.regexp_replace(c, f"(?<![^ ])(?:{stop}|[^ ])(?![^ ])", "")
    return F.trim(F.regexp_replace(c, " +", " "))


def keyword_terms(c: Column) -> Column:
    """:func:`keyword_text` as an array (empty for a text without words)."""
    return F.array_remove(F.split(keyword_text(c), " "), "")


def word_set(c: Column) -> Column:
    """Distinct white-space separated lower-case words."""
    return F.array_remove(F.array_distinct(F.split(collapse(F.lower(c)), " ")), "")


def contains_any(c: Column, words) -> Column:
    """True when the lower-case text holds any of the (lower-case) words."""
    words = list(words)
    if len(words) > 4:  # one pattern keeps the generated code small
        return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return F.coalesce(out, F.lit(False))


def first_match(rules_in_order, default) -> Column:
    """``[(condition, value), ...]`` as one CASE expression; the first true rule wins."""
    out = None
    for cond, value in rules_in_order:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def first_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), 1)
