"""Sparse text features of whole texts, computed once per distinct word of a task.

A word (lower-cased, between white space) gives the hashes of its character n-grams; a text's features are those of
its words. Everything is done on arrays: no loop over characters or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusflow.llm.vocab import ragged

EDGE = 1                      # code point that stands for both ends of a word
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the word number at each place, and the number of places of each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[\x09-\x0d]", " ")
    split = pc.split_pattern(plain, " ")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), counts


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two edges, and the length of each with its edges. Empty words have none."""
    joined = "".join([f"{chr(EDGE)}{w}{chr(EDGE)}" if w else "" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.fromiter((len(w) + 2 if w else 0 for w in words), np.int64, len(words))


def word_grams(words: list[str], orders: tuple[int, ...], whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each word, one word after the other, and their number per word.

    ``whole`` adds the word itself. An n-gram of the first letters is told from others by its edge.
    """
    codes, lens = word_codes(words)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(words), np.int64)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(n)  # places up to the end of the word
    h = np.zeros(n, np.uint64)
    out, who = [], []
    wide = codes.astype(np.uint64)
    for k in range(1, max(orders, default=0) + 1):
        h = h * _MULTIPLIER
        h[:n - k + 1] += wide[k - 1:] + np.uint64(7)
        if k in orders:
            ok = left >= k
            if k == 1:
                ok &= codes != EDGE
            out.append(mix(h[ok] + np.uint64(k)))
            who.append(owner[ok])
    if whole:
        starts = (np.cumsum(lens) - lens)[lens > 0]
        power = np.cumprod(np.full(int(lens.max()), _MULTIPLIER, np.uint64))
        out.append(mix(np.add.reduceat(wide * power[left - 1], starts)))
        who.append(np.flatnonzero(lens))
    who = np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return np.concatenate(out)[order], np.bincount(who, minlength=len(words))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values`` (rows), for runs of the given lengths; empty runs give zeros."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def distinct_per_text(number: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers (below ``size``) of each text and how many they are."""
    key = np.unique(np.repeat(np.arange(len(counts)), counts) * size + number)
    return key % size, np.bincount(key // size, minlength=len(counts))


def expand(flat: np.ndarray, lens: np.ndarray, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` named by ``index``, whose own runs have ``counts``: the values and their number per outer run."""
    values, n = ragged(flat, lens, index)
    return values, sums(n.astype(np.float64), counts).astype(np.int64)
