"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST, 2 q)`` long, that no neighbouring word extends.
In a run, words q apart are equal over at least q places; so for q between 2 B - 1 and 4 B - 2 those places hold a whole block of B
words that starts at a multiple of B. For B = 2, 4, 8, ... each such block is slid over the window of words 2 B - 1 to 4 B - 2 places
behind it. The sum of squared differences of the word numbers, by convolution with a number-theoretic transform (integers modulo
a prime, no rounding), is zero where the block occurs again: a multiple of the prime can only add a place, never hide one. Such
a distance seeds a run, which is extended word by word on both sides; the extension compares word numbers and so settles what the seed promised.
Blocks that hold a word which doesn't occur again soon enough can't recur and are left out of the transforms. The texts of an
Arrow piece are one sequence with a word of its own between two texts, so no run leaves its text.

Defined results: null and empty texts and texts of blanks have no words and no run; a repeated row or id is a document of its own;
a text of any length is searched whole, in memory proportional to it; rows with a null id are searched like others (and never altered);
an empty table gives no rows; other columns are not read, whatever their names. Runs of equal length: the smallest start, then the smallest period is the greatest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusflow.llm.tables import pieces

LEAST = 12                      # words of the shortest run
SMALLEST = 2                    # block of the first scale, which also takes the periods below 2 B - 1
PRIME = np.uint64(3 * 2 ** 30 + 1)
ROOT = 5                        # of the prime's multiplicative group, so transforms of up to 2^30 values exist
AT_ONCE = 1 << 20               # values that are transformed together
PIECE = 2_000_000               # bytes of text that one step works on


# words

def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, dictionary-coded, and their number per text."""
    plain = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x09-\x0d]", " ")
    split = pc.split_pattern(plain, " ")
    owner = pc.list_parent_indices(split).to_numpy()
    flat = split.flatten()
    real = pc.not_equal(flat, "")
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(real).dictionary_encode(), counts


# transforms

_twiddles: dict[tuple[int, bool], np.ndarray] = {}


def _powers(half: int, back: bool) -> np.ndarray:
    """Powers of the root of unity of order ``2 half``, or of its inverse."""
    if (half, back) not in _twiddles:
        p = int(PRIME)
        g = pow(ROOT, (p - 1) // (2 * half), p)
        g = pow(g, p - 2, p) if back else g
        out = np.ones(half, np.uint64)
        step = 1
        while step < half:  # doubling: the next powers are the first ones times g^step
            out[step:2 * step] = out[:step] * np.uint64(pow(g, step, p)) % PRIME
            step *= 2
        _twiddles[half, back] = out
    return _twiddles[half, back]


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long); the result is in bit-reversed order."""
    rows, half = len(a), a.shape[1] // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        a = np.stack([(low + high) % PRIME, (low + (PRIME - high)) % PRIME * _powers(half, False) % PRIME], axis=2)
        half //= 2
    return a.reshape(rows, -1)


def restore(a: np.ndarray) -> np.ndarray:
    """The inverse of :func:`transform`."""
    rows, size, half = len(a), a.shape[1], 1
    while half < size:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1] * _powers(half, True) % PRIME
        a = np.stack([(low + high) % PRIME, (low + (PRIME - high)) % PRIME], axis=2)
        half *= 2
    return a.reshape(rows, size) * np.uint64(pow(size, int(PRIME) - 2, int(PRIME))) % PRIME


def zero_distances(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row, whether the squared differences of the block and the window's part at each shift add up to zero modulo the prime."""
    n, width = blocks.shape[1], windows.shape[1]
    size = 1 << (width - 1).bit_length()
    x = np.zeros((len(blocks), size), np.uint64)
    y = np.zeros((len(blocks), size), np.uint64)
    x[:, :n], y[:, :width] = blocks[:, ::-1], windows
    cross = restore(transform(x) * transform(y) % PRIME)[:, n - 1:width]  # what wraps around lands before n - 1
    own = (blocks * blocks % PRIME).sum(axis=1, keepdims=True) % PRIME
    upto = np.zeros((len(blocks), width + 1), np.uint64)
    np.cumsum(windows * windows % PRIME, axis=1, out=upto[:, 1:])
    theirs = (upto[:, n:] - upto[:, :-n]) % PRIME
    return (own + theirs + np.uint64(2) * (PRIME - cross)) % PRIME == 0


# runs

def seeds(ids: np.ndarray, soon: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances): blocks of ``size`` words that occur again at a distance of this scale."""
    first = 1 if size == SMALLEST else 2 * size - 1
    last = 4 * size - 2
    starts = np.arange(0, len(ids) - size - first + 1, size)
    if not len(starts):
        return starts, starts
    late = np.add.reduceat(soon > last, starts)  # the last sum may take in words behind its block: cut below
    late[-1] = (soon[starts[-1]:starts[-1] + size] > last).sum()
    starts = starts[late == 0]
    padded = np.concatenate([ids, np.full(last + size, ids.max(initial=0) + 1, ids.dtype)])
    width, found = last - first + size, ([], [])
    step = max(1, AT_ONCE // (1 << (width - 1).bit_length()))
    for at in range(0, len(starts), step):
        s = starts[at:at + step]
        zero = zero_distances(padded[s[:, None] + np.arange(size)].astype(np.uint64), padded[s[:, None] + first + np.arange(width)].astype(np.uint64))
        row, shift = np.nonzero(zero)
        found[0].append(s[row])
        found[1].append(shift + first)
    return tuple(np.concatenate([np.zeros(0, np.int64), *f]) for f in found)


def _reach(same: Callable[[int, int], np.ndarray], most: int) -> int:
    """How many of up to ``most`` places are equal before the first that isn't; looked at in growing steps."""
    at, step = 0, 32
    while at < most:
        part = same(at, min(at + step, most))
        if not part.all():
            return at + int(part.argmin())
        at, step = min(at + step, most), step * 2
    return most


def stretches(ids: np.ndarray, q: int, places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of equal words q apart that hold one of ``places`` (ascending)."""
    n = len(ids) - q
    if len(places) * 64 > n:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:n] == ids[q:], [False]])))
        a, b = edge[::2], edge[1::2]
        k = np.unique(np.searchsorted(a, places, side="right") - 1)
        k = k[k >= 0]
        return list(zip(a[k].tolist(), b[k].tolist()))
    out, at = [], 0
    while at < len(places):
        i = int(places[at])
        b = i + _reach(lambda x, y: ids[i + x:i + y] == ids[i + q + x:i + q + y], n - i)
        a = i - _reach(lambda x, y: (ids[i - y:i - x] == ids[i + q - y:i + q - x])[::-1], i)
        out.append((a, b))
        at = max(at + 1, int(np.searchsorted(places, b)))
    return out


def _factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def find_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period.

    ``longest``: length of the longest text in the sequence, where a word of its own parts the texts.
    """
    n = len(ids)
    if n < LEAST:
        return []
    order = np.argsort(ids, kind="stable")
    soon = np.full(n, n, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    soon[order[:-1][again]] = (order[1:] - order[:-1])[again]
    runs: set[tuple[int, int, int]] = set()
    size = SMALLEST
    while size == SMALLEST or 2 * (2 * size - 1) <= (n if longest is None else longest):
        places, distances = seeds(ids, soon, size)
        by = np.argsort(places, kind="stable")
        places, distances = places[by], distances[by]
        keep = np.ones(len(places), bool)
        for a, length, q in runs if len(places) else ():  # a multiple of a known run's period inside of it is that run
            x, y = np.searchsorted(places, [a, a + length])
            keep[x:y] &= (distances[x:y] % q != 0) | (places[x:y] + distances[x:y] + size > a + length)
        places, distances = places[keep], distances[keep]
        by = np.lexsort((places, distances))
        places, distances = places[by], distances[by]
        cuts = np.flatnonzero(np.diff(distances)) + 1
        for group, q in zip(np.split(places, cuts), distances[np.concatenate([[0], cuts]).astype(int)].tolist() if len(distances) else ()):
            for a, b in stretches(ids, q, group):
                if b - a >= max(LEAST - q, q) and not any(np.array_equal(ids[a:a + q], ids[a + q // f:a + q // f + q]) for f in _factors(q)):
                    runs.add((a, b - a + q, q))
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for a, length, q in runs:
        edge[a + q] += 1
        edge[a + length] -= 1
    return np.cumsum(edge[:n]) > 0


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids: word numbers of a text whose words from some place on repeat with a period; else none."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, id_column: str, text_column: str, altered: Callable[[int | None, int], np.ndarray | None] | None = None,
                  with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: the number of words and of runs, its greatest run, digests of all runs and of the text without repetitions.

    ``altered`` may give another order of a document's word numbers before the search. ``with_runs`` adds all runs as
    an array of structs, ``with_text`` the collapsed text itself.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
              + (", runs array<struct<start: long, length: long, period: long>>" if with_runs else "") + (", collapsed string" if with_text else ""))

    def run(batches):
        for batch in pieces(batches, text_column, PIECE):
            coded, counts = word_lists(batch.column(text_column))
            number, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            ids, ends, parts = batch.column(id_column).to_pylist(), np.cumsum(counts), []
            for k, (doc, end, n) in enumerate(zip(ids, ends.tolist(), counts.tolist())):
                part = number[end - n:end]
                order = altered(doc, n) if altered else None
                parts += [part if order is None else part[order], np.array([len(words) + k])]
            whole = np.concatenate(parts) if parts else number
            first = np.cumsum(counts + 1) - counts - 1
            of_doc: list[list] = [[] for _ in ids]
            found = find_runs(whole, int(counts.max(initial=0)))
            for (a, length, q), k in zip(found, (np.searchsorted(first, [r[0] for r in found], side="right") - 1).tolist()):
                of_doc[k].append((a - int(first[k]), length, q))
            rows = []
            for doc, part, n, runs in zip(ids, parts[::2], counts.tolist(), of_doc):
                kept = part[~dropped(n, runs)] if runs else part
                text = " ".join([words[w] for w in kept.tolist()])
                a, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                lines = "".join(f"{r[0]},{r[1]},{r[2]}\n" for r in runs)
                row = (doc, n, len(runs), a, length, q, runs and 1000 * length // q or None, hashlib.sha256(lines.encode()).hexdigest(),
                       hashlib.sha256(text.encode()).hexdigest())
                rows.append(row + (([dict(zip(("start", "length", "period"), r)) for r in runs],) if with_runs else ()) + ((text,) if with_text else ()))
            types = [batch.schema.field(id_column).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = [id_column, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_runs:
                types.append(pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])))
                names.append("runs")
            if with_text:
                types.append(pa.string())
                names.append("collapsed")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
