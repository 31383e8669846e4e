"""Byte-pair encoding and decoding with an index of pair occurrences.

A task splits its texts into chunks and encodes a chunk once. The new chunks of a window of text form one array of
symbols with links to the neighbours. An index holds the positions of every pair that has a rank; ranks are
taken in ascending order, all positions of a rank are merged together, and the positions of the pairs that arise go
to the lists of their ranks. Positions whose pair has gone are dropped when their rank's turn comes.

Only normalisation and the split into words come from the library; merging and decoding are done here.

Defined results: null and empty texts give no ids and an empty decoded text; strings of special tokens give their ids;
repeated rows stay; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.tables import pieces
from corpusflow.llm.vocab import Encoder

GONE, WALL = -2, -1  # symbols: merged into its left neighbour; between words


class Merges:
    """The merge table of a tokenizer file: ranks and results of symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        tops = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in tops], np.int64)
        right = np.array([self.vocab[b] for _, b in tops], np.int64)
        self.left, self.right = left, right
        self.made = np.array([self.vocab[a + b] for a, b in tops], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.tokens = {i: t for t, i in self.vocab.items()}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)


def merge_words(merges: Merges, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and the number of ids of each."""
    single, last, vocab = {}, {}, merges.vocab
    symbols: list[int] = [WALL]
    for w in words:
        try:
            symbols += [single[c] for c in w[:-1]]
            symbols.append(last[w[-1]])
        except KeyError:
            for c in set(w):
                single[c], last[c] = vocab[c], vocab[c + merges.suffix]
            del symbols[len(symbols) - 1 - symbols[::-1].index(WALL) + 1:]
            symbols += [single[c] for c in w[:-1]]
            symbols.append(last[w[-1]])
        symbols.append(WALL)
    sym = np.array(symbols, np.int64)
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    # the pair index: positions sorted by rank, and lists for those that arise later
    rank = merges.ranks(sym[:-1], sym[1:])
    at = np.flatnonzero(rank >= 0)
    by = np.argsort(rank[at], kind="stable")
    at, ranked = at[by], rank[at][by]
    active, starts = np.unique(ranked, return_index=True)
    lists = {r: [p] for r, p in zip(active.tolist(), np.split(at, starts[1:]))} if len(active) else {}
    heap = list(lists)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        found = lists.pop(r)
        p = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        a, b, made = merges.left[r], merges.right[r], merges.made[r]
        p = p[sym[p] == a]
        p = p[sym[after[p]] == b]
        if a == b and len(p) > 1:  # in a run of one symbol, take every second pair from the left
            keep, end = [], -1
            for x, y in zip(p.tolist(), after[p].tolist()):
                if x != end:
                    keep.append(x)
                    end = y
                else:
                    end = -1
            p = np.array(keep, np.int64)
        if not len(p):
            continue
        q = after[p]
        nxt = after[q]
        sym[p], sym[q] = made, GONE
        after[p] = nxt
        before[nxt] = p
        # the pairs on both sides
        prev = before[p]
        x = np.concatenate([prev, p])
        y = np.concatenate([p, nxt])
        new = merges.ranks(sym[x], sym[y])
        ok = new >= 0
        if ok.any():
            x, new = x[ok], new[ok]
            if len(x) < 32:
                for one, k in zip(x.tolist(), new.tolist()):
                    _append(lists, heap, k, [one])
            else:
                by = np.argsort(new, kind="stable")
                ks, starts = np.unique(new[by], return_index=True)
                for k, part in zip(ks.tolist(), np.split(x[by], starts[1:])):
                    _append(lists, heap, k, part)
    walls = np.flatnonzero(sym == WALL)
    live = sym >= 0
    upto = np.cumsum(live)
    return sym[live].astype(np.uint32), np.diff(upto[walls])


def _append(lists: dict, heap: list, rank: int, positions) -> None:
    if rank not in lists:
        lists[rank] = []
        heapq.heappush(heap, rank)
    lists[rank].append(np.asarray(positions, np.int64))


class PairIndexEncoder(Encoder):
    """Texts to ids: the library normalises and splits, the pair index merges."""

    def __init__(self, path: str):
        super().__init__(path, True)
        self.merges = Merges(path)
        self.special_ids = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.merges.tokens |= {i: t for t, i in self.special_ids.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return merge_words(self.merges, words)

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        """Texts in which special tokens may stand: these are cut out first."""
        out = []
        for text in texts:
            ids = []
            for i, part in enumerate(self._special.split(text) if self._special else [text]):
                if i % 2:
                    ids.append(np.array([self.special_ids[part]], np.uint32))
                elif part:
                    ids.append(merge_words(self.merges, self._split([part])[0])[0])
            out.append(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.merges.tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def pair_encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def round_trip(docs: DataFrame, id_column: str, text_column: str, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Number and digest of every text's ids, and the digest of what they decode to.

    ``tokenizer`` is the file of a word-level tokenizer without a decoder of its own: tokens are joined by spaces.
    ``with_ids`` adds the ids and the decoded text.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        encode = pair_encoder(tokenizer)
        for batch in pieces(batches, text_column):
            flat, lens = encode.ids(batch.column(text_column))
            flat = flat.astype("<u4")
            ends = np.cumsum(lens).tolist()
            each = [flat[end - n:end] for end, n in zip(ends, lens.tolist())]
            decoded = [encode.decode(x) for x in each]
            columns = [batch.column(id_column), pa.array(lens, pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()),
                       pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)

