"""Packing token ids into sequences of a fixed capacity by minimum bin slack.

Every task packs the documents that it reads, so nothing is shuffled. A document's full windows are sequences of their
own; the rest lengths form a multiset. The longest rest opens a sequence, and a subset-sum over bitsets (one big
integer, bit s: sum s is reachable) finds the multiset of other rests that comes closest to the capacity; walking
the saved bitsets backwards gives how often each length is taken. Where the best sum leaves slack, better ones may come with
later documents; once two windows of rests are held, or no documents are left, a rest is cut to fill the slack. What a task has left at its end fills sequences whose lengths are powers of two, so no sequence is padded.

Defined results: null and empty texts are documents of the end id alone; repeated rows and repeated ids are documents
of their own; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusflow.llm.tables import pieces
from corpusflow.llm.vocab import encoder

CAPACITY = 2048
WINDOW = 4096  # rests that are packed together


class Rest:
    """Ids of a document that aren't placed yet."""

    __slots__ = ("doc", "total", "start", "ids")

    def __init__(self, doc, total: int, start: int, ids: np.ndarray):
        self.doc, self.total, self.start, self.ids = doc, total, start, ids

    def cut(self, n: int) -> Rest:
        head = Rest(self.doc, self.total, self.start, self.ids[:n])
        self.start, self.ids = self.start + n, self.ids[n:]
        return head


def closest(counts, lengths: list[int], target: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to ``target`` from below.

    ``lengths`` ascend; ``counts`` gives how many there are of a length (0: none left). Lengths are added from the longest that
    fits down, and the table stops growing at an exact sum.
    """
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for at in range(bisect_right(lengths, target) - 1, -1, -1):
        n = lengths[at]
        left = min(counts(n), target // n)
        if not left:
            continue
        steps.append((n, reach))
        k = 1
        while left:
            k = min(k, left)
            reach |= (reach << (k * n)) & mask
            left -= k
            k *= 2
        if reach >> target & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        while not before >> total & 1:
            total -= n
            taken[n] = taken.get(n, 0) + 1
    return taken


class Packer:
    """Takes documents one after the other and yields sequences: lists of rests whose lengths add up."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.rests: dict[int, list[Rest]] = {}
        self.size = self.held = 0
        self.next = window  # rests at which packing is tried

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Rest]]:
        whole = Rest(doc, len(ids), 0, ids)
        while len(whole.ids) >= self.capacity:
            yield [whole.cut(self.capacity)]
        self._keep(whole)
        if self.size >= self.next:
            self.next = self.window
            yield from self._pack(self.window // 4)

    def close(self) -> Iterator[list[Rest]]:
        yield from self._pack(0)
        last = [r for n in sorted(self.rests, reverse=True) for r in self.rests[n]]
        self.rests, self.size = {}, 0
        total = self.held
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                yield self._take(last, 1 << bit)

    def _keep(self, r: Rest) -> None:
        if len(r.ids):
            r.ids = r.ids.copy() if r.ids.base is not None else r.ids  # not the whole batch
            self.rests.setdefault(len(r.ids), []).append(r)
            self.size += 1
            self.held += len(r.ids)

    def _pop(self, n: int) -> Rest:
        stack = self.rests[n]
        r = stack.pop()
        if not stack:
            del self.rests[n]
        self.size -= 1
        self.held -= n
        return r

    @staticmethod
    def _take(last: list[Rest], n: int) -> list[Rest]:
        out = []
        while n:
            r = last[0]
            out.append(last.pop(0) if len(r.ids) <= n else r.cut(n))
            n -= len(out[-1].ids)
        return out

    def _pack(self, keep: int) -> Iterator[list[Rest]]:
        """Sequences while more than ``keep`` rests, and ids for a whole sequence, are left."""
        lengths = sorted(self.rests)
        count = lambda n: len(self.rests.get(n, ()))
        while self.size > keep and self.held >= self.capacity:
            while lengths[-1] not in self.rests:
                lengths.pop()
            if len(lengths) > 2 * len(self.rests):
                lengths = sorted(self.rests)
            out = [self._pop(lengths[-1])]
            slack = self.capacity - len(out[0].ids)
            for n, k in closest(count, lengths, slack).items():
                out += [self._pop(n) for _ in range(k)]
                slack -= n * k
            if slack and keep and self.size + len(out) < 2 * self.window:
                for r in out:
                    self._keep(r)
                self.next = min(self.size + self.window // 32, 2 * self.window)
                return
            while slack:
                r = self._pop(max(self.rests))
                out.append(r.cut(min(slack, len(r.ids))))
                slack -= len(out[-1].ids)
                self._keep(r)
                lengths = sorted(self.rests)
            yield out


def pack(docs: DataFrame, id_column: str, text_column: str, tokenizer: str, end_id: int, capacity: int = CAPACITY,
         window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where its ids start, how many they are, and its place in a sequence.

    ``tokenizer`` is the file of a byte-level tokenizer; ``end_id`` closes each document. ``with_ids`` adds the ids.
    ``docs`` should be a table, whose partitions read the same rows when a task is repeated.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
              + (", ids array<int>" if with_ids else ""))

    def run(batches):
        encode, packer, rows = encoder(tokenizer, False), Packer(capacity, window), []
        number = TaskContext.get().partitionId() << 40
        types = None

        def place(sequence):
            nonlocal number
            at, total = 0, sum(len(r.ids) for r in sequence)
            for r in sequence:
                row = (r.doc, r.start, len(r.ids), zlib.crc32(r.ids.astype("<u4").tobytes()), r.total, number, at, total)
                rows.append((*row, r.ids.astype(np.int32)) if with_ids else row)
                at += len(r.ids)
            number += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))
            rows.clear()
            return out

        for batch in pieces(batches, text_column):
            types = types or {id_column: batch.schema.field(id_column).type} | dict.fromkeys(
                ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"), pa.int64()) | (
                {"ids": pa.list_(pa.int32())} if with_ids else {})
            flat, lens = encode.ids(batch.column(text_column))
            ends = np.cumsum(lens)
            for doc, end, n in zip(batch.column(id_column).to_pylist(), ends.tolist(), lens.tolist()):
                for sequence in packer.add(doc, np.append(flat[end - n:end], np.uint32(end_id))):
                    place(sequence)
            if rows:
                yield flush()
        for sequence in packer.close():
            place(sequence)
        if rows:
            yield flush()

    return docs.select(id_column, text_column).mapInArrow(run, schema)
