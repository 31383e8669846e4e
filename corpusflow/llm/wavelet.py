"""Token shards as wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup.

A shard numbers its distinct ids by falling frequency and stores the numbers' bit-planes, highest first; each plane
holds the zeros of the plane above before its ones. A plane is cut into blocks, each compressed on its own, and a
directory keeps the ones before every block, so rank and select touch a few blocks only. A header has the id table with counts
and the documents with their lengths.

File: magic, header length, header (JSON, Zstandard), then the blocks. Shards are bounded by a number of ids, so a
shard fits a task's memory whatever the table's size. Files are written under a name of the task attempt and
then moved, so a repeated task leaves the same files.

Defined results: null and empty texts are documents of the end id alone; equal ids come in the order of their encoded
ids, so repeated rows give the same files; null ids come first; an empty table has no files and gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.tables import new_folder, pieces
from corpusflow.llm.vocab import encoder

MAGIC = b"WVMX0001"
SHARD_IDS = 1 << 22
BLOCK_BITS = 1 << 16  # of a compressed block
KEPT = 1_000_000, 1_300_000  # distinct chunks and words that a worker remembers, about 400 MB
SUFFIX = ".wvm"


def _pack_block(bits: np.ndarray, pack) -> bytes:
    raw = np.packbits(bits).tobytes()
    small = pack(raw)
    return b"\x01" + small if len(small) < len(raw) else b"\x00" + raw


def _unpack_block(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(data[1:]) if data[:1] == b"\x01" else data[1:]
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n)


def build(ids: np.ndarray, doc_ids: list, doc_lens: list[int], **facts) -> bytes:
    """The file of a shard. ``facts`` go into the header as they are."""
    size = int(ids.max()) + 1 if len(ids) else 1
    counts = np.bincount(ids, minlength=size)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    order = np.argsort(-counts, kind="stable")
    place = np.zeros(size, np.uint16 if len(order) <= 1 << 16 else np.uint32)
    place[symbols[order]] = np.arange(len(order))
    seq = place[ids]
    planes = max(1, int(len(order) - 1).bit_length())
    pack = zstandard.ZstdCompressor(level=1).compress
    blocks, zeros, ones = [], [], []
    for shift in reversed(range(planes)):
        bits = (seq >> shift).astype(np.uint8) & 1
        before = 0
        row = []
        for i in range(0, len(bits), BLOCK_BITS):
            part = bits[i:i + BLOCK_BITS]
            row.append(before)
            before += int(part.sum())
            blocks.append(_pack_block(part, pack))
        ones.append(row)
        zeros.append(len(bits) - before)
        one = bits.view(bool)
        seq = np.concatenate([seq[~one], seq[one]])
    header = {"n": len(ids), "planes": planes, "zeros": zeros, "ones": ones, "symbols": symbols[order].tolist(), "counts": counts[order].tolist(),
              "doc_ids": doc_ids, "doc_lens": doc_lens, "sizes": [len(b) for b in blocks], **facts}
    packed = zstandard.compress(json.dumps(header, separators=(",", ":")).encode(), 3)
    return MAGIC + struct.pack("<I", len(packed)) + packed + b"".join(blocks)


class WaveletMatrix:
    """Reads a shard file. Blocks are decompressed when they are needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no wavelet matrix file")
        (size,) = struct.unpack("<I", data[8:12])
        self.header = h = json.loads(zstandard.decompress(data[12:12 + size]))
        self.data, self.n, self.planes, self.zeros, self.ones = data, h["n"], h["planes"], h["zeros"], h["ones"]
        self.symbols = np.array(h["symbols"], np.uint32)
        self.per_plane = -(-self.n // BLOCK_BITS)
        self.starts = 12 + size + np.concatenate([[0], np.cumsum(h["sizes"])]).astype(np.int64)
        self._cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per_plane + block
        n = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return _unpack_block(self.data[self.starts[k]:self.starts[k + 1]], n)

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        if (plane, block) not in self._cache:
            bits = self._bits(plane, block)
            self._cache[plane, block] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self._cache[plane, block]

    def rank1(self, plane: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, at = divmod(i, BLOCK_BITS)
        return self.ones[plane][block] + int(self._block(plane, block)[1][at])

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit`` of a plane."""
        row = self.ones[plane]
        before = (lambda b: row[b]) if bit else (lambda b: b * BLOCK_BITS - row[b])
        block = bisect.bisect_right(range(self.per_plane), k, key=before) - 1
        bits = self._block(plane, block)[0]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - before(block)])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        code = 0
        for plane in range(self.planes):
            block, at = divmod(i, BLOCK_BITS)
            bit = int(self._block(plane, block)[0][at])
            ones = self.rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.symbols[code])

    def _code(self, symbol: int) -> int | None:
        at = np.flatnonzero(self.symbols == symbol)
        return int(at[0]) if len(at) else None

    def _narrow(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for plane in range(self.planes):
            a, b = self.rank1(plane, lo), self.rank1(plane, hi)
            if code >> (self.planes - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id stands in positions ``lo`` to ``hi``."""
        code = self._code(symbol)
        if code is None:
            return 0
        a, b = self._narrow(code, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, symbol: int, k: int) -> int | None:
        """Position of the ``k``-th (from 0) occurrence of an id."""
        code = self._code(symbol)
        if code is None:
            return None
        a, b = self._narrow(code, 0, self.n)
        if k >= b - a:
            return None
        i = a + k
        for plane in reversed(range(self.planes)):
            bit = code >> (self.planes - 1 - plane) & 1
            i = self.select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the lowest plane's order is known from the counts; each plane above is undone in turn."""
        codes = np.arange(len(self.symbols))
        back = np.zeros(len(codes), np.int64)
        for k in range(self.planes):
            back = back << 1 | (codes >> k & 1)
        order = np.argsort(back, kind="stable")
        small = np.uint16 if len(codes) <= 1 << 16 else np.uint32
        seq = np.repeat(codes[order].astype(small), np.array(self.header["counts"])[order])
        for plane in reversed(range(self.planes)):
            one = np.concatenate([self._bits(plane, b) for b in range(self.per_plane)]).view(bool)
            up = np.empty_like(seq)
            up[~one] = seq[:self.zeros[plane]]
            up[one] = seq[self.zeros[plane]:]
            seq = up
        return self.symbols[seq]


def _bounds(docs: DataFrame, id_column: str, parts: int) -> list[int]:
    """Ids that cut the table into ranges of about as many rows; reads the id column only. At most ``parts`` numbers."""
    cuts = ",".join(str(i / parts) for i in range(1, parts))
    got = docs.select(F.expr(f"percentile_approx(cast(`{id_column}` as long), array({cuts}), 20000)").alias("b")).first()[0] if parts > 1 else None
    return sorted(set(got or []))


def write_shards(docs: DataFrame, id_column: str, text_column: str, tokenizer: str, end_id: int, folder: str, shard_ids: int = SHARD_IDS) -> list[int]:
    """Encode the texts and write them in ascending id order as shard files below ``folder``.

    Returns the number of ids of each range of documents (as many numbers as there are ranges; not one per document).
    Only ids of two bytes each, compressed, go through the one shuffle.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs, id_column, parts)

    def encode(batches):
        enc, pack = encoder(tokenizer, True, *KEPT), zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        small = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in pieces(batches, text_column, 8_000_000):
            flat, lens = enc.ids(batch.column(text_column))
            ends = np.cumsum(lens)
            flat = flat.astype(small)
            end = np.array([end_id], small).tobytes()
            packed = [pack(flat[e - n:e].tobytes() + end) for e, n in zip(ends.tolist(), lens.tolist())]
            keys = batch.column(id_column).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([0 if k is None else bisect.bisect_left(bounds, k) for k in keys], pa.int32()),
                pa.array(keys, pa.int64()), pa.array(packed, pa.binary()), pa.array([int(small[2])] * len(keys), pa.int32())],
                names=["part", "doc", "ids", "width"])

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, unpack = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor().decompress
        keys, lens, ids, held, before, number, part = [], [], [], 0, 0, 0, None

        def flush():
            nonlocal keys, lens, ids, held, before, number
            data = build(np.concatenate(ids), keys, lens, part=part, before=before)
            name = f"{root}/shard-{part:06d}-{number:06d}"
            with store.open_output_stream(f"{name}.{attempt}.tmp", compression=None) as f:
                f.write(data)
            store.move(f"{name}.{attempt}.tmp", f"{name}{SUFFIX}")
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([held], pa.int64())})
            before, number, keys, lens, ids, held = before + held, number + 1, [], [], [], 0
            return out

        for batch in batches:
            for p, key, packed, width in zip(*(batch.column(c).to_pylist() for c in ("part", "doc", "ids", "width"))):
                if p != part:
                    if held:
                        yield flush()
                    part, before, number = p, 0, 0
                one = np.frombuffer(unpack(packed), f"<u{width}")
                keys.append(key)
                lens.append(len(one))
                ids.append(one)
                held += len(one)
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    coded = docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(encode, "part int, doc long, ids binary, width int")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc", "ids")
    totals = ordered.mapInArrow(write, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    out = [0] * (len(bounds) + 1)
    for r in totals:
        out[r["part"]] = r["n"]
    return out


def read_shards(spark, folder: str, totals: list[int], id_column: str) -> DataFrame:
    """One row per document from the shard files: start, number and digest of its ids."""
    first = np.concatenate([[0], np.cumsum(totals)]).tolist()

    def read(batches):
        for batch in batches:
            for data in batch.column("content"):
                m = WaveletMatrix(data.as_py())
                ids, h = m.ids().astype("<u4"), m.header
                lens = np.array(h["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h["doc_ids"], pa.int64()), pa.array(first[h["part"]] + h["before"] + ends - lens, pa.int64()),
                                                  pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], names=[id_column, "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(read, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")


def shards(docs: DataFrame, id_column: str, text_column: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write a table's ids as shard files in the shared work folder and report each document as read from them."""
    spark = docs.sparkSession
    folder = new_folder(spark, "wavelet")
    totals = write_shards(docs, id_column, text_column, tokenizer, end_id, folder, shard_ids)
    if not sum(totals):
        return spark.createDataFrame([], f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, totals, id_column)
