"""Encoding, packing and shards against the library and by exact round trips."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import bpe, packing, wavelet
from corpusflow.llm.tables import new_folder
from corpusflow.llm.vocab import Encoder, load, public_path
from tests.llm.conftest import ODD

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
HARD = ["a  b", "a \n b", "x\n\n  y \n", "a<|endoftext|> b  <|endoftext|>  c<|startoftext|>", "\ta\t b", "it's  we'll 'S don't. we'll, x' 's", "\u00e9 e\u0301 \u0301x \u0130 \u0391\u03a3",
        "a\x1cb c\x1c d", "  x\u3000y", "\u010a a \u010ab \u0120x", "aaa aaaa hahahaha", "a\xa0b \xa0c\u2028d\x85 e", "foo*** %%% a_b_ _ x.y, ..", "a.\nB c!\n\nd. \ne", "\u00c9t\u00e9, \u00c0\u00c7. \u0178\u012c\u0130"]


@pytest.mark.parametrize("path, words", [(BYTE, False), (WORD, True)])
def test_ids_are_the_librarys(path, words):
    texts = [t or "" for t in ODD] + HARD
    for made in (Encoder(path, words), *([bpe.PairIndexEncoder(path)] if words else [])):
        for group in (texts, texts[3:4], [], texts[::-1]):
            ids, lens = made.ids(pa.array(group, pa.string()))
            ends = np.cumsum(lens)
            for t, e, n in zip(group, ends, lens):
                assert ids[e - n:e].tolist() == load(path).encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("path, words", [(BYTE, False), (WORD, True)])
def test_words_go_to_the_library_alone(path, words):
    """A call to the library holds the words and nothing between them that it would have to encode, too."""
    made, sent = Encoder(path, words), []

    class Library:
        def encode_batch_fast(self, texts, bare=made.bare):
            sent.extend(w for t in texts for w in t.split(" "))
            return bare.encode_batch_fast(texts)

    made.bare = Library()
    texts = [t or "" for t in ODD] + HARD
    ids, lens = made.ids(pa.array(texts, pa.string()))
    want = [load(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for each in want for i in each] and lens.tolist() == [len(x) for x in want]
    assert len(sent) == len(set(sent)) == len(made.word_memory.known)
    made.spelled = np.zeros_like(made.spelled)  # as for a vocabulary that doesn't spell its words: each is encoded alone
    some = list(made.word_memory.known)
    assert [x.tolist() for x in made.encode_words(some)] == [x.tolist() for x in Encoder(path, words).encode_words(some)]
    assert [len(x) for x in made.encode_words([])] == [0, 0]


@pytest.mark.parametrize("path, words", [(BYTE, False), (WORD, True)])
def test_common_words_stay_in_a_full_memory(path, words):
    """Texts of 100 common words and 50 rare ones: what's full forgets rare ones, and the common ones are learned once."""
    letters = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    common = ["c" + letters(i) for i in range(100)]
    made, asked = Encoder(path, words, 400, 400), []
    learn = made.encode_words
    made.word_memory.learn = lambda keys: asked.extend(keys) or learn(keys)
    for n in range(60):
        text = " ".join([f"{c} r{letters(50 * n + i)}" if i < 50 else c for i, c in enumerate(common)])
        ids, lens = made.ids(pa.array([text]))
        assert ids.tolist() == load(path).encode(text, add_special_tokens=False).ids and lens.tolist() == [len(ids)]
        assert max(len(made.memory.known), len(made.word_memory.known)) <= 400
        for memory in (made.memory, made.word_memory):
            assert len(memory.known) == len(memory.lens) and memory.lens.sum() == len(memory.flat)
    assert len(asked) <= 60 * 50 + 100 + 1  # the first word of a byte-level text is another one


def test_round_trip_of_pair_index(odd, empty):
    got = bpe.round_trip(odd, "doc_id", "text", WORD, with_ids=True).collect()
    assert len(got) == odd.count()
    want = defaultdict(list)
    for r in odd.collect():
        ids = load(WORD).encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id].append((ids, load(WORD).decode(ids, skip_special_tokens=False)))
    for r in got:
        assert (r.ids, r.decoded) in want[r.doc_id]
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.round_trip(empty, "doc_id", "text", WORD).count() == 0


def test_closest_sum_against_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(60):
        items = rng.integers(1, 40, 9).tolist()
        target = int(rng.integers(1, 120))
        best = max(s for m in range(512) if (s := sum(x for i, x in enumerate(items) if m >> i & 1)) <= target)
        taken = packing.closest(lambda n: items.count(n), sorted(set(items)), target)
        assert sum(n * k for n, k in taken.items()) == best
        assert all(k <= items.count(n) for n, k in taken.items())


def check_packing(docs, rows):
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0  # no padding at all
        assert {r.sequence_length for r in pieces} == {at}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(load(BYTE).encode(r.text or "", add_special_tokens=False).ids + [1])
    assert set(of_doc) == set(texts)
    for doc, each in texts.items():
        if len(each) > 1:
            assert sum(r.length for r in of_doc[doc]) == sum(map(len, each))
            continue
        at = 0
        for r in sorted(of_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(each[0]))
            assert r.ids_crc32 == zlib.crc32(np.array(each[0][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(each[0])


def test_packing(odd, empty, documents):
    check_packing(odd, packing.pack(odd, "doc_id", "text", BYTE, 1, with_ids=True).collect())
    check_packing(documents, packing.pack(documents.repartition(3), "doc_id", "text", BYTE, 1).collect())
    assert packing.pack(empty, "doc_id", "text", BYTE, 1).count() == 0


def test_packing_windows():
    rng = np.random.default_rng(5)
    packer, sequences, total = packing.Packer(window=64), [], 0
    for i in range(900):
        ids = np.arange(int(rng.integers(1, 3000)), dtype=np.uint32)
        total += len(ids)
        sequences += list(packer.add(i, ids))
    sequences += list(packer.close())
    sizes = [sum(len(r.ids) for r in s) for s in sequences]
    assert sum(sizes) == total and all(n & (n - 1) == 0 for n in sizes) and sum(n < 2048 for n in sizes) <= 11


def test_window_is_a_bound():
    """Equal rests that fill no sequence exactly are cut; a packer never holds more than two windows, and nothing is padded or lost."""
    packer, placed, most = packing.Packer(2048, 256), [], 0
    for i in range(6000):
        placed += packer.add(i, np.full(1000, i, np.uint32))
        most = max(most, packer.size)
    assert most <= 2 * 256 and len(placed) > 2500
    placed += packer.close()
    sizes = [sum(len(r.ids) for r in s) for s in placed]
    assert sum(sizes) == 6_000_000 and all(n == 2048 for n in sizes[:-11])
    seen = sorted((r.doc, r.start, len(r.ids)) for s in placed for r in s)
    assert [(d, s) for d, s, _ in seen if s == 0] == [(i, 0) for i in range(6000)]


def test_wavelet_matrix():
    rng = np.random.default_rng(7)
    ids = (rng.zipf(1.3, 150_000) % 900).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [1], [len(ids)]))
    assert (m.ids() == ids).all()
    assert all(m.access(i) == ids[i] for i in range(0, len(ids), 7919))
    for v in (int(ids[0]), int(ids[70_000]), 899, 12_345):
        p = np.flatnonzero(ids == v)
        assert m.count(v) == len(p) and m.count(v, 500, 90_000) == int(((p >= 500) & (p < 90_000)).sum())
        assert [m.occurrence(v, k) for k in range(min(30, len(p)))] == p[:30].tolist() and m.occurrence(v, len(p)) is None
    one = wavelet.WaveletMatrix(wavelet.build(np.array([5, 5, 5], np.uint16), [1], [3]))
    assert one.ids().tolist() == [5, 5, 5] and one.occurrence(5, 2) == 2


def test_shards(spark, documents, odd, empty):
    got = wavelet.shards(documents, "doc_id", "text", WORD, 2, shard_ids=20_000).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = load(WORD).encode(d.text or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wavelet.shards(odd, "doc_id", "text", WORD, 2).count() == odd.count()
    assert wavelet.shards(empty, "doc_id", "text", WORD, 2).count() == 0


def test_shard_files_are_several(spark, documents):
    folder = new_folder(spark, "test-shards")
    totals = wavelet.write_shards(documents, "doc_id", "text", WORD, 2, folder, shard_ids=5_000)
    files = spark.read.format("binaryFile").load(folder).select("path").collect()
    assert len(files) > len(totals) and all(r.path.endswith(wavelet.SUFFIX) for r in files)
