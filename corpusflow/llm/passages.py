"""Removal of passages that an earlier document has, by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of a document; a word goes if a window covers it whose words also stand in a document with
a smaller id. Windows are judged on the input.

1. Equal texts are one class; its smallest id stands for it, and later ones go whole. Rows whose text may be repeated lie apart, so only they
   are matched with their class. One scan gives each text its anchors: of the seven
   seven-word grams of a window the one with the smallest hash. Equal windows have the same anchor, so only stretches of windows whose anchors occur
   more than once can hold repeated windows; the others are left behind.
2. The windows of these stretches are counted by a hash: each that several documents have is assigned to the block of ``REF`` windows where
   its first document has it. Blocks are dealt into reference shards of bounded size.
3. A shard's passages, the first copies, are sent to each block of the documents' stretches that are assigned to the shard. There they become
   a suffix automaton whose states know the smallest id that reaches them. So a shard that many documents repeat is streamed in many
   tasks, and automata, which are many times as large as their passages, are never moved. Sending all to all documents would grow with the
   square of the corpus.
4. Stretches are streamed word by word. Where the matching statistic reaches the window's length and the state is reached by a smaller id, the
   window's words go. The automaton compares words, so hashes only assign. A window that its shard doesn't confirm shows a collision of
   hashes: the assignment is then made again with another hash, until none is left.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows with a null id neither lose
words nor take them from others; repeated rows get the same result, rows with one id and different texts aren't earlier
than each other; an empty table gives no rows; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.skew import salted_join
from corpusflow.llm.features import mix
from corpusflow.llm.tables import bound_batches, new_folder, pieces

WINDOW = 13
GRAM = 7                # words of an anchor
REF = 4096              # windows of a block of a reference document
SHARD = 60_000          # windows of a reference shard, on average
STREAM = 400_000        # windows that are streamed through one copy of an automaton
GROUP = 400_000         # assigned windows that are cut into pieces together
PIECE = 2_000_000       # bytes of text that one step works on
KEY_BITS = np.uint64((1 << 48) - 1)  # of an anchor's hash; equal ones by chance only mean some more stretches
LONG = 64               # bytes of a word beyond which it is hashed by itself
FILTER_BITS = 1 << 26   # of the bitmaps that leave rows behind at a scan; a fixed 8 MB, results don't depend on them

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_rng = np.random.default_rng(20240513)
PLACES = (_rng.integers(0, 1 << 62, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


# anchors and windows

def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, and their number per text."""
    split = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x09-\x0d]", " "), " ")
    flat = split.flatten()
    real = pc.not_equal(flat, "")
    counts = np.bincount(pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(real), counts


def hashed(words: pa.Array) -> np.ndarray:
    """A hash of every word, eight bytes at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]], np.zeros(8, np.uint8)])
    start, size = ends[:-1] - ends[0], np.diff(ends)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = mix((eight[start] & masks[np.minimum(size, 8)]) + size.astype(np.uint64) * PLACES[0])
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest) and done < LONG:
        h[rest] = mix(h[rest] * PLACES[1] + (eight[start[rest] + done] & masks[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    for i in rest.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Hash of every word, the words, and their number per text."""
    words, counts = words_in(texts)
    return hashed(words), words, counts


def joined(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """Texts of as many consecutive words each, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), words), " ")


def digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def grams(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each ``size`` consecutive words."""
    n = max(0, len(h) - size + 1)
    s = np.full(n, np.uint64(seed))
    for j in range(size):
        s += h[j:n + j] * PLACES[(j + seed) % WINDOW]
    return mix(s)


def window_anchors(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, anchors, gram hashes): the places of the windows within one text, and the anchor's place of each."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, GRAM)
    best = np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1).argmin(axis=1)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))  # words up to the end of the text
    at = np.flatnonzero(left[:len(best)] >= WINDOW)
    return at, at + best[at], g


def described(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, d, n, whole, maybe, keys, ats) of every row: digest, words, digest of the words, whether another row may have the text, and the
    anchors' hashes and places."""
    every = rows(docs, id_column, text_column)
    repeated = every.groupBy("d").agg(F.count("*").alias("c")).where("c > 1")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated.select(_place(F.xxhash64("d")).alias("place"))))

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            h, words, counts = word_hashes(batch.column("text"))
            _, anchors, g = window_anchors(h, counts)
            anchors = anchors[np.diff(anchors, prepend=-1) != 0]  # they ascend
            ends = np.cumsum(counts)
            cuts = np.searchsorted(anchors, np.concatenate([[0], ends]))
            owner = np.repeat(np.arange(len(counts)), np.diff(cuts))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("d"), pa.array(counts, pa.int64()), digests(joined(words, counts)), pa.array(_there(bits.value, batch.column("place").to_numpy())),
                pa.ListArray.from_arrays(offsets, pa.array((g[anchors] & KEY_BITS).view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array((anchors - (ends - counts)[owner]).astype(np.int32)))],
                names=["id", "d", "n", "whole", "maybe", "keys", "ats"])

    placed = every.select("id", "d", "text", _place(F.xxhash64("d")).alias("place"))
    return placed.mapInArrow(run, "id long, d binary, n long, whole string, maybe boolean, keys array<long>, ats array<int>")


def rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, d): the rows with a digest of the text."""
    text = F.col(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("d"))


# tables of what is left

def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, in folders by the columns ``by``.

    The shuffles that made it are removed at once, not when the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    conf = spark.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def _bitmap(places: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the one column ``place``."""
    place = F.col("place") + 1
    parts = places.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _place(hashed):
    return F.pmod(hashed, F.lit(FILTER_BITS))


def _there(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def texts_of(docs: DataFrame, id_column: str, text_column: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (d, id, ...) with the text of each; for repeated rows a row from each task that has one."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(_place(F.xxhash64("d")).alias("place"))))

    def some(batches):
        seen = set()
        for batch in batches:
            keep = _there(bits.value, batch.column("place").to_numpy())
            for i in np.flatnonzero(keep).tolist():
                row = (batch.column("id")[i].as_py(), batch.column("d")[i].as_py())
                keep[i] = row not in seen
                seen.add(row)
            yield batch.select(["id", "d", "text"]).filter(pa.array(keep))

    found = rows(docs, id_column, text_column).where("id is not null").withColumn("place", _place(F.xxhash64("d"))).mapInArrow(some, "id long, d binary, text string")
    return found.join(wanted, ["d", "id"])


def shared_anchors(reps: DataFrame) -> DataFrame:
    """(uid, ats): the anchors of each representative that occur more than once."""
    every = reps.select(F.explode("keys").alias("key"))
    shared = stored(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "passage-anchors")
    bits = reps.sparkSession.sparkContext.broadcast(_bitmap(shared.select(_place(F.col("key")).alias("place"))))

    def some(batches):
        for batch in batches:
            n = np.diff(batch.column("keys").offsets.to_numpy())
            keys = batch.column("keys").flatten().to_numpy()
            keep = _there(bits.value, keys & (FILTER_BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(np.repeat(batch.column("uid").to_numpy(), n)[keep]),
                                              batch.column("ats").flatten().filter(pa.array(keep))], names=["key", "uid", "at"])

    likely = reps.select("uid", "keys", "ats").mapInArrow(some, "key long, uid long, at int")
    sure = salted_join(likely, shared, "key", "c", F.xxhash64("uid", "at"))
    return sure.groupBy("uid").agg(F.sort_array(F.collect_list("at")).alias("ats"))  # no more than the document has


def _runs(places: np.ndarray, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Slices of consecutive places (with one label)."""
    if not len(places):
        return []
    new = np.diff(places) != 1
    if labels is not None:
        new |= labels[1:] != labels[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(places)]])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def stretches(texts: DataFrame) -> DataFrame:
    """(uid, id, start, words): maximal stretches of windows whose anchors are shared."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            h, words, counts = word_hashes(batch.column("text"))
            first = np.cumsum(counts) - counts
            flagged = np.zeros(len(h), bool)
            lists = batch.column("ats")
            flagged[lists.flatten().to_numpy() + np.repeat(first, np.diff(lists.offsets.to_numpy()))] = True
            at, anchors, _ = window_anchors(h, counts)
            at = at[flagged[anchors]]
            doc = np.searchsorted(first, at, side="right") - 1
            cuts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(doc, prepend=-1) != 0))
            begin, k = at[cuts], pa.array(doc[cuts])
            size = at[np.append(cuts[1:], len(at)) - 1] + WINDOW - begin if len(at) else begin
            places = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(k), batch.column("id").take(k), pa.array(begin - first[doc[cuts]], pa.int64()),
                                              joined(words.take(pa.array(places)), size)], names=["uid", "id", "start", "words"])

    return texts.select("uid", "id", "ats", "text").mapInArrow(run, "uid long, id long, start long, words string")


def windows(parts: DataFrame, seed: int) -> DataFrame:
    """(h, uid, id, at): hash and place of each window of the stretches."""

    def run(batches):
        for batch in pieces(batches, "words", PIECE):
            h, _, counts = word_hashes(batch.column("words"))
            if not len(h):
                continue
            left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
            w = grams(h, WINDOW, seed)
            i = np.flatnonzero(left[:len(w)] >= WINDOW)
            row = np.searchsorted(np.cumsum(counts), i, side="right")
            at = i - (np.cumsum(counts) - counts)[row] + batch.column("start").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(w[i].view(np.int64)), pa.array(batch.column("uid").to_numpy()[row]), pa.array(batch.column("id").to_numpy()[row]),
                                              pa.array(at.astype(np.int32))], names=["h", "uid", "id", "at"])

    return parts.mapInArrow(run, "h long, uid long, id long, at int")


def cut_pieces(parts: DataFrame, assigned: DataFrame, groups: int) -> DataFrame:
    """(shard, first, uid, id, start, words): stretches cut where the shard changes; ``first`` marks the reference's own passages."""

    def run(left, right):
        left, right = left.sort_by([("uid", "ascending"), ("start", "ascending")]), right.sort_by([("first", "ascending"), ("uid", "ascending"), ("at", "ascending")])
        uid, start, ids = (left.column(c).to_numpy() for c in ("uid", "start", "id"))
        texts = left.column("words").to_pylist()
        ruid, at, shard, first = (right.column(c).to_numpy() for c in ("uid", "at", "shard", "first"))
        label = mix(ruid.astype(np.uint64)) + mix(shard.astype(np.uint64) * np.uint64(2) + first + PLACES[2])
        spans = _runs(at.astype(np.int64), label)
        low = np.array([a for a, _ in spans], np.int64)
        # the stretch of each run: the last one of its document that starts no later
        wide = np.int64(at.max(initial=0)) + start.max(initial=0) + 1
        known, back = np.unique(uid, return_inverse=True)
        k = np.searchsorted(back * wide + start, np.searchsorted(known, ruid[low]) * wide + at[low], side="right") - 1
        begin, out, last, words = (at[low] - start[k]).tolist(), [], -1, []
        for (a, b), j, x in zip(spans, k.tolist(), begin):
            if j != last:
                words, last = texts[j].split(" "), j
            out.append(" ".join(words[x:x + b - a + WINDOW - 1]))
        return pa.table({"shard": pa.array(shard[low], pa.int64()), "first": pa.array(first[low], pa.bool_()), "uid": pa.array(uid[k], pa.int64()),
                         "id": pa.array(ids[k], pa.int64()), "start": pa.array(at[low], pa.int64()), "words": pa.array(out, pa.string())})

    group = F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group")
    return parts.groupBy(group).cogroup(assigned.groupBy(group)).applyInArrow(run, "shard long, first boolean, uid long, id long, start long, words string")


# suffix automata

class Automaton:
    """Suffix automaton of passages; a state knows the smallest id of the passages that reach it."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [np.iinfo(np.int64).max]
        self.words: dict[str, int] = {}
        self.last = self.separators = 0

    def add(self, passage: list[str], owner: int) -> None:
        for word in passage:
            self._extend(self.words.setdefault(word, len(self.words)), owner)
        self.separators -= 1  # a word of its own behind every passage
        self._extend(self.separators, owner)

    def _extend(self, c: int, owner: int) -> None:
        step, link, length, first = self.step, self.link, self.length, self.first
        new, p = len(step), self.last
        step.append({})
        length.append(length[p] + 1)
        first.append(owner)
        link.append(0)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        self.last = new

    def arrays(self) -> dict[str, np.ndarray | list[str]]:
        """The automaton as flat arrays; ids are passed on to shorter suffixes."""
        first, link = self.first, self.link
        for s in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]
        edges = [(s, c, t) for s, d in enumerate(self.step) for c, t in d.items() if c >= 0]
        return {"words": list(self.words), "source": np.array([e[0] for e in edges], np.int32), "word": np.array([e[1] for e in edges], np.int32),
                "target": np.array([e[2] for e in edges], np.int32), "link": np.array(link, np.int32), "length": np.array(self.length, np.int32),
                "first": np.array(first, np.int64)}


class Stream:
    """Matching statistics of texts against an automaton made of its arrays."""

    def __init__(self, words, source, word, target, link, length, first):
        self.words = {w: i for i, w in enumerate(words)}
        self.wide = len(self.words) + 1
        self.step = dict(zip((np.asarray(source).astype(np.int64) * self.wide + word).tolist(), np.asarray(target).tolist()))
        self.link, self.length, self.first = np.asarray(link).tolist(), np.asarray(length).tolist(), np.asarray(first).tolist()

    def ends(self, passage: list[str], owner: int) -> list[int]:
        """Places where a window ends that a smaller id has."""
        step, link, length, first, wide, known = self.step, self.link, self.length, self.first, self.wide, self.words
        state = size = 0
        out = []
        for i, w in enumerate(passage):
            c = known.get(w, -1)
            if c < 0:
                state = size = 0
                continue
            to = step.get(state * wide + c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step.get(state * wide + c)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= WINDOW:
                while length[link[state]] >= WINDOW:  # the state of the last WINDOW words
                    state = link[state]
                if length[state] < size:
                    size = length[state]
                if first[state] < owner:
                    out.append(i)
        return out


AUTOMATON = ("words", "source", "word", "target", "link", "length", "first")


def automaton(passages: pa.Table) -> Stream:
    """The automaton of a shard's passages (id, words)."""
    made = Automaton()
    for text, owner in zip(passages.column("words").to_pylist(), passages.column("id").to_pylist()):
        made.add(text.split(" "), owner)
    arrays = made.arrays()
    return Stream(*(arrays[n] for n in AUTOMATON))


def confirmed(pieces_: DataFrame) -> DataFrame:
    """(uid, start, stop, missing): word spans of windows that an earlier document has, and how many assigned windows weren't confirmed.

    A shard's passages are sent to each part of what is asked of it and become an automaton there: they are a fraction of its size, and no more
    than the part streams through it.
    """
    passages = pieces_.where("first").select(*(F.col(c).alias(c) for c in ("shard", "id", "words")))  # as columns of its own
    asked = pieces_.where(~F.col("first")).drop("first")
    size = F.sum(F.size(F.split("words", " ")) - (WINDOW - 1))
    parts = asked.groupBy("shard").agg(F.ceil(size / STREAM).cast("int").alias("parts"), F.count("*").alias("c"))
    dealt = salted_join(asked, parts, "shard", "c", F.xxhash64("uid", "start")).withColumn("part", F.pmod(F.xxhash64("uid", "start"), F.col("parts")).cast("int"))
    copies = passages.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "c")

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            stream = automaton(right)
            for uid, owner, start, text in zip(*(left.column(c).to_pylist() for c in ("uid", "id", "start", "words"))):
                words = text.split(" ")
                ends = np.array(stream.ends(words, owner), np.int64)
                missing = len(words) - WINDOW + 1 - len(ends)
                spans = [(int(ends[a]) - WINDOW + 1, int(ends[b - 1]) + 1) for a, b in _runs(ends)]
                for a, b in spans:
                    out.append((uid, start + a, start + b, missing))
                if missing and not spans:
                    out.append((uid, None, None, missing))
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("uid", "start", "stop", "missing"), columns)})

    return dealt.select("shard", "part", "uid", "id", "start", "words").groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(
        run, "uid long, start long, stop long, missing long")


def repeated_spans(parts: DataFrame, seeds=range(1, 9)) -> DataFrame:
    """(uid, spans): word spans [start, stop) of the stretches that earlier documents have."""
    for seed in seeds:
        w = windows(parts, seed)
        own = F.xxhash64("uid", F.floor(F.col("at") / REF))  # the block of reference windows
        firsts = w.groupBy("h").agg(F.min_by(own, "id").alias("block"), F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("c")).where("low < high")
        firsts = stored(firsts.select("h", "block", "low", "c"), "passage-windows")
        size = firsts.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
        shards, groups = max(1, -(-size["n"] // SHARD)), max(1, -(-size["c"] // GROUP))
        both = salted_join(w, firsts, "h", "c", F.xxhash64("uid", "at"))
        first = F.col("id") == F.col("low")
        assigned = both.where(~first | (own == F.col("block"))).select("uid", "at", F.pmod("block", F.lit(shards)).alias("shard"), first.alias("first"))
        spans = stored(confirmed(stored(cut_pieces(parts, assigned, groups), "passage-pieces")), "passage-spans")
        if spans.where("missing > 0").isEmpty():  # else some hashes were equal by chance
            return spans.where("start is not null").groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    raise RuntimeError("windows stay unconfirmed under every hash")


def without_spans(texts: DataFrame, with_text: bool) -> DataFrame:
    """(d, removed, kept_sha256[, kept]) of texts with their spans."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            words, counts = words_in(batch.column("text"))
            ends, lists = np.cumsum(counts), batch.column("spans")
            base = np.repeat(ends - counts, np.diff(lists.offsets.to_numpy()))
            spans, change = lists.flatten(), np.zeros(len(words) + 1, np.int64)
            for edge, by in (("start", 1), ("stop", -1)):
                np.add.at(change, base + pc.struct_field(spans, edge).to_numpy(), by)
            keep = np.cumsum(change)[:-1] == 0
            left = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
            text = joined(words.filter(pa.array(keep)), left)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(counts - left, pa.int64()), digests(text), text if with_text else pa.nulls(len(text), pa.string())],
                                             names=["d", "removed", "digest", "kept"])

    return texts.select("d", "spans", "text").mapInArrow(run, "d binary, removed long, digest string, kept string")


def without_repeats(docs: DataFrame, id_column: str, text_column: str, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document.

    ``with_text`` adds ``kept``: the words that stay, joined by one space, of documents that lose some but not all; null for the others.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    table = stored(described(docs, id_column, text_column).withColumn("uid", F.monotonically_increasing_id()), "passage-documents", "maybe")
    able = table.where(f"id is not null and n >= {WINDOW}")
    alone, several = able.where("not maybe"), able.where("maybe")
    first = stored(several.groupBy("d").agg(F.min(F.struct("id", "uid")).alias("r"), F.count("*").alias("c")).select("d", "r.id", "r.uid", "c"), "passage-firsts")
    classes = stored(alone.select("d", "id", "uid", F.lit(1).cast("long").alias("c")).unionAll(first), "passage-classes")
    anchored = ("uid", "keys", "ats")
    reps = alone.select(*anchored).unionAll(several.select(*anchored).join(first.select("uid"), "uid", "left_semi"))
    flagged = stored(shared_anchors(reps).join(classes.select("uid", "id", "d"), "uid"), "passage-flagged")
    parts = stored(stretches(texts_of(docs, id_column, text_column, flagged)).dropDuplicates(["uid", "start"]), "passage-stretches")
    spans = stored(repeated_spans(parts).join(classes.select("uid", "id", "d"), "uid"), "passage-removed")
    cut = stored(without_spans(texts_of(docs, id_column, text_column, spans), with_text).dropDuplicates(["d"]), "passage-kept")
    of_class = classes.select("d", F.col("id").alias("rep"), "c").join(cut, "d", "left")
    of_class = of_class.where("c > 1 or removed is not null")
    out = salted_join(table.select("id", "d", "n", "whole"), of_class, "d", "c", F.xxhash64("id", "d"), "left")
    copy = (F.col("id") > F.col("rep")) & (F.col("n") >= WINDOW)
    same = F.col("id") == F.col("rep")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("id").cast(kind).alias(id_column), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(same, F.coalesce("removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).when(same, F.coalesce("digest", "whole")).otherwise(F.col("whole")).alias("kept_sha256"),
        *([F.when(same, F.col("kept")).alias("kept")] if with_text else []))
