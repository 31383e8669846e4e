"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian pruning, exact verification, components.

1. Every text gives its set of distinct word shingles as 64-bit hashes, a digest of the set and a MinHash signature.
   Texts with the same set are one class; its smallest id stands for it.
2. Signatures are cut into bands; representatives with an equal band share a bucket. Each member is paired with the bucket's
   centre, so a bucket of m members gives m - 1 candidates.
3. Candidates are compared in batches of signature values. A pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold is below ``MISS``. What survives is verified on the full sets, with integers.
4. Links give components (alternating star contraction). In a bucket that still holds several components, the members
   outside of its largest one are compared with all other members, block against block inside tasks: the same
   pruning, then full sets. A task emits only links that join components, so a bucket of m members gives less than m
   rows a block, and a bucket of any size is dealt over many tasks. So a link between two texts that share a bucket
   isn't lost, whatever the centre was. With these links the components are made anew.

The bands are as wide as they can be while a pair at the threshold shares no bucket with a probability below 1e-5.

Defined results: a text of fewer words than a shingle is one shingle; null texts and texts without words have an empty set
and are linked with nothing; rows with a null id stay on their own; rows that repeat an id with the same text
are one document, with another text a document of their own (so such an id may have several components); an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.features import mix, word_grams
from corpusflow.llm.tables import bound_batches, fresh, pieces, stored

WORDS = 5
PER_HUNDRED = 85       # 100 x intersection >= PER_HUNDRED x union makes a link
VALUES = 100           # of a signature
UNSEEN = 1e-5          # probability that a pair at the threshold shares no bucket
BATCH = 20             # signature values that are compared at a time
MISS = 1e-6            # posterior probability of a link below which a pair is dropped
BLOCK = 1 << 20        # shingles of a block of members; a task compares two blocks
BLOCK_ROWS = 1024      # and its members
PIECE = 2_000_000      # bytes of text that one step works on
FILTER_BITS = 1 << 26  # of the bitmap that keeps other documents out of the verification; a fixed 8 MB

_rng = np.random.default_rng(20240229)
MULTIPLIERS = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
OFFSETS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
PLACES = (_rng.integers(0, 1 << 62, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
WEIGHTS = (_rng.integers(0, 1 << 62, 20, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


# sets and signatures

def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x09-\x0d]", " ")
    split = pc.split_pattern(plain, " ")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if not distinct:
        return [np.zeros(0, np.uint64) for _ in counts]
    h, n = word_grams(distinct, (), whole=True)
    of_word = np.zeros(len(distinct), np.uint64)
    of_word[n > 0] = h
    index = coded.indices.to_numpy()
    real = (n > 0)[index]
    w = of_word[index[real]]
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    counts = np.bincount(owner, minlength=len(counts))
    s = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for j in range(words):
        s += w[j:len(w) - words + 1 + j] * PLACES[j]
    s = mix(s)
    out, at = [], 0
    for k in counts.tolist():
        if k >= words:
            out.append(np.unique(s[at:at + k - words + 1]))
        elif k:
            out.append(mix((w[at:at + k] * PLACES[:k]).sum(keepdims=True) + PLACES[7:] * np.uint64(k)))
        else:
            out.append(s[:0])
        at += k
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set; sixteen bits of each are kept."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[None, i:i + 2048] * MULTIPLIERS[:, None] + OFFSETS[:, None]).min(axis=1))
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def describe(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n, d1, d2, sig): size, digest and signature of each document's set; empty sets have no digest."""

    def run(batches):
        for batch in pieces(batches, text_column, PIECE):
            sets = shingle_sets(batch.column(text_column))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(id_column), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                pa.array([d and int.from_bytes(d[8:], "little", signed=True) for d in digests], pa.int64()),
                pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary())], names=["id", "n", "d1", "d2", "sig"])

    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(run, "id long, n long, d1 long, d2 long, sig binary")


def band_rows(per_hundred: int) -> int:
    """Values of a band: as many as keep the probability of an unseen pair below ``UNSEEN``."""
    t = per_hundred / 100
    return max([1, *(r for r in range(2, 21) if (1 - t ** r) ** (VALUES // r) <= UNSEEN)])


def band_keys(reps: DataFrame, per_hundred: int = PER_HUNDRED) -> DataFrame:
    """(key, id) for each band of each representative."""
    rows = band_rows(per_hundred)
    bands = VALUES // rows

    def run(batches):
        for batch in batches:
            sig = signatures(batch.column("sig"))[:, :bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = mix((sig * WEIGHTS[None, None, :rows]).sum(axis=2) + np.arange(bands, dtype=np.uint64)[None, :] * PLACES[6])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), bands))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


# Bayesian pruning

def least_matches(per_hundred: int = PER_HUNDRED, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): with a flat prior the posterior after m of n is a beta, and
    P(similarity >= t) is the chance of at most m successes among n + 1 draws at t."""
    t, out = per_hundred / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        p, m = 0.0, 0
        while m <= n:
            p += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if p >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays may be links; later batches are compared for those only that are left."""
    left, got, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in needed:
        got[left] += (a[left, at:n] == b[left, at:n]).sum(axis=1)
        left = left[got[left] >= m]
        at = n
    return left


def prune(pairs: DataFrame, reps: DataFrame, per_hundred: int) -> DataFrame:
    """Candidate pairs (a, b) that the posterior keeps. Pairs whose sizes can't reach the threshold go first."""
    side = reps.select("id", "n", "sig")
    x = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    x = x.join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    x = x.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_hundred))
    needed = least_matches(per_hundred)

    def run(batches):
        for batch in batches:
            if len(batch):
                yield batch.select(["a", "b"]).take(pa.array(survivors(signatures(batch.column("sa")), signatures(batch.column("sb")), needed)))

    return x.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


# exact verification

def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashes of ``ids``."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    rows = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def full_sets(ids: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, set) of the documents in ``ids`` (distinct), read in one scan; others stay behind at the scan."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(ids))
    keyed = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null")
    keyed = keyed.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))

    def sets(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            some = batch.filter(pa.array((bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for part in pieces(iter([some]), "text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"))], pa.binary())], names=["id", "set"])

    return stored(keyed.mapInArrow(sets, "id long, set binary").join(ids, "id", "left_semi").dropDuplicates(["id"]), "near-sets")


def linked(a: np.ndarray, b: np.ndarray, per_hundred: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_hundred * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, per_hundred: int) -> DataFrame:
    """Links among candidate pairs, by intersection and union of their full sets."""

    def run(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), per_hundred)
                    for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return x.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


# components

def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids of ``links`` (a, b), by alternating large and small stars; the component is its smallest id.

    A star's minimum is an aggregate, combined before the shuffle, so a hub isn't gathered anywhere.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def block_links(members: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, per_hundred: int) -> DataFrame:
    """Links between components that share a bucket, enough to join what is linked.

    ``members``: (key, id) of buckets with at least three members. A bucket's members outside of its largest component are
    compared with all members.
    """
    tagged = members.join(labels, "id", "left").join(reps.select("id", "n", "sig"), "id")
    tagged = stored(tagged.select("key", "id", F.coalesce("component", "id").alias("component"), "n", "sig"), "near-tagged")
    per = tagged.groupBy("key", "component").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "component", "c")).alias("m"), F.sum("n").alias("all"), F.sum("c").alias("rows"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, c: F.greatest(F.ceil(n / BLOCK), F.ceil(c / BLOCK_ROWS)).cast("int")
    main = main.select("key", F.col("m.component").alias("main"), blocks(F.col("all"), F.col("rows")).alias("ys"), blocks(F.col("all") - F.col("m.n"), F.col("rows") - F.col("m.c")).alias("xs"))
    some = tagged.join(main, "key").join(sets, "id")
    place = F.pmod(F.xxhash64("id", "key"), F.lit(1 << 30))
    right = some.withColumns({"y": F.pmod(place, "ys").cast("int"), "x": F.explode(F.sequence(F.lit(0), F.col("xs") - 1))})
    left = some.where("component != main").withColumns({"x": F.pmod(place, "xs").cast("int"), "y": F.explode(F.sequence(F.lit(0), F.col("ys") - 1))})
    columns = ["key", "x", "y", "id", "component", "sig", "set"]
    rows = right.select(*columns, F.lit(False).alias("asks")).union(left.select(*columns, F.lit(True).alias("asks")))
    needed = least_matches(per_hundred)

    def run(group: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        each = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        ids, label = group.column("id").to_numpy(), np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
        asks = group.column("asks").to_numpy()
        others, a, b = np.flatnonzero(~asks), [], []
        for i in np.flatnonzero(asks).tolist():
            o = others[label[others] != label[i]]
            for j in o[survivors(np.broadcast_to(sig[i], (len(o), VALUES)), sig[o], needed)].tolist():
                if label[j] != label[i] and linked(each[i], each[j], per_hundred):
                    label[label == label[j]] = label[i]
                    a.append(max(ids[i], ids[j]))
                    b.append(min(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _one_text_each(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str] | None:
    """Where ids have several texts: the documents with a column in which such rows have a number of their own; else None."""
    several = docs.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("several")).agg(
        F.min(F.xxhash64(text_column)).alias("a"), F.max(F.xxhash64(text_column)).alias("b")).where("a <> b").select("several")
    several = stored(several, "near-several")
    if several.isEmpty():
        return None
    own, mark = fresh(docs, "own", "mark")
    marked = docs.join(several.withColumnRenamed("several", mark), docs[id_column].cast("long") == F.col(mark), "left")
    low = F.lit(-(1 << 63)) + F.xxhash64(id_column, text_column).bitwiseAND(F.lit((1 << 61) - 1))
    return marked.withColumn(own, F.when(F.col(mark).isNotNull(), low).otherwise(F.col(id_column).cast("long"))).drop(mark), own


def near_duplicates(docs: DataFrame, id_column: str, text_column: str, per_hundred: int = PER_HUNDRED) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    bound_batches(docs.sparkSession)
    alone = _one_text_each(docs, id_column, text_column)
    if alone is None:
        return _near_duplicates(docs, id_column, text_column, per_hundred)
    marked, own = alone
    found = stored(_near_duplicates(marked, own, text_column, per_hundred).where(F.col(own).isNotNull()).dropDuplicates([own]), "near-found")
    rows = marked.select(F.col(id_column).cast("long").alias("id"), F.col(own).alias("own"))
    rows = rows.join(found.select(F.col(own).alias("own"), "n_shingles", F.col("component_id").alias("group")), "own", "left")
    names = rows.where("group is not null").groupBy("group").agg(F.min("id").alias("component_id"))
    out = rows.join(names, "group", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _near_duplicates(docs: DataFrame, id_column: str, text_column: str, per_hundred: int) -> DataFrame:
    """The same for documents whose ids have one text each."""
    all_docs = stored(describe(docs, id_column, text_column), "near-documents")
    usable = all_docs.where("d1 is not null and id is not null")
    reps = usable.groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "sig")).alias("r")).select("d1", "d2", "r.*")
    reps = stored(reps, "near-classes")
    keys = band_keys(reps, per_hundred)
    centres = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key"), "id"))["id"].alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(centres, "key"), "near-buckets")
    pairs = members.where("id != centre").select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()
    candidates = stored(prune(pairs, reps, per_hundred), "near-candidates")
    crowded = members.where("size > 2").select("key", "id")
    sets = full_sets(candidates.select(F.explode(F.array("a", "b")).alias("id")).union(crowded.select("id")).distinct(), docs, id_column, text_column)
    labels = stored(components(verify(candidates, sets, per_hundred)), "near-labels")
    more = stored(block_links(crowded, reps, sets, labels, per_hundred), "near-links")
    if not more.isEmpty():
        labels = stored(components(more.union(labels.select("id", "component"))), "near-labels")
    of_class = reps.select("d1", "d2", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = all_docs.select("id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, id_column: str, text_column: str, per_hundred: int = 80) -> DataFrame:
    """The filter: of each component the document with the smallest id, with all its columns. Of several texts of one id in a component all stay."""
    bound_batches(docs.sparkSession)
    alone = _one_text_each(docs, id_column, text_column)
    marked, own = alone or (docs, id_column)
    gone, real = fresh(marked, "gone", "real")
    found = _near_duplicates(marked, own, text_column, per_hundred)
    if alone is None:
        dropped = found.where(~F.col("kept")).select(F.col(own).alias(gone)).distinct()
    else:  # a component's smallest id is known by the real ids of its members
        found = stored(found.where(F.col(own).isNotNull()).select(F.col(own).alias(gone), "component_id").distinct(), "near-found")
        named = found.join(marked.select(F.col(own).alias(gone), F.col(id_column).cast("long").alias(real)).where(F.col(gone).isNotNull()).distinct(), gone)
        low = named.groupBy("component_id").agg(F.min(real).alias("low"))
        dropped = named.join(low, "component_id").where(F.col(real) > F.col("low")).select(gone)
    return marked.join(dropped, marked[own].cast("long") == dropped[gone], "left_anti").select(*docs.columns)
