"""Merkle manifest of a table: a leaf per row, a tree per group, a root over the groups, and a proof per row.

1. Leaves are digests of the rows' columns, made in the scan. A range partitioning by (group, id, leaf) gives every leaf its
   place in its group's tree: counts of (partition, group) are added up, so no group is sorted in one task.
2. Upwards: 2^``LEVELS`` consecutive nodes of a tree are a superblock. Each is reduced to one node; these nodes are numbered
   in superblocks again, until one node of each tree is left, its subroot. Subroots form one more tree of the same kind, whose last node is the root.
3. Downwards, by subtree exchange: a superblock is cogrouped with the nodes it needs from outside, the siblings on the way from its
   own node to the root. One call finishes the local reduction, joins local and outer siblings to proofs, and folds
   each leaf (or what an altered row gives) up to the root. So a proof travels once per superblock and not once per leaf.

A node is the SHA-256 of its children's hexadecimal digests, one after the other; a last child without a partner is hashed alone.

Defined results: nulls in any column are written as ``-`` and have leaves like other values; a null group is a tree of its
own, the first one; null ids come first in their tree and are never altered in the query; rows with equal ids are ordered by their leaves,
and equal rows are leaves each; empty and very long texts are values like others; an empty table gives no rows; columns
that aren't named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusflow.llm.tables import bound_batches, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10                   # levels of a superblock: 1024 nodes
ALONE, RIGHT, LEFT = 0, 1, 2  # the sibling of a node on the way up
KEY = "tree binary, pos long"
OUTER = f"{KEY}, path binary, subroot string, root string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(group: Column) -> Column:
    """Bytes that order groups: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit(b"\x01"), group.cast("string").cast("binary")), F.lit(b""))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos`` from 0 within each ``tree`` and ``n``, the tree's number of rows."""
    uid = rows.withColumn("uid", F.monotonically_increasing_id())  # parts equal rows; ``rows`` is a stored table
    keys = ["tree", *order, "uid"]
    at = uid.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = stored(at.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("uid"), label)
    per = at.groupBy("tree", "part").agg(F.min("at").alias("low"), F.count("*").alias("c"))
    w = W.partitionBy("tree").orderBy("part")
    per = per.select("tree", "part", (F.sum("c").over(w) - F.col("c") - F.col("low")).alias("shift"), F.sum("c").over(W.partitionBy("tree")).alias("n"))
    return at.join(per, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


# inside a superblock

def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], count: int) -> list[list[str]]:
    """The nodes and ``count`` levels above them."""
    out = [nodes]
    for _ in range(count):
        low = out[-1]
        out.append([_hash("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return out


def _count(n: int, most: int) -> int:
    """Levels that a superblock of a tree with ``n`` nodes has above its nodes, up to ``most``."""
    return min(most, (n - 1).bit_length())


def _siblings(levels: list[list[str]], at: int) -> list[tuple[int, str]]:
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((ALONE, "") if other >= len(nodes) else (LEFT if at & 1 else RIGHT, nodes[other]))
        at >>= 1
    return out


def pack_path(siblings: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(h) for side, h in siblings)


def unpack_path(path: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    while at < len(path):
        side, size = path[at], 0 if path[at] == ALONE else 32
        out.append((side, path[at + 1:at + 1 + size].hex()))
        at += 1 + size
    return out


def fold(h: str, siblings: list[tuple[int, str]]) -> str:
    """The last node on the way up from ``h`` along its siblings."""
    for side, other in siblings:
        h = _hash(other + h if side == LEFT else h + other)
    return h


# up and down

def climb(nodes: DataFrame, most: int, height: int, label: str) -> list[DataFrame]:
    """Stage tables (tree, pos, n, hash) from ``nodes`` to the one node of each tree; ``most`` is the number of nodes of the largest tree."""

    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iat[0])
        top = _levels(block["hash"].tolist(), _count(n, height))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // (1 << height))], "hash": top})

    stages = [nodes]
    while len(stages) == 1 or most > 1:
        blocks = stages[-1].select("tree", "pos", "n", "hash").groupBy("tree", F.shiftright("pos", height).alias("pos_above"))
        stages.append(stored(blocks.applyInPandas(reduce, f"{KEY}, n long, hash string"), f"{label}-up"))
        most = -(-most // (1 << height))
    return stages


def exchange(nodes: DataFrame, outer: DataFrame, height: int, finish, schema) -> DataFrame:
    """Superblocks of ``nodes`` cogrouped with the one row of ``outer`` (path, subroot, root) that belongs to the superblock's node.

    ``finish(block, levels, siblings above, subroot, root)`` makes the output rows.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = left.sort_values("pos", ignore_index=True)
        levels = _levels(block["hash"].tolist(), _count(int(block["n"].iat[0]), height))
        return finish(block, levels, unpack_path(bytes(right["path"].iat[0])), right["subroot"].iat[0], right["root"].iat[0])

    above = F.shiftright("pos", height)
    return nodes.groupBy("tree", above.alias("block")).cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(run, schema)


def _pass_on(block, levels, siblings, subroot, root) -> pd.DataFrame:
    paths = [pack_path(_siblings(levels, i) + siblings) for i in range(len(block))]
    return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "path": paths, "subroot": subroot, "root": root})


def descend(stages: list[DataFrame], outer: DataFrame, height: int, label: str) -> DataFrame:
    """What each superblock of the lowest stage needs from outside, from what the top nodes need."""
    for nodes in reversed(stages[1:-1]):
        outer = stored(exchange(nodes, outer, height, _pass_on, OUTER), f"{label}-down")
    return outer


def manifest(docs: DataFrame, id_column: str = "doc_id", columns=COLUMNS, tree_column: str = "lang",
             altered: tuple[Column, dict[str, Column]] | None = None, with_path: bool = False, height: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``altered``: a condition and the values that rows which meet it have when they are verified; their leaves, trees and
    proofs are those of the true values. ``with_path`` adds the siblings (one byte for the side, 32 bytes), for a later :func:`fold`.
    ``height``: levels of a superblock.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    when, values = altered or (F.lit(False), {})
    rows = docs.select(
        F.col(id_column).alias("id"), tree_key(F.col(tree_column)).alias("tree"), leaf([F.col(c) for c in columns]).alias("hash"),
        F.when(when, leaf([values.get(c, F.col(c)) for c in columns])).alias("altered"))
    leaves = stored(numbered(stored(rows, "merkle-leaves"), ["id", "hash"], "merkle-ranges"), "merkle-places")
    leaves = leaves.withColumn("id", F.col("id").cast("string"))  # pandas would make numbers beside nulls inexact
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    stages = climb(leaves, sizes[0] or 0, height, "merkle")
    tops = stages[-1].select(F.lit(b"").alias("tree"), F.col("tree").alias("group"), "hash")
    tops = stored(numbered(tops, ["group"], "merkle-groups"), "merkle-tops")
    over = climb(tops, sizes[1], height, "merkle-top")
    root = over[-1].select("tree", "pos", F.lit(b"").alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))

    def of_groups(block, levels, siblings, subroot, root):
        paths = [pack_path(_siblings(levels, i) + siblings) for i in range(len(block))]
        return pd.DataFrame({"tree": block["group"], "pos": 0, "path": paths, "subroot": block["hash"], "root": root})

    groups = stored(exchange(tops, descend(over, root, height, "merkle-top"), height, of_groups, OUTER), "merkle-outer")
    schema = T.StructType([T.StructField(id_column, T.StringType())] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
                          + [T.StructField("verified", T.BooleanType())] + ([T.StructField("path", T.BinaryType())] if with_path else []))

    def finish(block, levels, siblings, subroot, root):
        outside = "".join(h for _, h in siblings).encode()
        way, proofs, folded, paths = {}, [], [], []
        for i, (own, other) in enumerate(zip(block["hash"], block["altered"])):
            local = _siblings(levels, i)
            proofs.append(hashlib.sha256("".join(h for _, h in local).encode() + outside).hexdigest())
            node = fold(other if isinstance(other, str) else own, local)
            if node not in way:  # leaves that agree on their superblock's node go on together
                way[node] = fold(node, siblings)
            folded.append(way[node])
            if with_path:
                paths.append(pack_path(local + siblings))
        out = pd.DataFrame({id_column: block["id"], "leaf": block["hash"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded})
        out["verified"] = out["folded_root"] == root
        out[id_column] = out[id_column].where(out[id_column].notna(), None)
        if with_path:
            out["path"] = paths
        return out

    out = exchange(leaves, descend(stages, groups, height, "merkle"), height, finish, schema)
    return out.withColumn(id_column, F.col(id_column).cast(kind))


def one_more_character(id_column: str = "doc_id", column: str = "n_chars") -> tuple[Column, dict[str, Column]]:
    """The query's tampering: one is added to the count in rows whose id's CRC-32 is divisible by seven."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 0, {column: F.col(column).cast("decimal(20,0)") + 1}
