"""Merkle manifests: a digest of every row, one root over all of them, and for each row the proof that it is under the root.

Each group's rows are the leaves of a tree whose nodes have eight children at most; the roots of
the groups are the leaves of one more. Leaves are placed by a range shuffle of their digests alone,
blocks of 4,096 are reduced in tasks of their own, and the few nodes that remain make the upper tree: the driver
builds it and broadcasts each block's path to the root, with which the tasks finish the proofs of the
block's rows. Where more nodes remain than the driver takes, they are reduced once more in the same way.

Rows without an order value are behind the others; rows that are equal in group and order are placed by
their digests, and repeated rows are leaves each. The null group comes first. An empty table gives no rows.
Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

#: Children of a node.
FAN = 8
#: Levels that one block reduces: blocks have 8^4 leaves.
BLOCK_LEVELS = 4
#: Nodes that the driver takes, so broadcasts have so many rows, each with a path of a few KB.
TOP = 4096
PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as it stands in a leaf: its length in bytes, a colon and itself; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, leaf_, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """A digest of a proof: of all its siblings in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def proofs(rows: DataFrame, group: str, order: str, leaf_col: str = "leaf") -> DataFrame:
    """rows with subroot (their group's), root and path, the siblings of each level from the leaf's up to
    the root; columns of rows with these names give way. rows are shuffled twice, so they should be narrow: digests, not texts."""
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("subroot", "root", "path")])
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # the null group sorts first
    table = rows.select(name.alias("g"), F.col(order).alias("o"), F.col(leaf_col).alias("h"), payload.alias("row"))
    return _proved(_placed(table)).select("row.*", "subroot", "root", "path")


def _placed(table: DataFrame) -> DataFrame:
    """g, n (the group's rows), pos (from 0), h, row of a table (g, o, h, row): rows are sorted in ranges, and
    counts of the ranges before are added to the places within them."""
    table = staged(table.withColumn("i", F.monotonically_increasing_id()), "merkle-leaves")  # i keeps repeated rows apart
    by = [F.col("g"), F.col("o").asc_nulls_last(), F.col("h"), F.col("i")]
    at = F.monotonically_increasing_id()
    dealt = staged(table.repartitionByRange(*by).sortWithinPartitions(*by).select("g", "h", "row", at.alias("at"), F.spark_partition_id().alias("part")), "merkle-ranges")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    of = Window.partitionBy("g")
    before = F.sum("c").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(of).alias("n"))
    return dealt.join(counts, ["g", "part"]).select("g", "n", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "h", "row")


def _proved(nodes: DataFrame) -> DataFrame:
    """g, pos, h, row, subroot, root, path of placed nodes (g, n, pos, h, row): blocks are reduced, the nodes
    that remain are proved, and what they get is handed down to the nodes of their blocks."""
    size = FAN**BLOCK_LEVELS
    grouped = nodes.groupBy("g", "n", F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "h", "row"))).alias("nodes"))
    blocks = staged(grouped, "merkle-blocks")
    levels = _levels(blocks)
    top = staged(levels.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), F.col(f"l{BLOCK_LEVELS}")[0].alias("h"), F.lit(None).cast("string").alias("row")), "merkle-nodes")
    above = _above(top).select("g", F.col("pos").alias("block"), F.col("path").alias("up"), "subroot", "root")
    with_path = F.transform("nodes", lambda node, i: F.struct(node["pos"].alias("pos"), node["h"].alias("h"), node["row"].alias("row"), F.concat(_path(i), F.col("up")).alias("path")))
    return levels.join(above, ["g", "block"]).select("g", "subroot", "root", F.explode(with_path).alias("x")).select("g", "x.pos", "x.h", "x.row", "subroot", "root", "x.path")


def _levels(blocks: DataFrame) -> DataFrame:
    """blocks with the digests of their levels, l0 (those of the nodes), l1, ...; a level on which the group has
    one node is the last, and those above are the same."""
    out = blocks.withColumn("l0", F.transform("nodes", lambda x: x["h"]))
    for k in range(BLOCK_LEVELS):
        below = F.col(f"l{k}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        joined = F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(below, r * FAN + 1, FAN), ""), 256))  # noqa: B023  used at once
        out = out.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN**k, joined).otherwise(below))
    return out


def _path(i: Column) -> Column:
    """The siblings, level by level, of a block's i-th node."""
    steps = []
    for k in range(BLOCK_LEVELS):
        at = F.floor(i / FAN**k).cast("int")
        start = F.floor(i / FAN ** (k + 1)).cast("int") * FAN
        left, right = F.slice(f"l{k}", start + 1, at - start), F.slice(f"l{k}", at + 2, start + FAN - 1 - at)
        steps.append(F.when(F.col("n") > FAN**k, F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _above(nodes: DataFrame) -> DataFrame:
    """g, pos, path, subroot, root of nodes (g, n, pos, h), staged."""
    if nodes.limit(TOP + 1).count() <= TOP:
        return F.broadcast(_upper_tree(nodes))
    if not nodes.where("n > 1").isEmpty():
        return _proved(nodes)
    # every group is down to its root: they are the leaves of the last tree
    roots = nodes.select(F.lit("").alias("g"), F.col("g").alias("o"), "h", F.struct("g", "h").alias("row"))
    return _proved(_placed(roots)).select(F.col("row.g").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("row.h").alias("subroot"), "root")


def _upper_tree(nodes: DataFrame) -> DataFrame:
    """The same, built on the driver from at most TOP nodes."""
    of = defaultdict(list)
    for r in sorted(nodes.select("g", "pos", "h").collect(), key=lambda r: (r["g"].encode(), r["pos"])):
        of[r["g"]].append(r["h"])
    trees = {g: _tree(hashes) for g, hashes in of.items()}
    root, paths = _tree([subroot for subroot, _ in trees.values()])
    rows = [(g, pos, path + paths[n], subroot, root) for n, (g, (subroot, own)) in enumerate(trees.items()) for pos, path in enumerate(own)]
    return nodes.sparkSession.createDataFrame(rows, f"g string, pos long, path {PATH}, subroot string, root string")


def _tree(hashes: list[str]) -> tuple[str | None, list[list[tuple[str, str]]]]:
    """The root of nodes and each one's siblings, level by level, left and right of it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in hashes]
    level, width = hashes, 1
    while len(level) > 1:
        for i, path in enumerate(paths):
            at = i // width
            start = at - at % FAN
            path.append(("".join(level[start:at]), "".join(level[at + 1 : start + FAN])))
        level, width = [hashlib.sha256("".join(level[s : s + FAN]).encode()).hexdigest() for s in range(0, len(level), FAN)], width * FAN
    return (level[0] if level else None), paths


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, in trees by lang. To show what a proof is good
    for, documents whose id's crc32 is a multiple of 3 are tampered with, their A-Z lower-cased, before their leaf is folded
    to a root; that is found out unless nothing changed. Null ids and texts aren't tampered with."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "".join(map(chr, range(65, 91)))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    digests = docs.select("doc_id", "lang", leaf(*columns, F.col("text")).alias("leaf"), F.when(hit, leaf(*columns, F.translate("text", upper, upper.lower()))).alias("tampered"))
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proofs(digests, "lang", "doc_id").select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
