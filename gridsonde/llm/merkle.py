"""Merkle manifest of a dataset: a tree per source, a tree over the sources' roots, and an inclusion proof for every row.

Method. Leaves of a source are numbered in order of their id. Each aligned block of ``BLOCK`` nodes becomes one row that keeps a
level as one string, the hexadecimal digests of its nodes joined. The level above is made by hashing fixed-width substrings
(``FAN`` digests), and the siblings of a node are the two substrings that flank it within its run. A block climbs ``LEVELS``
levels at once; what it leaves is a node of the next round, so a tree of n leaves takes log n / log BLOCK rounds. Roots of
sources are the leaves of the last tree, built alike. Proofs go down again: a block passes the path above it to its nodes.

Scale. Nothing is collected but the largest count of a source (one number). Numbers come from a sorted, range-partitioned copy
of the digests (a hot source is split, and so are equal rows, by a salt) and a small table of counts per source and partition.
A block has ``BLOCK`` rows at most. Texts are read once and never shuffled. Every step starts from a table in the shared folder.

Odd cases: a null field is ``-`` and differs from an empty one. Rows without source form a tree of their own, the first. Rows
that share an id are ordered by digest, a null id comes first; equal rows are leaves of their own. A source with one row has
that leaf as its root, and a single source its root as the root of all. A null id is never tampered with. An empty table gives
no rows. Very long texts are hashed whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde.llm.shared import id_remainder, written

FAN, LEVELS, WIDE = 16, 2, 64
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """tree, doc_id, leaf, changed: ``changed`` is the leaf of the row as tampered with (A-Z of its text lower-cased), null where it is left alone."""
    plain = [F.col(f"`{c}`") for c in FIELDS]
    touched = [*plain[:-1], F.translate(F.col("text"), UPPER, LOWER)]
    return docs.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("tree"), F.col("doc_id"),
                       leaf_of(plain).alias("leaf"), F.when(id_remainder("doc_id", every) == 0, leaf_of(touched)).alias("changed"))


def numbered(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds ``at``, the number of a row among those of its ``tree`` in the given order from 0, and ``n``, their count."""
    dealt = df.withColumn("salt", F.rand(1)).repartitionByRange(tree, *order, "salt").sortWithinPartitions(tree, *order)
    rows = written(dealt.drop("salt").withColumn("row", F.monotonically_increasing_id()), name)  # ascending over the whole table
    rows = rows.withColumn("part", F.shiftright("row", 33))
    parts = rows.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    totals = parts.groupBy(tree).agg(F.sum("rows").alias("n"), F.collect_list(F.struct("part", "first", "rows")).alias("all"))
    # One entry a partition that the tree touches, so the list is bounded by the number of partitions.
    starts = totals.select(tree, "n", F.explode(F.aggregate(
        F.array_sort("all"), F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<part:bigint,shift:bigint>>").alias("out")),
        lambda acc, x: F.struct((acc["sum"] + x["rows"]).alias("sum"), F.concat(acc["out"], F.array(F.struct(x["part"].alias("part"), (acc["sum"] - x["first"]).alias("shift")))).alias("out")),
        lambda acc: acc["out"])).alias("e")).select(tree, "n", "e.part", "e.shift")
    return rows.join(starts, [tree, "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _above(level: Column) -> Column:
    """The level above, from fixed-width substrings of this one."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * WIDE)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FAN * WIDE) + 1, F.lit(FAN * WIDE)), 256)), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, n, members, l0 .. l2, height, top from nodes (tree, at, n, node, carried): one row an aligned block.
    ``height`` is the number of levels it climbs, ``top`` the node it leaves."""
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "node", "carried"))).alias("members"))
    grouped = grouped.withColumn("l0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    grouped = grouped.withColumn("height", F.when(F.col("n") <= 1, 0).when(F.col("n") <= FAN, 1).otherwise(2))
    grouped = grouped.withColumn("l1", F.when(F.col("height") > 0, _above(F.col("l0"))))
    grouped = grouped.withColumn("l2", F.when(F.col("height") > 1, _above(F.col("l1"))))
    return grouped.withColumn("top", F.coalesce("l2", "l1", "l0"))


@dataclass(frozen=True)
class Trees:
    """The rounds of blocks of a set of trees, from the leaves up; a tree that is done passes the later rounds unchanged."""

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        return self.rounds[-1].select("tree", "top")


def grown(nodes: DataFrame, largest: int, name: str) -> Trees:
    """Trees over nodes (tree, at, n, node, carried); ``largest`` is the greatest n."""
    rounds = []
    while True:
        rounds.append(written(blocks(nodes), f"{name}-{len(rounds)}"))
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return Trees(rounds)
        nodes = rounds[-1].select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("node"),
                                  F.lit(None).cast("string").alias("carried"))


def _flanks(level: str, index: Column) -> Column:
    """The digests left and right of node ``index`` of the level within its run."""
    place = index % FAN
    return F.struct(F.substring(F.col(level), (index - place) * WIDE + 1, place * WIDE).alias("left"),
                    F.substring(F.col(level), index * WIDE + WIDE + 1, (FAN - 1 - place) * WIDE).alias("right"))


def paths(trees: Trees, above: DataFrame, keep: list[str]) -> DataFrame:
    """tree, node, carried, path and the columns ``keep`` of ``above`` for every leaf; ``above`` has the path from a tree's root on.
    A path lists the siblings (left, right) of each level upwards."""
    upper = above.withColumn("place", F.lit(0).cast("long"))
    for level in reversed(trees.rounds):
        met = level.join(upper.withColumnRenamed("path", "upper").withColumnRenamed("place", "block"), ["tree", "block"])
        each = met.select("tree", "l0", "l1", "height", "upper", *keep, F.explode("members").alias("m"))
        index = F.col("m.at") % BLOCK
        own = F.array(_flanks("l0", index), _flanks("l1", F.floor(index / FAN).cast("long")))
        upper = each.select("tree", F.col("m.at").alias("place"), F.col("m.node").alias("node"), F.col("m.carried").alias("carried"), *keep,
                            F.concat(F.slice(own, F.lit(1), F.col("height")), "upper").alias("path"))
        rows = upper
        upper = upper.drop("node", "carried")
    return rows.drop("place")


def proof_of(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; every fifth id (by checksum) is tampered with before its proof is checked."""
    rows = numbered(written(leaves(docs, every), "merkle-leaves"), "tree", ["doc_id", "leaf"], "merkle-order")
    largest = rows.agg(F.max("n")).first()[0]
    if largest is None:
        largest = 0
    own = grown(rows.select("tree", "at", "n", F.col("leaf").alias("node"), F.struct("doc_id", "changed").alias("carried")), largest, "merkle-blocks")
    sources = numbered(own.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), "top"), "tree", ["source"], "merkle-sources")
    count = sources.count()
    over = grown(sources.select("tree", "at", "n", F.col("top").alias("node"), F.col("source").alias("carried")), count, "merkle-root")
    start = F.array().cast("array<struct<left:string,right:string>>")
    over_paths = paths(over, over.roots().select("tree", F.col("top").alias("root"), start.alias("path")), ["root"])
    above = over_paths.select(F.col("carried").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    found = paths(own, above, ["subroot", "root"])
    out = found.select("carried.doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"),
                       folded(F.col("path"), F.coalesce("carried.changed", "node")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
