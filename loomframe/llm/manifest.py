"""Merkle manifest of a dataset: a root that fixes every row, and a proof for each row that leads to it.

Each source has a tree: its leaves in the order of their ids, every ``FANOUT`` consecutive
nodes hashed into one until one is left. The roots of these trees, in the order of their sources, are the
leaves of one more tree, whose root is the dataset's.

Built bottom up: a level is a table of parents, each with the digests of its children, made
from the level below by one grouping of at most ``FANOUT`` rows a key, and written to the shared folder. A
place in a tree is a number, so a parent is found by division, and a level is as evenly dealt out
for a hot source as for many small ones. Each level has a sixteenth of the rows below it.

Proofs are pushed top down: parents join the proof suffix that they have inherited, and each child
prepends what its siblings are. Only the digests of a run travel with its parent; the proof of
a row exists in the task that makes it, and nothing of it is exchanged but its inherited part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored

FANOUT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROOTS = ""  # the tree of the sources' roots


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value as '-' if null, else its UTF-8 byte count, a colon and itself."""
    written = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written))


def ascii_lower(text: Column) -> Column:
    """A-Z, and nothing else, in lower case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with pos (their place in their tree, from 0) and n (how many the tree has).

    Rows are dealt out by ranges of (tree, order), and a place is that in the partition and a sum of what the
    partitions before hold of the tree: a large tree is many partitions. Rows that agree in all of order are told apart by
    where they were read, so a repeated row is no hot spot either.
    """
    spark = nodes.sparkSession
    nodes = stored(nodes.withColumn("_met", F.monotonically_increasing_id()), "merkle-nodes")  # a range exchange reads its input twice
    by = ["tree", *order, "_met"]
    ranged = nodes.repartitionByRange(parts(spark), *by).sortWithinPartitions(*by).drop("_met").withColumn("_m", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "merkle-order")
    held = ranged.groupBy("tree", "_part").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_held"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_held").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(held.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_held").over(tree).alias("n")), "merkle-offsets")
    return ranged.join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_m") + F.col("_shift")).drop("_m", "_part", "_shift")


@dataclass
class Trees:
    """leaves: (tree, pos, n, digest, ...). levels: from the lowest, (tree, pos, n, digest, kids). n: nodes of the tree at that level."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest, height): the one node left of each tree; a lone leaf has height 0."""
        out = None
        for height, level in enumerate([self.leaves, *self.levels]):
            top = level.where("n = 1").select("tree", "digest", F.lit(height).alias("height"))
            out = top if out is None else out.unionByName(top)
        return out

    def push(self, tops: DataFrame) -> DataFrame:
        """The leaves with path, from the leaf's siblings upwards, and the columns of tops.

        tops: a row for each tree, with its height and the path that its root has inherited. A path is an array of (left, right):
        the digests beside a node in its run, as text.
        """
        carried = [c for c in tops.columns if c not in ("tree", "height")]
        begin = lambda height: tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("pos"), *carried)
        given = None
        for height in range(len(self.levels), 0, -1):
            met = begin(height) if given is None else given.unionByName(begin(height))
            row = self.levels[height - 1].select("tree", "pos", "kids").join(met, ["tree", "pos"])
            row = row.withColumn("_all", F.array_join(F.transform("kids", lambda k: k["digest"]), ""))
            row = row.select("tree", "_all", *carried, F.posexplode("kids").alias("_i", "_kid"))
            sides = F.struct(F.substring("_all", F.lit(1), F.col("_i") * 64).alias("left"), F.substring("_all", F.col("_i") * 64 + 65, F.lit(64 * FANOUT)).alias("right"))
            longer = F.concat(F.array(sides), "path").alias("path")
            given = row.select("tree", "_kid.*", *(longer if c == "path" else c for c in carried))
            if height > 1:  # written down, so that no plan holds all levels
                given = stored(given.select("tree", "pos", *carried), f"merkle-proofs-{height}")
        lone = self.leaves.where("n = 1").drop("n").join(begin(0).drop("pos"), "tree")
        return lone if given is None else given.unionByName(lone)


def grow(nodes: DataFrame, order: list[str]) -> Trees:
    """Trees over nodes: (tree, digest, and whatever else), in the order of the columns named; what else nodes have stays with the leaves."""
    leaves = stored(numbered(nodes, order), "merkle-leaves")
    levels, below = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kid = F.struct("pos", *(c for c in below.columns if c not in ("tree", "pos", "n", "kids")))
        runs = below.where("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("_at")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
        level = runs.select("tree", F.col("_at").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), digest(F.array_join(F.transform("kids", lambda k: k["digest"]), "")).alias("digest"), "kids")
        below = stored(level, f"merkle-level-{len(levels) + 1}")
        levels.append(below)
        most = -(-most // FANOUT)
    return Trees(leaves, levels)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, beside: digest(beside["left"], node, beside["right"]))


def proofs(docs: DataFrame, claimed: Column | None = None, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a document: id, leaf, subroot, root, path, and with ``claimed`` (a digest made of columns of docs) also claimed.

    A null source is a tree of its own, before all others; a null id comes before all others of its source.
    Rows that agree in source and id are ordered by their leaf, and rows equal in every field of the
    leaf take neighbouring places. Columns that are not in ``fields`` are not read. An empty table gives no rows and has no root.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("-"))
    made = [c.alias(name) for name, c in (("digest", leaf([F.col(c) for c in fields])), ("claimed", claimed)) if c is not None]
    trees = grow(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), *made), ["id", "digest"])
    roots = stored(trees.roots(), "merkle-roots")
    top = grow(roots.select(F.lit(_ROOTS).alias("tree"), "digest", F.col("tree").alias("of"), F.col("height").alias("own_height")), ["of"])
    begun = top.roots().select("tree", "height", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = top.push(begun).select(F.col("of").alias("tree"), F.col("own_height").alias("height"), F.col("digest").alias("subroot"), "root", "path")
    found = trees.push(stored(tops, "merkle-tops"))
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *(["claimed"] if claimed is not None else []))


def audited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 5, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """proofs() with proof_sha256, folded_root and verified, after A-Z of each ``every``-th text by CRC of the id were put in lower case.

    What is folded is the changed row's leaf with the siblings of the manifest. A row with a null id is not changed; a text without
    A-Z stays as it is, and verifies.
    """
    chosen = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    text = F.when(chosen, ascii_lower(F.col(text_col).cast("string"))).otherwise(F.col(text_col).cast("string"))
    found = proofs(docs, leaf([text if c == text_col else F.col(c) for c in fields]), id_col=id_col, fields=fields)
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.withColumns({"proof_sha256": digest(beside), "folded_root": folded(F.col("claimed"), F.col("path"))})
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
