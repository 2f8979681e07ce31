"""Jaccard self-join on word n-grams with Bayesian candidate pruning.

1. A text becomes the set of its n-word shingles (64-bit hashes) and a MinHash
   signature. Texts with the same set are one node, with a weight.
2. Banding finds nodes that may be near: with 21 bands of 3 a pair at the threshold of
   0.8 is missed in 3 of 10^7 cases. The signatures of a band key's nodes meet, sorted, and are
   compared STEP values at a time; a pair is dropped once the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below ``tolerance``. What is
   left ties its nodes, as a tree for each key and never as pairs; a key of more
   than CROWD nodes ties them all. Connected nodes are a family: those that no pair could link are apart.
3. A family's texts meet in one task, or in blocks against blocks if there are more than
   BLOCK. There pairs are pruned likewise, and what is left is
   verified on the exact sets: pair by pair, or for dense blocks as a product of
   incidence matrices. A task returns a row for each node: the weight of its links and the
   root of its piece, never the pairs.
4. Roots are joined to classes; copies take the class of their node.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, stored, whole
from .components import components

BANDS, ROWS, STEP = 21, 3, 9
HASHES = BANDS * ROWS
BLOCK = 256
CROWD = 256  # nodes of a band key that are compared in one task
VOCABULARY = 400_000
COLUMNS = 8192  # shingles of a block that are multiplied at once

_RNG = np.random.default_rng(20240607)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, n: int, words_of: dict) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle of its own length."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b"%d " % len(words) + b" ".join(words))], np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    k = len(words) - n + 1
    mixed = np.zeros(k, np.uint64)
    for i in range(n):
        mixed = (mixed ^ h[i : i + k]) * _MIX[i % len(_MIX)]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[at : at + 2048, None] * _MULTIPLIERS).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of compared values agree), for a uniform prior."""
    n = compared + 1
    return sum(math.comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1))


@functools.lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared so far, fewest matches with which a pair goes on)."""
    return tuple((n, next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance)) for n in range(STEP, HASHES + 1, STEP))


def _pruned(sig_a: np.ndarray, sig_b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float, done: int = 0, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that are left when their values beyond the first ``done``, of which ``count`` agree, are compared STEP at a time."""
    count = np.zeros(len(i), np.int32) if count is None else count
    for hi, need in least_matches(threshold, tolerance):
        if hi <= done or not len(i):
            continue
        step = np.empty(len(i), np.int32)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            step[s] = (sig_a[i[s], hi - STEP : hi] == sig_b[j[s], hi - STEP : hi]).sum(axis=1)
        count = count + step
        go = count >= need
        i, j, count = i[go], j[go], count[go]
    return i, j


def linked_pairs(sig_a: np.ndarray, sig_b: np.ndarray, sets_a: list, sets_b: list, same: bool, threshold: tuple[int, int], tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs whose Jaccard similarity is at least p/q. same: a block with itself, each pair once."""
    p, q = threshold
    first, need = least_matches(p / q, tolerance)[0]
    agree = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for k in range(first):
        agree += sig_a[:, k, None] == sig_b[None, :, k]
    live = agree >= need
    if same:
        live = np.triu(live, 1)
    i, j = np.nonzero(live)
    i, j = _pruned(sig_a, sig_b, i, j, p / q, tolerance, first, agree[i, j].astype(np.int32))
    if not len(i):
        return i, j
    sizes_a, sizes_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if len(i) <= 4 * (len(sets_a) + len(sets_b)):
        shared = np.fromiter((len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    else:
        shared = _products(sets_a, sets_b)[i, j]
    links = shared * (p + q) >= p * (sizes_a[i] + sizes_b[j])
    return i[links], j[links]


def _products(sets_a: list, sets_b: list) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices, COLUMNS shingles at a time."""
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(sets_a), len(sets_b)), np.float64)
    place = []
    for flat, sets in ((flat_a, sets_a), (flat_b, sets_b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(common, flat)
        here = common[np.minimum(col, len(common) - 1)] == flat if len(common) else np.zeros(len(flat), bool)
        place.append((row[here], col[here]))
    for at in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - at)
        a, b = np.zeros((len(sets_a), width), np.float32), np.zeros((len(sets_b), width), np.float32)
        for m, (row, col) in zip((a, b), place, strict=True):
            in_part = (col >= at) & (col < at + width)
            m[row[in_part], col[in_part] - at] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _sketch(rows: DataFrame, n: int) -> DataFrame:
    """(id, hash, set1, set2, sig) of each row with a word; a set is named by 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _Hashes()
        for batch in batches:
            at, s1, s2, sigs = [], [], [], []
            for k, text in enumerate(batch.column(2)):
                shingles = shingle_set(text.as_py(), n, words_of)
                if not len(shingles):
                    continue
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                at.append(k)
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                sigs.append(signature(shingles).tobytes())
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "hash", "set1", "set2", "sig"]
            )

    return rows.mapInArrow(run, "id long, hash long, set1 long, set2 long, sig binary")


def key_trees(keys: np.ndarray, nodes: np.ndarray, sigs: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Ties among the nodes of each key (equal keys adjoin): a tree over those that unpruned pairs connect."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    left = np.repeat(np.append(begins[1:], len(keys)), np.diff(np.append(begins, len(keys)))) - np.arange(len(keys)) - 1  # members after each
    found_i, found_j = [], []
    for d in range(1, int(left.max()) + 1 if len(left) else 1):
        i = np.flatnonzero(left >= d)
        i, j = _pruned(sigs, sigs, i, i + d, threshold, tolerance)
        found_i.append(i)
        found_j.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
    root = np.array(_roots(len(keys), i, j), np.int64)
    tied = np.flatnonzero(root != np.arange(len(keys)))
    return nodes[root[tied]], nodes[tied]


def _ties(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): edges that connect every two nodes that may be near."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = nodes.select("node", F.explode(band).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    met = cut(bands.join(shared, "key"))
    crowds = met.where((F.col("n") > CROWD) & (F.col("node") != F.col("head"))).select(F.col("head").alias("a"), F.col("node").alias("b"))
    few = met.where(F.col("n") <= CROWD).select("key", "node").join(nodes.select("node", "sig"), "node")
    few = few.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last key's nodes may go on in the next batch

        def out(table: pa.Table) -> pa.RecordBatch:
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(len(table), HASHES)
            a, b = key_trees(table["key"].to_numpy(), table["node"].to_numpy(), sigs, threshold, tolerance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held = table.slice(last)
            if last:
                yield out(table.slice(0, last))
        if held is not None and len(held):
            yield out(held)

    return crowds.unionAll(few.mapInArrow(run, "a long, b long")).distinct()


def _compare(n: int, threshold: tuple[int, int], tolerance: float):
    def run(table: pa.Table) -> pa.Table:
        words_of = _Hashes()
        nodes: dict[int, tuple] = {}
        columns = [table[c].to_pylist() for c in ("node", "weight", "sig", "part", "text")]
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        for node, weight, sig, part, text in zip(*columns, strict=True):
            if node not in nodes:  # rows that are wholly alike
                nodes[node] = (weight, np.frombuffer(sig, "<u4"), shingle_set(text, n, words_of), part)
        names = sorted(nodes)
        weight = np.array([nodes[x][0] for x in names], np.int64)
        sides = [[k for k, x in enumerate(names) if nodes[x][3] == side] for side in (left, right)]
        links = np.zeros(len(names), np.int64)
        roots = list(range(len(names)))
        if all(sides):
            a, b = sides
            stack = lambda s: np.stack([nodes[names[k]][1] for k in s])
            sets = lambda s: [nodes[names[k]][2] for k in s]
            i, j = linked_pairs(stack(a), stack(b), sets(a), sets(b), left == right, threshold, tolerance)
            i, j = np.array(a)[i], np.array(b)[j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            roots = _roots(len(names), i, j)
        return pa.table([pa.array(names, pa.int64()), pa.array([names[r] for r in roots], pa.int64()), pa.array(links, pa.int64())], names=["node", "root", "links"])

    return run


LOW = -(1 << 63)


def _row_id(docs: DataFrame, id_col: str) -> Column:
    return F.coalesce(docs[id_col].cast("long"), F.lit(LOW))


def _row_hash(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(whole(docs[text_col]))


def _settled(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: tuple[int, int], tolerance: float) -> DataFrame:
    """(id, hash, first, links): for each id and text with a word the smallest (id, hash) of its class, and the number of its links."""
    rows = docs.select(_row_id(docs, id_col).alias("id"), _row_hash(docs, text_col).alias("hash"), whole(docs[text_col]).cast("string").alias("text"))
    sketch = cut(_sketch(rows, n))
    nodes = sketch.groupBy("set1", "set2").agg(F.min(F.struct("id", "hash")).alias("own"), F.count(F.lit(1)).alias("weight"), F.min("sig").alias("sig"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, for good
    families = components(_ties(nodes, threshold[0] / threshold[1], tolerance))
    sizes = families.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = families.join(sizes, "label").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(nodes.select("node", "own.id", "own.hash", "weight", "sig"), "node")
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("part", o).alias("left"), F.greatest("part", o).alias("right")))
    texts = rows.join(members.select("id", "hash", "node", "weight", "sig", "label", "part", "blocks"), ["id", "hash"])
    dealt = texts.select("*", F.explode(units).alias("u")).select("label", "u.left", "u.right", "node", "weight", "sig", "part", "text")
    found = cut(dealt.groupBy("label", "left", "right").applyInArrow(_compare(n, threshold, tolerance), "node long, root long, links long"))
    classes = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "set1", "set2", "own", "weight").join(classes, "node", "left").join(links, "node", "left")
    linked = linked.select("set1", "set2", "own", F.coalesce("label", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    firsts = linked.groupBy("class").agg(F.min("own").alias("first"))
    return sketch.select("id", "hash", "set1", "set2").join(linked.join(firsts, "class").select("set1", "set2", "first", "links"), ["set1", "set2"]).select("id", "hash", "first", "links").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-6) -> DataFrame:
    """(id, class_id, n_links), a row for each row of docs: class_id is the smallest id of the class, n_links the number of other documents within the threshold.

    Words are runs without white space, unchanged. A text of fewer than n words is
    one shingle; a null, empty or blank text has none, no links, and is its own
    class. A null id counts as smaller than any other; rows are told apart by id and text, so
    rows that share an id and no text may be of two classes, and copies count as links each.
    Further columns of docs are not read. An empty table gives no rows.
    """
    settled = _settled(docs, id_col, text_col, n, threshold, tolerance)
    rows = docs.select(F.col(id_col), _row_id(docs, id_col).alias("_id"), _row_hash(docs, text_col).alias("_hash"))
    out = rows.join(settled, (F.col("_id") == F.col("id")) & (F.col("_hash") == F.col("hash")), "left")
    label = F.coalesce(F.col("first.id"), F.col("_id"))
    return out.select(rows[id_col], F.when(label == LOW, None).otherwise(label).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-6) -> DataFrame:
    """One row of each class: that of the smallest id, null first, then of the smallest text hash; columns unchanged, whatever they are called.

    Of rows that agree in id and text one stays, whichever it is. Texts without a
    word are no copies of each other, but of rows with the same id. An empty table gives an empty table.
    """
    gone = _settled(docs, id_col, text_col, n, threshold, tolerance).where((F.col("id") != F.col("first.id")) | (F.col("hash") != F.col("first.hash")))
    row_id, row_hash, number = fresh(docs.columns, "id", "hash", "number")
    gone = gone.select(F.col("id").alias(row_id), F.col("hash").alias(row_hash))
    kept = docs.withColumns({row_id: _row_id(docs, id_col), row_hash: _row_hash(docs, text_col)}).join(gone, [row_id, row_hash], "left_anti")
    one = Window.partitionBy(row_id, row_hash).orderBy(F.lit(0))
    return kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*docs.columns)
