"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents (counted in
   the tasks, one row a word returned) give TF-IDF weights.
2. A randomised SVD of TF-IDF passages, the benchmark's items with every passage of every
   document, spans the latent space: a basis that the items have turned is multiplied once with
   all passages, whose thin products are added up in bands of rows, and the product
   gives the leading directions (Nystroem). What a passage has outside the leading directions is kept as a random
   projection of the rest, so that lengths and cosines are those of the whole passage but for
   a noise that SKETCH directions for each doubling of the passages hold down.
   There is one space for all items, of a width that grows with their logarithm.
3. Every passage of every document (windows of WINDOW words, half overlapping) is
   folded in; items with a high cosine, of which the window holds a good share, are candidates. An item longer than a window is also cut into
   overlapping passages, and any of them makes it one.
4. A candidate is checked on the words around the passage: the longest common
   subsequence must cover most of the item, and the item's terms be there by weight; if it covers only part, as in a
   paraphrase, the item's answer (its weightiest words) must be there too.

Only the benchmark, the term vectors of its words and the small products are ever
on the driver. Each task holds the benchmark too: item words as numbers, and
PROJECTION rows of the space at most (beyond that terms share rows, in the space alone).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, stored, whole

WINDOW, STRIDE = 48, 24
RANK, SKETCH = 96, 12
PROJECTION = 1 << 16
CELLS = 1 << 18  # numbers in a block of a product: about what a cache holds
CORPUS_WEIGHT = 16_000  # the corpus's passages weigh as many together, where they are more: a benchmark is not lost among them
BLOCK = 64  # rows of a product in a band, which is what one task adds up at least
BATCH_WORDS = 400_000
#: Terms are runs without white space or these marks, A-Z in lower case.
_MARKS = b".,;:!?\"'()[]{}*#$%&|<>"
_PLAIN = bytes(0x20 if c in _MARKS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


@dataclass(frozen=True)
class Items:
    """The benchmark: ids, the number of each term, the terms of each item; its passages, and the item of each."""

    ids: list
    known: dict[bytes, int]
    row: np.ndarray  # of each term in the projection
    codes: list[np.ndarray]
    passages: list[np.ndarray]
    owner: np.ndarray

    def numbers(self, text: str) -> np.ndarray:
        """The text's terms; -1 for those that no item has."""
        words = terms_of(text)
        return np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))


def passage_bounds(n: int) -> list[tuple[int, int]]:
    """Where an item of n words is searched: the whole, and if it is longer than a window, each stride of it up to its end."""
    if n <= WINDOW:
        return [(0, n)]
    return [(0, n), *((s, s + WINDOW) for s in range(0, n - WINDOW, STRIDE)), (n - WINDOW, n)]


def read_items(rows: list[tuple], projection: int = PROJECTION) -> Items:
    words = [terms_of(text or "") for _, text in rows]
    names = sorted({w for ws in words for w in ws})
    known = {w: i for i, w in enumerate(names)}
    row = np.arange(len(names)) if len(names) <= projection else np.array([xxhash.xxh64_intdigest(w) % projection for w in names])
    kept = [(i, ws) for (i, _), ws in zip(rows, words, strict=True) if ws]
    codes = [np.array([known[w] for w in ws], np.int64) for _, ws in kept]
    bounds = [(i, a, b) for i, c in enumerate(codes) for a, b in passage_bounds(len(c))]
    return Items([i for i, _ in kept], known, row, codes, [codes[i][a:b] for i, a, b in bounds], np.array([i for i, _, _ in bounds], np.int64))


class Rows:
    """TF-IDF rows of length 1, sparse: an entry for each term of a passage."""

    def __init__(self, passages: list[np.ndarray], idf: np.ndarray, row: np.ndarray, weight: float = 1.0):
        codes, counts, ends = [], [], []
        for p in passages:
            c, n = np.unique(p, return_counts=True)
            w = n * idf[c]
            codes.append(c)
            counts.append(weight * w / max(1e-9, math.sqrt(float(w @ w))))
            ends.append(len(c))
        self.n = len(passages)
        self.cols = row[np.concatenate(codes)] if codes else np.zeros(0, np.int64)
        self.values = np.concatenate(counts).astype(np.float32) if codes else np.zeros(0, np.float32)
        self.ends = np.cumsum(ends)

    def blocks(self, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First and last row, entries' rows within them, columns and values, so that entries x width is bounded."""
        at = 0
        while at < self.n:
            begin = int(self.ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(self.ends, begin + max(1, CELLS // width), "right")))
            end = int(self.ends[stop - 1])
            sizes = np.diff(np.concatenate([[begin], self.ends[at:stop]]))
            yield at, stop, np.repeat(np.arange(stop - at), sizes), self.cols[begin:end], self.values[begin:end]
            at = stop

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, m.shape[1]), np.float32)
        for at, stop, rows, cols, values in self.blocks(m.shape[1]):
            np.add.at(out[at:stop], rows, m[cols] * values[:, None])
        return out

    def add_transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        """out += rows' @ y"""
        for at, stop, rows, cols, values in self.blocks(y.shape[1]):
            np.add.at(out, cols, y[at:stop][rows] * values[:, None])


def document_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(items.known), np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                codes = np.unique(items.numbers(text.as_py()))
                seen[codes[codes >= 0]] += 1
                n += 1
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1), pa.int64()), pa.array(np.append(seen[where], n), pa.int64())], names=["term", "n"])

    rows = docs.select("_text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each of the benchmark's terms
    out, n = np.zeros(len(items.known)), 0
    for r in rows:
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, n


def in_pieces(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts cut into pieces of STRIDE words: how many each has, the number of its first, the known terms of all, and the piece of each."""
    pieces = np.array([-(-len(c) // STRIDE) for c in codes], np.int64)
    first = np.cumsum(pieces) - pieces
    flat = np.concatenate([np.zeros(0, np.int64), *codes])
    piece = np.concatenate([np.zeros(0, np.int64), *(f + np.arange(len(c)) // STRIDE for f, c in zip(first, codes, strict=True))])
    known = flat >= 0
    return pieces, first, flat[known], piece[known]


def piece_sums(vectors: np.ndarray, flat: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
    """The sum of the vectors of each piece's terms."""
    z = np.zeros((n, vectors.shape[1]), np.float32)
    begins = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    step = max(1, CELLS // (STRIDE * vectors.shape[1]))
    for at in range(0, len(begins), step):
        b = begins[at : at + step]
        stop = begins[at + step] if at + step < len(begins) else len(flat)
        z[piece[b]] = np.add.reduceat(vectors[flat[b[0] : stop]], b - b[0], axis=0)
    return z


def add_windows(codes: list[np.ndarray], idf: np.ndarray, row: np.ndarray, vectors: np.ndarray, total: np.ndarray) -> int:
    """total += A'(A basis), A being the TF-IDF rows of length 1 of all windows of the texts; how many windows have a term.

    vectors: the basis for each term, times its idf. A window is two pieces, so that its row is a sum of what they are by themselves, but for its length.
    """
    pieces, _, flat, piece = in_pieces(codes)
    if not len(flat):
        return 0
    n = int(pieces.sum())
    text_of = np.repeat(np.arange(len(codes)), pieces)
    joined = np.concatenate([text_of[1:] == text_of[:-1], [False]])  # with the next piece
    second = np.concatenate([[False], joined[:-1]])  # of the window before
    bits = len(idf).bit_length()
    alone, also = (joined | ~second)[piece], second[piece]
    terms = np.concatenate([piece[alone] << bits | flat[alone], piece[also] - 1 << bits | flat[also]])
    terms.sort()
    begins = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    counts = np.diff(np.append(begins, len(terms)))
    mass = np.bincount(terms[begins] >> bits, (counts * idf[terms[begins] & ((1 << bits) - 1)]) ** 2, n)
    y = piece_sums(vectors, flat, piece, n)
    y[:-1] += y[1:] * joined[:-1, None]
    y *= np.where(mass > 0, 1 / np.maximum(mass, 1e-18), 0).astype(np.float32)[:, None]
    y[1:] += y[:-1] * second[1:, None]  # the windows of a piece
    order = np.argsort(flat, kind="stable")
    step = max(1, CELLS // y.shape[1])
    for at in range(0, len(order), step):
        some = order[at : at + step]
        term = flat[some]
        begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        term = term[begins]
        np.add.at(total, row[term], np.add.reduceat(y[piece[some]], begins, axis=0) * idf[term, None])
    return int(np.count_nonzero(mass))


def latent_space(docs: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, item_weight: float = 10.0) -> np.ndarray:
    """Rows of the projection x directions: the leading right singular vectors of the weighted passages, and a random projection of what is left.

    All windows of all documents take part, once: of G, the weighted sum of the passages' outer products, tasks return their part of G times a basis.
    """
    own = Rows(items.passages, idf, items.row, item_weight)
    height = int(items.row.max()) + 1
    width = min(rank + 16, height)

    def of_items(basis: np.ndarray) -> np.ndarray:
        out = np.zeros(basis.shape)
        own.add_transposed(own.times(basis), out)
        return out

    rng = np.random.default_rng(11)
    basis = rng.standard_normal((height, width))
    for _ in range(2):
        basis = np.linalg.qr(of_items(basis))[0]
    shared = docs.sparkSession.sparkContext.broadcast((items, idf, basis.astype(np.float32)))  # the benchmark, and PROJECTION rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, m = shared.value
        vectors = (weights[:, None] * m[known.row]).astype(np.float32)
        total, n = np.zeros(m.shape), 0
        for batch in batches:
            codes, held = [], 0
            for text in batch.column(0):
                codes.append(known.numbers(text.as_py()))
                held += len(codes[-1])
                if held > BATCH_WORDS:
                    n += add_windows(codes, weights, known.row, vectors, total)
                    codes, held = [], 0
            n += add_windows(codes, weights, known.row, vectors, total)
        if n:
            task = TaskContext.get().partitionId()
            bands = [total[at : at + BLOCK].astype("<f4").tobytes() for at in range(0, len(total), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([task] * (len(bands) + 1), pa.int64()), pa.array(range(-1, len(bands)), pa.int64()), pa.array([np.int64(n).tobytes(), *bands], pa.binary())], names=["task", "band", "m"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for band, m in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(m.as_buffer(), "<i8" if band < 0 else "<f4")
                sums[band] = sums[band] + part if band in sums else part.astype(np.int64 if band < 0 else np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(v if k < 0 else v.astype("<f4")).tobytes() for k, v in sums.items()], pa.binary())], names=["band", "m"])

    parts = docs.select("_text").mapInArrow(run, "task long, band long, m binary").repartition("band").sortWithinPartitions("band", "task")  # always added up in one order
    found = {r["band"]: bytes(r["m"]) for r in parts.mapInArrow(add_up, "band long, m binary").collect()}  # one thin product of PROJECTION rows at most
    product = of_items(basis)
    if found:
        weight = min(1.0, CORPUS_WEIGHT / int(np.frombuffer(found.pop(-1), "<i8")[0]))
        product += weight * np.frombuffer(b"".join(found[k] for k in sorted(found)), "<f4").reshape(product.shape)
    q, r = np.linalg.qr(product)
    inner = basis.T @ product
    _, turn = np.linalg.eigh(r @ np.linalg.pinv((inner + inner.T) / 2, 1e-6, True) @ r.T)
    leading = (q @ turn[:, ::-1])[:, :rank]
    more = SKETCH * math.ceil(math.log2(len(items.passages) + 1))
    rest = rng.standard_normal((height, more)) / math.sqrt(more)
    return np.column_stack([leading, rest - leading @ (leading.T @ rest)])


def common_subsequence(item_masks: dict[int, int], m: int, codes: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    full = (1 << m) - 1
    v = full
    for c in codes:
        y = item_masks.get(c)
        if y:
            u = v & y
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Searcher:
    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray, cosine: float, share: float, sure: float, likely: float):
        self.items, self.idf, self.cosine, self.sure, self.likely = items, idf, cosine, sure, likely
        self.vectors = (idf[:, None] * space[items.row]).astype(np.float32)
        self.square = idf**2
        self.latent = Rows(items.passages, idf, items.row).times(space)
        self.least = (share * np.array([math.sqrt(float(((n * idf[c]) ** 2).sum())) for c, n in (np.unique(p, return_counts=True) for p in items.passages)])).astype(np.float32)
        self.checks = functools.lru_cache(4_000)(self._checks)

    def _checks(self, i: int) -> tuple[dict[int, int], dict[int, float], frozenset[int]]:
        """Of an item: where its terms are, their shares of its weight, and its answer."""
        masks: dict[int, int] = {}
        for k, c in enumerate(self.items.codes[i].tolist()):
            masks[c] = masks.get(c, 0) | 1 << k
        total = sum(float(self.idf[c]) for c in masks)
        rare = sorted(masks, key=lambda c: (-self.idf[c], c))
        return masks, {c: float(self.idf[c]) / total for c in masks}, frozenset(rare[: max(1, len(rare) // 3)])

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(text, item, coverage) of each leak in the texts."""
        codes = [self.items.numbers(t) for t in texts]
        pieces, first, flat, piece = in_pieces(codes)
        if not len(flat):
            return
        n = int(pieces.sum())
        z, mass = piece_sums(self.vectors, flat, piece, n), np.bincount(piece, self.square[flat], n)
        text_of = np.repeat(np.arange(len(texts)), pieces)
        joins = np.concatenate([text_of[1:] == text_of[:-1], [False]])  # a window is a piece with the next one of its text
        z[:-1] += z[1:] * joins[:-1, None]
        mass[:-1] += mass[1:] * joins[:-1]
        best: dict[tuple[int, int], float] = {}
        step = max(16, CELLS // len(self.latent))
        for at in range(0, n, step):
            dots = z[at : at + step] @ self.latent.T
            near = dots >= self.least  # so much of the passage's weight is in the window
            near &= dots >= (self.cosine * np.sqrt(np.maximum(mass[at : at + step], 1e-9))).astype(np.float32)[:, None]
            windows, passages = np.nonzero(near)
            for w, i in np.unique(np.column_stack([windows, self.items.owner[passages]]), axis=0).tolist():
                t = int(text_of[at + w])
                start, m = STRIDE * int(at + w - first[t]), len(self.items.codes[i])
                around = codes[t][max(0, start - m) : start + WINDOW + m]
                around = around[around >= 0].tolist()
                there = set(around)
                masks, weights, answer = self.checks(i)
                if sum(w for c, w in weights.items() if c in there) < self.likely:  # by weight, so that common words alone are no leak
                    continue
                cover = common_subsequence(masks, m, around) / m
                if cover < self.likely or (cover < self.sure and len(answer & there) < 0.6 * len(answer)):
                    continue
                best[t, i] = max(best.get((t, i), 0.0), cover)
        for (t, i), cover in best.items():
            yield t, i, cover


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    cosine: float = 0.28,
    share: float = 0.4,
    sure: float = 0.8,
    likely: float = 0.6,
) -> DataFrame:
    """(id, item, coverage): which documents hold which items, and how much of them; a pair once for each row of docs.

    Ids may be of any type. Null text counts as empty and holds nothing; an item without a word is found
    nowhere; a null id or item id stays null. Repeated items are reported each. Other
    columns are not read. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).cast("string").alias("_text"))
    item_type = benchmark.schema[item_col].dataType
    fields = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_item", item_type), T.StructField("coverage", T.DoubleType())])
    items = read_items([tuple(r) for r in benchmark.select(item_col, item_text_col).orderBy(item_col, item_text_col).collect()])
    if not items.ids:
        return spark.createDataFrame([], fields).toDF(id_col, item_col, "coverage")
    df, n = document_frequencies(rows, items)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    space = latent_space(rows, items, idf)
    shared = spark.sparkContext.broadcast((items, idf, space.astype(np.float32)))  # the benchmark, and PROJECTION rows at most
    arrow_type = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, cosine, share, sure, likely)  # of this task: an idle worker keeps nothing
        for batch in batches:
            texts, held, ids, out = batch.column(1), 0, [], []

            def flush() -> None:
                for t, i, cover in searcher.search([texts[k].as_py() for k in ids]):
                    out.append((ids[t], searcher.items.ids[i], cover))
                ids.clear()

            for k in range(len(batch)):
                ids.append(k)
                held += len(texts[k].as_buffer() or b"")
                if held > 5 * BATCH_WORDS:
                    flush()
                    held = 0
            flush()
            at, item, cover = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, arrow_type), pa.array(cover, pa.float64())], names=["_id", "_item", "coverage"])

    return rows.mapInArrow(run, fields).toDF(id_col, item_col, "coverage")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that hold no item; columns unchanged, whatever they are called.

    Rows that share an id go together, rows with a null id as well. Null and empty texts hold nothing and stay.
    Without documents or items docs come back as they are.
    """
    (leak,) = fresh(docs.columns, "leak")
    leaks = stored(find_leaks(docs, benchmark, id_col, text_col, **params).select(F.col(id_col).alias(leak)).distinct(), "leaks")
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks[leak]), "left_anti")
