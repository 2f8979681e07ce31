"""Byte-level BPE over whole texts, with the merges done on padded matrices.

A text is cut by the tokenizer's pattern. Pieces that a worker has not met are
encoded together: they are dealt to buckets by length, each bucket is one padded
matrix of token ids, and in each round every row merges its leftmost pair of
minimum rank. As every row that still merges loses exactly one column a round,
compaction is one masked reshape. Pairs are looked up in an open-addressing
table of 32-bit keys. Pieces too long for a matrix (rare: runs of letters without
a space) are merged with a heap in the same order, so no text is quadratic.

The ids of a text are then gathered from the worker's table of pieces. Output is
packed: ids as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

NONE = np.int32(1 << 30)  # no such pair
LONGEST_ROW = 64  # bytes; longer pieces go to the heap
MATRIX_CELLS = 1 << 21
CACHE_PIECES = 300_000  # a worker's table of pieces starts anew beyond that: it bounds memory, not results
CHUNK_CHARS = 2_000_000


class Merges:
    """A rank file: token bytes in id order, and the table of pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        if size >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    values.append(rank)
        self._hash(np.array(keys, np.int64), np.array(values, np.int32))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled a probe distance at a time."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_value = np.full(1 << self.bits, NONE, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.table_key[slot] < 0
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            self.table_key[slot[wins]], self.table_value[slot[wins]] = keys[left[wins]], values[left[wins]]
            left, self.probes = left[~wins], self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of ids the id it merges to, or NONE; padding (-1) merges with nothing."""
        keys = a.astype(np.int64) << 16 | b
        keys[(a < 0) | (b < 0)] = -2
        found = np.full(keys.shape, NONE, np.int32)
        todo = np.arange(keys.size)
        flat, out = keys.ravel(), found.ravel()
        for probe in range(self.probes):
            slot = self._slot(flat[todo], probe)
            there = self.table_key[slot]
            hit = there == flat[todo]
            out[todo[hit]] = self.table_value[slot[hit]]
            todo = todo[~hit & (there >= 0)]  # an empty slot ends a probe
            if not len(todo):
                break
        return out.reshape(keys.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole_id = self.ranks.get(piece)
            if whole_id is not None:
                out[i] = np.array([whole_id], np.int32)
            elif len(piece) <= LONGEST_ROW:
                buckets.setdefault(-(-len(piece) // 8) * 8, []).append(i)
            else:
                out[i] = self._heap(piece)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                self._matrix([pieces[i] for i in members[at : at + step]], members[at : at + step], width, out)
        return out

    def _matrix(self, pieces: list[bytes], members: list[int], width: int, out: list) -> None:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        ids[np.arange(width) >= lengths[:, None]] = -1
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        while len(rows):
            at = rank.argmin(axis=1)  # the first of equals: the leftmost
            r = np.arange(len(rows))
            best = rank[r, at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    row = ids[k]
                    out[members[rows[k]]] = row[row >= 0]
                go = ~done
                ids, rank, rows, at, best = ids[go], rank[go], rows[go], at[go], best[go]
                if not len(rows):
                    break
                r = np.arange(len(rows))
            ids[r, at] = best
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[r, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            pairs = rank.shape[1]
            left, right = r[at > 0], r[at < pairs]
            if len(left):
                rank[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            if len(right):
                rank[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
            if not pairs:
                for k in r:
                    out[members[rows[k]]] = ids[k]
                break

    @functools.cached_property
    def pair_map(self) -> dict[int, int]:
        used = self.table_key >= 0
        return dict(zip(self.table_key[used].tolist(), self.table_value[used].tolist(), strict=True))

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order, O(n log n)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pair = len(ids), self.pair_map
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m, i) for i in range(n - 1) if (m := pair.get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or pair.get(ids[i] << 16 | ids[j]) != merged:
                continue
            ids[i], alive[j], after[i] = merged, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := pair.get(merged << 16 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := pair.get(ids[before[i]] << 16 | merged)) is not None:
                heapq.heappush(heap, (m, before[i]))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)


@functools.lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})


class _Codes(dict):
    """Piece -> number, in order of first sight."""

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Encoder:
    """Encodes lists of texts; keeps the ids of pieces it has met."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.codes.new = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        found = self.merges.encode_pieces([p.encode() for p in new])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.codes) - len(new), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.codes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = np.concatenate(found)
        self.sizes[first : first + len(new)] = sizes
        self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > CACHE_PIECES:
            self._reset()
        look = self.codes.__getitem__
        codes, ends = [], []
        for text in texts:
            codes.append(np.fromiter(map(look, self.find(text)), np.int64))
            ends.append(len(codes[-1]))
        self._learn()
        out = []
        for c in codes:
            out.append(_gather(self.flat, self.starts[c], self.sizes[c]))
        return out


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of flat, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def decode_ids(merges: Merges, ids: np.ndarray) -> bytes:
    return _gather(merges.flat, merges.starts[ids], merges.lengths[ids]).tobytes()


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of about CHUNK_CHARS characters."""
    for batch in batches:
        sizes = batch.column(text_at)
        first, room = 0, 0
        for i in range(len(batch)):
            room += len(sizes[i].as_buffer() or b"") if sizes[i].is_valid else 0
            if room >= CHUNK_CHARS or i + 1 == len(batch):
                part = batch.slice(first, i + 1 - first)
                yield part, part.column(text_at).to_pylist()
                first, room = i + 1, 0


@dataclass(frozen=True)
class Tokenizer:
    """A rank file and its pattern. The file must lie at the same path on every executor."""

    path: str
    pattern: str

    def encode(self, docs: DataFrame, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
        """docs with ``out`` (binary, packed ids) added, and with ``decoded`` (binary) the bytes they stand for.

        Null text counts as empty; an empty text has no ids. Special tokens are
        ordinary text. Other columns are kept; one named like a new one is replaced.
        """
        me, names = self, [c for c in docs.columns if c not in (out, decoded)]
        rows = docs.select(*names, whole(text_col).cast("string").alias("_text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges = load_merges(me.path)
            encoder = Encoder(merges, me.pattern)
            for part, texts in _chunks(batches, len(names)):
                ids = encoder.encode(texts)
                columns = [*part.columns[:-1], pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([decode_ids(merges, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, out, *([decoded] if decoded else [])])

        added = [T.StructField(c, T.BinaryType()) for c in (out, decoded) if c]
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *added]))

    def decode(self, df: DataFrame, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
        """df with ``out`` (binary) added: the bytes that the packed ids stand for; null for null."""
        me, names = self, [c for c in df.columns if c != out]
        at = names.index(ids_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges = load_merges(me.path)
            for batch in batches:
                raw = batch.column(at).to_pylist()
                found = [None if x is None else decode_ids(merges, np.frombuffer(x, "<u4").astype(np.int64)) for x in raw]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*names, out])

        rows = df.select(*names)
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))


def n_tokens(ids_col: str = "ids"):
    return F.expr(f"octet_length({ids_col}) div 4").cast("long")
