"""Exact removal of repeated word passages by super-k-mers.

A document's windows of ``window`` words are cut into super-k-mers: runs of
windows that share a minimiser (the smallest hash of an ``m``-word gram inside the
window). Equal windows have equal minimisers, so a run goes as one packed string
of words to the bucket of its minimiser, and all copies of a window meet there. A
bucket sorts its windows by a 64-bit hash and compares the words of those with equal hashes,
so what it counts is exact; every occurrence but the earliest is marked.

Before anything travels, a task keeps only the earliest of its equal super-k-mers:
the others are repeats whatever else there is, and are marked at once. So a
passage in a third of all documents reaches its bucket once from each task. The
number of buckets follows the size of the input, so a bucket is about BUCKET_BYTES.
A minimiser so frequent that it would fill a bucket alone is found in a sample, and its
windows go by their least other gram as well: this changes the way, and not what is found.

The marks (document, start, length) meet the documents again by id, and the text
is cut there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts, stored, whole

FLUSH_BYTES = 6_000_000  # text that a task packs at once: its local duplicates are found within that
BUCKET_BYTES = 4_000_000  # text whose super-k-mers share a bucket
HASH_BYTES = 1 << 20
SAMPLE_SHARE, SAMPLE_DOCS = 32, 200_000  # one document in so many, and no more than about so many, is looked at for frequent minimisers
LEAST_SEEN, LEAST_SHARE = 20, 1e-5  # windows of a frequent minimiser in the sample; its share, so that the list stays short
_MIX = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1) for i in range(64)]
HEAD = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])


_BASE, _UNBASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word of a text whose words are joined by one space.

    A word's hash is a difference of prefix sums of byte x base^place, moved back to
    place 0 by the base's inverse: no word becomes an object. Sums start anew every HASH_BYTES.
    """
    raw = np.frombuffer(packed, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begins, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + HASH_BYTES)))
        low, high = int(begins[at]), int(ends[stop - 1])
        if len(_powers[0]) < high - low:
            for k, base in enumerate((_BASE, _UNBASE)):
                steps = np.full(max(high - low, HASH_BYTES), base)
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * _powers[0][: high - low], out=sums[1:])
        first = begins[at:stop] - low
        h = (sums[ends[at:stop] - low] - sums[first]) * _powers[1][first]
        h ^= h >> np.uint64(32)
        h *= _MIX[-2]
        out[at:stop] = h ^ (h >> np.uint64(29))
        at = stop
    return begins, ends, out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(hashes: np.ndarray, window: int, m: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of a document.

    Windows whose minimiser is among the sorted ``frequent`` ones are told apart by the least of their other grams too.
    """
    grams = len(hashes) - m + 1
    mixed = sum(hashes[k : k + grams] * _MIX[k] for k in range(m))
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[-1]
    mixed ^= mixed >> np.uint64(32)
    least = _sliding_min(mixed, window - m + 1)
    if frequent is not None and len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)] == least
        if hot.any():
            often = frequent[np.minimum(np.searchsorted(frequent, mixed), len(frequent) - 1)] == mixed
            other = _sliding_min(np.where(often, np.iinfo(np.uint64).max, mixed), window - m + 1)
            least = np.where(hot, (least ^ (other >> np.uint64(1))) * _MIX[-3], least)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.diff(np.append(first, len(least))), least[first]


def _columns(rows: list[tuple[int, int, int]]) -> bytes:
    """Heads column by column, as differences where they ascend: small once compressed."""
    doc, start, size = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    return b"".join((np.diff(doc, prepend=0).astype("<i8").tobytes(), np.diff(start, prepend=0).astype("<i4").tobytes(), size.astype("<i4").tobytes()))


def _rows(raw: bytes) -> np.ndarray:
    n = len(raw) // HEAD.itemsize
    out = np.zeros(n, HEAD)
    out["doc"] = np.cumsum(np.frombuffer(raw, "<i8", n))
    out["start"] = np.cumsum(np.frombuffer(raw, "<i4", n, 8 * n))
    out["size"] = np.frombuffer(raw, "<i4", n, 12 * n)
    return out


class _Packer:
    """Collects super-k-mers; gives them out as one compressed blob for each bucket."""

    def __init__(self, window: int, m: int, n_buckets: int, frequent: np.ndarray | None = None):
        self.window, self.m, self.n_buckets, self.frequent = window, m, n_buckets, frequent
        self._reset()

    def _reset(self) -> None:
        self.earliest: dict[bytes, tuple[int, int, int, int]] = {}  # packed words -> doc, first window, windows, bucket
        self.marks: list[tuple[int, int, int]] = []
        self.held = 0

    def add(self, doc: int, text: str) -> None:
        words = text.encode().split()
        self.held += len(text)
        if len(words) < self.window:
            return
        packed = b" ".join(words)
        begins, ends, hashes = word_hashes(packed)
        first, count, least = super_kmers(hashes, self.window, self.m, self.frequent)
        buckets = (least % np.uint64(self.n_buckets)).tolist()
        lefts, rights = begins[first].tolist(), ends[first + count + self.window - 2].tolist()
        earliest, width = self.earliest, self.window - 1
        for f, c, b, left, right in zip(first.tolist(), count.tolist(), buckets, lefts, rights, strict=True):
            run = packed[left:right]
            here = earliest.get(run)
            if here is None:
                earliest[run] = (doc, f, c, b)
            elif (doc, f) < here[:2]:
                self.marks.append((here[0], here[1], here[2] + width))
                earliest[run] = (doc, f, c, b)
            elif (doc, f) != here[:2]:
                self.marks.append((doc, f, c + width))

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, heads, words) of each bucket that has any, and the marks made here."""
        by: dict[int, list] = {}
        for run, (doc, f, _, b) in self.earliest.items():
            by.setdefault(b, []).append((doc, f, run))
        pack = zstandard.ZstdCompressor(level=3).compress
        for b, runs in by.items():
            yield b, pack(_columns([(d, f, len(r)) for d, f, r in runs])), pack(b"\n".join(r for _, _, r in runs))
        if self.marks:  # already decided: they pass through some bucket
            for i in range(0, len(self.marks), 4096):
                raw = _columns(self.marks[i : i + 4096])
                yield xxhash.xxh32_intdigest(raw) % self.n_buckets, pack(raw), b""
        self._reset()


def repeated_windows(heads: np.ndarray, runs: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """(doc, first word, words) of the windows that are not the earliest of their kind, adjoining ones merged."""
    packed = b" ".join(runs)
    begins, word_ends, hashes = word_hashes(packed)
    sizes = np.fromiter((r.count(b" ") + 1 for r in runs), np.int64, len(runs))
    n = len(begins) - window + 1
    if n < 1:
        return []
    ends = np.cumsum(sizes)
    run_of = np.repeat(np.arange(len(runs)), sizes)
    at = np.arange(len(begins)) - np.repeat(ends - sizes, sizes)
    valid = np.flatnonzero(at[:n] + window <= sizes[run_of[:n]])
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code += hashes[k : k + n] * _MIX[k]
    code = code[valid]
    doc, start = heads["doc"][run_of[valid]], heads["start"][run_of[valid]] + at[valid]
    order = np.lexsort((start, doc, code))
    code, doc, start, valid = code[order], doc[order], start[order], valid[order]
    same = np.concatenate([[False], code[1:] == code[:-1]])
    if not same.any():
        return []
    in_group = same.copy()
    in_group[:-1] |= same[1:]
    late: list[int] = []
    groups = np.flatnonzero(in_group)
    cuts = np.flatnonzero(~same[groups])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(groups)], strict=True):
        members = groups[lo:hi]
        leaders: dict[bytes, tuple[int, int]] = {}  # one, unless hashes collide
        for i in members.tolist():
            p = int(valid[i])
            leader = leaders.setdefault(packed[begins[p] : word_ends[p + window - 1]], (int(doc[i]), int(start[i])))
            if leader != (int(doc[i]), int(start[i])):
                late.append(i)
    if not late:
        return []
    marks = sorted({(int(doc[i]), int(start[i])) for i in late})
    out = [[marks[0][0], marks[0][1], window]]
    for d, s in marks[1:]:
        last = out[-1]
        if d == last[0] and s <= last[1] + last[2] - window + 1:
            last[2] = s + window - last[1]
        else:
            out.append([d, s, window])
    return [tuple(x) for x in out]


def _words_kept(text: str, spans: list | None) -> tuple[list[bytes], int]:
    words = text.encode().split()
    if not spans:
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int64)
    starts = np.array([s["start"] for s in spans])
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts + np.array([s["size"] for s in spans]), len(words)), -1)
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
    return [words[i] for i in keep], len(words)


def frequent_minimisers(rows: DataFrame, window: int, m: int, n_docs: int, total: int) -> np.ndarray:
    """Minimisers (sorted) that a sample holds to have more windows than half a bucket: LEAST_SHARE bounds their number."""
    one_in = max(SAMPLE_SHARE, -(-n_docs // SAMPLE_DOCS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, int] = {}
            for text in batch.column(0):
                words = text.as_py().encode().split()
                if len(words) >= window:
                    _, n, least = super_kmers(word_hashes(b" ".join(words))[2], window, m)
                    for k, c in zip(least.view(np.int64).tolist(), n.tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array(sums.values(), pa.int64())], names=["least", "n"])

    seen = stored(rows.where(F.pmod(F.xxhash64("doc", "text"), F.lit(one_in)) == 0).select("text").mapInArrow(count, "least long, n long").groupBy("least").agg(F.sum("n").alias("n")), "minimisers")
    all_windows = seen.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_SEEN, all_windows * LEAST_SHARE, all_windows * BUCKET_BYTES / max(1, 2 * total))
    return np.sort(np.array([r["least"] for r in seen.where(F.col("n") > least).collect()], np.int64).view(np.uint64))


def find_repeats(docs: DataFrame, id_col: Column, text_col: str = "text", window: int = 20, m: int = 4) -> DataFrame:
    """(doc, spans): the parts of each document, in words, that repeat an earlier passage."""
    spark = docs.sparkSession
    total, n_docs = (x or 0 for x in docs.agg(F.sum(F.octet_length(whole(text_col))), F.count(F.lit(1))).first())
    n_buckets = max(2 * parts(spark), -(-total // BUCKET_BYTES))
    rows = docs.select(id_col.alias("doc"), whole(text_col).cast("string").alias("text"))
    frequent = frequent_minimisers(rows, window, m, n_docs, total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, m, n_buckets, frequent)

        def out() -> Iterator[pa.RecordBatch]:
            held = list(packer.flush())
            for i in range(0, len(held), 256):
                bucket, heads, words = zip(*held[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(heads, pa.binary()), pa.array(words, pa.binary())], names=["bucket", "heads", "words"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                packer.add(ids[i].as_py(), texts[i].as_py())
                if packer.held >= FLUSH_BYTES:
                    yield from out()
        yield from out()

    def settle(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        heads, runs, found = [], [], []
        for h, w in zip(table["heads"].to_pylist(), table["words"].to_pylist(), strict=True):
            part = _rows(unpack(h))
            if w:
                heads.append(part)
                runs += unpack(w).split(b"\n")
            else:
                found += part.tolist()
        if runs:
            found += repeated_windows(np.concatenate(heads), runs, window)
        doc, start, size = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["doc", "start", "size"])

    packed = rows.mapInArrow(pack, "bucket int, heads binary, words binary")
    marks = packed.groupBy("bucket").applyInArrow(settle, "doc long, start int, size int")
    return marks.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, m: int = 4) -> DataFrame:
    """docs with text_col replaced by the kept words joined by one space; n_words and n_removed (long) added.

    A window that also starts earlier (smaller id, or the same document, earlier)
    goes with all its words; windows are those of the input. Texts shorter than a
    window stay. Null text counts as empty; a null id as smaller than any other; rows
    that share an id share their marks and don't repeat each other. Columns named
    n_words and n_removed are replaced, all others stay, whatever they are called. An empty table gives an empty table.
    """
    low = F.lit(-(1 << 63))
    key = F.coalesce(F.col(id_col).cast("long"), low)
    spans = find_repeats(docs, key, text_col, window, m)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    doc, marks, text_of = fresh(docs.columns, "doc", "spans", "text")
    joined = docs.select(*names).join(spans.select(F.col("doc").alias(doc), F.col("spans").alias(marks)), key == F.col(doc), "left")
    rest = [c for c in names if c != text_col]
    rows = joined.select(*rest, whole(text_col).cast("string").alias(text_of), marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n_words, n_removed = [], [], []
            for t, s in zip(batch.column(len(rest)), batch.column(len(rest) + 1), strict=True):
                kept, n = _words_kept(t.as_py(), s.as_py())
                text.append(b" ".join(kept).decode())
                n_words.append(n)
                n_removed.append(n - len(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*rest, text_col, "n_words", "n_removed"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(rest)]), f"`{text_col}` string, n_words long, n_removed long"])
    return rows.mapInArrow(run, fields).select(*names, "n_words", "n_removed")
