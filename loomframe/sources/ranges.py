"""Files larger than a task, read by byte ranges: members of zip archives, and elements of the arrays of one JSON document.

What is where is a small table that Spark makes first; then ranges are dealt to partitions, and a task reads only
its own. Files are opened through pyarrow's file systems, so a path may lie wherever these reach (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.relational import cut

BATCH = 16 << 20


def opened(path: str) -> pa.NativeFile:
    """A file that can be read anywhere, by its URI or path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    at, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return at.open_input_file(name)


# --- zip archives --------------------------------------------------------------------------------------

_MEMBER = "archive string, member string, name string, at long, packed long, size long, method int, crc long"


def zip_listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(archive, member, name, at, packed, size, method, crc): the members of the archives, from their central directories alone; name is the base name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _MEMBER.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    rows = [(path, i.filename, i.filename.rpartition("/")[2], i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()]
                if rows:
                    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, min(len(paths), 1000))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInArrow(read, _MEMBER)


def member_content(f: pa.NativeFile, at: int, packed: int, size: int, method: int, crc: int) -> bytes:
    """A member's bytes, read from its local header on and checked against its CRC."""
    f.seek(at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member begins at byte {at}")
    f.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"compression method {method} is not known")
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError(f"the member at byte {at} is damaged")
    return raw


def zip_members(listing: DataFrame, wanted: DataFrame | None = None, existing: DataFrame | None = None, part_bytes: int = 128 << 20) -> DataFrame:
    """(archive, member, name, content) of the listed members whose base name is in ``wanted`` (name) and not in ``existing`` (name).

    Members are dealt to partitions of about part_bytes, those of an archive in the order of their places; an archive is never held, a member is one value.
    """
    rows = listing
    if wanted is not None:
        rows = rows.join(wanted.select("name").distinct(), "name", "left_semi")
    if existing is not None:
        rows = rows.join(existing.select("name").distinct(), "name", "left_anti")
    rows = cut(rows.select("archive", "member", "name", "at", "packed", "size", "method", "crc"))
    total = rows.agg(F.sum("packed")).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // part_bytes)), "archive", "at").sortWithinPartitions("archive", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            out, held = [], 0
            for archive, member, name, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != path:
                    if f is not None:
                        f.close()
                    path, f = archive, opened(archive)
                out.append((archive, member, name, member_content(f, *place)))
                held += len(out[-1][-1])
                if held >= BATCH:
                    yield _members(out)
                    out, held = [], 0
            if out:
                yield _members(out)
        if f is not None:
            f.close()

    return dealt.mapInArrow(read, "archive string, member string, name string, content binary")


def _members(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["archive", "member", "name", "content"])


def extract(spark: SparkSession, paths: Sequence[str], wanted: DataFrame, dest: str) -> int:
    """Write the wanted members (name) that the table dest (name, content) lacks to it, and return how many; of members of one name the first by archive and place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(dest)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    existing = spark.read.schema("name string, content binary").parquet(dest).select("name") if there else None
    first = zip_listing(spark, paths).groupBy("name").agg(F.min(F.struct("archive", "at", "member", "packed", "size", "method", "crc")).alias("m")).select("name", "m.*")
    before = existing.count() if existing is not None else 0
    zip_members(first, wanted, existing).select("name", "content").write.mode("append").parquet(dest)
    return spark.read.schema("name string, content binary").parquet(dest).select("name").count() - before


# --- one JSON document ---------------------------------------------------------------------------------


class Scan:
    """The structure of a block of JSON: which of its bytes open, close, or part, given whether it begins inside a string."""

    def __init__(self, data: bytes, before: int, inside: bool):
        """before: backslashes right before the block."""
        self.bytes = b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == 0x22)
        slashes = np.concatenate(([before % 2], (b == 0x5C).astype(np.int8)))  # [i]: of the byte before byte i
        real = np.ones(len(quotes), bool)
        for k in np.flatnonzero(slashes[quotes]):  # a quote after a backslash is real if there is an even number of them
            n, at = 0, int(quotes[k])
            while at > 0 and b[at - 1] == 0x5C:
                n, at = n + 1, at - 1
            real[k] = (n + (before if at == 0 else 0)) % 2 == 0
        self.quotes = quotes[real]
        marks = np.zeros(len(b) + 1, np.int64)
        marks[self.quotes + 1] = 1
        self.outside = ((np.cumsum(marks)[:-1] + inside) % 2) == 0  # of each byte; a quote itself counts by what comes before it
        self.ends_inside = bool((len(self.quotes) + inside) % 2)
        opens = ((b == 0x7B) | (b == 0x5B)) & self.outside
        closes = ((b == 0x7D) | (b == 0x5D)) & self.outside
        self.steps = opens.astype(np.int64) - closes

    @property
    def rise(self) -> int:
        return int(self.steps.sum())


def _slashes(f: pa.NativeFile, at: int) -> int:
    """How many backslashes stand right before a place."""
    n = 0
    while at > 0:
        low = max(0, at - 64)
        f.seek(low)
        raw = f.read(at - low)
        run = len(raw) - len(raw.rstrip(b"\\"))
        n += run
        if run < len(raw):
            return n
        at = low
    return n


def json_blocks(spark: SparkSession, path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """(path, block, low, high, inside, depth) of the blocks of the files of a path: whether a block begins in a string, and how deep.

    Each block is scanned once, for both ways to begin; the right ones follow from the sums over the blocks before, which are a few numbers each.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    blocks = cut(blocks.select("path", F.col("block").cast("int").alias("block"), (F.col("block") * block_bytes).cast("long").alias("low"), F.least("length", (F.col("block") + 1) * block_bytes).cast("long").alias("high")))
    n = blocks.count()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, block, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(at) as f:
                    before = _slashes(f, low)
                    f.seek(low)
                    raw = f.read(high - low)
                outer, inner = Scan(raw, before, False), Scan(raw, before, True)
                out.append((at, block, low, high, outer.ends_inside, outer.rise, inner.rise))
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, types, strict=True)], names=["path", "block", "low", "high", "odd", "rise", "rise_inside"])

    scanned = cut(blocks.repartition(max(1, n), "path", "block").mapInArrow(scan, "path string, block int, low long, high long, odd boolean, rise long, rise_inside long"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    placed = scanned.withColumn("inside", inside).withColumn("_r", F.when(F.col("inside"), F.col("rise_inside")).otherwise(F.col("rise")))
    return placed.select("path", "block", "low", "high", "inside", F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("depth"))


def json_elements(spark: SparkSession, path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """(path, field, pos, element): the objects of the arrays of a document {"field": [{...}, ...], ...}, as text, pos their byte in the file.

    A task reads a block, and of the element that its end cuts the rest. An element larger than that is read in steps. What a document holds
    besides (numbers, objects, arrays of other things) has no rows.
    """
    blocks = cut(json_blocks(spark, path, block_bytes))
    n = blocks.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block, low, high, inside, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, held = [], 0
                with opened(at) as f:
                    for field, pos, text in _elements(f, low, high, inside, depth):
                        out.append((at, block, field, pos, text))
                        held += len(text or b"")
                        if held >= BATCH:
                            yield _found(out)
                            out, held = [], 0
                yield _found(out)

    found = blocks.repartition(max(1, n), "path", "block").mapInArrow(read, "path string, block int, field string, pos long, element binary")
    found = cut(found)
    named = found.where("element IS NULL").groupBy("path", "block").agg(F.max_by("field", "pos").alias("_last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("path", "block").join(named, ["path", "block"], "left").select("path", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_field"))
    rows = found.where("element IS NOT NULL").join(carried, ["path", "block"])
    return rows.select("path", F.coalesce("field", "_field").alias("field"), "pos", F.col("element").cast("string").alias("element"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["path", "block", "field", "pos", "element"])


def _elements(f: pa.NativeFile, low: int, high: int, inside: bool, depth: int) -> Iterator[tuple[str | None, int, bytes | None]]:
    """The elements that begin in a block, and (name, place, None) for each field name of the document in it. The field is None for those before the block's first name."""
    f.seek(low)
    raw = f.read(high - low)
    scan = Scan(raw, _slashes(f, low), inside)
    after = depth + np.cumsum(scan.steps)
    b = scan.bytes
    starts = np.flatnonzero((scan.steps == 1) & (after == 3) & (b == 0x7B))
    ends = np.flatnonzero((scan.steps == -1) & (after == 2) & (b == 0x7D))
    colons = np.flatnonzero((b == 0x3A) & scan.outside & (after == 1))
    names = [(int(c), _name_before(f, low + int(c))) for c in colons]
    for c, name in names:
        yield name, low + c, None
    k = 0
    for s in starts.tolist():
        while k < len(names) and names[k][0] < s:
            k += 1
        e = int(np.searchsorted(ends, s))
        text = raw[s : int(ends[e]) + 1] if e < len(ends) else raw[s:] + _rest(f, high, scan.ends_inside, int(after[-1]))
        yield (names[k - 1][1] if k else None), low + s, text


def _name_before(f: pa.NativeFile, at: int) -> str:
    """The string that ends before a colon; names of up to 4,096 bytes."""
    low = max(0, at - 4096)
    f.seek(low)
    raw = f.read(at - low).rstrip()
    opening = len(raw) - 1
    while True:
        opening = raw.rindex(b'"', 0, opening)
        n = len(raw[:opening]) - len(raw[:opening].rstrip(b"\\"))
        if n % 2 == 0:
            return json.loads(raw[opening:])


def _rest(f: pa.NativeFile, at: int, inside: bool, depth: int, step: int = 1 << 16) -> bytes:
    """What follows a place up to where the depth falls to 2."""
    out = []
    while True:
        before = _slashes(f, at)
        f.seek(at)
        raw = f.read(step)
        if not raw:
            raise ValueError("the document ends within an element")
        scan = Scan(raw, before, inside)
        after = depth + np.cumsum(scan.steps)
        end = np.flatnonzero((scan.steps == -1) & (after == 2))
        if len(end):
            return b"".join([*out, raw[: int(end[0]) + 1]])
        out.append(raw)
        at, inside, depth, step = at + len(raw), scan.ends_inside, int(after[-1]), step * 2


def json_tables(spark: SparkSession, path: str, schema: T.StructType, block_bytes: int = 64 << 20) -> dict[str, DataFrame]:
    """The arrays of one document of any size as tables, by the schema of the whole document."""
    rows = cut(json_elements(spark, path, block_bytes))
    kinds = {f.name: f.dataType.elementType for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    return {name: rows.where(F.col("field") == name).select(F.from_json("element", kind).alias("r")).select("r.*") for name, kind in kinds.items()}
