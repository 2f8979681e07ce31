"""WARC archives of any payload size, by way of a table of chunks.

A payload is never one value here: it is rows (record, chunk) of ``chunk_bytes`` at most, and each
carries the size and SHA-1 of the payload up to its own end, so the last chunk's are the
payload's. What is equal to what is found from these last chunks without reading any data.

Each chunk is written as a WARC record of its own: the first as a response, further ones as
its continuations (WARC-Segment-Number, the format's own way to divide a record). So a row is
all that a writer holds, a record may lie in several archives, and Spark's text writer does
the writing: it commits whole files, on whatever file system the path names. Files are
compressed, so each is read in one piece by one task, as lines, and never held as a whole.

Reading gives chunk rows again. The digest of an undivided record is taken as it is read. Chunks
of divided ones are dealt out by record, sorted by number, and their SHA-1 carried from
chunk to chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, stored

CHUNK = 1 << 16
LEAST_BYTES = 1000  # shorter payloads are written again
HOT = 1000  # a digest with over a HOT-th of the records is hot; there are fewer than HOT of them
BATCH_BYTES = 8 << 20
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK) -> DataFrame:
    """(record, chunk, last, id, url, size, sha1, data), written to the shared folder; a null payload is an empty chunk.

    record numbers the rows of pages, so repeated rows are records of their own; size and sha1 are of the payload up to the chunk's end.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("data"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0

            def filled() -> pa.RecordBatch:
                at, chunk, last, size, sha1, data = zip(*out, strict=True)
                own = batch.select([0, 1, 2]).take(pa.array(at))  # noqa: B023
                columns = [own.column(0), pa.array(chunk, pa.int32()), pa.array(last), own.column(1), own.column(2), pa.array(size, pa.int64()), pa.array(sha1), pa.array(data, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["record", "chunk", "last", "id", "url", "size", "sha1", "data"])

            for at, value in enumerate(batch.column(3)):
                payload, state = memoryview(value.as_buffer()), hashlib.sha1(usedforsecurity=False)
                for chunk, low in enumerate(range(0, max(len(payload), 1), chunk_bytes)):
                    piece = payload[low : low + chunk_bytes]
                    state.update(piece)
                    end = low + len(piece)
                    out.append((at, chunk, end == len(payload), end, state.hexdigest(), bytes(piece)))
                    held += len(piece)
                    if held >= BATCH_BYTES:
                        yield filled()
                        out, held = [], 0
            if out:
                yield filled()

    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields["record"], T.StructField("chunk", T.IntegerType()), T.StructField("last", T.BooleanType()), fields["id"], fields["url"], T.StructField("size", T.LongType()), T.StructField("sha1", T.StringType()), T.StructField("data", T.BinaryType())])
    return stored(rows.mapInArrow(split, schema), "warc-chunks")


def revisits(chunks: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record, of_record, of_id, full_size, full_sha1) of each record whose payload is that of another with a larger id.

    Of equal payloads of least_bytes or more the record with the largest id is written, of several with
    that id the one numbered last; a null id is the smallest. A digest's records are counted in part before they
    meet. Digests that many records share are joined by broadcast (fewer than HOT rows), the others by exchange.
    """
    heads = chunks.where("last").select("record", "id", "size", "sha1")
    long = heads.where(F.col("size") >= least_bytes)
    total = heads.count()
    shared = long.groupBy("sha1").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("id", "record")).alias("_of")).where("_n > 1")
    shared = stored(shared, "warc-shared")
    hot = F.broadcast(shared.where(F.col("_n") * HOT > total))
    rest = long.join(hot.select("sha1"), "sha1", "left_anti").join(shared, "sha1")
    met = long.join(hot, "sha1").unionByName(rest).where("record <> _of.record")
    return stored(met.select("record", F.col("_of.record").alias("of_record"), F.col("_of.id").alias("of_id"), F.col("size").alias("full_size"), F.col("sha1").alias("full_sha1")), "warc-revisits")


def _urn(archive: str, record: Column, chunk: Column) -> Column:
    made = F.md5(F.concat_ws(" ", F.lit(archive), record, chunk).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(made, at, n) for at, n in cuts)), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line, or nothing if the value is null. Line ends in a value are percent-encoded."""
    value = F.lit(value) if isinstance(value, str) else F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def write_warc(chunks: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> None:
    """Write chunk rows as WARC 1.1 archives in the folder path, gzip-compressed, one for each task.

    The revisited chunks go, and with them their data, before anything is written. Ids and those that they
    refer to are extension fields (X-Page-ID, X-Refers-To-Page-ID).
    """
    again = revisits(chunks, least_bytes)
    rows = chunks.join(again, "record", "left").where("of_record IS NULL OR chunk = 0")
    archive = uuid.uuid4().hex
    first, is_revisit, divided = F.col("chunk") == 0, F.col("of_record").isNotNull(), ~(F.col("last") & (F.col("chunk") == 0))
    size = F.when(is_revisit, F.col("full_size")).when(F.col("last"), F.col("size"))
    sha1 = F.when(is_revisit, F.col("full_sha1")).when(F.col("last"), F.col("sha1"))
    only = lambda when, value: F.when(when, value if isinstance(value, Column) else F.lit(value))
    http = F.when(first, F.concat(F.lit(f"HTTP/1.1 200 OK{END}"), _line("Content-Type", content_type), _line("Content-Length", size), F.lit(END))).otherwise("")
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.col("data").cast("string")))  # bytes as they are
    urn = lambda record, chunk: _urn(archive, record, chunk)
    segment = divided & ~is_revisit
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(is_revisit, "revisit").when(first, "response").otherwise("continuation")),
        _line("WARC-Record-ID", urn(F.col("record"), F.col("chunk"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.col("url")),
        _line("X-Page-ID", F.col("id")),
        _line("Content-Type", only(first, "application/http; msgtype=response")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("WARC-Profile", only(is_revisit, PROFILE)),
        _line("WARC-Refers-To", only(is_revisit, urn(F.col("of_record"), F.lit(0)))),
        _line("X-Refers-To-Page-ID", F.col("of_id")),
        _line("WARC-Segment-Number", only(segment, F.col("chunk") + 1)),
        _line("WARC-Segment-Origin-ID", only(segment & ~first, urn(F.col("record"), F.lit(0)))),
        _line("WARC-Segment-Total-Length", only(segment & F.col("last"), F.col("size"))),
        _line("Content-Length", F.octet_length(block.cast("binary"))),
    )
    rows.select(F.concat(header, F.lit(END), block).alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(path)


# --- reading ------------------------------------------------------------------------------------------

READ = "record string, segment int, last boolean, divided boolean, type string, id string, url string, refers_to string, refers_to_id string, size long, sha1 string, said_sha1 string, data binary"


@dataclass
class _Reader:
    """Records from the lines of archives, one after another: what is held is one block."""

    header: dict[str, str] | None = None  # of the block that is read
    lines: list[bytes] = None  # type: ignore[assignment]
    left: int = -1  # bytes of the block and its end that are to come; -1: within the header

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """A line without its line feed; a record if it ends here."""
        if self.left >= 0:
            self.lines.append(line)
            self.left -= len(line) + 1
            if self.left > 0:
                return None
            block = b"\n".join(self.lines) + b"\n"
            if self.left < 0 or not block.endswith(b"\r\n\r\n"):
                raise ValueError(f"a WARC record does not end where its length says: {self.header}")
            done, self.header, self.lines, self.left = self.header, None, [], -1
            return done, block[:-4]
        line = line.removesuffix(b"\r")
        if self.header is None:
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            self.header, self.lines = {}, []
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.header[name.strip().lower()] = value.strip()
        else:
            self.left = int(self.header["content-length"]) + 4
        return None


def _row(header: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, number = header.get("warc-type"), int(header.get("warc-segment-number", 0))
    http, payload = b"", block
    if kind in ("response", "revisit") and header.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    size, said = len(payload), header.get("warc-payload-digest", "").removeprefix("sha1:") or None
    sha1 = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    if kind == "revisit":  # its payload is elsewhere: what is said of it
        lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, sha1 = int(lengths[0]) if lengths else None, said
    ids = header.get("warc-segment-origin-id", header["warc-record-id"]), max(number, 1)
    last = not number or "warc-segment-total-length" in header
    kept = payload if payloads or number else None
    return (*ids, last, number > 0, kind, header.get("x-page-id"), header.get("warc-target-uri"), header.get("warc-refers-to"), header.get("x-refers-to-page-id"), size, sha1, said, kept)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Chunk rows (READ) of the archives in a folder; without ``payloads`` only divided records have their data.

    size and sha1 are the chunk's own, for a revisit those of the payload that it stands for. A record that is cut off or whose length is wrong
    fails the read; a folder without archives gives no rows. Archives must be compressed, or read by one task each in another way.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, held = _Reader(), [], 0

        def filled() -> pa.RecordBatch:
            types = (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary())
            names = [x.split()[0] for x in READ.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for line in batch.column(0):
                found = reader.feed(line.as_py())
                if found and found[0].get("warc-type") in ("response", "revisit", "continuation", "resource"):
                    out.append(_row(*found, payloads))
                    held += len(out[-1][-1] or b"") + 500
                    if held >= BATCH_BYTES:
                        yield filled()
                        out, held = [], 0
        if reader.header is not None:
            raise ValueError(f"a WARC record is cut off: {reader.header}")
        if out:
            yield filled()

    return lines.mapInArrow(parse, READ)


def joined_digests(segments: DataFrame) -> DataFrame:
    """(record, size, sha1, segments) of divided records: the SHA-1 is carried from chunk to chunk, which come in order.

    A record of which a chunk is missing or comes twice fails.
    """
    n = parts(segments.sparkSession)
    dealt = segments.select("record", "segment", "last", "data").repartition(n, "record").sortWithinPartitions("record", "segment")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, count, ended, state = None, 0, 0, True, hashlib.sha1(usedforsecurity=False)
        for batch in batches:
            done = []
            for record, segment, last, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                if record.as_py() != now:
                    if not ended:
                        raise ValueError(f"the last segment of {now} is missing")
                    now, size, count, ended, state = record.as_py(), 0, 0, False, hashlib.sha1(usedforsecurity=False)
                count += 1
                if ended or segment.as_py() != count:
                    raise ValueError(f"segment {count} of {now} is missing, or one comes twice")
                state.update(data.as_buffer())
                size += len(data.as_buffer())
                if last.as_py():
                    ended = True
                    done.append((now, size, state.hexdigest(), count))
            columns = zip(*done, strict=True) if done else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["record", "size", "sha1", "segments"])
        if not ended:
            raise ValueError(f"the last segment of {now} is missing")

    return dealt.mapInArrow(fold, "record string, size long, sha1 string, segments int")


def records(rows: DataFrame) -> DataFrame:
    """One row a record of read_warc(): record, type, id, url, refers_to, refers_to_id, size, sha1, intact.

    intact: the digest of what was read is the one that the archive says (for a revisit, that it says one).
    """
    firsts = rows.where("segment = 1").select("record", "type", "id", "url", "refers_to", "refers_to_id", "divided", "size", "sha1", "said_sha1")
    plain = firsts.where("NOT divided").drop("divided")
    whole_ones = joined_digests(rows.where("divided"))
    said = rows.where("divided AND last").select("record", "said_sha1")
    divided = firsts.where("divided").drop("divided", "size", "sha1", "said_sha1").join(whole_ones.drop("segments"), "record").join(said, "record")
    return plain.unionByName(divided).withColumn("intact", F.col("sha1").eqNullSafe(F.col("said_sha1"))).drop("said_sha1")


def payloads(rows: DataFrame) -> DataFrame:
    """(record, id, url, segment, last, data): the chunks of every record of read_warc(), for a revisit those of the record that it refers to."""
    data = rows.where("type <> 'revisit'")
    names = data.where("segment = 1").select("record", "id", "url")
    own = data.select("record", "segment", "last", "data").join(names, "record")
    again = rows.where("type = 'revisit'").select("record", "id", "url", "refers_to")
    theirs = data.select(F.col("record").alias("refers_to"), "segment", "last", "data")
    return own.unionByName(again.join(theirs, "refers_to").drop("refers_to"))


def archived(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record for each row of pages to archives in path, and read them back: one row a record.

    Columns: id_col, url_col, payload_bytes, payload_digest (SHA-1, hex), record_type (response or revisit), refers_to (as id_col, null unless revisit), intact.
    Ids of any type that a string can carry and bring back; a null id, URL or payload is left out, and read as null, null and empty. Further columns are not
    read. Line ends inside an id or URL come back percent-encoded. An empty table gives an empty table.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    write_warc(chunk_records(pages, id_col, url_col, payload_col, chunk_bytes), path, least_bytes)
    found = records(read_warc(spark, path, payloads=False))
    return found.select(
        F.col("id").cast(kind).alias(id_col),
        F.col("url").alias(url_col),
        F.col("size").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_id").cast(kind).alias("refers_to"),
        "intact",
    )
