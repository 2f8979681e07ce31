import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomframe.llm import warc
from loomframe.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=1000):
    best = {}
    for i, _, text in rows:
        best[text or ""] = max(best.get(text or "", -1), -1 if i is None else i)
    out = []
    for i, _, text in rows:
        data = (text or "").encode()
        again = len(data) >= least and (-1 if i is None else i) < best[text or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[text or ""] if again else None))
    return sorted(out, key=str)


def pages(rng, n=60):
    texts = ["", None, "short", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30, "é" * 700, "x" * 999, "x" * 1000, "no line end " * 400, "\n" * 1500, "😀" * 2000, "\r" * 1200]
    return [(i, f"http://h{i % 3}.example/ä?{i}" if i % 7 else None, rng.choice(texts)) for i in range(n)]


def test_against_brute_force_for_any_chunk_size(spark):
    rows = pages(random.Random(1))
    frame = spark.createDataFrame(rows, SCHEMA)
    for size in (7, 100, 1000, warc.CHUNK):
        path = scratch_path(spark, "archives")
        got = warc.archived(frame, path, chunk_bytes=size).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)
        assert all(r["intact"] for r in got) and {(r["page_id"], r["url"]) for r in got} == {r[:2] for r in rows}
        back = {}
        for r in warc.payloads(warc.read_warc(spark, path)).orderBy("segment").collect():
            back[int(r["id"])] = back.get(int(r["id"]), b"") + bytes(r["data"])
        assert back == {i: (text or "").encode() for i, _, text in rows}


def test_files_are_plain_warc_and_hold_a_shared_payload_once(spark, tmp_path):
    rows = [(i, "http://a/", "the same page, " * 100) for i in range(50)] + [(90, "http://b/\r\nX: y", "other")]
    path = f"file://{tmp_path}/archives"
    warc.write_warc(warc.chunk_records(spark.createDataFrame(rows, SCHEMA).repartition(5)), path)
    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "archives").glob("*.gz")))
    assert raw.count(b"the same page, " * 100) == 1 and raw.count(b"WARC/1.1\r\n") == 51 and b"http://b/%0D%0AX: y" in raw
    at, types = 0, []
    while at < len(raw):  # by the book: header, blank line, as many bytes as said, two line ends
        end = raw.index(b"\r\n\r\n", at)
        header = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        at = end + 4 + int(header["Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
        types.append(header["WARC-Type"])
    assert sorted(types) == ["response"] * 2 + ["revisit"] * 49


def test_null_ids_repeated_rows_bytes_and_clashing_columns(spark):
    body = "a body of a thousand bytes and more " * 40
    rows = [(None, None, body, 1, "a"), (None, "http://a/", body, 2, "b"), (None, "http://a/", body, 2, "b")]
    got = warc.archived(spark.createDataFrame(rows, SCHEMA + ", record int, data string"), scratch_path(spark, "archives")).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "revisit", "revisit"] and all(r["page_id"] is None and r["refers_to"] is None for r in got)
    twice = spark.createDataFrame([("b", None, body), ("b", None, body), ("a", None, body)], "page_id string, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(twice, scratch_path(spark, "archives")).collect()) == [("a", "revisit", "b"), ("b", "response", None), ("b", "revisit", "b")]
    raw = spark.createDataFrame([(1, None, bytes(range(256)) * 9)], "page_id int, url string, html binary")
    assert warc.archived(raw, scratch_path(spark, "archives"), chunk_bytes=100).first()["payload_digest"] == hashlib.sha1(bytes(range(256)) * 9).hexdigest()
    assert warc.archived(spark.createDataFrame([], SCHEMA), scratch_path(spark, "archives")).collect() == []


def test_hot_digests_are_joined_apart_and_nothing_changes(spark, monkeypatch):
    rows = [(i, None, ("hot " if i % 2 else f"pair {i // 4} ") * 300) for i in range(200)]
    monkeypatch.setattr(warc, "HOT", 10)
    got = warc.archived(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "archives")).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)


def test_a_divided_record_is_never_whole(spark):
    frame = spark.range(2).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.repeat(F.lit("0123456789"), 700_000).alias("html"))
    chunks = warc.chunk_records(frame)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == warc.CHUNK and chunks.count() == 2 * 107
    path = scratch_path(spark, "archives")
    warc.write_warc(chunks.where("record >= 0"), path)
    rows = warc.read_warc(spark, path, payloads=False)
    found = warc.records(rows).orderBy("id").collect()
    want = hashlib.sha1(b"0123456789" * 700_000).hexdigest()
    assert [(r["type"], r["size"], r["sha1"], r["intact"]) for r in found] == [("revisit", 7_000_000, want, True), ("response", 7_000_000, want, True)]


def test_broken_archives_fail(spark, tmp_path):
    rows = spark.createDataFrame([(i, None, "page of some length " * 200) for i in range(1)], SCHEMA)
    path = tmp_path / "archives"
    warc.write_warc(warc.chunk_records(rows, chunk_bytes=1000), f"file://{path}")
    for f in [*path.glob("*.gz"), *path.glob(".*.crc")]:
        raw = gzip.open(f).read() if f.suffix == ".gz" else b""
        f.unlink()
        if raw:
            f.write_bytes(gzip.compress(raw[:-30]))
    with pytest.raises(Exception, match="cut off|does not end"):
        warc.read_warc(spark, f"file://{path}").count()
    lost = warc.read_warc  # a segment that never came
    chunks = warc.chunk_records(rows, chunk_bytes=1000).where("chunk <> 1")
    warc.write_warc(chunks, f"file://{tmp_path}/lost")
    with pytest.raises(Exception, match="missing"):
        warc.records(lost(spark, f"file://{tmp_path}/lost")).collect()
