"""Byte ranges of archives and documents against the whole files."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.sources import files, ranges


def test_members_by_range_count_and_what_is_there_already(spark, tmp_path):
    rng, want = random.Random(1), {}
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w") as z:
            z.mkdir(f"d{a}")
            for i in range(40):
                data = rng.randbytes(rng.randint(0, 5000)) if i % 2 else b"text " * i
                z.writestr(zipfile.ZipInfo(f"d{a}/m{a}_{i}.png"), data, zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
                want[f"m{a}_{i}.png"] = data
    paths = [f"file://{tmp_path}/a{a}.zip" for a in range(3)]
    listing = ranges.zip_listing(spark, paths)
    assert listing.count() == 120
    got = ranges.zip_members(listing, part_bytes=20_000)
    assert got.rdd.getNumPartitions() > 3 and {r["name"]: bytes(r["content"]) for r in got.collect()} == want
    names = spark.createDataFrame([(n,) for n in list(want)[:50]] + [("absent.png",)], "name string")
    dest = f"file://{tmp_path}/out"
    assert ranges.extract(spark, paths[:1], names, dest) == 40 and ranges.extract(spark, paths, names, dest) == 10 and ranges.extract(spark, paths, names, dest) == 0
    assert {r["name"]: bytes(r["content"]) for r in spark.read.parquet(dest).collect()} == {n: want[n] for n in list(want)[:50]}
    raw = bytearray((tmp_path / "a0.zip").read_bytes())
    raw[len(raw) // 3] ^= 1
    (tmp_path / "bad.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged|decompress"):
        ranges.zip_members(ranges.zip_listing(spark, [f"{tmp_path}/bad.zip"])).count()
    assert ranges.zip_listing(spark, []).collect() == []


TRICKY = ['plain', 'a "quoted" \\ one', "\\\\", '\\"', "[{]}", 'x":[{', "é😀", "", "\\" * 9 + '"', "\n\t"]


def document(rng, n):
    item = lambda i: {"id": i, "name": rng.choice(TRICKY), "deep": {"list": [[i, {"k": rng.choice(TRICKY)}], []]}, "v": rng.choice([None, 1.5])}
    return {"info": {"year": 2020, "list": [{"no": 1}]}, "images": [item(i) for i in range(n)], "nothing": [], "numbers": [1, 2, [{"not": "this"}]], 'odd "key"': [item(-1)], "annotations": [{"id": i, "name": "x" * rng.randint(0, 400), "deep": None, "v": 0.5} for i in range(n)], "end": "[{"}


KIND = "STRUCT<id: BIGINT, name: STRING, v: DOUBLE>"


@pytest.mark.parametrize("block", [50, 997, 1 << 20])
def test_tables_equal_the_whole_document(spark, tmp_path, block):
    rng = random.Random(block)
    for k, style in enumerate(({}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")})):
        doc = document(rng, 25 if block == 50 else 60)
        (tmp_path / "doc.json").write_text(json.dumps(doc, **style), encoding="utf-8")
        schema = T.StructType([T.StructField(n, T.ArrayType(T._parse_datatype_string(KIND))) for n in ("images", "annotations", "nothing", 'odd "key"')])
        path = f"{tmp_path}/doc.json"
        elements = ranges.json_elements(spark, path, block).orderBy("pos").collect()
        want = [(n, e) for n in ("images", 'odd "key"', "annotations") for e in doc[n]]
        assert [(r["field"], json.loads(r["element"])) for r in elements] == want
        if k == 1:
            tables, plain = ranges.json_tables(spark, path, schema, block), files.coco(spark, path, schema)
            assert set(tables) == set(plain)
            for n in tables:
                rows = lambda df: sorted(str(r) for r in df.collect())
                assert rows(tables[n]) == rows(plain[n])


def test_a_document_is_many_tasks(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps(document(random.Random(2), 200)))
    blocks = ranges.json_blocks(spark, f"{tmp_path}/doc.json", 4096)
    assert blocks.count() > 10 and blocks.agg(F.min("depth"), F.max(F.col("high") - F.col("low"))).first()[:] == (0, 4096)
