"""Sinks, the breaker's stream, run-length strings: small parts with a test of their own."""

import json
import random

from pyspark.sql import functions as F

from loomframe.functions import checks
from loomframe.operators import masks
from loomframe.sources import files
from loomframe.streaming import breaker


def packed(counts):
    """The compressed string of run lengths, by the rule that counts_from_string undoes."""
    out = []
    for i, c in enumerate(counts):
        x, more = c - counts[i - 2] if i > 2 else c, True
        while more:
            low = x & 31
            x >>= 5
            more = not (x == 0 and not low & 16) and not (x == -1 and low & 16)
            out.append(chr((low | (32 if more else 0)) + 48))
    return "".join(out)


def test_run_length_strings():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 50):
        counts = [rng.choice([0, 1, 15, 16, 31, 32, 1000, 70_000]) for _ in range(n)]
        assert masks.counts_from_string(packed(counts)) == counts


def test_appended_csv_is_read_as_one_table(spark, tmp_path):
    at = f"{tmp_path}/log"
    for k in range(3):
        files.append_csv(spark.range(k * 10, k * 10 + 10).select("id", F.lit("a,\"b\"").alias("t")).repartition(2), at)
    rows = files.text_csv(spark, at)
    assert rows.columns == ["id", "t"] and sorted(int(r["id"]) for r in rows.collect()) == list(range(30)) and rows.where("t <> 'a,\"b\"'").count() == 0


def test_create_if_absent_and_sorted_index(spark, tmp_path):
    at = f"{tmp_path}/sheet"
    files.create_if_absent(spark.range(3), at)
    files.create_if_absent(spark.range(9), at)
    assert files.text_csv(spark, at).count() == 3
    files.write_index(spark.range(500).select(F.format_string("f%03d", F.col("id")).alias("file")).orderBy(F.rand(1)).repartition(5), f"{tmp_path}/index")
    lines = [json.loads(x)["file"] for f in sorted((tmp_path / "index").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 500


def test_breaker_as_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"p{i % 3}", i, rng.random() < (0.02, 0.5, 0.9)[i % 3]) for i in range(300)]
    schema = "provider string, at int, ok boolean"
    want = {tuple(r) for r in breaker.circuit_breaker(spark.createDataFrame(rows, schema), "provider", ["at"], "ok").collect()}
    query, seen = None, {}
    for k in range(3):  # a file a batch, in the order of the tries
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = breaker.stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "provider", ["at"], "ok")
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r["provider"]: tuple(r) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
    assert set(seen.values()) == want and any(r[3] for r in want)


def test_prompts_of_every_style(spark):
    layers = ("inner under coat", "flat", "outer", "single")
    rows = spark.createDataFrame([("shirt", x) for x in layers], "category string, layer string")
    got = {style: [r[0] for r in rows.select(checks.extract_prompt(F.col("category"), F.col("layer"), style)).collect()] for style in ("struct", "natural", "generic", "dim", "dimfine")}
    assert got["struct"][0] == "[EXTRACT] shirt; layer=inner under coat"
    assert "the shirt marked with the green outline in image 1 (image 2 is a close-up of it; it is worn under the coat)" in got["natural"][0] and "no coat, no person, no other clothing." in got["natural"][0]
    assert "(image 2 is a close-up of it; it lies among other things)" in got["natural"][1] and got["natural"][3].startswith("Create a store product photo of the shirt marked") and "(image 2 is a close-up of it):" in got["natural"][3]
    assert all(x.endswith(checks.MARK_NOTE) for x in got["natural"] + got["generic"]) and "the top marked" in got["generic"][2]
    assert "the top shown bright" in got["dim"][3] and "the shirt shown bright" in got["dimfine"][3] and not any("{" in x for v in got.values() for x in v)
    peel = spark.range(1).select(checks.peel_prompt(F.lit("coat"), "natural")).first()[0]
    assert peel.startswith("Remove the coat marked") and peel.endswith(checks.MARK_NOTE)


def test_an_item_covers_a_pixel_once(spark):
    from loomframe.operators import pixels

    rows = [(1, 7, 0, 0, 0), (1, 7, 2, 0, 0), (1, 7, 0, 0, 1), (1, 8, 1, 0, 0), (1, 8, 1, 0, 1)]
    got = pixels.stacked(spark.createDataFrame(rows, "scene int, item int, ord int, y int, x int")).collect()
    assert {(r["item"], r["full"], r["visible"]) for r in got} == {(7, 2, 1), (8, 2, 1)}


def test_a_document_is_parsed_once(spark):
    from pyspark.sql import functions as F

    from loomframe.functions import checks

    spec = {"a": {"type": "integer", "minimum": 1, "maximum": 2}, "b": {"type": "array", "enum": ["x"], "maxItems": 1}, "c": {"type": "string", "required": False}}
    docs = spark.createDataFrame([('{"a": 3, "b": ["x", "y"], "d": 1}',), ('{"b": "x", "c": 5}',), ("[1]",), (None,), ('{"a": 2, "b": []}',)], "t string")
    found = docs.select(checks.json_violations(F.col("t"), spec).alias("v"))
    assert found._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    assert [r["v"] for r in found.collect()] == [["a: range", "b: size", "b: members", "d: unknown"], ["a: missing", "b: no array", "c: no string"], ["no object"], ["no object"], []]


def test_edges_are_runs_of_their_nearest_pixels(spark):
    import random

    from pyspark.sql import functions as F

    from loomframe.operators import runs

    draw = random.Random(5)
    edges = [(i, *(draw.randrange(12) for _ in range(4))) for i in range(150)]
    want = set()
    for i, *ends in edges:
        for x0, y0, x1, y1 in (ends, ends[2:] + ends[:2]):
            n = max(abs(x1 - x0), abs(y1 - y0))
            want |= {(i, y0 + int((2 * k * (y1 - y0) + n) // (2 * n)) if n else y0, x0 + int((2 * k * (x1 - x0) + n) // (2 * n)) if n else x0) for k in range(n + 1)}
    shapes = spark.createDataFrame([(i, 0, [float(v) for v in (x0, y0, x1, y1, x1, y1)]) for i, x0, y0, x1, y1 in edges], "image int, ring int, points array<double>")
    size = shapes.select("image", F.lit(12).alias("lines"), F.lit(12).alias("length"))
    got = {(r["image"], r["line"], x) for r in runs.filled(shapes, size).collect() for x in range(r["a"], r["b"])}
    assert got == want
