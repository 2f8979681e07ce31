import math
import random
import zlib

from pyspark.sql import functions as F

from loomframe.llm.sharding import category_code, category_cuts, hilbert_index, hilbert_shards, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, hilbert string"


def test_curve_steps_to_a_neighbour_each_time(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*(F.expr(f"cast(id div {side**i} % {side} as int)").alias(f"c{i}") for i in range(n)))
        rows = cells.withColumn("h", hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(side**n))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_runs_differ_by_one_at_most_and_slots_have_no_gaps(spark):
    rows = [(i, "x" * (i % 50), "en" if i % 3 else "de", f"s{i % 7}", "clash") for i in range(1000)]
    rows += [(None, None, None, None, None), (5, "", "en", "s1", None), (5, "", "en", "s1", None), (2000, "long " * 50_000, "fr", "s0", "")]
    got = hilbert_shards(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert [(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None] == [(8, 0)]


def test_empty_table(spark):
    assert hilbert_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_rows_against_brute_force(spark):
    """Coordinates, order and runs again in plain Python, ties and nulls included."""
    rng = random.Random(5)
    rows = [(rng.randrange(500), "x" * rng.randrange(3000), rng.choice(["en", "de", None]), f"s{int(30 * rng.random() ** 3)}", "c") for _ in range(700)]
    bits, n = 8, len(rows)
    codes = []
    for at in (2, 3):
        values = sorted((r[at] or "") for r in rows)
        codes.append({v: values.index(v) * (1 << bits) // n for v in set(values)})
    low, high = min(r[0] for r in rows), max(r[0] for r in rows)
    cells = []
    for r in rows:
        size = len(r[1]) + 8
        cells.append((codes[0][r[2] or ""], codes[1][r[3] or ""], min(255, int(math.log2(size) * 256 / 32)), min(255, int((r[0] - low) * 256 / (high - low + 1)))))
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i long, c0 int, c1 int, c2 int, c3 int")
    curve = {r["i"]: r["h"] for r in frame.select("i", hilbert_index([F.col(f"c{k}") for k in range(4)], bits).alias("h")).collect()}
    keyed = sorted((curve[i], zlib.crc32(r[1].encode()), r[0]) for i, r in enumerate(rows))
    want = [(h, crc, i, k * 24 // n, k - -(-(k * 24 // n) * n // 24)) for k, (h, crc, i) in enumerate(keyed)]
    got = hilbert_shards(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["hilbert"], r["text_crc32"], r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted(want)


def test_categories_of_many_values_keep_their_order(spark):
    """More values than the curve has codes, and more than any dictionary: classes stay in alphabetical order and of equal depth."""
    frame = spark.range(70_000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("v"))
    cuts = category_cuts(frame, "v", 8)
    assert len(cuts) == 256 and [c for _, c in cuts] == list(range(256)) and [v for v, _ in cuts] == sorted(v for v, _ in cuts)
    sizes = frame.groupBy(category_code("v", cuts).alias("c")).count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1


def test_every_row_is_written_once(spark, tmp_path):
    rows = [(1, "a", "en", "s", "x"), (1, "a", "en", "s", "x"), (1, "b", "en", "s", "y"), (None, None, None, None, None), (None, "", None, None, None), *((i, f"t{i}", "en", "s", "z") for i in range(10, 40))]
    docs = spark.createDataFrame(rows, SCHEMA)
    shards = hilbert_shards(docs, n_shards=4)
    write_shards(docs, shards, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and set(back.columns) == {*docs.columns, "shard", "slot"}
    assert back.select("shard", "slot").distinct().count() == len(rows)
    assert back.where("doc_id is null").count() == 2
    write_shards(docs.limit(0), hilbert_shards(docs.limit(0)), f"{tmp_path}/none")
