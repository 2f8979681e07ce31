import pytest
from pyspark.sql import functions as F

from loomframe.functions import records


def test_scores_with_defaults(spark):
    rows = [
        (1, {"fg_frac": 0.5, "outer_frac": 0.0, "palette_dist": 3.0, "extra_color": 2.0}, 0.1, 0.0),
        (2, {"fg_frac": 0.5, "outer_frac": 0.5, "palette_dist": 3.0, "extra_color": 2.0}, 0.1, 0.0),
        (3, {"fg_frac": 0.5}, 0.1, None),
        (4, {"fg_frac": 0.5, "palette_dist": 3.0, "extra_color": 2.0, "target_chroma": 20.0, "chroma_ratio": 3.0}, 0.1, 0.0),
        (5, {}, 0.1, 0.0),
    ]
    df = spark.createDataFrame(rows, "k int, s map<string,double>, margin double, marker double")
    got = df.select("k", records.right_item(F.col("s"), F.col("margin")).alias("r"), records.faithful(F.col("s"), F.col("margin"), F.col("marker")).alias("f"), records.passes_all(F.col("s"), ["fg_frac"], {"fg_frac": 0.4}).alias("p"))
    assert {x["k"]: (x["r"], x["f"], x["p"]) for x in got.collect()} == {1: (True, True, True), 2: (False, False, True), 3: (True, False, True), 4: (True, False, True), 5: (False, False, False)}


def test_media_units_sizes_names(spark):
    media = [("Images", ("CC0",), "a"), ("Images", ("other",), "b"), ("3d", ("CC0",), "c"), ("Images", ("CC0",), "d"), ("Images", ("CC0",), "e")]
    df = spark.createDataFrame([(media, "nmnhbotany"), (None, "CHNDM")], "m array<struct<type:string,usage:struct<access:string>,content:string>>, u string")
    got = df.select(records.first_media(F.col("m"), "Images", "CC0", 2).alias("m"), records.excluded_unit(F.col("u")).alias("x")).collect()
    assert [list(r["m"]) for r in got] == [["a", "d"], []] and [r["x"] for r in got] == [True, False]
    lit = F.lit
    row = spark.range(1).select(
        records.too_small(lit(0), lit(10), 400), records.too_small(lit(300), lit(900), 400), records.out_stem(lit(""), lit("x/a.b.jpg")), records.out_stem(lit("o"), lit("x")),
        records.category_of(lit(" t-shirt "), F.create_map(lit("T-shirt"), lit("top"))), records.two_way_softmax(lit(0.0), lit(0.0)), records.bundle_title(lit("일반세탁"), lit("어두운색"), lit(40), lit(2)),
        records.least_aspect(lit(None).cast("string"), ["b"], ["o"], 1.0, 2.0, 3.0),
    ).first()
    assert row[:] == (False, True, "a.b", "o", "top", 0.5, "어두운색 옷 · 일반세탁 40℃ 이하 · 2벌", 2.0)


def test_field_scores(spark):
    df = spark.createDataFrame([(("상의", ["봄", "여름"], 2), ("상의", "봄; 가을", "3")), (None, ("하의", "", ""))], "pred struct<category:string,season:array<string>,formality:int>, label struct<category:string,season:string,formality:string>")
    got = df.select(*(c.alias(n) for n, c in records.field_scores(["category"]))).collect()
    assert got[0][:] == (1.0, pytest.approx(1 / 3), 1.0) and got[1][:] == (0.0, None, None)


def test_fallback_join_cycle_timing_and_evidence(spark):
    results = spark.createDataFrame([("a/x.jpg",), ("q/y.jpg",), ("z.jpg",)], "src string")
    labels = spark.createDataFrame([(0, "b/y.jpg", "B"), (1, "a/x.jpg", "A"), (2, "c/y.jpg", "C")], "pos int, key string, v string")
    got = {r["src"]: (r["label_key"], r["v"]) for r in records.join_by_path_or_name(results, labels, "src", "key", "pos").collect()}
    assert got == {"a/x.jpg": ("a/x.jpg", "A"), "q/y.jpg": ("b/y.jpg", "B"), "z.jpg": ("z.jpg", None)}
    combos = spark.createDataFrame([("s1", "l1"), ("s1", "l2"), ("s2", "l1")], "s string, l string")
    assert [(r["s"], r["l"]) for r in records.cycled(combos, ["s", "l"], 5).orderBy("id").collect()] == [("s1", "l1"), ("s1", "l2"), ("s2", "l1"), ("s1", "l1"), ("s1", "l2")]
    times = spark.createDataFrame([("g", i, float(i)) for i in range(12)] + [("h", 0, 5.0)], "g string, i int, s double")
    assert {r["g"]: (r["n"], r["p50"], r["p95"], r["mean"]) for r in records.timing_summary(times, "g", "i", "s", 2).collect()} == {"g": (10, 6.5, 11.0, 6.5), "h": (1, 5.0, 5.0, 5.0)}
    d, s = lambda x: F.lit(x).cast("double"), lambda x: F.lit(x).cast("string")
    text = spark.range(1).select(records.evidence_text(d(None), d(1), d(1), d(1), s(None), s("ab"), d(0.5), d(None))).first()[0]
    assert text == '- text: photo "(none)", product "ab", similarity 0.50'
