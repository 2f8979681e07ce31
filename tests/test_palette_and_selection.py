import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import color
from loomframe.operators import palette, relational


def test_numpy_and_column_differences_agree(spark):
    rng = np.random.default_rng(2)
    p, q = (np.column_stack([rng.uniform(0, 100, 200), rng.uniform(-90, 90, 200), rng.uniform(-90, 90, 200)]) for _ in range(2))
    q[:5] = p[:5]
    p[5:8, 1:] = 0
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, q))], "i int, l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    lab = lambda k: F.struct(F.col(f"l{k}").alias("l"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"))
    for k_l in (1.0, 2.0):
        got = color.with_delta_e(df.withColumns({"p": lab(1), "q": lab(2)}), "p", "q", "de", k_l=k_l).orderBy("i").collect()
        assert np.allclose([r["de"] for r in got], palette.delta_e(p, q, k_l), atol=1e-9)


def test_dominant_colours(spark):
    rgb = [(22, 22, 24)] * 60 + [(24, 24, 26)] * 10 + [(200, 32, 42)] * 27 + [(240, 210, 52)] * 3
    df = spark.createDataFrame([("i", k, *c) for k, c in enumerate(rgb)] + [("one", 0, 22, 22, 24), (None, 0, 1, 2, 3)], "key string, at int, r int, g int, b int")
    got = {r["key"]: (r["primary"], r["secondary"], r["shares"]) for r in palette.palettes(df, "key").collect()}
    assert got == {"i": ("블랙", ["레드"], [0.7, 0.27]), "one": ("블랙", [], [1.0])}
    assert palette.palettes(df.limit(0), "key").collect() == []
    shares = [("블랙", 0.7), ("레드", 0.27)]
    assert palette.primary_and_secondary(shares) == ("블랙", ["레드"])
    assert palette.primary_and_secondary([("a", 0.3), ("b", 0.3), ("c", 0.3)]) == ("멀티", []) and palette.dominant([]) == []
    one = (palette.to_lab(np.array([[22, 22, 24.0]])), np.ones(1))
    assert palette.palette_distance(one, one) == 0.0


def test_clusters_equal_lloyds_rounds(spark):
    rng = np.random.default_rng(4)
    rgb = np.concatenate([rng.normal(c, 12, (200, 3)) for c in ((200, 40, 40), (30, 60, 160), (90, 200, 90))]).clip(0, 255).astype(int)
    df = spark.createDataFrame([("i", k, *map(int, c)) for k, c in enumerate(rgb)], "key string, at int, r int, g int, b int")
    counts = palette.color_counts(df, "key").cache()
    start = np.array([[c[x] for x in "lab"] for c in palette.centres(counts, "key", 5, rounds=0).first()["centres"]])
    lab = palette.to_lab(rgb)
    assert len(start) == 5 and all((np.abs(lab - s).sum(1) < 1e-6).any() for s in start)
    for _ in range(3):
        owner = ((lab[:, None] - start) ** 2).sum(2).argmin(1)
        start = np.array([lab[owner == i].mean(0) if (owner == i).any() else start[i] for i in range(5)])
    got = np.array([[c[x] for x in "lab"] for c in palette.centres(counts, "key", 5, rounds=3).first()["centres"]])
    assert np.allclose(got, start, atol=1e-6)
    found = palette.color_clusters(df, "key", 3)
    assert found.agg(F.sum("n"), F.round(F.sum("share"), 9)).first()[:] == (600, 1.0) and found.agg(F.max("n")).first()[0] < 260  # seeds lie apart


def test_sample_is_exact_even_and_the_same_each_time(spark):
    df = spark.range(30_000).selectExpr("if(id < 29000, 'large', 'small') AS key", "id AS at", "cast(id % 256 AS int) AS r", "0 AS g", "0 AS b")
    some = palette.sampled(df, "key", ["at"], 2000)
    assert {r["key"]: r["n"] for r in some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()} == {"large": 2000, "small": 1000}
    assert some.exceptAll(palette.sampled(df.repartition(7), "key", ["at"], 2000)).count() == 0
    halves = some.where("key = 'large'").agg(F.count_if(F.col("at") < 14500)).first()[0]
    assert abs(halves - 1000) < 120


def test_foreground():
    img = np.full((60, 60, 3), 240.0)
    img[20:40, 15:45] = (32, 42, 70)
    mask = palette.foreground(palette.to_lab(img))
    assert abs(int(mask.sum()) - 600) < 60 and mask[30, 30] and not mask[5, 5]


@pytest.mark.parametrize("seed", range(3))
def test_capped_selection_equals_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i}", rng.choice("aaabc"), j) for i in range(120) for j in range(rng.randint(1, 3))]
    need, want = {"a": 6, "b": 6, "c": 6}, set()
    by = {}
    for f, g, j in sorted(rows, key=lambda x: x[2]):
        by.setdefault(f, []).append(g)
    for f in sorted(by, key=lambda f: (hashlib.sha1(f.encode()).hexdigest(), f)):
        g = next((g for g in by[f] if need[g]), None)
        if g:
            need[g] -= 1
            want.add((f, g))
    got = relational.capped_selection(spark.createDataFrame(rows, "f string, g string, j int"), "f", "g", "j", ["a", "b", "c"], 6)
    assert {tuple(r) for r in got.collect()} == want


def test_visible_cases(spark):
    rows = [("f1", "shirt", 50, 0.9, False), ("f1", "coat", 1, 0.1, True), ("f2", "shirt", 50, 0.9, None), ("f2", "skirt", 3, 0.9, False), ("f3", "coat", 50, 0.6, False), ("f4", "coat", 50, 0.8, False), ("f5", "coat", 50, 0.8, True), ("f6", "hat", 50, 0.9, False), ("f7", "skirt", None, 0.9, False), ("f8", None, 50, 0.9, False)]
    notes = spark.createDataFrame(rows, "file string, category string, area int, solidity double, iscrowd boolean").withColumn("pixels", F.lit(100))
    found = relational.visible_cases(notes, {"shirt": "top", "coat": "outer", "skirt": "bottom"}, "top", "outer", 0.04, 0.7)
    assert sorted((r["file"], r["group"]) for r in found.collect()) == [("f2", "top"), ("f4", "outer")]
