import math

import pytest
from pyspark.sql import functions as F

from loomframe.operators import metrics, outfits, relational


def test_dedup_round_robin_and_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "id int, t string")
    kept = relational.dedup_id_then_content(df, "id", F.col("t"), [F.col("id"), F.col("t")])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    again = relational.dedup_id_then_content(df, "id", F.col("t"), [F.col("id"), F.col("t")], kept.where("id = 3").select("id", "sha1"))
    assert [r["id"] for r in again.collect()] == [1]
    items = spark.createDataFrame([(f"t{i}", "T-Shirt") for i in range(10)] + [(f"p{i}", "Pants") for i in range(10)] + [("s", "Shoes")], "id string, label string")
    got = [r["label"] for r in relational.round_robin(items, "label", F.col("id"), 6).collect()]
    assert len(got) == 6 and got.count("Shoes") == 1 and got.count("Pants") in (2, 3)
    with pytest.raises(Exception, match="occurs twice"):
        relational.unique_or_fail(df, "id").collect()
    with pytest.raises(Exception, match="no row"):
        relational.strict_lookup(df, spark.createDataFrame([(1, "x")], "id int, n string"), ["id"]).collect()


def test_every_nth_and_first_passing(spark):
    df = spark.range(0, 300, 3)
    assert sorted(r["id"] for r in relational.every_nth(df, "id", 7).collect()) == list(range(0, 300, 21))
    pairs = spark.createDataFrame([("a", d, d, d >= 3) for d in range(8)], "g string, c int, o int, ok boolean")
    found = relational.first_passing(pairs, "g", "c", F.col("o"), F.col("ok"), 5).collect()
    assert [(r["c"], r["attempt"]) for r in found] == [(3, 4)]


def test_auroc_and_nearest_rank(spark):
    pos, neg = [1, 2, 2, 5], [0, 2, 3]
    df = spark.createDataFrame([(float(x), True) for x in pos] + [(float(x), False) for x in neg], "s double, p boolean")
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 12
    assert metrics.auroc(df, F.col("s"), F.col("p")).first()["auroc"] == pytest.approx(want)
    assert metrics.auroc(df.where("p"), F.col("s"), F.col("p")).first()["auroc"] is None
    values = [float(i % 13) for i in range(41)]
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    assert metrics.nearest_rank_by(rows, "g", "v", 0.95).first()["v"] == sorted(values)[round(0.95 * 40)]
    assert rows.agg(metrics.nearest_rank(F.collect_list("v"), 0.95)).first()[0] == sorted(values)[38]


def test_mcnemar(spark):
    def p(a, b):
        return spark.range(1).select(metrics.mcnemar(F.lit(a), F.lit(b))).first()[0]

    assert p(10, 0) == pytest.approx(2 / 2**10) and p(0, 0) == 1.0 and p(3, 3) == 1.0
    assert p(299, 9) == pytest.approx(2.41507595953e-76, rel=1e-6)
    assert p(11, 2) == pytest.approx(2 * sum(math.comb(13, k) for k in range(3)) / 2**13)


def test_multiset_overlap(spark):
    p = spark.createDataFrame([("f", c) for c in ("상의", "하의")], "k string, c string")
    t = spark.createDataFrame([("f", c) for c in ("상의", "하의", "신발")], "k string, c string")
    r = metrics.multiset_overlap(p, t, ["k"], "c").first()
    assert (r["count_exact"], r["shared"]) == (False, 2)
    assert (r["accuracy"], r["missing_ratio"], r["extra_ratio"]) == pytest.approx((2 / 3, 1 / 3, 0))


def test_greedy_diversity(spark):
    rows = [(1, 0.9, ["a", "b", "s"], ["a", "b"]), (1, 0.8, ["a", "c", "s"], ["a", "c"]), (1, 0.7, ["d", "c", "s"], ["d", "c"]), (2, 0.1, ["x"], ["x"])]
    df = spark.createDataFrame(rows, "context int, score double, ids array<string>, core array<string>")
    got = {(r["context"], r["rank"]): list(r["ids"]) for r in outfits.greedy_diverse(df, "context").collect()}
    assert got == {(1, 1): ["a", "b", "s"], (1, 2): ["d", "c", "s"], (2, 1): ["x"]}
    more = outfits.greedy_diverse(df, "context", max_reuse=2).where("context = 1").count()
    assert more == 3


def test_paired_mcnemar_of_a_p_below_all_doubles_is_minus_infinity(spark, tmp_path):
    """1,100 pairs that all differ one way: p is 2 ** -1099, its logarithm as the SQL has it."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    spark.range(1100).selectExpr("id doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(1100).selectExpr("id doc_id", "if(id < 1090, 'en', 'de') lang").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("labels", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, queries()["paired_mcnemar"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(oracle_sql()["paired_mcnemar"]).fetchall())
    assert got[1] == ("en", 1090, 0, float("-inf"))
