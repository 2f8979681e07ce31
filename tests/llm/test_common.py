"""The join to a table that is usually small, on both of its ways."""

import pytest
from pyspark.sql import functions as F

from loomframe.llm import common


@pytest.fixture(scope="module")
def tables(spark):
    # a third of the rows hold one key that the small table has, a third one that it lacks
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "lacking").otherwise(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias("key"), F.col("id"))
    small = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 2000, 2))], "of string, v int")
    return rows, common.stored(small, "small")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined(tables):
    rows, small = tables
    return common.with_small(rows, small, {"key": "of"}, F.length("of") + 8, F.xxhash64("id"))


def test_a_light_table_is_broadcast_without_repeats(spark, tables):
    got = joined(tables)
    assert "Exchange hashpartitioning" not in plan(got) and "Generate" not in plan(got)


def test_a_heavy_table_is_merged_with_the_same_rows(spark, tables, monkeypatch):
    want = {tuple(r) for r in joined(tables).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    got = joined(tables)
    assert "SortMergeJoin" in plan(got)
    rows = got.collect()
    assert len(rows) == 6000 and {tuple(r) for r in rows} == want
    assert sum(r["v"] is None for r in rows) >= 2000


def test_hot_keys_are_spread_over_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        largest = joined(tables).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert largest < 2000  # neither hot key is in one task, though each holds 2,000 rows


def test_empty_tables(spark, tables, monkeypatch):
    rows, small = tables
    for limit in (0, 1 << 20):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        assert joined((rows.limit(0), small)).collect() == []
        none = joined((rows, common.stored(small.limit(0), "none")))
        assert none.count() == 6000 and none.where("v is not null").count() == 0
