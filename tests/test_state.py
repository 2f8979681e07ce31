import pandas as pd
from pyspark.sql import functions as F

from loomframe.functions.dims import CLEAN, NEEDS_WASH, WORN
from loomframe.streaming import breaker, care

SCHEMA = "item string, seq int, kind string"


def events(spark, **kinds):
    return spark.createDataFrame([(i, n, k) for i, ks in kinds.items() for n, k in enumerate(ks)], SCHEMA)


def fold(spark, base, **kinds):
    return {r["item"]: (r["load"], r["interval_override"], r["state"], r["wear_count"]) for r in care.fold(events(spark, **kinds), "item", ["seq"], F.lit(base)).collect()}


def test_wears_snooze_and_wash(spark):
    got = fold(spark, 4.0, a=["wear"] * 3, b=["wear"] * 4, c=["wear"] * 4 + ["snooze"], d=["wear"] * 4 + ["snooze", "start", "wash"], e=["snooze"])
    assert got["a"] == (3.0, None, WORN, 3) and got["b"][2] == NEEDS_WASH
    assert got["c"] == (4.0, 5.0, WORN, 4) and got["d"] == (0.0, 5.0, CLEAN, 4) and got["e"][2] == CLEAN
    assert fold(spark, 8.0, jeans=["sweaty"])["jeans"][2] == NEEDS_WASH
    assert [fold(spark, 2.0, s=["hot"] * n)["s"][2] for n in (1, 2)] == [WORN, NEEDS_WASH]


def test_stream_agrees_with_the_fold(spark, tmp_path):
    rows = [(f"i{k % 5}", n, ["wear", "hot", "snooze", "wash", "sweaty"][(n * k) % 5]) for n, k in enumerate(range(60))]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        df.where(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = {}

    def take(batch, _):
        found.update({r["item"]: (r["load"], r["interval_override"], r["state"], r["wear_count"]) for r in batch.collect()})

    # one file a batch, oldest first: the batches arrive in order
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = care.stream(source, "item", ["seq"], 4.0).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = {r["item"]: (r["load"], r["interval_override"], r["state"], r["wear_count"]) for r in care.fold(df, "item", ["seq"], F.lit(4.0)).collect()}
    assert found == want


def test_circuit_breaker(spark):
    df = spark.createDataFrame(pd.DataFrame({"provider": ["p"] * 100 + ["q"] * 30, "seq": [*range(100), *range(30)], "ok": [False] * 100 + [i % 2 == 0 for i in range(30)]}))
    got = {r["provider"]: (r["n_ok"], r["n_failed"], r["n_skipped"]) for r in breaker.circuit_breaker(df, "provider", ["seq"], "ok").collect()}
    assert got == {"p": (0, 20, 80), "q": (15, 15, 0)}
