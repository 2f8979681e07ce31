"""Ingestion from a paged stream: stopped, resumed, with a quota, against a plain walk over all rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomframe.sources import web
from loomframe.streaming import ingest


def pages():
    rng = random.Random(7)
    ids = [f"id{rng.randint(0, 60)}" for _ in range(400)]
    rows = [{"id": i, "content": f"c{rng.randint(0, 80)}", "ok": rng.random() < 0.6} for i in ids]
    out = {}
    for seed, n in (("a", 5), ("b", 3), ("c", 0), ("d", 6)):
        out[seed] = [[rows.pop() for _ in range(rng.randint(1, 12))] for _ in range(n)]
    return out


PAGES = pages()


def transport(request):
    found = PAGES[request["seed"]]
    return {"rows": found[request["page"] - 1] if request["page"] <= len(found) else [], "page_count": len(found)}


def walk(accepted, quota, kept=()):
    """What a program that reads page after page keeps."""
    out = list(kept)
    for page in range(1, 7):
        for seed in sorted(PAGES):
            for row in PAGES[seed][page - 1] if page <= len(PAGES[seed]) else []:
                if len(out) < quota and accepted(row) and all(row["id"] != k[0] and row["content"] != k[1] for k in out):
                    out.append((row["id"], row["content"]))
    return out


def parsed(df):
    return df.select("seed", "page", "pos", *(F.get_json_object("body", f"$.{c}").alias(c) for c in ("id", "content", "ok")))


def stream(spark):
    return parsed(web.stream_pages(spark, transport, list(PAGES)))


def logged(spark, path):
    return {(r["id"], r["content"]) for r in spark.read.parquet(path).collect()}


def test_stream_equals_the_walk_and_one_batch(spark, tmp_path):
    ok, order = F.col("ok") == "true", ["page", "seed", "pos"]
    for quota in (1000, 7):
        log = f"file://{tmp_path}/log{quota}"
        job = ingest.Ingestion(log, ok, ["id", "content"], order, quota)
        n = job.run(stream(spark), f"file://{tmp_path}/at{quota}")
        want = walk(lambda r: r["ok"], quota)
        assert logged(spark, log) == set(want) and n == len(want)
        whole = parsed(web.read_pages(spark.createDataFrame([(s, p) for s in PAGES for p in range(1, 7)], "seed string, page int"), transport))
        once = ingest.Ingestion(f"{log}-once", ok, ["id", "content"], order, quota)
        once.take(whole)
        assert logged(spark, f"{log}-once") == set(want)


def test_killed_between_batches_resumed_and_rejected_rows_looked_at_again(spark, tmp_path, monkeypatch):
    ok, order = F.col("ok") == "true", ["page", "seed", "pos"]
    log, at = f"file://{tmp_path}/log", f"file://{tmp_path}/at"
    write, failed = ingest.Log.write, []

    def dies(self, rows, run, batch):
        write(self, rows, run, batch)
        if batch == 2 and not failed:  # the batch is in the log, and not yet in the stream's own books
            failed.append(batch)
            raise RuntimeError("killed")

    monkeypatch.setattr(ingest.Log, "write", dies)
    with pytest.raises(Exception, match="killed"):
        ingest.Ingestion(log, ok, ["id", "content"], order, 1000).run(stream(spark), at)
    part = logged(spark, log)
    n = ingest.Ingestion(log, ok, ["id", "content"], order, 1000).run(stream(spark), at)
    want = walk(lambda r: r["ok"], 1000)
    assert failed and part < logged(spark, log) == set(want) and n == len(want)
    again = ingest.Ingestion(log, F.lit(True), ["id", "content"], order, 1000, name="second")
    again.run(stream(spark), f"{at}-second")
    assert logged(spark, log) == set(walk(lambda r: True, 1000, want)) > set(want)


def test_first_distinct_and_empty_batches(spark, tmp_path):
    rows = [("a", "x", 1), ("b", "x", 2), ("b", "y", 3), (None, "z", 4), (None, "w", 5), ("c", None, 6), ("d", None, 7), ("a", "q", 8)]
    df = spark.createDataFrame(rows, "id string, content string, at int")
    assert sorted(r["at"] for r in ingest.first_distinct(df, ["id", "content"], ["at"]).collect()) == [1, 3, 4, 6]
    job = ingest.Ingestion(f"file://{tmp_path}/log", F.lit(True), ["id", "content"], ["at"], 2)
    job.take(df.limit(0), 0)
    assert job.total == 0
    job.take(df, 1)
    job.take(df, 1)  # the same batch again
    assert job.total == 2 and logged(spark, f"file://{tmp_path}/log") == {("a", "x"), ("b", "y")}
    job.take(spark.createDataFrame([("n", "m", 9)], df.schema), 2)
    assert job.total == 2 and json.loads(json.dumps(web.page_counts(spark, transport, ["a", "c"]))) == {"a": 5, "c": 0}
