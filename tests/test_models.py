import math

import pytest
from pyspark.sql import functions as F

from loomframe.functions import checks, records, rules
from loomframe.operators import joins, models, relational, stages


def test_every_kind_has_a_fake(spark):
    assert {k for k, n in models.BACKENDS if n == "fake"} == set(models.KINDS)
    rows = spark.createDataFrame([(1, 4, 3), (2, 5, 6)], "id int, width int, height int")
    got = models.predict(rows, "embed", "fake", "id int, vector array<double>, error string").collect()
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in got) and got[0]["vector"] != got[1]["vector"]
    assert [r["mask"] for r in models.predict(rows, "mask", "fake", "id int, mask array<int>, error string").orderBy("id").collect()] == [[0, 12], [0, 30]]


def test_a_failing_service_gives_rows_with_errors(spark):
    def transport(body):
        if "bad" in body["messages"][0]["content"][0]["image_url"]["url"]:
            raise OSError("no answer")
        assert body["response_format"]["json_schema"]["schema"] == {"type": "object"}
        return {"choices": [{"message": {"content": "ok"}}]}

    models.BACKENDS["tag", "test"] = models.chat_backend(transport, "m", "what is it?", {"type": "object"})
    rows = spark.createDataFrame([("good",), ("bad",)], "url string")
    got = {r["url"]: (r["text"], r["error"]) for r in models.predict(rows, "tag", "test", "url string, text string, error string", batch=1).collect()}
    assert got == {"good": ("ok", None), "bad": (None, "OSError: no answer")}


def test_verifier_learns_and_holds_out_items(spark):
    rows = spark.range(200).select((F.col("id") / 4).cast("int").alias("item"), (F.col("id") % 2).alias("label"), F.array((F.col("id") % 2 * 2 - 1) + F.rand(3) * 0.5, F.rand(4)).alias("vector"))
    train, test = models.held_out(rows, "item")
    assert (train.count(), test.count()) == (160, 40) and {r["item"] % 5 for r in test.collect()} == {0}
    scored = models.verify(test, models.fit_verifier(train))
    assert scored.where((F.col("prob") >= 0.5).cast("int") != F.col("label")).count() == 0


def test_self_test(spark):
    models.BACKENDS["embed", "half"] = lambda: lambda rows: [{"got": [x * 1.001 for x in r["want"]] if r["id"] else [0.0, 0.0]} for r in rows]
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "id int, want array<double>")
    assert {r["id"]: r["ok"] for r in models.self_test(rows, "embed", "half", "want", "id int, want array<double>, got array<double>, error string", "got").collect()} == {0: False, 1: True}


def test_records(spark):
    texts = spark.createDataFrame([('{"a": 1, "zz": 2}',), ("{}",), ("[1]",), ("no",), (None,)], "t string")
    got = texts.select(records.rebuilt(F.col("t"), "a int, b string", {"b": F.lit("x")}).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in got] == [(1, "x"), (None, "x"), None, None, None]
    tokens = spark.createDataFrame([({"yes": -1.0, "Yes": -2.0, "no": -3.0},), ({"x": 0.0},)], "m map<string,double>")
    gaps = [r[0] for r in tokens.select(records.log_mass_gap(F.col("m"), ["yes", "Yes"], ["no", "No"])).collect()]
    assert abs(gaps[0] - (math.log(math.exp(-1) + math.exp(-2)) + 3)) < 1e-9 and gaps[1] == 0.0
    scenes = spark.createDataFrame([([("a", 2), ("b", None)],), (None,)], "i array<struct<category:string,count:int>>")
    assert [r[0] for r in scenes.select(records.expected_count(F.col("i"))).collect()] == [3, 0]


def test_stages_keep_what_was_done_and_tell_what_failed(spark, tmp_path):
    table, seen = stages.StageTable(spark, f"{tmp_path}/stages", "id", "int"), []
    df = spark.createDataFrame([(1,), (2,)], "id int")

    def save(name, rows):
        if name == "mesh":
            raise RuntimeError("no model")
        table.mark(rows, name)
        return df

    with pytest.raises(RuntimeError):
        stages.run_stages(df, table.done(), [stages.Stage("cut", lambda d: d), stages.Stage("mesh", lambda d: d)], save, key="id", partial=lambda *a: seen.append((a[0], a[1].count(), a[2])))
    assert seen == [("mesh", 2, "RuntimeError: no model")]
    assert {(r["id"], r["stage"]) for r in table.done().collect()} == {(1, "cut"), (2, "cut")}
    assert stages.pending(df, table.done(), "cut", "id").count() == 0 and stages.pending(df, table.done(), "mesh", "id").count() == 2
    config = stages.Config.of({"backends": ["scene=none", "mesh=fake"], "max_side": 512, "stages": ["scene"]})
    assert config.backends == {"scene": "none", "mesh": "fake"} and config.stages == ("scene",)
    with pytest.raises(ValueError):
        stages.Config.of({"colour": 1})


def test_checks_and_joins_at_their_edges(spark):
    one = spark.range(1)
    assert one.select(rules.needs_outer(F.lit(16.9))).first()[0] and not one.select(rules.needs_outer(F.lit(17))).first()[0]
    prompts = one.select(checks.extract_prompt(F.lit("shirt"), F.lit("inner under coat"), "dim"), checks.extract_prompt(F.lit("shirt"), F.lit("flat"), "dimfine"), checks.generic(F.lit("cape")), checks.generic(F.lit("hat")), checks.peel_prompt(F.lit("coat"))).first()
    assert "the top shown bright in image 2, which is worn under the coat" in prompts[0] and "the shirt shown bright in image 2, which lies among other things" in prompts[1]
    assert tuple(prompts)[2:] == ("outer garment", "hat", "[PEEL] coat")
    titles = spark.createDataFrame([("Category:Beds", "My bed", 0.5), ("Category:Beds", "A Painting of a bed", 0.5), ("Category:Beds", None, 0.05), ("Category:Cats", "cat", 0.9)], "seed string, title string, s double")
    assert [r[0] for r in titles.select(checks.usable_background(F.col("seed"), F.col("title"), F.col("s"))).collect()] == [True, False, False, False]
    with pytest.raises(Exception):
        one.select(rules.fit_report(F.lit("shoes"), F.struct(*(F.lit(1.0).alias(c) for c in ("shoulder", "chest", "length", "sleeve"))), F.struct(F.lit(170.0).alias("height"), F.lit(40.0).alias("shoulder_width"), F.lit(90.0).alias("chest"), F.lit(None).cast("double").alias("arm_length"), F.create_map().cast("map<string,double>").alias("landmarks")))).collect()
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "l long, g string")
    right = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1, 40)], "r long, g string")
    import hashlib

    want = {(a, b) for a, g in ((1, "a"), (2, "a"), (3, "b")) for b in sorted((i for i in range(1, 40) if ("a" if i % 3 else "b") == g), key=lambda i: (hashlib.sha1(f"{a}|{i}".encode()).hexdigest()[:8], i))[:4]}
    assert {(r["l"], r["r"]) for r in relational.top_by_pair_hash(left, right, "g", "l", "r", 4, block=3).collect()} == want
    runs = joins.compare_runs(spark.createDataFrame([(1, True), (2, True), (3, None)], "f int, ok boolean"), spark.createDataFrame([(1, False), (2, False), (4, True)], "f int, ok boolean"), "f", F.col("ok")).first()
    assert (runs["n"], runs["a_only"], runs["b_only"], runs["p"]) == (2, 2, 0, 0.5)


def test_running_sums_cross_partitions_and_null_groups(spark):
    rows = [(g, i) for g in ("a", None, "b") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(7)
    got = relational.running_sums(df, ["g"], ["i"], {"n": F.lit(1), "s": F.col("i")}).collect()
    assert all(r["n_before"] == r["i"] and r["s_before"] == sum(range(r["i"])) and r["n_all"] == 50 for r in got) and len(got) == 150


def test_heads_of_pairs_are_those_of_sha1(monkeypatch):
    """Numbers of all lengths, in rounds of a few: each pair once, with the hash that hashlib gives."""
    import hashlib

    import numpy as np

    from loomframe.functions import hashing

    monkeypatch.setattr(hashing, "_AT_ONCE", 5)
    left, right = [0, 7, -3, 12, 1234567, 2**62], [*range(8), *range(95, 105), 10**9, -(2**62)]
    got = {}
    for keys, others, heads in hashing.pair_heads(np.array(left), np.array(right)):
        got |= {(a, b): int(h) for a, row in zip(keys.tolist(), heads, strict=True) for b, h in zip(others.tolist(), row.tolist(), strict=True)}
    assert got == {(a, b): int(hashlib.sha1(f"{a}|{b}".encode()).hexdigest()[:8], 16) for a in left for b in right}


def test_a_group_of_many_pairs_is_many_tasks(spark):
    """One group of four blocks: small as their keys are, Spark does not put them together into one task."""
    rows = spark.range(40).selectExpr("1 g", "id l", "id r")
    found = relational.top_by_pair_hash(rows, rows, "g", "l", "r", 2, block=10)
    assert found.count() == 80
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "FlatMapCoGroups" not in plan
