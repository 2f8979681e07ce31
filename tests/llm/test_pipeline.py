import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{int(5000 ** rng.random())}x" for _ in range(20_000)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    texts = {i: prose(rng.randint(4, 20)) for i in range(300)}
    texts[300] = texts[10]  # a copy: all its lines go, and then it
    near = texts[11].split()
    near[5] = "changed"
    texts[301] = " ".join(near)  # a near copy in one line
    texts[302] = texts[12] + "\n" + items[4][1]  # its first lines go as copies; what is left is a leak
    texts[303] = prose(6) + "\n" + items[5][1]
    texts[304] = prose(8).replace(" ", "*** ")
    texts[305] = "too short"
    texts[306], texts[307] = None, ""
    rows = [(i, t, "en" if i % 3 else "de", "src0" if i % 2 else f"s{i % 9}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, gone = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
        gone[name] = before - {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert gone == {
        "quality_rules": {304, 305, 306, 307},
        "line_dedup": {300},
        "ngram_jaccard_join": {301},
        "benchmark_decontamination": {302, 303},
        "byte_level_bpe": set(),
    }
    assert docs.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{int(3000 ** rng.random())}x" for _ in range(10_000)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    texts = {i: prose(rng.randint(5, 15)) for i in range(60)}
    long = prose(4_000)
    rows = [(i, t, "en", "src0") for i, t in texts.items()] + [(1, texts[1], "en", "src0"), (None, texts[2], None, None), (None, None, None, None), (70, "", None, "x"), (71, long, "de", None)]
    names = ["_id", "_row", "_gone", "_lines", "n_lines", "n_dropped", "_hash", "_leak", "_text", "failed", "kept", "lines_before"]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    spark.createDataFrame([(0, " ".join(texts[5].split()[3:40])), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        assert docs.where(" or ".join(f"{n} <> {k}" for k, n in enumerate(names))).count() == 0
    got = docs.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [*(i for i in range(60) if i not in (2, 5)), 71]
    assert [r["text"] for r in got if r["doc_id"] is None] == [texts[2]]  # a null id comes first
    assert next(r["n_chars"] for r in got if r["doc_id"] == 71) == len(long)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(got)
