import hashlib
import random
import re

from pyspark.sql import functions as F

from loomframe.llm import fill_in_middle as fim

TEXTS = ["", "a", "ab", "a b", "Äb Zürich 12", "😀😀x", "x" * 500, "word " * 300, "\n\r\t", "<P> a", "b <S>", "<M>", "no < P> mark <", "P>S>M>", "ſK ﬀ", "é" * 129, "ab" * 64 + "é" + "c" * 64, "\u0000a\u0000"]


def brute(i, text, percent=90, spm=20, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, hexed = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_brute_force_for_every_chunk_size(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abZ Z9é😀\n<>PSM") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a text without an id"), (7, "a text of one more row of an id"), (7, "a text of one more row of an id"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 2, 3, 7, 64, fim.CHUNK):
        made = fim.fill_in_middle(docs, chunk_bytes=size).withColumn("back", fim.restored()).collect()
        assert [tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) for r in made] == [brute(*r) for r in rows]
        assert all(r["back"] == (r["text"] or "") for r in made)
    assert {r["form"] for r in made} == {"plain", "spm", "psm"}


def test_rates_are_parameters_and_long_texts_are_whole(spark):
    docs = spark.createDataFrame([(i, "one long text, " * 200_000) for i in range(3)], "doc_id long, text string")
    made = fim.fill_in_middle(docs, percent=100, spm_percent=100, seed=9).withColumn("back", fim.restored() == F.col("text"))
    assert [(r["n"], r["form"], r["output"]) for r in made.collect()] == [brute(r["doc_id"], r["text"], 100, 100, 9)[:2] + (brute(r["doc_id"], r["text"], 100, 100, 9)[4],) for r in docs.collect()]
    assert made.where("back").count() == 3


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "x", 2, 3, 4)], "doc_id long, text string, output string, _text int, h1 int, n int")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "_text", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert (made.first()["_text"], made.first()["h1"], made.first()["n"]) == (2, 3, 3)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
