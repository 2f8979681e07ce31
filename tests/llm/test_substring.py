import random

from loomframe.llm import substring
from loomframe.llm.substring import remove_repeats


def brute(docs, window):
    seen, late = set(), {}
    for d, text in sorted(docs):
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                late.setdefault(d, set()).update(range(i, i + window))
            seen.add(w)
    out = {}
    for d, text in docs:
        words = (text or "").encode().split()
        out[d] = (b" ".join(w for i, w in enumerate(words) if i not in late.get(d, ())).decode(), len(words), len(late.get(d, ())))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}é" for i in range(200)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(8)]
    docs = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(0, 6))]
        docs.append((i, "\n ".join(" ".join(p) for p in parts)))
    docs += [(200, None), (201, ""), (202, "same " * 300), (203, "same " * 25), (204, docs[7][1]), (-5, docs[8][1]), (205, " ".join(rng.choice(words) for _ in range(30_000)))]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, spans string, doc string").repartition(5)
    want = brute(docs, 20)
    for flush in (1, 1 << 30):  # each document by itself, or a task's documents together
        monkeypatch.setattr(substring, "FLUSH_BYTES", flush)
        got = remove_repeats(frame)
        assert got.columns == ["doc_id", "text", "spans", "doc", "n_words", "n_removed"]
        assert {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in got.collect()} == want
    assert sum(n for _, _, n in want.values()) > 1000


def test_null_id_repeated_row_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, text), (None, "a b")]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 2, 0), (1, 25, 0), (1, 25, 0), (2, 25, 25)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_frequent_minimiser_changes_the_way_and_not_the_result(spark, monkeypatch):
    """One gram in every window of many texts: its windows go to many buckets, and the same words are removed."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(w for _ in range(30) for w in ("often", "seen", "words", "here", rng.choice(words), rng.choice(words)))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " and more") for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.remove_repeats(frame).collect()}
    seen = []
    monkeypatch.setattr(substring, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(substring, "SAMPLE_SHARE", 1)
    own = substring.frequent_minimisers
    monkeypatch.setattr(substring, "frequent_minimisers", lambda *a: seen.append(own(*a)) or seen[-1])
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.remove_repeats(frame).collect()} == plain
    assert len(seen[0]) > 0 and sum(n for _, n in plain.values()) > 0
    hashes = substring.word_hashes(docs[0][1].encode())[2]
    assert len(set(substring.super_kmers(hashes, 20, 4, seen[0])[2].tolist())) > len(set(substring.super_kmers(hashes, 20, 4)[2].tolist()))


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"t{i}" for i in range(30))
    frame = spark.createDataFrame([(1, text, 7, 8), (2, text, 7, 8)], "doc_id long, text string, _spans int, _doc int")
    got = substring.remove_repeats(frame)
    assert got.columns == [*frame.columns, "n_words", "n_removed"]
    assert sorted((r["doc_id"], r["_spans"], r["_doc"], r["n_removed"]) for r in got.collect()) == [(1, 7, 8, 0), (2, 7, 8, 30)]
