import random

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import ngram_join
from loomframe.llm.ngram_join import keep_one_of_each, near_classes, posterior


def brute(docs):
    sets = {}
    for i, text in docs:
        words = (text or "").split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids = [i for i, _ in docs]
    links, label = dict.fromkeys(ids, 0), {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = label[a], label[b]
                for k in ids:
                    if label[k] in (x, y):
                        label[k] = min(x, y)
    return {i: (label[i], links[i]) for i in ids}


def corpus(rng):
    words = [f"w{i}" for i in range(300)]
    docs, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((i, " ".join(text)))
            i += 1
    return [*docs, (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one  two"), (1005, "w " * 40_000)]


def test_against_brute_force_in_one_block_and_many(spark, monkeypatch):
    docs = corpus(random.Random(6))
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id long, text string, id string, node string, label string").repartition(4)
    want = brute(docs)
    for block, crowd in ((512, 256), (7, 256), (7, 3)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "CROWD", crowd)
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_classes(frame).collect()} == want
    kept = keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _ in want.values()}


def test_dense_product_equals_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 120).astype(np.uint64)) for _ in range(30)]
    got = ngram_join._products(sets[:12], sets[12:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[12 + j])) for i in range(12) for j in range(18))


def test_posterior_falls_with_fewer_matches():
    assert posterior(9, 9, 0.8) > 0.85 > posterior(7, 9, 0.8) > posterior(2, 9, 0.8) > 1e-6 > posterior(0, 9, 0.8)


def test_null_id_repeated_row_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(None, text), (1, text), (1, text), (2, "alone here"), (None, None)]
    got = sorted(((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(-1, -1, 0), (-1, -1, 2), (1, -1, 2), (1, -1, 2), (2, 2, 0)]
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"t{i}" for i in range(25))
    near = text.replace("t24", "other")
    rows = [(None, text, 1), (None, near, 2), (1, text, 3), (1, text, 3), (2, near, 4), (3, "alone here", 5), (3, "alone here", 5), (3, "else", 6), (4, None, 7), (5, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").withColumns({"_hash": F.lit(1), "hash": F.lit(2)})
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([x for x in got if x[0] is None]) == 1  # copies under a null id are copies too
    assert sorted((i, t or "") for i, t in got if i is not None) == [(3, "alone here"), (3, "else"), (4, ""), (5, "")]
    assert keep_one_of_each(docs.limit(0)).collect() == []


def test_a_key_ties_only_what_may_be_near():
    """Two groups of near copies and a stranger under one key: two trees, and the stranger alone."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, (3, ngram_join.HASHES), dtype=np.uint32)
    sigs = np.concatenate([np.repeat(base[:1], 4, 0), np.repeat(base[1:2], 3, 0), base[2:]])
    sigs[1, :5] = 0
    a, b = ngram_join.key_trees(np.array([7] * 8), np.arange(10, 18), sigs, 0.8, 1e-6)
    assert sorted(zip(a.tolist(), b.tolist())) == [(10, 11), (10, 12), (10, 13), (14, 15), (14, 16)]
    a, b = ngram_join.key_trees(np.array([1, 1, 2, 3]), np.arange(4), np.repeat(base[:1], 4, 0), 0.8, 1e-6)
    assert (a.tolist(), b.tolist()) == ([0], [1])
