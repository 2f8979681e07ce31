import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm.decontam import Rows, Searcher, common_subsequence, drop_leaks, find_leaks, read_items


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 12))], [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert common_subsequence(masks, len(a), b) == table[-1][-1]


def corpus(rng):
    words = [f"w{int(5000 ** rng.random())}x" for _ in range(40_000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 55)))) for i in range(60)]
    docs, leaks = [], set()
    for i in range(400):
        body = text(rng.randint(30, 600))
        if i % 8 == 0:
            k = rng.randrange(60)
            copy = items[k][1].split()
            if i % 16 == 0:  # reworded in places
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = "other"
            at = rng.randrange(len(body))
            body[at:at] = copy
            leaks.add((i, k))
        docs.append((i, " ".join(body)))
    return docs, items, leaks


def test_planted_leaks_and_clean_documents(spark):
    docs, items, leaks = corpus(random.Random(8))
    docs += [(900, None), (901, ""), (902, "w1x " * 60_000 + items[3][1]), (None, items[4][1])]
    frame = spark.createDataFrame([(*d, "c", "c") for d in docs], "doc_id long, text string, item_id string, coverage string")
    bench = spark.createDataFrame([*items, (100, None), (101, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(frame, bench).collect()}
    assert got == leaks | {(902, 3), (None, 4)}
    kept = drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_empty_tables(spark):
    docs, items, _ = corpus(random.Random(2))
    frame, bench = spark.createDataFrame(docs[:3], "doc_id long, text string"), spark.createDataFrame(items[:2], "item_id long, text string")
    assert find_leaks(frame.limit(0), bench).collect() == []
    assert find_leaks(frame, bench.limit(0)).collect() == []
    assert drop_leaks(frame, bench.limit(0)).count() == 3


def test_verbatim_copies_among_thousands_of_items(spark):
    """Every copy is found, as a brute-force search finds it, though the items are many times the rank."""
    rng = random.Random(5)
    words = [f"w{int(20_000 ** rng.random())}x" for _ in range(80_000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 55)))) for i in range(2_500)]
    docs = []
    for i in range(300):
        body = text(rng.randint(60, 400))
        at = rng.randrange(len(body))
        body[at:at] = items[rng.randrange(2_500)][1].split()
        docs.append((i, " ".join(body)))
    docs += [(1_000 + i, " ".join(text(rng.randint(60, 400)))) for i in range(100)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    brute = {(d, k) for d, body in docs for k, item in items if f" {item} " in f" {body} "}
    assert len(brute) >= 300
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(frame, bench).collect()} == brute


def test_long_items(spark):
    """Items many windows long are found when whole, and still compared as wholes: a third of one is no leak."""
    rng = random.Random(6)
    words = [f"w{int(20_000 ** rng.random())}x" for _ in range(80_000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([60, 150, 300, 700])))) for i in range(60)]
    docs = []
    for i in range(120):
        body, item = text(rng.randint(60, 400)), items[i % 60][1].split()
        at = rng.randrange(len(body))
        body[at:at] = item if i < 90 else item[: len(item) // 3]
        docs.append((i, " ".join(body)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(frame, bench).collect()} == {(i, i % 60) for i in range(90)}


def test_terms_that_share_rows_of_the_projection():
    """With far fewer rows than terms the search still finds what it finds with a row for each, and reports nothing else."""
    rng = random.Random(7)
    docs, items, leaks = corpus(rng)
    found = []
    for projection in (1 << 16, 512):
        known = read_items(items, projection)
        df = np.zeros(len(known.known))
        for _, body in docs:
            codes = np.unique(known.numbers(body))
            df[codes[codes >= 0]] += 1
        idf = np.log((len(docs) + 1) / (df + 1)) + 1e-3
        space = np.random.default_rng(1).standard_normal((int(known.row.max()) + 1, 128)) / math.sqrt(128)
        searcher = Searcher(known, idf, space.astype(np.float32), 0.28, 0.4, 0.8, 0.6)
        found.append({(docs[t][0], known.ids[i]) for t, i, _ in searcher.search([body for _, body in docs])})
    assert found[0] == leaks and len(found[1] - leaks) == 0 and len(found[1]) >= 0.9 * len(leaks)


def test_sparse_products():
    rng = np.random.default_rng(3)
    passages = [rng.integers(0, 30, n) for n in (1, 5, 40, 0, 7)]
    idf = rng.random(30) + 0.1
    dense = np.zeros((5, 30))
    for row, p in zip(dense, passages, strict=True):
        np.add.at(row, p, idf[p])
        row /= max(1e-9, np.linalg.norm(row))
    rows, m, y, out = Rows(passages, idf, np.arange(30)), rng.random((30, 4)), rng.random((5, 4)), np.zeros((30, 4))
    assert np.allclose(rows.times(m), dense @ m, atol=1e-5)
    rows.add_transposed(y, out)
    assert np.allclose(out, dense.T @ y, atol=1e-5)


def test_ids_of_any_type_and_columns_of_any_name(spark):
    docs, items, leaks = corpus(random.Random(8))
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, _leak int").withColumn("doc_id", F.col("doc_id").cast("short"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.to_date(F.timestamp_seconds(86400 * F.col("item_id"))))
    got = find_leaks(frame, bench)
    assert [f.dataType.simpleString() for f in got.schema] == ["smallint", "date", "double"]
    assert {(r["doc_id"], r["item_id"].day) for r in got.collect()} == {(d, (datetime.date(1970, 1, 1) + datetime.timedelta(i)).day) for d, i in leaks}
    kept = drop_leaks(frame, bench)
    assert kept.columns == frame.columns and {r["_leak"] for r in kept.collect()} == {7}
    assert kept.count() == len(docs) - len({d for d, _ in leaks})


def test_the_space_is_fitted_on_every_window(spark):
    """Terms that only the middle of long documents holds are among the leading directions, as in the exact decomposition over all windows."""
    from loomframe.llm.decontam import add_windows, latent_space

    rng = np.random.default_rng(2)
    common, hidden = [f"c{i}x" for i in range(30)], [f"h{i}x" for i in range(8)]
    items = read_items([(0, " ".join(common + hidden)), *((1 + i, f"{common[i]} {common[i + 1]} {hidden[i % 8]}") for i in range(29))])
    docs = []
    for i in range(12):
        words = [str(w) for w in rng.choice(common, 24 * 41)]
        for at in range(24 * 3, 24 * 11, 24 * 2):  # far from where few passages of a document would be taken
            words[at : at + 24] = [str(w) for w in rng.choice(hidden[: 1 + i % 8], 24)]
        docs.append((i, " ".join(words)))
    idf = np.ones(len(items.known))
    idf[[items.known[h.encode()] for h in hidden]] = 3
    frame = spark.createDataFrame(docs, "_id long, _text string").repartition(5)
    space = latent_space(frame, items, idf, rank=6, item_weight=0.01)
    assert np.array_equal(space, latent_space(frame, items, idf, rank=6, item_weight=0.01))
    dense, windows = np.zeros((len(idf), len(idf))), 0
    for _, text in docs:
        codes = items.numbers(text)
        for s in range(0, len(codes) - 24, 24):
            v = idf * np.bincount(codes[s : s + 48], minlength=len(idf))
            dense += np.outer(v, v) / (v @ v)
            windows += 1
    vectors = idf[:, None] * np.eye(len(idf))
    total = np.zeros_like(dense)
    assert add_windows([items.numbers(t) for _, t in docs] + [np.zeros(0, np.int64)], idf, items.row, vectors.astype(np.float32), total) == windows
    assert np.allclose(total, dense, atol=1e-3)
    best = np.linalg.eigvalsh(dense)[::-1][:6].sum()
    leading = np.linalg.qr(space[:, :6])[0]
    assert np.trace(leading.T @ dense @ leading) > 0.97 * best


def test_recall_against_brute_force(spark):
    """What the space proposes leads to all that checking each item at each window finds, reworded copies included, up to a tenth."""
    docs, items, leaks = corpus(random.Random(11))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found, brute = ({(r["doc_id"], r["item_id"]) for r in find_leaks(frame, bench, **p).collect()} for p in ({}, {"cosine": -1e9, "share": -1e9}))
    assert leaks <= brute and found <= brute and len(found) >= 0.9 * len(brute)
