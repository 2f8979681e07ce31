import random
import zlib

import numpy as np

from loomframe.llm import boosting
from loomframe.llm.toxicity import FEATURES, Lexicon, _Flags, features, rate


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(0)
    raw, y = rng.integers(0, 15, 80).astype(float), rng.integers(0, 2, 80).astype(float)
    got = boosting.fit_isotonic(raw, y)(np.arange(15.0))
    values = sorted(set(raw))
    mean = lambda a, b: y[(raw >= values[a]) & (raw <= values[b])].mean()
    want = [max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    assert np.allclose(got[[int(v) for v in values]], want)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    model = boosting.fit(x[:3000], y[:3000])
    assert ((model.raw(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_features():
    flags = _Flags(Lexicon(frozenset({"blarg"}), frozenset({"zorp"})))
    x = dict(zip(FEATURES, features("You BLARG! a zorpable b1arg blar9 stupid", flags), strict=True))
    assert x["words"] == x["stems"] == x["insults"] == 1 / 7 and x["near_second"] > 0 and x["mixed"] > 0
    assert features("", flags) == [0.0] * len(FEATURES)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(2):
                text[rng.randrange(len(text))] = rng.choice(["grumlat", "grumpix", "Snorvel!"])
        rows.append((i, " ".join(text), "clash", "x"))
        labels.append((i, int(toxic)))
    rows += [(9000, None, None, None), (9001, "", None, None), (None, "w1 grumlat", None, None), (9002, "w2 " * 100_000, "", ""), (1, rows[1][1], "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score string")
    frame = spark.createDataFrame([*labels, (3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    got = rate(docs, frame).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    truth = dict(labels)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.97
    assert rate(docs.limit(0), frame).collect() == []
    assert len({round(r["score"], 9) for r in rate(docs, frame.limit(0)).collect()}) == 1
