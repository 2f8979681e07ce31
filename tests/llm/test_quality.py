import math
import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from loomframe.llm.quality import COUNTS, MEASURES, _keys, assess, at_most, beyond_chance, judge, keep_good, limits, measure, measure_text

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "bé ", "\n", "c\t", "#x ", " \n", "ü v ", "a b a b a b\n"]) for _ in range(rng.randint(0, 60)))
        assert measure_text(text)[:5] == brute(text)
    assert measure_text("")[:5] == (0, 0, 0, 0, 0)


def clean(rng):
    words = ["stone", "river", "of", "the", "a", "walking", "under", "Light", "cold", "and", "be"]
    return "\n".join(" ".join(rng.choice(words) + rng.choice(["", "", "x", "ed"]) for _ in range(30)) + "." for _ in range(4))


def test_junk_goes_and_clean_stays_in_hot_and_small_groups(spark):
    rng = random.Random(4)
    rows, bad = [], set()
    for i in range(900):
        lang, source = ("en", "hot") if i % 3 else (rng.choice(["de", "en"]), f"s{i % 40}")
        text = clean(rng)
        if i % 4 == 0:
            bad.add(i)
            text = [re.sub(" ", "*** ", text), text.upper().replace(" ", "!! "), text.replace(" ", " | ")][i // 4 % 3]
        rows.append((i, text, lang, source, "clash"))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in assess(docs).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == bad
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(900)) - bad


def test_nulls_repeats_long_and_empty(spark):
    rng = random.Random(5)
    good = clean(rng)
    rows = [(1, good, None, None, None), (1, good, None, None, None), (None, good, "en", None, None), (2, None, "en", "s", None), (3, "", None, "s", None), (4, " ".join(clean(rng) for _ in range(2000)), "en", "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["n_words"] > 0, r["base_failed"]) for r in assess(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, True, False), (1, True, False), (None, True, False), (2, False, True), (3, False, True), (4, True, False)]))
    assert keep_good(docs).count() == 4
    assert assess(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).collect() == []


def mixed(rng):
    """Groups that differ in every measure, junk in some of them; ids of the junk."""
    rows, bad = [], set()
    for i in range(1200):
        g = i % 6
        text = clean(rng) if g < 3 else " ".join(clean(rng) for _ in range(3))
        if g == 1:  # titles are usual here
            text = " ".join(w.capitalize() if rng.random() < 0.5 else w for w in text.split(" "))
        if g == 2:  # and symbols here
            text = " ".join(w + "#" if rng.random() < 0.1 else w for w in text.split(" "))
        if g == 4:
            text = text.replace("walking", "walkingunderneath").replace(" of ", " whereof ")
        if i % 20 == 7:
            bad.add(i)
            text = [re.sub(" ", "*** ", text), text.upper(), text.replace(" ", "! ")][i // 20 % 3]
        rows.append((i, text, "en" if g % 2 else "de", f"s{g}", "clash"))
    return rows, bad


def test_decisions_against_brute_force_with_exact_quantiles(spark):
    """Sketches wide enough to be exact; every step again in numpy."""
    rng = random.Random(7)
    rows, bad = mixed(rng)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in assess(docs, k=4096).collect()}
    counts = {r[0]: dict(zip(COUNTS, measure_text(r[1]), strict=True)) for r in rows}
    passing = [r for r in rows if not got[r[0]]["base_failed"]]
    ratio = lambda i, m: counts[i][m.over] / counts[i][m.under] if counts[i][m.under] else 0.0

    def read(ids, m):
        v, u = sorted(ratio(i, m) for i in ids), sorted(counts[i][m.under] for i in ids)
        at = lambda x, q: x[max(0, math.ceil(q * len(x)) - 1)]
        return np.array([at(v, 0.1), at(v, 0.5), at(v, 0.9), sum(x == 0 for x in v) / len(v), at(u, 0.5)])

    draw = lambda n, own, parent: (n * own + 100 * parent) / (n + 100)
    failed: dict[int, list] = {r[0]: [] for r in rows}
    for m in MEASURES:
        whole = read([r[0] for r in passing], m)
        for lang in ("en", "de"):
            of_lang = [r[0] for r in passing if r[2] == lang]
            by_lang = draw(len(of_lang), read(of_lang, m), whole)
            for source in {r[3] for r in passing if r[2] == lang}:
                ids = [r[0] for r in passing if (r[2], r[3]) == (lang, source)]
                below, median, above, zeros, length = draw(len(ids), read(ids, m), by_lang)
                size, some = len(ids) + 100, 1 - zeros
                upper = (some + 25 / (2 * size) + 5 * math.sqrt(some * (1 - some) / size + 25 / (4 * size * size))) / (1 + 25 / size)
                for i in ids:
                    x, n = ratio(i, m), counts[i][m.under]
                    if m.both_sides:
                        wide = 6 * max(min(median - below, above - median), median / (2 * math.sqrt(max(length, 1)))) + 5 * x / (2 * math.sqrt(n))
                        fails = x < median - wide or x > median + wide
                    else:
                        high = median + 6 * (max(median - below, math.sqrt(median / max(length, 1))) - math.log(max(1 - upper, 0.5)) / max(length, 1))
                        c, mean = counts[i][m.over], high * n
                        fails = c > mean and c * math.log(c / mean) - c + mean > 12.5 + math.log(size)
                    if fails:
                        failed[i].append(m.name)
    assert {i: got[i]["failed"] for i in got if not got[i]["base_failed"]} == {r[0]: failed[r[0]] for r in passing}
    caught = {i for i, r in got.items() if not r["kept"]}
    assert caught == bad


def test_limits_differ_by_group(spark):
    rows, _ = mixed(random.Random(8))
    measured = measure(spark.createDataFrame(rows, SCHEMA), _keys(spark.createDataFrame(rows, SCHEMA), "doc_id"))
    found = limits(measured.where("n_words >= 10"), 6.0, 0.1, 200, 100.0).collect()
    assert len(found) == 6
    for name in ("symbols", "capitals", "word_length"):
        assert len({round(r["limits"][f"high_{name}"], 6) for r in found}) == 6


def test_the_same_text_passes_in_one_group_and_fails_in_another(spark):
    """What decides is the group: for each measure a text with that many is usual in one group, and beyond all chance in the other."""
    rng = random.Random(3)
    few = {
        "symbols": lambda t: t.replace(" ", " # ", 18),
        "capitals": lambda t: t.upper()[:220] + t[220:],
        "bangs": lambda t: t.replace(" ", "! ", 18),
        "dup_lines": lambda t: "\n".join([*t.split("\n"), *[t.split("\n")[0]] * 40]),
        "word_length": lambda t: " ".join(w + "underneath" if rng.random() < 0.9 else w for w in t.split(" ")),
    }
    for name, make in few.items():
        probe = make(clean(rng))
        rows = [(i, make(clean(rng)) if g == "usual" else clean(rng), "en", g, "") for g, low in (("usual", 0), ("never", 10_000)) for i in range(low, low + 1500)]
        rows += [(50_000, probe, "en", "usual", ""), (50_001, probe, "en", "never", "")]
        measured = measure(spark.createDataFrame(rows, SCHEMA), _keys(spark.createDataFrame(rows, SCHEMA), "doc_id")).withColumns({"n_repeat_words": F.lit(0)})
        got = {r["_id"]: r["failed"] for r in judge(measured, prior=1.0).where("_id >= 50000").collect()}
        assert name not in got[50_000] and name in got[50_001], name


def test_chance_by_size_of_group(spark):
    """How many of a thing that no text of a group has are allowed falls with the group's size, and no number is added."""
    row = spark.range(1)
    allowed = []
    for n in (200, 20_000, 2_000_000):
        mean = -F.log(1 - at_most(F.lit(0.0), F.lit(float(n)), 5.0)) * 6
        allowed.append(next(c for c in range(1, 60) if row.select(beyond_chance(F.lit(float(c)), mean, F.lit(float(n)), 5.0)).first()[0]))
    assert allowed[0] > allowed[1] > allowed[2] and allowed[2] <= 4


def test_heavy_limits_are_merged_and_decide_alike(spark, monkeypatch):
    """Limits too heavy to broadcast: with a hot group among small ones the same documents go."""
    from loomframe.llm import common

    rng = random.Random(4)
    rows = []
    for i in range(600):
        lang, source = ("en", "hot") if i % 3 else (rng.choice(["de", "en"]), f"s{i % 40}")
        rows.append((i, re.sub(" ", "*** ", clean(rng)) if i % 4 == 0 else clean(rng), lang, source, "clash"))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = assess(spark.createDataFrame(rows, SCHEMA))
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    assert len(found) == 600 and {r["doc_id"] for r in found if not r["kept"]} == set(range(0, 600, 4))
