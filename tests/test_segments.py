"""Merging of candidates against whole numpy masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import runs, segments
from loomframe.operators.masks import containment, iou

H, W = 20, 26


def brute(cands, single, min_area=segments.MIN_AREA, max_items=segments.MAX_ITEMS):
    kept = sorted((c for c in cands if c["mask"].sum() and c["mask"].sum() >= min_area * H * W), key=lambda c: (-int(c["mask"].sum()), c["cand"]))
    items = []
    for c in kept:
        new = {"category": c["category"], "score": c["score"], "mask": c["mask"].copy(), "members": [c["cand"]]}
        for m in items:
            if iou(new["mask"], m["mask"]) >= 0.55 or containment(new["mask"], m["mask"]) >= 0.80:
                m.update(mask=m["mask"] | new["mask"], score=max(m["score"], new["score"]), members=m["members"] + new["members"])
                if m["category"] == segments.UNKNOWN:
                    m["category"] = new["category"]
                break
        else:
            items.append(new)

    def gather(items, same, better):
        out = []
        for x in items:
            home = next((y for y in out if same(x, y)), None)
            if home is None:
                out.append(x)
            else:
                home.update(mask=home["mask"] | x["mask"], members=home["members"] + x["members"], score=max(home["score"], x["score"]) if better else home["score"])
        return out

    items = gather(items, lambda x, y: x["category"] == y["category"] and x["category"] in segments.PAIRED, False)
    if single and len(items) > 1:
        known = gather([x for x in items if x["category"] != segments.UNKNOWN], lambda x, y: x["category"] == y["category"], True)
        for x in items:
            if x["category"] == segments.UNKNOWN:
                if known:
                    best = max(known, key=lambda y: y["mask"].sum())
                    best.update(mask=best["mask"] | x["mask"], members=best["members"] + x["members"], score=max(best["score"], x["score"]))
                else:
                    known.append(x)
        items = known
    items.sort(key=lambda x: -x["mask"].sum())
    return [(x["category"], x["score"], len(x["members"]), int(x["mask"].sum()), x["members"], len(kept) - len(items)) for x in items[:max_items]], [x["mask"] for x in items[:max_items]]


@pytest.fixture(scope="module")
def photos():
    rng = np.random.default_rng(3)
    out = {}
    for p in range(40):
        cands = []
        for k in range(int(rng.integers(0, 20))):
            mask = np.zeros((H, W), bool)
            y, x, h, w = rng.integers(0, 14), rng.integers(0, 18), rng.integers(1, 9), rng.integers(0, 10)
            mask[y : y + h, x : x + w] = True
            if k % 3 == 0:
                mask &= rng.random((H, W)) < 0.8
            cands.append({"cand": k, "category": ["상의", "신발", segments.UNKNOWN, "하의"][int(rng.integers(0, 4))], "score": float(rng.integers(0, 100)) / 100, "mask": mask})
        if cands:
            cands.append({**cands[-1], "cand": 99})  # a repeated mask: a tie
        out[f"p{p}"] = cands
    return out


def frames(spark, photos):
    cands = spark.createDataFrame([(p, c["cand"], c["category"], c["score"]) for p, cs in photos.items() for c in cs], "photo string, cand int, category string, score double")
    pixels = spark.createDataFrame([(p, c["cand"], int(y), int(x)) for p, cs in photos.items() for c in cs for y, x in zip(*np.nonzero(c["mask"]), strict=True)], "photo string, cand int, y int, x int")
    size = spark.createDataFrame([(p, H, W) for p in photos], "photo string, lines int, length int")
    return cands, runs.runs_of(pixels, F.lit(True), ["photo", "cand"]), size


def test_against_whole_masks(spark, photos):
    cands, masks, size = frames(spark, photos)
    for limit in (segments.MAX_ITEMS, 2):
        found = segments.merged(cands, masks, size, F.substring("photo", -1, 1) == "3", max_items=limit)
        got, cells = {}, {}
        for r in found.orderBy("photo", "item").collect():
            got.setdefault(r["photo"], []).append((r["category"], r["score"], r["parts"], r["area"], r["members"], r["merged"]))
        for r in runs.pixels_of(segments.item_runs(found)).collect():
            cells.setdefault((r["photo"], r["item"]), []).append((r["y"], r["x"]))
        for p, cs in photos.items():
            want, shapes = brute(cs, p[-1] == "3", max_items=limit)
            assert got.get(p, []) == want, p
            for k, m in enumerate(shapes, 1):
                assert sorted(cells[p, k]) == sorted((int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True))


def test_empty_null_category_and_nothing_left(spark, photos):
    cands, masks, size = frames(spark, photos)
    assert segments.merged(cands.limit(0), masks, size).collect() == []
    assert segments.merged(cands, masks, size, min_area=1.1).collect() == []
    nameless = segments.merged(cands.withColumn("category", F.lit(None).cast("string")), masks, size, F.lit(True))
    assert {r["category"] for r in nameless.collect()} == {segments.UNKNOWN} and nameless.groupBy("photo").count().agg(F.max("count")).first()[0] == 1


def test_intervals_meet_as_sets_do():
    rng = np.random.default_rng(0)
    for _ in range(300):
        sets = [set(rng.integers(0, 40, rng.integers(0, 30)).tolist()) for _ in range(2)]
        spans = []
        for s in sets:
            flat = np.zeros(42, bool)
            flat[list(s)] = True
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flat.astype(int)))))
            spans.append((edges[::2], edges[1::2]))
        assert segments.shared(*spans) == len(sets[0] & sets[1])
        both = segments.union(*spans)
        assert segments.length(both) == len(sets[0] | sets[1]) and (both[0][1:] > both[1][:-1]).all()


def test_photos_over_several_batches_and_null_scores(spark, photos):
    """A photo goes on in the next batch, in step with others; a candidate without a score takes part and leaves the others' score."""
    cands, masks, size = frames(spark, photos)
    some = cands.withColumn("score", F.when(F.col("cand") % 2 == 0, F.col("score")))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, found = spark.conf.get(key), {}
    try:
        for n in (old, "3"):
            spark.conf.set(key, n)
            found[n] = {(r["photo"], r["item"]): (r["category"], r["score"], r["parts"], r["area"], r["members"], r["merged"], r["starts"], r["ends"]) for r in segments.merged(some, masks, size, F.substring("photo", -1, 1) == "3").collect()}
    finally:
        spark.conf.set(key, old)
    assert found[old] == found["3"]
    first = {p: {c["cand"]: c["score"] if c["cand"] % 2 == 0 else None for c in cs} for p, cs in photos.items()}
    plain = [(p, v) for (p, _), v in found[old].items() if v[0] not in segments.PAIRED]  # a pair keeps the score of its first piece
    assert all(v[1] == max((first[p][m] for m in v[4] if first[p][m] is not None), default=None) for p, v in plain) and any(v[1] is None for _, v in plain)
