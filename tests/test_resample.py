"""Resampling, smoothing and flat-lay scenes against plain loops over whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import flatlay, masks, palette, pixels, resample, runs


def frame(spark, named, columns, kind="double"):
    rows = [(n, y, x, *(a[y, x].tolist())) for n, a in named.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, " + ", ".join(f"{c} {kind}" for c in columns)).repartition(3)


def arrays(df, columns, key="image"):
    found = {}
    for r in df.collect():
        found.setdefault(r[key], []).append((r["y"], r["x"], [float(r[c]) for c in columns]))
    out = {}
    for n, rows in found.items():
        a = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1, len(columns)), np.nan)
        for y, x, v in rows:
            assert np.isnan(a[y, x]).all()  # each pixel once
            a[y, x] = v
        assert not np.isnan(a).any()
        out[n] = a
    return out


def lanczos(d):
    return 1.0 if abs(d) < 1e-9 else 4 * math.sin(math.pi * d) * math.sin(math.pi * d / 4) / (math.pi * d) ** 2 if abs(d) < 4 else 0.0


def line(v, m, how):
    """A row of values brought to m values."""
    n, out = len(v), []
    for t in range(m):
        src, total, acc = (t + 0.5) * n / m - 0.5, 0.0, 0.0
        if how == "area":
            pairs = [(s, min((s + 1) * m, (t + 1) * n) - max(s * m, t * n)) for s in range(n)]
            pairs = [(s, w) for s, w in pairs if w > 0]
        elif how == "nearest":
            pairs = [(t * n // m, 1)]
        elif how == "linear":
            i = math.floor(src)
            pairs = [(min(max(i + k, 0), n - 1), (src - i) if k else 1 - (src - i)) for k in (0, 1)]
        else:
            i = math.floor(src)
            pairs = [(min(max(i + k, 0), n - 1), lanczos(src - (i + k))) for k in range(-3, 5)]
        for s, w in pairs:
            total, acc = total + w, acc + w * v[s]
        out.append(acc / total)
    return np.array(out)


def plain_resize(a, h, w, how):
    wide = np.stack([np.apply_along_axis(line, 0, row, w, how) for row in a])
    return np.stack([np.apply_along_axis(line, 0, wide[:, x], h, how) for x in range(w)], axis=1)


@pytest.mark.parametrize("how", ["area", "linear", "lanczos", "nearest"])
def test_resizing_equals_a_plain_loop(spark, how):
    rng = np.random.default_rng(6)
    named = {f"i{k}": rng.integers(0, 256, (*rng.integers(1, 14, 2), 3)).astype(float) for k in range(6)}
    to = {n: tuple(int(v) for v in rng.integers(1, 20, 2)) for n in named}
    size = spark.createDataFrame([(n, *a.shape[:2], *to[n]) for n, a in named.items()], "image string, lines int, length int, new_lines int, new_length int")
    got = arrays(resample.resized(frame(spark, named, "rgb"), size, how=how), "rgb")
    for n, a in named.items():
        assert got[n].shape[:2] == to[n]
        assert np.allclose(got[n], plain_resize(a, *to[n], how), atol=1e-9), n


def test_sizes_for_models_and_views(spark):
    rng = np.random.default_rng(1)
    named = {"wide": rng.integers(0, 256, (20, 50, 3)), "small": rng.integers(0, 256, (9, 7, 3))}
    rows = frame(spark, named, "rgb", "int").withColumn("m", F.col("x") > 3)
    shapes = lambda df: {n: a.shape[:2] for n, a in arrays(df, "rgb").items()}
    assert shapes(resample.shrunk(rows, 25)) == {"wide": (10, 25), "small": (9, 7)}
    assert shapes(resample.fitted(rows, 32, 8)) == {"wide": (8, 32), "small": (32, 24)}
    made = resample.prepared(rows, ["m"], side=40, step=4)
    assert shapes(made) == {"wide": (16, 40), "small": (8, 4)}
    assert made.where("image = 'wide' AND m").agg(F.min("x")).first()[0] == 4  # 5 * 0.8 begins in 4 * 50 // 40 = 5
    assert resample.shrunk(rows.limit(0), 25).collect() == []


def test_normalised_product(spark):
    rng = np.random.default_rng(2)
    for h, w, side in ((30, 20, 25), (8, 11, 25)):
        img = rng.integers(0, 256, (h, w, 3)).astype(float)
        alpha = np.zeros((h, w))
        alpha[2 : h - 1, 3 : w - 2] = rng.random((h - 3, w - 5)) * 0.4 + 0.6
        rows = frame(spark, {"a": np.dstack([img, alpha])}, ["r", "g", "b", "alpha"])
        got = arrays(resample.normalised(rows, side=side), ["r", "g", "b", "alpha"])["a"]
        ch, cw = h - 3, w - 5
        scale = side * resample.FILL / max(ch, cw)
        nh, nw = round(ch * scale), round(cw * scale)
        crop = plain_resize(img[2 : h - 1, 3 : w - 2], nh, nw, "lanczos" if scale > 1 else "area")
        a = plain_resize(alpha[2 : h - 1, 3 : w - 2, None], nh, nw, "linear")
        want = np.dstack([np.full((side, side, 3), 255.0), np.zeros((side, side, 1))])
        oy, ox = (side - nh) // 2, (side - nw) // 2
        want[oy : oy + nh, ox : ox + nw] = np.dstack([a * np.clip(crop, 0, 255) + (1 - a) * 255, a])
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-9)
    assert resample.normalised(rows.withColumn("alpha", F.lit(0.0)), side=9).collect() == []


def smooth(a, sigma):
    w = resample.gaussian(sigma)
    r = len(w) - 1
    kernel = np.array([*w[:0:-1], *w])
    for axis in (1, 0):
        padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="reflect")
        a = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, padded)
    return a


def test_gaussian_and_feather(spark):
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (25, 31, 3)).astype(float)
    mask = np.zeros((25, 31), bool)
    mask[5:20, 0:17] = True
    rows = frame(spark, {"a": np.dstack([img, mask])}, ["r", "g", "b", "m"])
    assert np.allclose(arrays(resample.blurred(rows, ["r", "g", "b"], 1.5), "rgb")["a"], smooth(img, 1.5), atol=1e-9)
    soft = resample.feathered(rows.withColumns({"mask": F.col("m") > 0, "r2": 255 - F.col("r"), "g2": F.col("g"), "b2": F.lit(7.0)}), "mask", 4)
    alpha = np.clip(smooth(mask.astype(float), 2.0), 0, 1)
    assert np.allclose(arrays(soft, ["alpha"])["a"][..., 0], alpha, atol=1e-12)
    over = arrays(pixels.composite(soft, ("r2", "g2", "b2"), "alpha"), "rgb")["a"]
    gen = np.dstack([255 - img[..., 0], img[..., 1], np.full((25, 31), 7.0)])
    assert np.abs(over - (img * (1 - alpha[..., None]) + gen * alpha[..., None])).max() <= 0.5 + 1e-9


def test_boxes_are_running_sums_and_near_a_gaussian(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((40, 50, 1))
    got = arrays(resample.box_blurred(frame(spark, {"a": a}, ["v"]), ["v"], 4.0), ["v"])["a"]
    want = a.copy()
    for axis in (1, 0):
        for r in resample.box_radii(4.0):
            n = want.shape[axis]
            want = np.stack([want.take(range(max(0, i - r), min(n, i + r + 1)), axis).mean(axis) for i in range(n)], axis)
    assert np.allclose(got, want, atol=1e-9)
    inner = np.s_[14:-14, 14:-14]
    assert np.abs(got[inner] - smooth(a, 4.0)[inner]).max() < 0.03 and sum(2 * r + 1 for r in resample.box_radii(123.0)) > 700


def test_change_map(spark):
    rng = np.random.default_rng(5)
    a = np.full((48, 60, 3), 120.0) + rng.normal(0, 2, (48, 60, 3))
    b = a + rng.normal(0, 2, a.shape)
    b[10:30, 12:34] = (200, 40, 40)
    b[15:20, 20:22] = a[15:20, 20:22]
    b[40, 50] = (255, 0, 0)  # a speck
    rows = frame(spark, {"a": np.dstack([a, b])}, ["r", "g", "b", "r2", "g2", "b2"])
    got = np.zeros((48, 60), bool)
    for r in resample.changed(rows).collect():
        got[r["line"], r["a"] : r["b"]] = True
    m = palette.delta_e(smooth(palette.to_lab(a), 1.5), smooth(palette.to_lab(b), 1.5)) > 14

    def grow(mask, value=True):
        out = np.zeros_like(mask)
        for y, x in zip(*np.nonzero(mask), strict=True):
            for d, r in runs.disc(3):
                if 0 <= y + d < 48:
                    out[y + d, max(0, x - r) : x + r + 1] = True
        return out

    wear = lambda mask: mask & ~grow(~mask)
    m = grow(wear(m))
    m = wear(wear(grow(grow(m))))
    ids, n = masks.label(m)
    want = np.isin(ids, [i for i in range(1, n + 1) if (ids == i).sum() >= 0.002 * m.size])
    assert np.array_equal(got, want) and want[15:25, 15:30].all() and not want[40, 50]


def test_gather_between_pixels(spark):
    rng = np.random.default_rng(7)
    img = rng.integers(0, 256, (9, 12, 1)).astype(float)
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-3, 14, 200), rng.uniform(-3, 11, 200), strict=True))] + [(900, 3.0, 4.0), (901, -0.5, 0.0), (902, 11.0, 8.0), (903, -7.0, 2.0)]
    wanted = spark.createDataFrame([("a", *r) for r in at], "image string, k int, sx double, sy double")
    got = {r["k"]: r["v"] for r in resample.gathered(frame(spark, {"a": img}, ["v"]), wanted, {"v": 255.0}).collect()}
    value = lambda y, x: img[y, x, 0] if 0 <= y < 9 and 0 <= x < 12 else 255.0
    for k, x, y in at:
        i, j = math.floor(x), math.floor(y)
        u, v = x - i, y - j
        want = (1 - v) * ((1 - u) * value(j, i) + u * value(j, i + 1)) + v * ((1 - u) * value(j + 1, i) + u * value(j + 1, i + 1))
        assert got[k] == pytest.approx(want), (x, y)


def coordinates(h, w):
    ys, xs = np.mgrid[:h, :w]
    return np.dstack([xs * 4.0, ys * 4.0, np.zeros((h, w)), np.ones((h, w))])


def test_bending_moves_pixels_as_said_and_can_be_undone(spark):
    h, w = 40, 60
    rows = frame(spark, {"a": coordinates(h, w), "b": coordinates(h, w)}, ["r", "g", "b", "alpha"])
    places = flatlay.displaced(rows, 3, 60).cache()
    moved = arrays(places, ["sx", "sy"])
    for n in "ab":
        ys, xs = np.mgrid[:h, :w]
        dx, dy = moved[n][..., 0] - xs, moved[n][..., 1] - ys
        assert max(np.abs(dx).max(), np.abs(dy).max()) == pytest.approx(0.025 * 60)
        assert np.abs(np.diff(dx, axis=1)).max() < 0.5 and np.abs(np.diff(dy, axis=0)).max() < 0.5  # neighbours move alike
    assert not np.allclose(moved["a"], moved["b"]) and np.allclose(arrays(flatlay.displaced(rows, 3, 60), ["sx", "sy"])["a"], moved["a"])
    bent = arrays(flatlay.warped(rows, places), ["r", "g", "alpha"])["a"]
    inner = np.s_[3:-3, 3:-3]  # the colours are the places that they come from
    assert np.allclose(bent[inner][..., 0] / 4, moved["a"][inner][..., 0], atol=1e-6) and np.allclose(bent[inner][..., 1] / 4, moved["a"][inner][..., 1], atol=1e-6)
    ys, xs = np.mgrid[:h, :w]
    back = frame(spark, {"a": np.dstack([2 * xs - moved["a"][..., 0], 2 * ys - moved["a"][..., 1]])}, ["sx", "sy"])
    undone = arrays(resample.gathered(frame(spark, {"a": bent}, ["r", "g", "alpha"]), back, {"r": 255.0, "g": 255.0}), ["r", "g"])["a"]
    assert np.abs(undone[6:-6, 6:-6] / 4 - np.dstack([xs, ys])[6:-6, 6:-6]).max() < 1  # within a pixel


def test_placing_composing_and_what_shows(spark):
    side = 48
    img = coordinates(20, 12)
    img[..., 3] = 0
    img[2:18, 2:10, 3] = 1
    products = frame(spark, {"p": img, "q": img[:, ::-1]}, ["r", "g", "b", "alpha"])
    where = spark.createDataFrame(
        [(1, 0, "p", 15.0, 0.0, 20.0, 24.0, 1.0, 0.0, 1.0, 0.3), (1, 1, "q", 30.0, 90.0, 26.0, 24.0, 0.9, 0.1, 2.0, 0.2), (2, 0, "q", 15.0, 180.0, 2.0, 2.0, 1.0, 0.0, 1.0, 0.3)],
        "scene int, ord int, item string, extent double, turn double, tx double, ty double, gain double, tint double, step double, depth double",
    )
    layers = flatlay.placed(products, where, side).cache()
    full = {}
    for r in layers.collect():
        full[r["scene"], r["ord"], r["y"], r["x"]] = (r["r"], r["g"], r["alpha"])
    for y in range(side):
        for x in range(side):
            u, v = x - 20.0 + 5.5, y - 24.0 + 9.5  # scale 1, no turn
            want = 1.0 if 2 <= u <= 9 and 2 <= v <= 17 else 0.0
            if u == int(u) and v == int(v):
                assert full.get((1, 0, y, x), (0, 0, 0))[2] == want
            a, b = (y - 24.0) / -2.0, (x - 26.0) / 2.0  # twice as large, a quarter turn: right becomes up
            sx, sy = a + 5.5, b + 9.5
            if 3 <= sx <= 8 and 3 <= sy <= 16:
                assert full[1, 1, y, x][0] == pytest.approx((11 - sx) * 4) and full[1, 1, y, x][1] == pytest.approx(sy * 4)
    ground = spark.sql(f"SELECT CAST(s.id AS INT) AS scene, CAST(y.id AS INT) AS y, CAST(x.id AS INT) AS x, 200 AS r, CAST(x.id * 2 AS INT) AS g, 90 AS b FROM range(1, 3) s, range({side}) y, range({side}) x")
    made = {k: v for k, v in arrays(flatlay.composed(ground, layers, where, side), ["r", "g", "b", "label"], "scene").items()}
    alpha, color = np.zeros((3, 2, side, side)), np.zeros((3, 2, side, side, 2))
    for (s, o, y, x), (r, g, a) in full.items():
        alpha[s, o, y, x], color[s, o, y, x] = a, (r, g)
    for s, orders in ((1, (0, 1)), (2, (0,))):
        canvas = np.dstack([np.full((side, side), 200.0), np.tile(np.arange(side) * 2.0, (side, 1))])
        mean, label = canvas.reshape(-1, 2).mean(0) / 255 - 0.5, np.zeros((side, side))
        for o in orders:
            step, depth, gain, tint = ((1.0, 0.3, 1.0, 0.0), (2.0, 0.2, 0.9, 0.1))[o]
            k = int(step)
            moved = np.zeros((side, side))
            moved[k:, k:] = alpha[s, o][:-k, :-k]
            shadow = smooth(moved, 0.01 * side) * depth
            a = alpha[s, o][..., None]
            canvas = canvas * (1 - shadow[..., None]) * (1 - a) + np.clip(color[s, o] * gain * (1 + mean * tint), 0, 255) * a
            label[alpha[s, o] > 0.5] = o + 1
        assert np.abs(made[s][..., :2] - canvas).max() <= 0.5 + 1e-6 and np.array_equal(made[s][..., 3], label)
    got = {(r["scene"], r["ord"]): (r["item"], r["full"], r["visible"], r["target"]) for r in flatlay.shown(layers).collect()}
    covers = alpha > 0.5
    left = covers[1, 0] & ~covers[1, 1]
    assert got[1, 0] == ("p", covers[1, 0].sum(), left.sum(), bool(left.sum() / covers[1, 0].sum() >= 0.4)) and got[1, 1][2] == covers[1, 1].sum() and got[2, 0][3]


def test_scenes_are_drawn_alike_in_every_run_and_no_item_twice(spark):
    bank = spark.createDataFrame([(f"i{k}",) for k in range(5)], "item string")
    drawn = flatlay.cast(spark.range(400).withColumnRenamed("id", "scene"), bank, 1)
    found = {}
    for r in drawn.collect():
        found.setdefault(r["scene"], []).append(r["item"])
    counts = np.bincount([len(v) for v in found.values()], minlength=5)[1:] / 400
    assert len(found) == 400 and np.abs(counts - [0.25, 0.35, 0.25, 0.15]).max() < 0.08 and all(len(set(v)) == len(v) for v in found.values())
    assert {i for v in found.values() for i in v} == {f"i{k}" for k in range(5)}
    assert flatlay.cast(spark.range(3).withColumnRenamed("id", "scene"), bank.limit(1), 1).count() == 3 and flatlay.cast(spark.range(3).withColumnRenamed("id", "scene"), bank.limit(0), 1).count() == 0
    img = coordinates(16, 16)
    products = frame(spark, {f"i{k}": img for k in range(3)}, ["r", "g", "b", "alpha"])
    ground = spark.sql("SELECT CAST(s.id AS INT) AS scene, CAST(y.id AS INT) AS y, CAST(x.id AS INT) AS x, 10 AS r, 20 AS g, 30 AS b FROM range(3) s, range(32) y, range(32) x")
    scene, items = flatlay.scenes(products, ground, 5, 32, 16)
    again, _ = flatlay.scenes(products.repartition(7), ground.repartition(5), 5, 32, 16)
    assert scene.count() == 3 * 32 * 32 and scene.exceptAll(again).count() == 0
    top = {(r["scene"], r["label"] - 1): r["n"] for r in scene.where("label > 0").groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert top == {(r["scene"], r["ord"]): r["visible"] for r in items.where("visible > 0").collect()}


def test_gather_over_tiles_with_holes_and_pixels_that_are_there_twice(spark, capsys):
    rng = np.random.default_rng(5)
    img = rng.integers(0, 256, (30, 60)).astype(float)
    gone = rng.random(img.shape) < 0.1
    gone[:, 30:] = False  # some tiles are whole, others lack pixels
    rows = [("a", y, x, float(img[y, x])) for y in range(30) for x in range(60) if not gone[y, x] and (y, x) != (3, 5)]
    gone[3, 5] = False
    rows += [("a", 3, 5, float(img[3, 5])), ("a", 3, 5, 1.5)]
    img[3, 5] += 1.5  # it is there twice
    pixels = spark.createDataFrame(rows, "image string, y int, x int, v double")
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-2, 62, 500), rng.uniform(-2, 32, 500), strict=True))] + [(900, 4.5, 3.0), (901, 23.0, 22.5), (902, 46.5, 23.0)]
    wanted = spark.createDataFrame([("a", *r) for r in at], "image string, k int, sx double, sy double")
    made = resample.gathered(pixels, wanted, {"v": 7.0})
    got = {r["k"]: r["v"] for r in made.collect()}
    value = lambda y, x: img[y, x] if 0 <= y < 30 and 0 <= x < 60 and not gone[y, x] else 7.0
    for k, x, y in at:
        i, j = math.floor(x), math.floor(y)
        u, v = x - i, y - j
        assert got[k] == pytest.approx((1 - v) * ((1 - u) * value(j, i) + u * value(j, i + 1)) + v * ((1 - u) * value(j + 1, i) + u * value(j + 1, i + 1))), (x, y)
    made.explain()  # a place is one row on its way, not one for each of its four pixels that are summed up again
    assert not any("Aggregate" in line and "k#" in line for line in capsys.readouterr().out.splitlines())
    products = pixels.withColumns({"alpha": F.lit(1.0), **dict.fromkeys("rgb", F.col("v"))})
    where = spark.createDataFrame([(0, 0, "a", 59.0, 20.0, 30.0, 20.0)], "scene int, ord int, item string, extent double, turn double, tx double, ty double")
    layer = {(r["y"], r["x"]): (r["r"], r["alpha"]) for r in flatlay.placed(products, where, 64).collect()}
    a, b = math.cos(math.radians(20)), math.sin(math.radians(20))
    seen = 0
    for y in range(64):
        for x in range(64):
            sx, sy = a * (x - 30) - b * (y - 20) + 29.5, b * (x - 30) + a * (y - 20) + 14.5
            if not (-1 < sx < 60 and -1 < sy < 30):
                assert (y, x) not in layer
                continue
            i, j = math.floor(sx), math.floor(sy)
            want, seen = 0.0, seen + 1
            for q, w in ((i, 1 - sx + i), (i + 1, sx - i)):
                for p, z in ((j, 1 - sy + j), (j + 1, sy - j)):
                    want += w * z * (img[p, q] if 0 <= p < 30 and 0 <= q < 60 and not gone[p, q] else 255.0)
            assert layer[y, x][0] == pytest.approx(want), (y, x)
    assert seen == len(layer) > 1000


def test_resizing_is_dealt_out_by_lines_and_columns(spark, capsys):
    """Not by whole images, and not in partitions that are put together by what they weigh before a pixel becomes many rows."""
    size = spark.createDataFrame([("a", 2, 2, 5, 5)], "image string, lines int, length int, new_lines int, new_length int")
    made = resample.resized(frame(spark, {"a": np.arange(4.0).reshape(2, 2, 1)}, ["r"]), size, ["r"], "linear")
    assert made.count() == 25
    made.explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if "REPARTITION_BY_NUM" in line and "hashpartitioning" in line]
    assert len(dealt) == 2 and "x#" in dealt[0] and "y#" in dealt[1]
