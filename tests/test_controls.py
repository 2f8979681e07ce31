"""Made cases against plain arrays: spoilt products, calibration candidates, hidden garments, accessories, plain-ground items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions.hashing import drawn
from loomframe.operators import controls, metrics, pixels
from loomframe.operators.pixels import RGB

H, W, SIZE = 26, 20, 30


def table(spark, images, **flags):
    rows = [(n, y, x, *map(int, img[y, x]), *(f[n][y, x].item() for f in flags.values())) for n, img in images.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    kind = lambda f: "boolean" if next(iter(f.values())).dtype == bool else "double"
    return spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int" + "".join(f", {n} {kind(f)}" for n, f in flags.items()))


def array(rows, columns=RGB):
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    assert len(rows) == h * w
    out = np.zeros((h, w, len(columns)))
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in columns]
    return out


def white(img, flag, fill=0.86):
    ys, xs = np.nonzero(flag)
    if not len(xs):
        return np.full((1, 1, 3), 255)
    y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
    side = int(max(x1 - x0, y1 - y0) / fill)
    out = np.full((side, side, 3), 255)
    oy, ox = (side - (y1 - y0)) // 2, (side - (x1 - x0)) // 2
    out[oy : oy + y1 - y0, ox : ox + x1 - x0] = np.where(flag[y0:y1, x0:x1, None], img[y0:y1, x0:x1], 255)
    return out


@pytest.fixture(scope="module")
def bank():
    rng = np.random.default_rng(3)
    images, masks = {}, {}
    for n in controls.NEGATIVES:
        images[n] = rng.integers(0, 250, (H, W, 3))
        masks[n] = np.zeros((H, W), bool)
        masks[n][4:22, 3:17] = rng.random((18, 14)) < 0.9
    images["jacket"], masks["jacket"] = np.full((H, W, 3), 77), np.zeros((H, W), bool)
    masks["jacket"][2:24, 1:19] = True
    return images, masks


def test_on_white_keeps_flagged_pixels_only(spark, bank):
    images, masks = bank
    masks = {**masks, "jacket": np.zeros((H, W), bool)}  # nothing flagged: white
    got = controls.on_white(table(spark, images, m=masks), F.col("m")).collect()
    for n in images:
        assert np.array_equal(array([r for r in got if r["image"] == n]), white(images[n], masks[n]))


def test_masked_crop_has_room_and_is_square(spark, bank):
    images, masks = bank
    (n, mask), rows = ("strip", masks["strip"]), controls.masked_crop(table(spark, bank[0], m=masks), F.col("m"), 0.2).where("image = 'strip'").collect()
    ys, xs = np.nonzero(mask)
    y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
    py, px = int((y1 - y0) * 0.2), int((x1 - x0) * 0.2)
    y0, y1, x0, x1 = max(0, y0 - py), min(H, y1 + py), max(0, x0 - px), min(W, x1 + px)
    side = max(y1 - y0, x1 - x0)
    want = np.full((side, side, 3), 255)
    oy, ox = (side - (y1 - y0)) // 2, (side - (x1 - x0)) // 2
    want[oy : oy + y1 - y0, ox : ox + x1 - x0] = np.where(mask[y0:y1, x0:x1, None], images[n][y0:y1, x0:x1], 255)
    assert np.array_equal(array(rows), want)


def test_every_kind_of_negative(spark, bank, monkeypatch):
    images, masks = bank
    monkeypatch.setattr(controls, "_sized", lambda df, size: df)  # squares as they are, so that pixels can be held exactly
    deal = [(n, n, "jacket") for n in controls.NEGATIVES if n != "pair"]
    got = controls.negatives(table(spark, images, m=masks), spark.createDataFrame(deal, "image string, kind string, other string"), 7, SIZE).collect()
    draws = {r["n"]: (r["u"], r["v"]) for r in spark.createDataFrame([(n,) for n in controls.NEGATIVES], "n string").select("n", drawn(7, F.col("n"), "first").alias("u"), drawn(7, F.col("n"), "second").alias("v")).collect()}
    ys, xs = np.mgrid[:H, :W]
    for n in images.keys() - {"jacket", "pair"}:
        (u, v), img, m = draws[n], images[n].copy(), masks[n]
        py, px = np.nonzero(m)
        y0, y1, x0, x1 = py.min(), py.max() + 1, px.min(), px.max() + 1
        w, kept = x1 - x0, m.copy()
        if n == "strip":
            cx, half = (x0 + x1) / 2 + (-0.05 + 0.1 * v) * w, (0.12 + 0.23 * u) * w / 2
            kept &= (xs >= int(cx - half)) & (xs < int(cx + half))
        elif n == "half":
            kept &= [ys < (y0 + y1) // 2, ys >= (y0 + y1) // 2, xs < (x0 + x1) // 2, xs >= (x0 + x1) // 2][int(u * 4)]
        elif n == "grey":
            left = int(x0 + u * w * 0.7)
            img[m & (xs >= left) & (xs < left + int((0.2 + 0.25 * v) * w))] = 128
        elif n == "merge":
            gap = int((0.1 + 0.2 * u) * W / 2)
            cover = masks["jacket"] & ~((xs >= W // 2 - gap) & (xs < W // 2 + gap))
            img[cover], kept = 77, m | cover
        elif n == "marker":
            padded = np.pad(m, 1)
            edge = m & ~(padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:])
            grow = lambda f, k: np.array([[f[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1].any() for x in range(W)] for y in range(H)])
            img[grow(edge, 1)], kept = (0, 255, 0), grow(m, 4)
        assert np.array_equal(array([r for r in got if r["image"] == n]), white(img, kept)), n


def test_pairs_lie_side_by_side_or_pressed(spark, bank):
    images, masks = bank
    deal = spark.createDataFrame([("pair", "pair", "jacket"), ("half", "pair", "half")], "image string, kind string, other string")
    got = controls.negatives(table(spark, images, m=masks), deal, 7, SIZE).collect()
    u = {r["n"]: r["u"] for r in spark.createDataFrame([("pair",), ("half",)], "n string").select("n", drawn(7, F.col("n"), "first").alias("u")).collect()}
    for n in ("pair", "half"):
        assert array([r for r in got if r["image"] == n]).shape == (SIZE, SIZE if u[n] < 0.5 else 2 * SIZE, 3)
    assert {r["kind"] for r in got} == {"pair"}


def test_deal_gives_merges_an_outer_item(spark):
    bank = spark.createDataFrame([(str(i), i % 10 == 0) for i in range(300)], "image string, outer boolean")
    got = controls.dealt(bank, 1).collect()
    assert sorted(r["image"] for r in got) == sorted(str(i) for i in range(300))
    assert {r["kind"] for r in got} == set(controls.NEGATIVES)
    assert all(int(r["other"]) % 10 == 0 for r in got if r["kind"] == "merge")
    none = controls.dealt(bank.where("not outer"), 1).where("kind = 'merge'")
    assert none.count() > 0 and none.where("other is null").count() == 0
    assert controls.dealt(bank.limit(0), 1).collect() == []


def test_candidates_hold_one_right_and_six_wrong(spark, bank):
    images, masks = bank
    photo, inner = images["half"], np.zeros((H, W), bool)
    inner[8:18, 8:12] = True
    outer = masks["jacket"]
    one = lambda n: (table(spark, {"p": images[n]}, m={"p": masks[n]}))
    got = controls.candidates(table(spark, {"p": photo}, inner={"p": inner}, outer={"p": outer}), one("strip"), one("grey"), 24).collect()
    kinds = {k: [r for r in got if r["kind"] == k] for k in ("pos", "other", "outer", "strip", "merge", "dark", "hue")}
    assert sum(map(len, kinds.values())) == len(got)
    assert len(kinds["outer"]) == len(kinds["strip"]) == 24 * 24
    assert np.array_equal(array(kinds["pos"]), images["strip"])
    want, xs = images["strip"].copy(), np.mgrid[:H, :W][1]
    want[((xs < int(W * 0.38)) | (xs >= int(W * 0.62))) & masks["strip"]] = np.median(photo[outer & ~inner], axis=0).astype(int)
    assert np.array_equal(array(kinds["merge"]), want)
    dark = array(kinds["dark"])
    assert np.array_equal(dark[~masks["strip"]], images["strip"][~masks["strip"]]) and dark[masks["strip"]].max() <= 0.45 * 255 + 1


def test_a_pasted_garment_takes_the_tops_place_and_size(spark):
    photo, top = np.full((40, 40, 3), 10), np.zeros((40, 40), bool)
    top[10:30, 10:30] = True
    donor, outer, inner = np.full((20, 20, 3), 200), np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    outer[4:14, 3:8], outer[4:14, 9:13], inner[4:14, 8:9] = True, True, True
    photos, donors = table(spark, {"p": photo}, top={"p": top}), table(spark, {"d": donor}, outer={"d": outer}, inner={"d": inner})
    got = controls.occluded(photos, donors, spark.createDataFrame([("p", "d", 1.0)], "image string, donor string, widen double")).collect()
    jacket = array(got, ["jacket"])[..., 0].astype(bool)
    ys, xs = np.nonzero(jacket)
    # twice as large, its top at the top's, its middle at the top's middle; the open front stays
    assert abs(ys.min() - 10) <= 1 and abs(ys.max() - 28) <= 1 and abs(xs.min() - 10) <= 1 and abs(xs.max() - 28) <= 1
    assert not jacket[20, 20] and jacket[20, 14] and jacket[20, 26]
    shown = array(got)
    assert abs(shown[20, 14] - 200).max() <= 2 and (shown[~np.array(jacket) & (np.abs(np.mgrid[:40, :40][0] - 20) > 15)] == 10).all()
    record = controls.hidden_shares(spark.createDataFrame(got)).first()
    assert record["hidden_frac"] == pytest.approx((jacket & top).sum() / top.sum()) and record["fits"]
    assert record["inner_share"] == pytest.approx((top & ~jacket).sum() / ((top & ~jacket).sum() + jacket.sum()))


def test_the_first_fitting_donor_is_kept(spark):
    photo, top = np.full((30, 30, 3), 10), np.zeros((30, 30), bool)
    top[5:25, 5:25] = True
    full, nothing = np.zeros((12, 12), bool), np.zeros((12, 12), bool)
    full[1:11, 1:11] = True
    slit = full.copy()
    slit[:, 5:7] = False
    donors = table(spark, {n: np.full((12, 12, 3), 90) for n in "abc"}, outer={"a": full, "b": slit, "c": slit}, inner={"a": nothing, "b": full & ~slit, "c": full & ~slit})
    tried = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("p", "c", 2)], "image string, donor string, attempt int")
    made, records = controls.hidden_cases(table(spark, {"p": photo}, top={"p": top}), donors, tried)
    (record,) = records.collect()
    assert record["donor"] == "b" and record["attempt"] == 1  # the first hides all of the top
    assert {r["donor"] for r in made.select("donor").distinct().collect()} == {"b"} and made.count() == 900


@pytest.mark.parametrize("kind", ["tie", "belt", "scarf", "bag"])
def test_accessories_lie_where_they_are_worn(spark, kind):
    img, mask = np.full((60, 60, 3), 255), np.zeros((60, 60), bool)
    mask[10:50, 15:45] = True
    piece = {"q": np.full((30, 10, 3), 40)}
    products, pieces = table(spark, {"p": img}, m={"p": mask}), table(spark, piece, alpha={"q": np.ones((30, 10))})
    deal = spark.createDataFrame([("p", "q", kind)], "image string, shown string, kind string")
    got = controls.with_pieces(products, pieces, deal, 3).collect()
    covered, laid = (array(got, [c])[..., 0].astype(bool) for c in ("covered", "piece"))
    assert (covered <= mask).all() and (covered <= laid).all() and covered.any()
    assert (array(got)[covered] == 40).all() and (array(got)[~laid] == 255).all()
    ys, xs = np.nonzero(laid)
    wide, tall = xs.max() - xs.min() - 1, ys.max() - ys.min() - 1
    if kind == "belt":  # turned, as it stands
        assert wide > tall and 0.65 * 30 <= wide <= 31 and 10 + 0.55 * 40 <= ys.min() + 1 <= 10 + 0.8 * 40
    else:
        share = {"tie": (0.45, 0.7, tall / 40), "bag": (0.3, 0.5, tall / 40), "scarf": (0.4, 0.65, wide / 30)}[kind]
        assert share[0] - 0.05 <= share[2] <= share[1] + 0.05


def test_accessory_notes_take_the_first_of_each_kind(spark):
    rows = [(f"f{i}", 1, c, a, i == 0) for i, (c, a) in enumerate([("tie", 2000), ("tie", 1500), ("tie", 1499), ("tie", 9000), ("tie", 9000), ("bag, wallet", 6000), ("hat", 9999)])]
    got = controls.accessory_notes(spark.createDataFrame(rows, "file string, ann int, category string, area int, iscrowd boolean"), 2).collect()
    assert sorted((r["file"], r["kind"]) for r in got) == [("f1", "tie"), ("f3", "tie"), ("f5", "bag")]


def test_plain_items_are_the_largest_components(spark):
    img = np.full((40, 60, 3), 230)
    img[5:15, 5:25], img[20:35, 30:50], img[8:11, 10:14], img[30, 5] = 20, 120, 230, 0  # a hole in the first, a speck
    df = table(spark, {"p": img})
    items, spans = controls.plain_items(df, side=60, most=2)
    assert [(r["item"], r["area"]) for r in items.orderBy("item").collect()] == [(0, 300), (1, 200)]
    assert items.orderBy("item").first()["score"] == pytest.approx(300 / 2400)
    assert spans.where("item = 1").selectExpr("sum(b - a)").first()[0] == 200
    assert controls.plain_items(table(spark, {"p": np.full((9, 9, 3), 7)}), side=9)[0].collect() == []


def test_masks_packed_in_the_channels(spark):
    img = np.array([[[255, 0, 128], [127, 200, 0]]])
    got = controls.case_masks(table(spark, {"p": np.zeros((1, 3, 3), int)}), table(spark, {"p": img})).orderBy("x").collect()
    assert [(r["jacket"], r["top"], r["hidden"]) for r in got] == [(True, False, True), (False, True, False), (False, False, False)]


def test_margin_against_the_other_items_of_a_photo(spark):
    rng = np.random.default_rng(2)
    items = [(f, i, rng.normal(size=8).tolist()) for f, n in (("a", 200), ("b", 1), ("c", 3)) for i in range(n)]
    results = [("a", 5, rng.normal(size=8).tolist(), 0), ("a", 5, rng.normal(size=8).tolist(), 1), ("b", 0, rng.normal(size=8).tolist(), 2), ("c", 9, rng.normal(size=8).tolist(), 3), ("d", 0, rng.normal(size=8).tolist(), 4)]
    got = metrics.margin_in_photo(spark.createDataFrame(results, "file string, item int, v array<double>, k int"), spark.createDataFrame(items, "file string, item int, v array<double>"), "file", "item", "v").collect()
    cos = lambda p, q: np.dot(p, q) / np.linalg.norm(p) / np.linalg.norm(q)
    for r in got:
        own = [cos(r["v"], v) for f, i, v in items if f == r["file"] and i == r["item"]]
        rest = [cos(r["v"], v) for f, i, v in items if f == r["file"] and i != r["item"]]
        assert r["margin"] == (None if not own else pytest.approx(own[0] - max(rest) if rest else 1.0)), r["k"]
    assert len(got) == 5


def test_unflagged_products_have_no_negative(spark, bank):
    images, _ = bank
    df = table(spark, {"p": images["half"]}, m={"p": np.zeros((H, W), bool)})
    assert controls.negatives(df, spark.createDataFrame([("p", "grey", "p")], "image string, kind string, other string"), 1, 10).collect() == []
    assert pixels.boxes(df, F.col("m")).collect() == []
