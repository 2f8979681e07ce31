"""Pixel tables against numpy on whole arrays."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import palette, pixels

H, W = 24, 40


def table(spark, image, **flags):
    rows = [("i", y, x, *map(int, image[y, x]), *(bool(f[y, x]) for f in flags.values())) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int" + "".join(f", {n} boolean" for n in flags))


def array(df, columns):
    rows = df.collect()
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    out = np.zeros((h, w, len(columns)))
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in columns]
    return out


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(5)
    img = rng.integers(0, 256, (H, W, 3))
    mask = np.zeros((H, W), bool)
    mask[4:18, 8:30] = True
    mask[8:11, 12:16] = False
    return img, mask


def test_boxes_crop_and_dim(spark, image):
    img, mask = image
    df = table(spark, img, target=mask)
    assert tuple(pixels.boxes(df, F.col("target")).first())[1:] == (8, 4, 30, 18)
    got = array(pixels.dim_crop(df), pixels.RGB)
    want = np.where(mask[..., None], img, np.round(img * 0.3))[2:20, 5:33]  # 15 % of 22 and of 14
    assert got.shape == want.shape and np.abs(got - want).max() <= 1
    assert pixels.boxes(df, F.lit(False)).collect() == []


def test_outline_fill_and_grey(spark, image):
    img, mask = image
    df = table(spark, img, target=mask, outer=np.ones_like(mask))
    inner = mask.copy()
    for axis in (0, 1):
        for step in (-1, 1):
            inner &= np.roll(mask, step, axis)
    edge = mask & ~inner
    got = array(pixels.pointed(df, "grey_outer", outer="outer"), pixels.RGB)
    assert (got[edge] == pixels.MARK).all() and (got[~mask] == pixels.GREY).all() and (got[inner] == img[inner]).all()
    filled = array(pixels.pointed(df, "fill"), pixels.RGB)
    assert np.abs(filled[inner] - (0.65 * img[inner] + 0.35 * np.array(pixels.MARK))).max() <= 0.5 + 1e-9
    with pytest.raises(ValueError):
        pixels.pointed(df, "grey_outer")
    with pytest.raises(ValueError):
        pixels.pointed(df, "other")


def test_guard_band_and_dilation(spark, image):
    img, mask = image
    df = table(spark, img, target=mask).withColumn("alpha", F.when(F.col("x") % 5 == 0, 4).otherwise(200))
    grown = np.zeros((H + 6, W + 6), bool)
    for dy in range(7):
        for dx in range(7):
            grown[dy : dy + H, dx : dx + W] |= mask
    alpha = array(pixels.guarded(df, "alpha", "target", px=3), ["alpha"])[..., 0]
    want = np.where(grown[3:-3, 3:-3] & (np.arange(W) % 5 != 0), 200, 0)
    assert (alpha == want).all()


def test_marker_and_composite(spark, image):
    img, mask = image
    img = img.copy()
    img[6:8, 20:24] = pixels.MARK
    df = table(spark, img, target=mask)
    near = palette.delta_e(palette.to_lab(img[mask]), np.broadcast_to(palette.to_lab(np.array([pixels.MARK])), (mask.sum(), 3))) < 20
    assert abs(pixels.marker_share(df, F.col("target")).first()["share"] - near.mean()) < 1e-9
    assert pixels.marker_share(df, F.lit(False)).first()["share"] == 0.0
    both = df.withColumns({"gr": F.lit(10), "gg": F.lit(20), "gb": F.lit(30), "alpha": F.lit(0.25)})
    got = array(pixels.composite(both, ("gr", "gg", "gb"), "alpha"), pixels.RGB)
    assert np.abs(got - (img * 0.75 + np.array([10, 20, 30]) * 0.25)).max() <= 0.5


def test_hull_and_holes(spark):
    square = np.zeros((H, W), bool)
    square[3:13, 5:15] = True
    square[6:9, 8:11] = False
    row = pixels.row_hull(table(spark, np.zeros((H, W, 3), int), m=square), F.col("m")).first()
    assert (row["area"], row["hull_area"], round(row["solidity"], 2)) == (91, 100.0, 0.91)
    df = spark.createDataFrame([(91, 100), (0, 0)], "n int, f int")
    assert [round(r[0], 2) for r in df.select(pixels.occlusion(F.col("n"), F.col("f"))).collect()] == [0.09, 0.0]


def test_tokens_and_weights(spark):
    rng = np.random.default_rng(1)
    img = np.full((48, 64, 3), 120)
    img[:16, 16:32] = rng.integers(0, 256, (16, 16, 3))  # a pattern in one token
    hidden = np.zeros((48, 64), bool)
    hidden[:16, :40] = True
    df = table(spark, img, hidden=hidden)
    inside = {(r["ty"], r["tx"]): r["inside"] for r in pixels.tokens(df, F.col("hidden"), 0.25).collect()}
    assert len(inside) == 12 and {k for k, v in inside.items() if v} == {(0, 0), (0, 1), (0, 2)}
    detail = pixels.detail_tokens(df, "hidden", inset=2)
    weights = {(r["ty"], r["tx"]): r["weight"] for r in pixels.token_weights(pixels.tokens(df, F.col("hidden"), 0.25), detail).collect()}
    assert weights[0, 1] == 0.0 and weights[0, 0] == 0.3 and weights[2, 3] == 1.0


def test_recolouring_and_shift(spark):
    img = np.full((4, 4, 3), (200, 40, 40))
    df = table(spark, img, fg=np.ones((4, 4), bool))
    source, result = palette.to_lab(np.array([[40, 40, 200]]))[0], palette.to_lab(np.array([[200, 40, 40]]))[0]
    struct = lambda v: F.array(F.struct(*(F.lit(float(x)).alias(c) for c, x in zip("lab", v))))
    centers = df.select("image").distinct().select("image", struct(source).alias("source"), struct(result).alias("result"))
    lab = pixels.recoloured(df, centers, F.col("fg"), most=1000.0).first()["lab"]
    assert np.allclose([lab["l"], lab["a"], lab["b"]], source, atol=1e-6)
    turned = pixels.shifted(df, F.col("fg"), hue=120.0).first()
    assert (turned["r"], turned["g"], turned["b"]) == (40, 200, 40)
    dark = pixels.shifted(df, F.col("fg"), sat=0.5, val=0.5).first()
    assert (dark["r"], dark["g"], dark["b"]) == (100, 60, 60)


def test_pasting_and_urls(spark):
    base = table(spark, np.zeros((2, 2, 3), int))
    top = spark.createDataFrame([("i", 0, 1, 9, 8, 7)], "image string, y int, x int, r int, g int, b int")
    got = {(r["y"], r["x"]): (r["r"], r["covered"]) for r in pixels.pasted(base, top).collect()}
    assert got == {(0, 0): (0, False), (0, 1): (9, True), (1, 0): (0, False), (1, 1): (0, False)}
    url = spark.createDataFrame([(bytearray(b"abc"),)], "c binary").select(pixels.data_url(F.col("c"))).first()[0]
    assert url == "data:image/jpeg;base64," + base64.b64encode(b"abc").decode()
