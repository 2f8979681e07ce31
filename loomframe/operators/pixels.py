"""Image operators over pixel tables: a row a pixel (image, y, x, r, g, b and flags), so that an image is never one value.

Everything is grouping, windows along rows and columns, and column arithmetic; images are groups, however large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color

KEY = ["image"]
AT = ["image", "y", "x"]
RGB = ["r", "g", "b"]
#: The marker's and the grey's colour, sizes and limits of tokens, skin, plain backgrounds.
MARK, GREY = (0, 255, 0), (128, 128, 128)
TOKEN, PLAIN_WEIGHT, STD_DETAIL, EDGE_DETAIL, BAND_MARGIN = 16, 0.3, 8.0, 6.0, 0.06


def lab() -> Column:
    return color.srgb_to_lab(*(F.col(c) for c in RGB))


def boxes(pixels: DataFrame, flag: Column | None = None) -> DataFrame:
    """(image, x0, y0, x1, y1), the ends exclusive, of the pixels with the flag; an image without any has no row."""
    rows = pixels if flag is None else pixels.where(flag)
    return rows.groupBy("image").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def expand(box: DataFrame, size: DataFrame, margin: float) -> DataFrame:
    """Boxes with a margin of their own size on each side, kept within the image (image, width, height)."""
    mx, my = (F.bround((F.col(f"{c}1") - F.col(f"{c}0")) * margin).cast("int") for c in "xy")
    return box.join(size, "image").select(
        "image", F.greatest(F.lit(0), F.col("x0") - mx).alias("x0"), F.greatest(F.lit(0), F.col("y0") - my).alias("y0"), F.least("width", F.col("x1") + mx).alias("x1"), F.least("height", F.col("y1") + my).alias("y1")
    )


def crop(pixels: DataFrame, box: DataFrame) -> DataFrame:
    """The pixels inside their image's box, counted from its corner."""
    inside = F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1)
    rest = [c for c in pixels.columns if c not in AT]
    return pixels.join(box, "image").where(inside).select("image", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *rest)


def with_border(pixels: DataFrame, width: int = 1, name: str = "border") -> DataFrame:
    """pixels with a flag: within ``width`` of an edge of the image."""
    size = boxes(pixels).select("image", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    near = F.lit(False)
    for c in "xy":
        near = near | (F.col(c) < F.col(f"_{c}0") + width) | (F.col(c) >= F.col(f"_{c}1") - width)
    return pixels.join(size, "image").withColumn(name, near).drop("_x0", "_y0", "_x1", "_y1")


def border_foreground(pixels: DataFrame, threshold: float = 40.0) -> DataFrame:
    """pixels with fg: further than the threshold from the median colour of the image's edge."""
    edge = with_border(pixels).where("border").groupBy("image").agg(*(F.median(c).alias(f"_{c}") for c in RGB))
    far = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2.0)) for c in RGB), F.lit(0.0))) > threshold
    return pixels.join(edge, "image").withColumn("fg", far).drop(*(f"_{c}" for c in RGB))


def dilated(flagged: DataFrame, px: int) -> DataFrame:
    """(image, y, x) within px of a flagged pixel (a square), along rows and then along columns, so that a pixel becomes 2 (2 px + 1) rows and not the square."""
    out = flagged.select(*AT)
    for c in ("x", "y"):
        near = F.explode(F.sequence(F.col(c) - px, F.col(c) + px))
        out = out.select(*(near.alias(c) if k == c else F.col(k) for k in AT)).distinct()
    return out


def guarded(pixels: DataFrame, alpha: str, mask: str, px: int = 6, least: int = 8) -> DataFrame:
    """pixels whose alpha is 0 outside the mask's guard band of px, and where it is under ``least``."""
    band = dilated(pixels.where(mask), px).withColumn("_in", F.lit(True))
    kept = F.when(F.col("_in") & (F.col(alpha) >= least), F.col(alpha)).otherwise(0)
    return pixels.join(band, AT, "left").withColumn(alpha, kept).drop("_in")


def is_skin() -> Column:
    """The usual skin range in YCbCr."""
    r, g, b = (F.col(c) for c in RGB)
    cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return (y > 60) & (cb > 77) & (cb < 127) & (cr > 133) & (cr < 173)


def scene_cases(pixels: DataFrame, skin: float, plain: float, width: int = 8) -> DataFrame:
    """(image, bg_std, skin, case, confidence): worn if enough skin shows, laid flat on a plain ground if the edge hardly varies, else among other things."""
    edge = F.col("border")
    std = sum((F.stddev_pop(F.when(edge, F.col(c))) for c in RGB), F.lit(0.0)) / 3
    found = with_border(pixels, width).groupBy("image").agg(std.alias("bg_std"), F.avg(is_skin().cast("int")).alias("skin"))
    worn, flat = F.col("skin") >= skin, F.col("bg_std") <= plain
    return found.select("image", "bg_std", "skin", F.when(worn, "case2").when(flat, "case1").otherwise("case3").alias("case"), F.when(worn, F.least(F.lit(1.0), F.lit(0.5) + F.col("skin"))).when(flat, 0.6).otherwise(0.5).alias("confidence"))


def with_outline(pixels: DataFrame, mask: str, name: str = "outline") -> DataFrame:
    """pixels with a flag: of the mask, with a neighbour in the row or column that is not, or is none."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    inner = F.lit(True)
    for w, at in ((row, "x"), (column, "y")):
        for step in (F.lag, F.lead):
            inner = inner & F.coalesce(step(F.col(mask)).over(w) & (F.abs(step(F.col(at)).over(w) - F.col(at)) == 1), F.lit(False))
    return pixels.withColumn(name, F.col(mask) & ~inner)


def painted(pixels: DataFrame, where: Column, rgb: Sequence[int], alpha: float = 1.0) -> DataFrame:
    """pixels with a colour laid over where the condition holds."""
    return pixels.withColumns({c: F.when(where, F.bround((1 - alpha) * F.col(c) + alpha * v).cast("int")).otherwise(F.col(c)) for c, v in zip(RGB, rgb, strict=True)})


def pointed(pixels: DataFrame, variant: str, target: str = "target", outer: str | None = None) -> DataFrame:
    """The image with its target shown: outline, fill (and outline), or grey_outer; text leaves it as it is."""
    if variant == "text":
        return pixels
    out = with_outline(pixels, target, "_edge")
    if variant == "fill":
        out = painted(out, F.col(target), MARK, 0.35)
    elif variant == "grey_outer":
        if outer is None:
            raise ValueError("grey_outer needs the outer garment's mask")
        out = painted(out, F.col(outer) & ~F.col(target), GREY)
    elif variant != "outline":
        raise ValueError(f"unknown variant {variant!r}")
    return painted(out, F.col("_edge"), MARK).drop("_edge")


def dim_crop(pixels: DataFrame, target: str = "target", pad: float = 0.15, factor: float = 0.3) -> DataFrame:
    """The box of the target with some room, all but the target darkened."""
    size = boxes(pixels).select("image", F.col("x1").alias("width"), F.col("y1").alias("height"))
    dark = pixels.withColumns({c: F.when(F.col(target), F.col(c)).otherwise(F.bround(F.col(c) * factor).cast("int")) for c in RGB})
    return crop(dark, expand(boxes(pixels, F.col(target)), size, pad))


def composite(pixels: DataFrame, gen: Sequence[str], alpha: str) -> DataFrame:
    """The generated colours over the original ones, by alpha from 0 to 1."""
    return pixels.withColumns({c: F.bround(F.col(c) * (1 - F.col(alpha)) + F.col(g) * F.col(alpha)).cast("int") for c, g in zip(RGB, gen, strict=True)})


def marker_share(pixels: DataFrame, fg: Column | None = None, near: float = 20.0) -> DataFrame:
    """(image, share) of the foreground (else what is not nearly white) whose colour is near the marker's; 0 without foreground."""
    ground = F.col("r") + F.col("g") + F.col("b") < 735 if fg is None else fg
    mark = color.lab_of(MARK)
    hit = ground & (color.delta_e(lab(), mark) < near)
    return pixels.groupBy("image").agg(F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count_if(ground)), F.lit(0.0)).alias("share"))


def visible_share(pixels: DataFrame, visible: Column, torso: Column) -> DataFrame:
    """(image, share): the visible part within the rows that it spans, over the torso there; 0 where nothing is visible."""
    rows = pixels.groupBy("image", "y").agg(F.count_if(visible).alias("v"), F.count_if(torso).alias("t"))
    span = rows.where("v > 0").groupBy("image").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    inside = rows.join(span, "image", "left").groupBy("image").agg(F.sum("v").alias("v"), F.coalesce(F.sum(F.when(F.col("y").between(F.col("a"), F.col("b")), F.col("t"))), F.lit(0)).alias("t"))
    return inside.select("image", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v") / F.greatest("t", F.lit(1)).cast("double")).alias("share"))


def stacked(placed: DataFrame) -> DataFrame:
    """(scene, item, full, visible): pixels that each placed item covers, and those where none lies on top of it.

    placed: scene, item, ord (0 lies lowest), y, x; an item that is on a pixel several times covers it once. Pixels don't meet what lies on
    top of them: the tops of an item are counted by themselves, and meet its count. Rows dealt out by scene and item before they
    become pixels are counted where they are.
    """
    top = placed.groupBy("scene", "y", "x").agg(F.max(F.struct("ord", "item"))["item"].alias("item"))
    visible = top.groupBy("scene", "item").agg(F.count(F.lit(1)).alias("visible"))
    full = placed.select("scene", "item", "y", "x").distinct().groupBy("scene", "item").agg(F.count(F.lit(1)).alias("full"))
    return full.join(visible, ["scene", "item"], "left").na.fill(0, ["visible"])


def pasted(below: DataFrame, above: DataFrame) -> DataFrame:
    """An image with another's pixels (image, y, x, r, g, b) laid over it where there are any; covered says where."""
    top = above.select(*AT, *(F.col(c).alias(f"_{c}") for c in RGB))
    out = below.join(top, AT, "left").withColumn("covered", F.col("_r").isNotNull())
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in RGB}).drop(*(f"_{c}" for c in RGB))


def tokens(pixels: DataFrame, mask: Column, share: float, token: int = TOKEN) -> DataFrame:
    """(image, ty, tx, inside): the whole tokens of the image, and whether the mask has its share of each."""
    size = boxes(pixels).select("image", F.floor(F.col("y1") / token).alias("_h"), F.floor(F.col("x1") / token).alias("_w"))
    cells = pixels.withColumns({"ty": F.floor(F.col("y") / token), "tx": F.floor(F.col("x") / token)}).join(size, "image").where("ty < _h and tx < _w")
    return cells.groupBy("image", "ty", "tx").agg((F.avg(mask.cast("int")) >= share).alias("inside"))


def detail_tokens(pixels: DataFrame, mask: str, inset: int = 4, token: int = TOKEN) -> DataFrame:
    """(image, ty, tx, detail): tokens with a pattern, by the spread and the edges of lightness on the mask's inner part, if that is 30 % of the token."""
    light = pixels.select(*AT, mask, lab()["l"].alias("l"))
    near_edge = dilated(light.where(~F.col(mask)), inset).withColumn("_cut", F.lit(True))
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    around = [F.coalesce(step("l").over(w), F.col("l")) for w in (row, column) for step in (F.lag, F.lead)]
    edged = light.withColumn("_e", F.abs(sum(around, F.lit(0.0)) - 4 * F.col("l"))).join(near_edge, AT, "left")
    inner = F.col(mask) & F.col("_cut").isNull()
    cells = edged.withColumns({"ty": F.floor(F.col("y") / token), "tx": F.floor(F.col("x") / token)}).groupBy("image", "ty", "tx")
    stats = cells.agg(F.count_if(inner).alias("n"), F.stddev_pop(F.when(inner, F.col("l"))).alias("std"), F.avg(F.when(inner, F.col("_e"))).alias("edge"))
    return stats.select("image", "ty", "tx", ((F.col("n") >= 0.3 * token * token) & (F.coalesce("std", F.lit(0.0)) > STD_DETAIL) | (F.col("n") >= 0.3 * token * token) & (F.coalesce("edge", F.lit(0.0)) > EDGE_DETAIL)).alias("detail"))


def token_weights(hidden: DataFrame, detail: DataFrame) -> DataFrame:
    """(image, ty, tx, weight): 1, less where the target was hidden, 0 where it was hidden and has a pattern that none could know."""
    on = ["image", "ty", "tx"]
    lost = F.coalesce(F.col("detail"), F.lit(False))
    return hidden.join(detail, on, "left").select(*on, F.when(F.col("inside") & lost, 0.0).when(F.col("inside"), PLAIN_WEIGHT).otherwise(1.0).alias("weight"))


def recoloured(pixels: DataFrame, centers: DataFrame, fg: Column, strength: float = 1.0, most: float = 40.0) -> DataFrame:
    """pixels with lab moved towards the photo's colours: each of the result's clusters takes the shift to the photo's nearest one, pixels share their clusters' shifts softly.

    centers: image, source and result (arrays of struct(l, a, b), a handful). Lightness counts half in what is near. The new
    colour is in ``lab``; pixels outside fg keep theirs.
    """
    gap = lambda p, q: F.pow((p["l"] - q["l"]) * 0.5, F.lit(2.0)) + F.pow(p["a"] - q["a"], F.lit(2.0)) + F.pow(p["b"] - q["b"], F.lit(2.0))
    cut = lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), v)) * strength
    nearest = lambda d: F.array_min(F.transform("source", lambda s: F.struct(gap(d, s).alias("g"), s.alias("s"))))["s"]
    moves = F.transform("result", lambda d: F.struct(d.alias("d"), *(cut(nearest(d)[c] - d[c]).alias(c) for c in ("l", "a", "b"))))
    near = F.transform("_moves", lambda m: F.struct(gap(F.col("lab"), m["d"]).alias("g"), m.alias("m")))
    least = F.array_min(F.transform("_near", lambda n: n["g"]))
    soft = F.transform("_near", lambda n: F.struct(F.exp(-(n["g"] - F.col("_least")) / 50.0).alias("w"), n["m"].alias("m")))
    total = F.aggregate("_soft", F.lit(0.0), lambda s, x: s + x["w"])
    moved = lambda c: F.col("lab")[c] + F.aggregate("_soft", F.lit(0.0), lambda s, x: s + x["w"] * x["m"][c]) / total
    out = pixels.withColumn("lab", lab()).join(centers.withColumn("_moves", moves), "image").withColumn("_near", near).withColumn("_least", least).withColumn("_soft", soft)
    new = F.when(fg, F.struct(*(moved(c).alias(c) for c in ("l", "a", "b")))).otherwise(F.col("lab"))
    return out.select(*pixels.columns, new.alias("lab"))


def shifted(pixels: DataFrame, mask: Column, hue: float = 0.0, sat: float = 1.0, val: float = 1.0) -> DataFrame:
    """The mask's pixels with hue turned (in degrees) and saturation and value scaled: controls that a gate must reject."""
    r, g, b = (F.col(c) / 255.0 for c in RGB)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    h, s, v = F.pmod(turn + hue, F.lit(360.0)), F.least(F.lit(1.0), F.when(top == 0, 0.0).otherwise(span / top) * sat), F.least(F.lit(1.0), top * val)
    part = lambda n: F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
    channel = lambda n: F.bround((v - v * s * F.greatest(F.lit(0.0), F.least(part(n), 4 - part(n), F.lit(1.0)))) * 255).cast("int")
    return pixels.withColumns({c: F.when(mask, channel(n)).otherwise(F.col(c)) for c, n in zip(RGB, (5, 3, 1), strict=True)})


def row_hull(pixels: DataFrame, flag: Column) -> DataFrame:
    """(image, area, hull_area, solidity): the flagged pixels and the convex hull of their corners, from the ends of each row only."""
    import numpy as np
    import pandas as pd

    ends = pixels.where(flag).groupBy("image", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n"))

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(float(x), float(y + d)) for y, a, b in zip(pdf["y"], pdf["a"], pdf["b"], strict=True) for x in (a, b + 1) for d in (0, 1)})
        turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
        ring: list = []
        for way in (points, points[::-1]):
            part: list = []
            for p in way:
                while len(part) > 1 and turn(part[-2], part[-1], p) <= 0:
                    part.pop()
                part.append(p)
            ring += part[:-1]
        xy = np.array(ring)
        area = 0.5 * abs(float(xy[:, 0] @ np.roll(xy[:, 1], -1) - xy[:, 1] @ np.roll(xy[:, 0], -1)))
        n = int(pdf["n"].sum())
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "area": [n], "hull_area": [area], "solidity": [n / max(area, 1.0)]})

    kind = pixels.schema["image"].dataType.simpleString()
    return ends.groupBy("image").applyInPandas(hull, f"image {kind}, area long, hull_area double, solidity double")


def occlusion(counts: Column, filled: Column) -> Column:
    """The share of a silhouette that is holes, from its area and that with its holes filled; 0 for none."""
    return F.when(filled > 0, 1 - counts / filled.cast("double")).otherwise(0.0)


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))
