"""Images resampled and smoothed as pixel tables: a row a pixel (image, y, x and value columns), every pixel of an image there.

Everything is done along rows and then along columns. A pixel knows by arithmetic which pixels of the new
size it has a part in, so resizing joins nothing but an image's sizes; a weighted sum over neighbours is a window
along a row, and places between pixels meet tiles of them. Values may be of any number type and come back as doubles; what an image library would round is for the caller to round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color
from . import runs
from .pixels import RGB, boxes
from .relational import cut, dealt

KEYS = ("image",)
#: Side and filled share of a product photo, side and step of a model's input, limits of what counts as changed.
SIDE, FILL, MODEL_SIDE, MODEL_STEP = 1024, 0.86, 1024, 16
CHANGED_DELTA, CHANGED_SHARE, CHANGED_SIGMA, CHANGED_DISC = 14.0, 0.002, 1.5, 3
LANCZOS = 4
TILE = 24  # pixels along a side that are gathered from one array


def sizes(pixels: DataFrame) -> DataFrame:
    """(image, lines, length) of whole images."""
    return boxes(pixels).select("image", F.col("y1").alias("lines"), F.col("x1").alias("length"))


# --- resizing ------------------------------------------------------------------------------------------


def _lanczos(d: Column) -> Column:
    x = d * math.pi
    return F.when(F.abs(d) < 1e-9, 1.0).when(F.abs(d) < LANCZOS, LANCZOS * F.sin(x) * F.sin(x / LANCZOS) / (x * x)).otherwise(0.0)


def _along(df: DataFrame, at: str, old: str, new: str, keys: Sequence[str], columns: Sequence[str], how: str) -> DataFrame:
    """df with its pixels along ``at`` brought from ``old`` to ``new`` many (columns), values averaged by their weights."""
    s, n, m = F.col(at).cast("long"), F.col(old).cast("long"), F.col(new).cast("long")
    t = F.col("_t")
    place = (t + 0.5) * n / m - 0.5  # of a new pixel among the old ones
    if how == "area":  # a pixel's part of a cell, in whole numbers
        low, high = F.expr(f"{at} * bigint({new}) div {old}"), F.expr(f"(({at} + 1) * bigint({new}) + {old} - 1) div {old} - 1")
        weight = F.least((s + 1) * m, (t + 1) * n) - F.greatest(s * m, t * n)
    elif how == "nearest":
        low, high = F.expr(f"({at} * bigint({new}) + {old} - 1) div {old}"), F.expr(f"(({at} + 1) * bigint({new}) + {old} - 1) div {old} - 1")
        weight = F.lit(1)
    else:
        reach = 1 if how == "linear" else LANCZOS
        near = lambda d: (s + d + 0.5) * m / n - 0.5
        low = F.when(s == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(near(-reach)))).cast("long")
        high = F.when(s == n - 1, m - 1).otherwise(F.least(m - 1, F.floor(near(reach)))).cast("long")
        if how == "linear":
            weight = F.greatest(F.lit(0.0), 1 - F.abs(F.greatest(F.lit(0.0), F.least(place, (n - 1).cast("double"))) - s))
        elif how == "lanczos":  # beyond an edge lies the edge's own pixel
            weight = _lanczos(place - s)
            for k in range(1, LANCZOS + 1):
                weight = weight + F.when(s == 0, _lanczos(place + k)).otherwise(0.0) + F.when(s == n - 1, _lanczos(place - (n - 1 + k))).otherwise(0.0)
        else:
            raise ValueError(f"unknown way to resize {how!r}")
    targets = F.when(low <= high, F.sequence(low, high))
    weighed = df.select(*keys, *columns, at, old, new, F.explode(targets).alias("_t")).withColumn("_w", weight.cast("double")).where("_w <> 0")
    means = [(F.sum(F.col(c).cast("double") * F.col("_w")) / F.sum("_w")).alias(c) for c in columns]
    return weighed.groupBy(*keys, F.col("_t").cast("int").alias(at)).agg(*means)


def resized(pixels: DataFrame, size: DataFrame, columns: Sequence[str] = RGB, how: str = "area") -> DataFrame:
    """The images in another size. size: image, lines, length (as they are), new_lines, new_length; images that it lacks go.

    area: each new pixel is the mean of what it covers. linear, lanczos (a window of eight): values between the old pixels'
    centres. nearest: the value of the pixel that it begins in (flags as numbers, too).
    """
    # dealt out by lines each time: a pixel becomes several rows, and an image is not one task's
    rows = dealt(pixels.join(size, "image").select("image", "y", "x", *columns, "lines", "length", "new_lines", "new_length"), "image", "y")
    wide = dealt(_along(rows, "x", "length", "new_length", ["image", "y", "lines", "new_lines"], columns, how), "image", "x")
    return _along(wide, "y", "lines", "new_lines", ["image", "x"], columns, how).select("image", "y", "x", *columns)


def _scaled(n: str, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.col(n) * scale).cast("int"))


def shrunk(pixels: DataFrame, side: int, columns: Sequence[str] = RGB, how: str = "lanczos") -> DataFrame:
    """Images no longer than ``side``; smaller ones keep their size."""
    scale = F.least(F.lit(1.0), side / F.greatest("lines", "length"))
    return resized(pixels, sizes(pixels).select("*", _scaled("lines", scale).alias("new_lines"), _scaled("length", scale).alias("new_length")), columns, how)


def fitted(pixels: DataFrame, side: int, step: int = MODEL_STEP, columns: Sequence[str] = RGB, how: str = "lanczos") -> DataFrame:
    """Images whose longer side is ``side``, both sides multiples of step."""
    to = lambda n: F.greatest(F.lit(step), F.floor(F.col(n) * (side / F.greatest("lines", "length")) / step).cast("int") * step)
    return resized(pixels, sizes(pixels).select("*", to("lines").alias("new_lines"), to("length").alias("new_length")), columns, how)


def prepared(pixels: DataFrame, masks: Sequence[str] = (), side: int = MODEL_SIDE, step: int = MODEL_STEP) -> DataFrame:
    """Photo and masks (flags) for a model: no longer than side, cut to multiples of step; colours by area, masks by nearest pixel."""
    size = sizes(pixels)
    scale = F.least(F.lit(1.0), side / F.greatest("lines", "length"))
    size = size.select("*", _scaled("lines", scale).alias("new_lines"), _scaled("length", scale).alias("new_length"))
    # the exact product may lie under a whole number by rounding: the cut is taken as the scale gives it
    keep = size.select("image", *((F.floor(F.floor(F.col(n) * scale) / step) * step).cast("int").alias(f"_{n}") for n in ("lines", "length")))
    out = resized(pixels, size, RGB)
    if masks:
        flags = resized(pixels.withColumns({m: F.col(m).cast("int") for m in masks}), size, masks, "nearest")
        out = out.join(flags.withColumns({m: F.col(m) > 0.5 for m in masks}), ["image", "y", "x"])
    return out.join(keep, "image").where("y < _lines AND x < _length").drop("_lines", "_length")


def canvas(images: DataFrame, side: int) -> DataFrame:
    """(image, y, x) of a square for each row of images."""
    return images.select("image", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))


def normalised(pixels: DataFrame, alpha: str = "alpha", side: int = SIDE, fill: float = FILL) -> DataFrame:
    """(image, y, x, r, g, b, alpha): the item (alpha over a half) cut out and scaled to ``fill`` of a white square, in its middle.

    Colours are resized by area if they shrink and by lanczos if they grow, alpha (0 to 1) linearly. An image without an item goes.
    """
    inside = F.col(alpha) > 0.5
    box = boxes(pixels, inside)
    lines, length = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    scale = side * fill / F.greatest(lines, length)
    size = box.select("image", lines.alias("lines"), length.alias("length"), scale.alias("_scale"), *(F.greatest(F.lit(1), F.bround(n * scale).cast("int")).alias(f"new_{c}") for c, n in (("lines", lines), ("length", length))))
    item = pixels.join(box, "image").where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    item = item.select("image", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *RGB, F.col(alpha).alias("alpha"))
    colours = resized(item, size.where("_scale <= 1").drop("_scale"), RGB).unionByName(resized(item, size.where("_scale > 1").drop("_scale"), RGB, "lanczos"))
    made = colours.join(resized(item, size.drop("_scale"), ["alpha"], "linear"), ["image", "y", "x"])
    corner = size.select("image", *(F.floor((side - F.col(f"new_{n}")) / 2).cast("int").alias(f"_{n}") for n in ("lines", "length")))
    made = made.join(corner, "image").select("image", (F.col("y") + F.col("_lines")).alias("y"), (F.col("x") + F.col("_length")).alias("x"), *RGB, "alpha")
    whole = canvas(box, side).join(made, ["image", "y", "x"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
    shown = {c: F.coalesce(F.col("alpha") * F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c))), F.lit(0.0)) + (1 - F.col("alpha")) * 255 for c in RGB}
    return whole.withColumns(shown).select("image", "y", "x", *RGB, "alpha")


# --- smoothing -----------------------------------------------------------------------------------------


def gaussian(sigma: float) -> list[float]:
    """Weights of 0, 1, 2, ... steps; their sum over both sides is 1."""
    reach = (round(sigma * 8 + 1) | 1) // 2
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(reach + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def _mirrored(df: DataFrame, at: str, n: str, reach: int) -> DataFrame:
    """df with the pixels beyond its ends, mirrored at the last ones."""
    s, last = F.col(at), F.col(n) - 1
    places = F.array(s, F.when(s.between(1, reach), -s), F.when((s < last) & (s >= last - reach), 2 * last - s))
    return df.select(*(c for c in df.columns if c != at), F.explode(F.array_compact(places)).alias(at))


def blurred(pixels: DataFrame, columns: Sequence[str], sigma: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """pixels with the columns smoothed by a Gaussian; images are mirrored at their edges. A side shorter than the weights' reach counts what is there once."""
    weights = gaussian(sigma)
    reach = len(weights) - 1
    out = pixels.join(pixels.groupBy(*keys).agg((F.max("y") + 1).alias("_lines"), (F.max("x") + 1).alias("_length")), list(keys))
    for at, other, n in (("x", "y", "_length"), ("y", "x", "_lines")):
        w = Window.partitionBy(*keys, other).orderBy(at)
        step = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) + F.coalesce(F.lead(c, k).over(w), F.lit(0.0))  # noqa: B023, E731
        made = {c: sum((step(c, k) * weights[k] for k in range(1, reach + 1)), F.col(c) * weights[0]) for c in columns}
        out = _mirrored(out.withColumns({c: F.col(c).cast("double") for c in columns}), at, n, reach).withColumns(made).where((F.col(at) >= 0) & (F.col(at) < F.col(n)))
    return out.drop("_lines", "_length")


def box_radii(sigma: float, times: int = 3) -> list[int]:
    """Radii of boxes that, one after another, smooth like a Gaussian."""
    ideal = math.sqrt(12 * sigma * sigma / times + 1)
    low = int(ideal) - (int(ideal) % 2 == 0)
    narrow = round((12 * sigma * sigma - times * low * low - 4 * times * low - 3 * times) / (-4 * low - 4))
    return [((low if i < narrow else low + 2) - 1) // 2 for i in range(times)]


def box_blurred(pixels: DataFrame, columns: Sequence[str], sigma: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """pixels with the columns smoothed by three boxes, for a sigma of any size: the mean of a box is a difference of two running sums.

    At an edge a box is what is left of it.
    """
    out = pixels.withColumns({c: F.col(c).cast("double") for c in columns})
    for at, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*keys, other).orderBy(at)
        line, so_far = Window.partitionBy(*keys, other), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for r in (r for r in box_radii(sigma) if r > 0):
            out = out.withColumns({**{f"_s_{c}": F.sum(c).over(so_far) for c in columns}, "_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(line)})
            out = out.withColumns({f"_t_{c}": F.max(F.when(F.col("_i") == F.col("_n"), F.col(f"_s_{c}"))).over(line) for c in columns})
            count = F.least(F.col("_i") + r, F.col("_n")) - F.greatest(F.col("_i") - r, F.lit(1)) + 1
            mean = lambda c: (F.coalesce(F.lead(f"_s_{c}", r).over(w), F.col(f"_t_{c}")) - F.coalesce(F.lag(f"_s_{c}", r + 1).over(w), F.lit(0.0))) / count  # noqa: B023, E731
            out = out.withColumns({c: mean(c) for c in columns}).drop("_i", "_n", *(f"_{k}_{c}" for k in "st" for c in columns))
    return out


def feathered(pixels: DataFrame, mask: str, px: int, name: str = "alpha") -> DataFrame:
    """pixels with an alpha from 0 to 1 that goes over about px pixels on the mask's edge."""
    soft = blurred(pixels.withColumn(name, F.col(mask).cast("double")), [name], max(px, 1) / 2)
    return soft.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name))))


def changed(pixels: DataFrame, other: Sequence[str] = ("r2", "g2", "b2"), threshold: float = CHANGED_DELTA, share: float = CHANGED_SHARE) -> DataFrame:
    """(image, line, a, b): the runs of an image that differ from its other version (columns ``other``), in pieces of a share of it or more.

    Both are smoothed in Lab, compared by CIEDE2000, single pixels are taken off and gaps closed.
    """
    flat = pixels.select("image", "y", "x", color.srgb_to_lab(*(F.col(c) for c in RGB)).alias("_p"), color.srgb_to_lab(*(F.col(c) for c in other)).alias("_q"))
    flat = cut(flat.select("image", "y", "x", *(F.col(f"_{k}.{c}").alias(f"{k}_{c}") for k in "pq" for c in "lab")))
    soft = cut(blurred(flat, [f"{k}_{c}" for k in "pq" for c in "lab"], CHANGED_SIGMA))
    lab = lambda k: F.struct(*(F.col(f"{k}_{c}").alias(c) for c in "lab"))
    gap = color.with_delta_e(soft.select("image", "y", "x", lab("p").alias("p"), lab("q").alias("q")), "p", "q", "gap")
    size, shape = sizes(pixels), runs.disc(CHANGED_DISC)
    spots = cut(runs.runs_of(gap, F.col("gap") > threshold))
    found = runs.closed(runs.opened(spots, shape, size), shape, size, times=2)
    pieces = runs.labelled(found)
    large = runs.parts(pieces).join(size, "image").where(F.col("area") >= share * F.col("lines") * F.col("length"))
    return pieces.join(large.select("image", "part"), ["image", "part"]).select("image", *runs.RUN)


# --- gathering -----------------------------------------------------------------------------------------


def tile_of(place: Column) -> Column:
    """The tile, along one side, of a place: its lower neighbour and the next one are both there."""
    return F.floor((F.floor(place) + 1) / TILE).cast("int")


def tiled(pixels: DataFrame, columns: dict[str, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, _ty, _tx, _y0, _x0, _h, _w, _at, _v_<column>): the pixels in tiles that share a line with the next ones, their values in arrays by y and x.

    _at is null where no pixel is missing in the tile's frame, else it says which pixels are there. Nulls become what ``columns`` gives; a pixel that is
    there twice counts as the sum.
    """
    tiles = {c: F.explode(F.array_distinct(F.array(tile_of(F.col(c) - 1), tile_of(F.col(c))))) for c in "yx"}
    rows = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.coalesce(F.col(c).cast("double"), F.lit(float(out))).alias(f"_v_{c}") for c, out in columns.items()))
    spot = [*keys, "_ty", "_tx"]
    rows = dealt(rows.withColumn("_ty", tiles["y"]).withColumn("_tx", tiles["x"]), *spot)
    once = rows.groupBy(*spot, "y", "x").agg(*(F.sum(f"_v_{c}").alias(f"_v_{c}") for c in columns))
    frame = [f(c).alias(f"_{c}{k}") for c in "yx" for k, f in ((0, F.min), (1, F.max))]
    packed = once.groupBy(*spot).agg(*frame, F.sort_array(F.collect_list(F.struct(_code(F.col("y"), F.col("x")).alias("at"), *(f"_v_{c}" for c in columns)))).alias("_p"))
    packed = packed.select(*spot, "_y0", "_x0", (F.col("_y1") - F.col("_y0") + 1).alias("_h"), (F.col("_x1") - F.col("_x0") + 1).alias("_w"), "_p")
    there = F.when(F.size("_p") < F.col("_h") * F.col("_w"), F.col("_p.at"))
    return packed.select(*spot, "_y0", "_x0", "_h", "_w", there.alias("_at"), *(F.col(f"_p._v_{c}").alias(f"_v_{c}") for c in columns))


def _code(y: Column, x: Column) -> Column:
    return y.cast("long") * F.lit(1 << 32) + x


def gathered(pixels: DataFrame, wanted: DataFrame, columns: dict[str, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """wanted (keys, ..., sx, sy) with the columns' values at places between pixels, bilinearly; ``columns`` says what lies outside.

    Other columns of wanted must tell its rows apart. A place goes to the one tile that has the pixels around it, and is summed up there.
    """
    rest = [c for c in wanted.columns if c not in ("sx", "sy")]
    asked = wanted.where("sx IS NOT NULL AND sy IS NOT NULL").withColumns({f"_t{c}": tile_of(F.col(f"s{c}")) for c in "xy"})
    met = asked.join(tiled(pixels, columns, keys), [*keys, "_ty", "_tx"], "left").withColumns({f"_{c}": F.floor(f"s{c}").cast("int") for c in "xy"})
    part = {c: F.col(f"s{c}") - F.floor(f"s{c}") for c in "xy"}
    places, weights, taps = [], [], [(i, j) for i in (0, 1) for j in (0, 1)]
    for i, j in taps:
        x, y = F.col("_x") + i, F.col("_y") + j
        inside = (y >= F.col("_y0")) & (y < F.col("_y0") + F.col("_h")) & (x >= F.col("_x0")) & (x < F.col("_x0") + F.col("_w"))
        at = F.when(F.col("_at").isNull(), (y - F.col("_y0")) * F.col("_w") + x - F.col("_x0")).otherwise(F.array_position("_at", _code(y, x)).cast("int") - 1)
        places.append(F.when(inside, at).alias(f"_i{i}{j}"))
        weights.append(((part["x"] if i else 1 - part["x"]) * (part["y"] if j else 1 - part["y"])).alias(f"_w{i}{j}"))
    found = met.select(*rest, *(F.col(f"_v_{c}") for c in columns), *places, *weights)
    value = lambda c, out, k: F.when(F.col(f"_w{k}") > 0, F.col(f"_w{k}") * F.coalesce(F.get(f"_v_{c}", F.col(f"_i{k}")), F.lit(float(out)))).otherwise(0.0)
    return found.select(*rest, *(sum((value(c, out, f"{i}{j}") for i, j in taps), F.lit(0.0)).alias(c) for c, out in columns.items()))
