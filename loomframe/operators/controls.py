"""Made cases over pixel tables: pictures that a check must reject, garments hidden on purpose, accessories laid on, and plain-ground items.

Every draw is a hash of the seed and of the image, so a case comes out the same in any run. Images meet by (image, y, x), so one
that many others draw is spread over its pixels; per image there is one row of geometry, joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import drawn
from . import pixels as px
from . import resample, runs
from .relational import cut, running_sums

AT, RGB = px.AT, px.RGB
#: Kinds of made failures, their measures, the white frame and the edge of crops.
NEGATIVES = ("strip", "half", "merge", "pair", "marker", "grey")
STRIP, STRIP_OFF, GAP, PATCH, PATCH_ROOM = (0.12, 0.35), (-0.05, 0.05), (0.1, 0.3), (0.2, 0.45), 0.3
FRAME, CROP_PAD, LINE, LINE_SHARE, MARK_REACH = 0.86, 0.05, 3, 0.008, 4
SIDES, DARK, HUE, RESULT_SIDE, NOT_WHITE = (0.38, 0.62), (0.35, 0.45), 120.0, 768, 740
#: A pasted garment's width and height against the one below, what it may hide, and what must still show.
WIDEN, MAX_TALL, EDGE = (1.05, 1.3), 1.35, 0.8
HIDDEN, LEAST_VISIBLE = (0.3, 0.95), 0.05
#: Accessories by category, the least area of each kind, and where each is laid: extent, middle, top, as shares of the garment's box.
ACCESSORIES = {"tie": "tie", "belt": "belt", "scarf": "scarf", "bag, wallet": "bag"}
LEAST_AREA = {"tie": 1500, "belt": 1200, "scarf": 4000, "bag": 6000}
LAID = {
    "tie": ((0.45, 0.7), (0.46, 0.54), (0.02, 0.08)),
    "belt": ((0.7, 1.0), (0.5, 0.5), (0.6, 0.8)),
    "scarf": ((0.4, 0.65), (0.4, 0.6), (0.0, 0.05)),
    "bag": ((0.3, 0.5), (0.25, 0.75), (0.3, 0.55)),
}
#: The working side, the distance from the ground and the number of a plain photo's items.
WORK_SIDE, FROM_GROUND, MAX_ITEMS = 512, 34.0, 12


def _between(limits: tuple[float, float], draw: Column) -> Column:
    return limits[0] + (limits[1] - limits[0]) * draw


def _seated(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(image, y, x, r, g, b): white squares of ``side`` with the given pixels of the frame (x0, y0, x1, y1) in the middle."""
    for c in "xy":
        frames = frames.withColumn(f"_{c}", F.floor((F.col("side") - (F.col(f"{c}1") - F.col(f"{c}0"))) / 2).cast("int") - F.col(f"{c}0"))
    moved = pixels.join(frames.select("image", "_x", "_y"), "image").select("image", (F.col("y") + F.col("_y")).alias("y"), (F.col("x") + F.col("_x")).alias("x"), *RGB)
    grid = frames.select("image", "side")
    for c in "yx":
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    return grid.join(moved, AT, "left").select(*AT, *(F.coalesce(c, F.lit(255)).alias(c) for c in RGB))


def _sized(pixels: DataFrame, size: int | None) -> DataFrame:
    if size is None:
        return pixels
    known = resample.sizes(pixels).withColumns({"new_lines": F.lit(size), "new_length": F.lit(size)})
    whole = resample.resized(pixels, known, RGB, "lanczos")
    return whole.select(*AT, *(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c).cast("int"))).alias(c) for c in RGB))


def on_white(pixels: DataFrame, flag: Column, size: int | None = None, fill: float = FRAME) -> DataFrame:
    """(image, y, x, r, g, b): the flagged pixels alone in the middle of a white square, whose side is the longer one of their box over ``fill``.

    With a size all squares are made that large. An image without a flagged pixel is white: one pixel, or all of the size.
    """
    images = pixels.select("image").distinct().join(px.boxes(pixels, flag), "image", "left")
    frames = images.select("image", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    side = F.greatest(F.lit(1), F.floor(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / fill).cast("int"))
    return _sized(_seated(pixels.where(flag), frames.withColumn("side", side)), size)


def masked_crop(pixels: DataFrame, flag: Column, pad: float = CROP_PAD, size: int | None = None) -> DataFrame:
    """(image, y, x, r, g, b): the flagged pixels' box with some room, all else white, in a white square. An image without a flagged pixel has no crop."""
    box, whole = px.boxes(pixels, flag), resample.sizes(pixels)
    room = {c: F.floor((F.col(f"{c}1") - F.col(f"{c}0")) * pad).cast("int") for c in "xy"}
    ends = {"x": F.col("length"), "y": F.col("lines")}
    frames = box.join(whole, "image").select("image", *(F.greatest(F.lit(0), F.col(f"{c}0") - room[c]).alias(f"{c}0") for c in "xy"), *(F.least(ends[c], F.col(f"{c}1") + room[c]).alias(f"{c}1") for c in "xy"))
    return _sized(_seated(pixels.where(flag), frames.withColumn("side", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))), size)


# --- failures made on purpose --------------------------------------------------------------------------


def dealt(bank: DataFrame, seed: int) -> DataFrame:
    """(image, kind, other): a kind of failure for each item of the bank (image, outer), and another item, an outer one for merge (any where there is none).

    Items are numbered once and drawn by number, so nobody meets the whole bank. An item may draw itself.
    """
    of = lambda rows, name: running_sums(rows.select("image").withColumn("_one", F.lit(0)), ["_one"], ["image"], {"k": F.lit(1)}).select(F.col("image").alias("other"), F.col("k_before").alias("_at"), F.lit(name).alias("_pool"))
    pools = of(bank, "all").unionByName(of(bank.where("outer"), "outer"))
    counts = bank.agg(F.count(F.lit(1)).alias("_all"), F.count_if("outer").alias("_outers"))  # one row
    draw = lambda name, n: F.floor(drawn(seed, F.col("image"), name) * n)
    kind = F.element_at(F.array(*map(F.lit, NEGATIVES)), (draw("kind", F.lit(len(NEGATIVES))) + 1).cast("int"))
    asked = bank.select("image").crossJoin(F.broadcast(counts)).withColumn("kind", kind)
    outer = (F.col("kind") == "merge") & (F.col("_outers") > 0)
    asked = asked.withColumns({"_pool": F.when(outer, "outer").otherwise("all"), "_at": draw("other", F.when(outer, F.col("_outers")).otherwise(F.col("_all")))})
    return asked.join(pools, ["_pool", "_at"]).select("image", "kind", "other")


def negatives(products: DataFrame, deal: DataFrame, seed: int, size: int, mask: str = "m") -> DataFrame:
    """(image, kind, y, x, r, g, b): each product spoilt in the way that deal (image, kind, other) gives it, on a white square of size.

    strip: only an upright strip of the middle. half: one half. merge: the other's sides over it. pair: both side by side (pressed into the
    square for half of them, else twice as wide). marker: with a green outline. grey: a part painted grey. products: image, y, x, r, g, b and a mask;
    products without a masked pixel have no negative.
    """
    rows = products.select(*AT, *RGB, F.col(mask).alias("m"))
    facts = _facts(rows, deal, seed)
    single = on_white(_spoilt(rows, facts.where("kind <> 'pair'")), F.col("kept"), size).join(deal.where("kind <> 'pair'").select("image", "kind"), "image")
    return single.select("image", "kind", "y", "x", *RGB).unionByName(_pairs(rows, facts.where("kind = 'pair'"), size))


def spoilt(products: DataFrame, deal: DataFrame, seed: int, mask: str = "m") -> DataFrame:
    """(image, kind, y, x, r, g, b, kept): the pixels of negatives() where they lie in the picture, and which of them go on white; pairs are left out."""
    rows = products.select(*AT, *RGB, F.col(mask).alias("m"))
    return _spoilt(rows, _facts(rows, deal.where("kind <> 'pair'"), seed))


def _facts(rows: DataFrame, deal: DataFrame, seed: int) -> DataFrame:
    one = lambda name: drawn(seed, F.col("image"), name)
    facts = deal.join(px.boxes(rows, F.col("m")), "image").join(resample.sizes(rows), "image").withColumn("w", F.col("x1") - F.col("x0"))
    return cut(facts.withColumns({"u": one("first"), "v": one("second")}))


def _spoilt(rows: DataFrame, facts: DataFrame) -> DataFrame:
    known = rows.join(facts, "image")
    whole = lambda c: F.floor(c).cast("int")
    middle, half = (F.col("x0") + F.col("x1")) / 2 + _between(STRIP_OFF, F.col("v")) * F.col("w"), _between(STRIP, F.col("u")) * F.col("w") / 2
    in_strip = (F.col("x") >= whole(middle - half)) & (F.col("x") < whole(middle + half))
    way, mid = F.floor(F.col("u") * 4), {c: whole((F.col(f"{c}0") + F.col(f"{c}1")) / 2) for c in "xy"}
    in_half = F.when(way == 0, F.col("y") < mid["y"]).when(way == 1, F.col("y") >= mid["y"]).when(way == 2, F.col("x") < mid["x"]).otherwise(F.col("x") >= mid["x"])
    plain = known.where("kind in ('strip', 'half', 'grey')").withColumn("kept", F.col("m") & F.when(F.col("kind") == "strip", in_strip).when(F.col("kind") == "half", in_half).otherwise(True))
    left = whole(F.col("x0") + F.col("u") * F.col("w") * (1 - PATCH_ROOM))
    patch = (F.col("kind") == "grey") & F.col("m") & (F.col("x") >= left) & (F.col("x") < left + whole(_between(PATCH, F.col("v")) * F.col("w")))
    plain = px.painted(plain, patch, px.GREY)
    columns = ["image", "kind", "y", "x", *RGB, "kept"]

    over = rows.where("m").select(F.col("image").alias("other"), "y", "x", *(F.col(c).alias(f"_{c}") for c in RGB))
    gap, centre = whole(_between(GAP, F.col("u")) * F.col("length") / 2), whole(F.col("length") / 2)
    merged = known.where("kind = 'merge'").join(over, ["other", "y", "x"], "left")
    covers = F.col("_r").isNotNull() & ((F.col("x") < centre - gap) | (F.col("x") >= centre + gap))
    merged = merged.withColumns({c: F.when(covers, F.col(f"_{c}")).otherwise(F.col(c)) for c in RGB}).withColumn("kept", F.col("m") | covers)

    marked = known.where("kind = 'marker'")
    width = F.greatest(F.lit(LINE), whole(LINE_SHARE * F.greatest("lines", "length")))
    line = px.with_outline(marked, "m").where("outline").select(*AT, whole(width / 2).alias("_half"))
    for c in ("x", "y"):
        near = F.explode(F.sequence(F.col(c) - F.col("_half"), F.col(c) + F.col("_half")))
        line = line.select(*(near.alias(c) if k == c else F.col(k) for k in (*AT, "_half"))).distinct()
    room = px.dilated(marked.where("m"), MARK_REACH).withColumn("kept", F.lit(True))
    marked = marked.join(line.select(*AT, F.lit(True).alias("_line")), AT, "left").join(room, AT, "left")
    marked = px.painted(marked, F.coalesce("_line", F.lit(False)), px.MARK).withColumn("kept", F.coalesce("kept", F.lit(False)))

    return plain.select(*columns).unionByName(merged.select(*columns)).unionByName(marked.select(*columns))


def _pairs(rows: DataFrame, facts: DataFrame, size: int) -> DataFrame:
    who = facts.select("image", F.posexplode(F.array("image", "other")).alias("place", "shown"), (F.col("u") < 0.5).alias("pressed"))
    own = F.struct("image", "place")
    pixels = who.join(rows.withColumnRenamed("image", "shown"), "shown").select(own.alias("image"), "y", "x", *RGB, "m", "pressed")
    side_by_side = on_white(pixels, F.col("m"), size).select("image.image", "y", (F.col("x") + F.col("image.place") * size).alias("x"), *RGB)
    known = facts.select("image", (F.col("u") < 0.5).alias("pressed"))
    both = side_by_side.join(known, "image")
    small = resample.resized(both.where("pressed"), known.where("pressed").select("image", F.lit(size).alias("lines"), F.lit(2 * size).alias("length"), F.lit(size).alias("new_lines"), F.lit(size).alias("new_length")), RGB, "area")
    small = small.select(*AT, *(F.bround(c).cast("int").alias(c) for c in RGB))
    return both.where("not pressed").select(*AT, *RGB).unionByName(small).select("image", F.lit("pair").alias("kind"), "y", "x", *RGB)


def candidates(photos: DataFrame, products: DataFrame, others: DataFrame, size: int = RESULT_SIDE) -> DataFrame:
    """(image, kind, y, x, r, g, b, m): what a check is calibrated on, one right result (pos) and six wrong ones for each photo.

    photos: image, y, x, r, g, b, inner, outer; products and others: image, y, x, r, g, b, m, the right item and a wrong one of the
    same photo. outer and strip are crops of the photo, of size; merge has the outer garment's median colour on its sides.
    """
    named = lambda rows, kind: rows.select("image", F.lit(kind).alias("kind"), "y", "x", *RGB, "m")
    out = named(products, "pos").unionByName(named(others, "other"))
    jacket = F.col("outer") & ~F.col("inner")
    for kind, flag in (("outer", jacket), ("strip", F.col("inner"))):
        out = out.unionByName(named(masked_crop(photos, flag, size=size).withColumn("m", F.col("r") + F.col("g") + F.col("b") < NOT_WHITE), kind))
    cloth = photos.where(jacket).groupBy("image").agg(*(F.floor(F.median(c)).cast("int").alias(f"_{c}") for c in RGB))
    sided = products.join(resample.sizes(products), "image").join(cloth, "image", "left")
    side = F.col("m") & F.col("_r").isNotNull() & ((F.col("x") < F.floor(F.col("length") * SIDES[0])) | (F.col("x") >= F.floor(F.col("length") * SIDES[1])))
    out = out.unionByName(named(sided.withColumns({c: F.when(side, F.col(f"_{c}")).otherwise(F.col(c)) for c in RGB}), "merge"))
    out = out.unionByName(named(px.shifted(products, F.col("m"), sat=DARK[0], val=DARK[1]), "dark"))
    return out.unionByName(named(px.shifted(products, F.col("m"), hue=HUE), "hue"))


# --- garments hidden on purpose ------------------------------------------------------------------------


def occluded(photos: DataFrame, donors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image, donor, y, x, r, g, b, top, jacket, hidden): each photo with a donor's outer garment laid over its top, at the top's place and size.

    photos: image, y, x, r, g, b, top. donors: image, y, x, r, g, b, outer, inner. pairs: image, donor, widen (the width against the top's). Pairs whose
    photo has no top or whose donor has no garment have no rows.
    """
    above = px.boxes(donors, F.col("outer") | F.col("inner")).select(F.col("image").alias("donor"), *(F.col(f"{c}{i}").alias(f"s{c}{i}") for c in "xy" for i in (0, 1)))
    laid = pairs.join(px.boxes(photos, F.col("top")), "image").join(above, "donor")
    span = lambda p: F.greatest(F.lit(1), F.col(f"{p}1") - F.col(f"{p}0"))
    scale = F.least(F.col("widen") * (F.col("x1") - F.col("x0")) / span("sx"), MAX_TALL * (F.col("y1") - F.col("y0")) / span("sy"))
    laid = cut(laid.select("image", "donor", scale.alias("_s"), ((F.col("x0") + F.col("x1")) / 2).alias("_tx"), ((F.col("sx0") + F.col("sx1")) / 2).alias("_cx"), F.col("y0").alias("_ty"), F.col("sy0").alias("_cy")))
    rows = photos.select(*AT, *RGB, "top").join(laid, "image")
    at = {c: (F.col(c) - F.col(f"_t{c}")) / F.col("_s") + F.col(f"_c{c}") for c in "xy"}
    wanted = rows.select(F.col("image").alias("_photo"), F.col("donor").alias("image"), "y", "x", at["x"].alias("sx"), at["y"].alias("sy"))
    source = donors.select(*AT, *RGB, F.col("outer").cast("double").alias("alpha"))
    got = resample.gathered(source, wanted, {**dict.fromkeys(RGB, 0.0), "alpha": 0.0})
    got = got.select(F.col("_photo").alias("image"), F.col("image").alias("donor"), "y", "x", *(F.col(c).alias(f"_{c}") for c in RGB), "alpha")
    soft = resample.blurred(got, ["alpha"], EDGE, ["image", "donor"])
    both = rows.select("image", "donor", "y", "x", *RGB, "top").join(soft, ["image", "donor", "y", "x"])
    out = px.composite(both, [f"_{c}" for c in RGB], "alpha").withColumn("jacket", F.col("alpha") > 0.5)
    return out.select("image", "donor", "y", "x", *RGB, "top", "jacket", (F.col("top") & F.col("jacket")).alias("hidden"))


def hidden_shares(cases: DataFrame) -> DataFrame:
    """(image, donor, hidden_frac, inner_share, fits) of occluded(): how much of the top is hidden, what of both shows, and whether that makes a case."""
    top, hidden, jacket = (F.count_if(c).cast("double") for c in ("top", "hidden", "jacket"))
    found = cases.groupBy("image", "donor").agg((hidden / F.greatest(top, F.lit(1.0))).alias("hidden_frac"), ((top - hidden) / F.greatest(top - hidden + jacket, F.lit(1.0))).alias("inner_share"))
    return found.withColumn("fits", F.col("hidden_frac").between(*HIDDEN) & (F.col("inner_share") >= LEAST_VISIBLE))


def hidden_cases(photos: DataFrame, donors: DataFrame, tried: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The pixels (occluded()) and the records (hidden_shares(), attempt) of each photo's first donor that makes a case; tried: image, donor, attempt (a few for each photo)."""
    pairs = tried.withColumn("widen", _between(WIDEN, drawn(seed, F.col("image"), F.col("donor"), "widen")))
    made = cut(occluded(photos, donors, pairs))
    fits = hidden_shares(made).where("fits").join(tried.select("image", "donor", "attempt"), ["image", "donor"])
    first = fits.groupBy("image").agg(F.min_by(F.struct(*(c for c in fits.columns if c != "image")), F.struct("attempt", "donor")).alias("_f")).select("image", "_f.*")
    return made.join(first.select("image", "donor"), ["image", "donor"]), first


# --- accessories ---------------------------------------------------------------------------------------


def accessory_notes(notes: DataFrame, per_kind: int) -> DataFrame:
    """notes (file, ann, category, area, iscrowd, ...) with kind: the first per_kind of each kind by file and number, none too small or a crowd."""
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    least = F.when(F.lit(False), F.lit(None).cast("int"))
    for category, name in ACCESSORIES.items():
        kind, least = kind.when(F.col("category") == category, name), least.when(F.col("category") == category, LEAST_AREA[name])
    fit = notes.withColumn("kind", kind).where((F.col("area") >= least) & ~F.coalesce("iscrowd", F.lit(False)))
    w = Window.partitionBy("kind").orderBy("file", "ann")  # each task keeps per_kind rows a kind before the exchange
    return fit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_kind).drop("_n")


def with_pieces(products: DataFrame, pieces: DataFrame, deal: DataFrame, seed: int) -> DataFrame:
    """(image, y, x, r, g, b, m, piece, covered): products with an accessory laid on, where it is (and a pixel around it), and what of the garment it covers.

    products: image, y, x, r, g, b, m. pieces: image, y, x, r, g, b, alpha (0 to 1). deal: image, shown (a piece), kind. A belt that stands is turned by a quarter.
    """
    one = lambda name: drawn(seed, F.col("image"), name)
    size = resample.sizes(pieces).select(F.col("image").alias("shown"), "lines", "length")
    facts = deal.join(px.boxes(products, F.col("m")), "image").join(size, "shown")
    facts = facts.withColumn("_turn", (F.col("kind") == "belt") & (F.col("lines") > F.col("length")))
    tall, wide = F.when(F.col("_turn"), F.col("length")).otherwise(F.col("lines")), F.when(F.col("_turn"), F.col("lines")).otherwise(F.col("length"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    extent, middle, top = (F.when(F.lit(False), 0.0) for _ in range(3))
    for k, (a, b, c) in LAID.items():
        extent = extent.when(F.col("kind") == k, _between(a, one("extent")) * (w / wide if k in ("belt", "scarf") else h / tall))
        middle, top = middle.when(F.col("kind") == k, F.col("x0") + w * _between(b, one("middle"))), top.when(F.col("kind") == k, F.col("y0") + h * _between(c, one("top")))
    whole = lambda c: F.floor(c).cast("int")
    facts = facts.withColumns({"_tall": tall, "_wide": wide, "_scale": extent, "_mid": middle, "_top": whole(top)})
    facts = facts.withColumns({"new_lines": F.greatest(F.lit(4), whole(F.col("_tall") * F.col("_scale"))), "new_length": F.greatest(F.lit(4), whole(F.col("_wide") * F.col("_scale")))})
    facts = cut(facts.withColumn("_left", whole(F.col("_mid") - F.col("new_length") / 2)))
    laid = facts.select("image", "shown", "_turn", F.col("length").alias("_l")).join(pieces.withColumnRenamed("image", "shown"), "shown")
    turned = laid.select("image", F.when(F.col("_turn"), F.col("_l") - 1 - F.col("x")).otherwise(F.col("y")).alias("y"), F.when(F.col("_turn"), F.col("y")).otherwise(F.col("x")).alias("x"), *RGB, "alpha")
    sized = resample.resized(turned, facts.select("image", F.col("_tall").alias("lines"), F.col("_wide").alias("length"), "new_lines", "new_length"), [*RGB, "alpha"], "lanczos")
    over = sized.join(facts.select("image", "_top", "_left"), "image").select("image", (F.col("y") + F.col("_top")).alias("y"), (F.col("x") + F.col("_left")).alias("x"), *(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c))).alias(f"_{c}") for c in RGB), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("alpha"))).alias("_a"))
    over = cut(over)
    near = px.dilated(over.where("_a > 0.5"), 1).withColumn("piece", F.lit(True))
    rows = products.select(*AT, *RGB, "m").join(facts.select("image"), "image", "left_semi").join(over, AT, "left").join(near, AT, "left").withColumn("_a", F.coalesce("_a", F.lit(0.0)))
    rows = rows.withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(0.0)) for c in RGB})
    return px.composite(rows, [f"_{c}" for c in RGB], "_a").select(*AT, *RGB, "m", F.coalesce("piece", F.lit(False)).alias("piece"), (F.col("m") & (F.col("_a") > 0.5)).alias("covered"))


# --- items on a plain ground ---------------------------------------------------------------------------


def plain_items(pixels: DataFrame, side: int = WORK_SIDE, threshold: float = FROM_GROUND, most: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Items of photos on a plain ground: (image, item, area, score) and their runs (image, item, line, a, b), both at the working size.

    The ground is the edge's median colour; what lies further from it is filled, cut into components, and the ``most`` largest are
    the items, numbered from 0 (equal ones in reading order). score: the item's share of the photo.
    """
    scale = side / F.greatest("lines", "length")
    to = lambda n: F.greatest(F.lit(1), F.bround(F.col(n) * scale).cast("int"))
    sized = resample.sizes(pixels).select("*", to("lines").alias("new_lines"), to("length").alias("new_length"))
    small = cut(resample.resized(pixels, sized, RGB, "linear"))
    size = resample.sizes(small)
    ground = runs.runs_of(px.border_foreground(small, threshold), F.col("fg"))
    pieces = cut(runs.labelled(runs.without_holes(ground, size)))
    w = Window.partitionBy("image").orderBy(F.desc("area"), "part")
    found = runs.parts(pieces).withColumn("item", F.row_number().over(w) - 1).where(F.col("item") < most)
    items = found.join(size, "image").select("image", "item", "area", (F.col("area") / (F.col("lines") * F.col("length"))).alias("score"))
    return items, pieces.join(found.select("image", "part", "item"), ["image", "part"]).select("image", "item", *runs.RUN)


def case_masks(originals: DataFrame, packed: DataFrame, names: tuple[str, str, str] = ("jacket", "top", "hidden"), level: int = 127) -> DataFrame:
    """originals (image, y, x, ...) with three flags from a picture (image, y, x, r, g, b) that packs a mask in each channel; pixels that it lacks are in none."""
    flags = packed.select(*AT, *((F.col(c) > level).alias(n) for c, n in zip(RGB, names, strict=True)))
    return originals.join(flags, AT, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
