"""Colour columns: sRGB to CIELAB, CIEDE2000, nearest named colour. All in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims

D = F.lit


def _linear(v: Column) -> Column:
    c = v / D(255.0)
    return F.when(c <= 0.04045, c / D(12.92)).otherwise(F.pow((c + D(0.055)) / D(1.055), D(2.4)))


def srgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) under D65, of sRGB values from 0 to 255."""
    r, g, b = (_linear(v.cast("double")) for v in (r, g, b))
    knee = (6 / 29) ** 3

    def curve(x: Column) -> Column:
        return F.when(x > knee, F.cbrt(x)).otherwise(x / D(3 * (6 / 29) ** 2) + D(4 / 29))

    x, y, z = (curve((r * D(m[0]) + g * D(m[1]) + b * D(m[2])) / D(w)) for m, w in zip(dims.SRGB_TO_XYZ, dims.WHITE, strict=True))
    return F.struct((D(116.0) * y - D(16.0)).alias("l"), (D(500.0) * (x - y)).alias("a"), (D(200.0) * (y - z)).alias("b"))


def lab_values(rgb: Sequence[int]) -> tuple[float, float, float]:
    """srgb_to_lab of a fixed colour, as numbers."""
    r, g, b = (c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (v / 255 for v in rgb))
    curve = lambda v: v ** (1 / 3) if v > (6 / 29) ** 3 else v / (3 * (6 / 29) ** 2) + 4 / 29
    x, y, z = (curve((r * m[0] + g * m[1] + b * m[2]) / w) for m, w in zip(dims.SRGB_TO_XYZ, dims.WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_of(rgb: Sequence[int]) -> Column:
    return F.struct(*(D(v).alias(n) for n, v in zip("lab", lab_values(rgb), strict=True)))


def hue(lab: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(lab["b"], lab["a"])), D(360.0))


def chroma(lab: Column) -> Column:
    return F.hypot(lab["a"], lab["b"])


def with_delta_e(df: DataFrame, one: str, two: str, out: str, k_l: float = 1.0, k_c: float = 1.0, k_h: float = 1.0) -> DataFrame:
    """df with the CIEDE2000 difference of two Lab structs. The steps are columns of their own, so none is computed twice."""
    seven = D(25.0**7)
    p1, p2 = F.col(one), F.col(two)
    step = [
        {"_c": (chroma(p1) + chroma(p2)) / 2},
        {"_g": D(0.5) * (1 - F.sqrt(F.pow("_c", D(7.0)) / (F.pow("_c", D(7.0)) + seven)))},
        {"_a1": (1 + F.col("_g")) * p1["a"], "_a2": (1 + F.col("_g")) * p2["a"]},
        {"_c1": F.hypot("_a1", p1["b"]), "_c2": F.hypot("_a2", p2["b"])},
        {"_h1": F.pmod(F.degrees(F.atan2(p1["b"], F.col("_a1"))), D(360.0)), "_h2": F.pmod(F.degrees(F.atan2(p2["b"], F.col("_a2"))), D(360.0))},
        {"_gap": F.col("_h2") - F.col("_h1"), "_sum": F.col("_h1") + F.col("_h2"), "_grey": F.col("_c1") * F.col("_c2") == 0},
        {
            "_dh": F.when(F.col("_grey"), 0.0).when(F.abs("_gap") <= 180, F.col("_gap")).when(F.col("_gap") > 0, F.col("_gap") - 360).otherwise(F.col("_gap") + 360),
            "_h": F.when(F.col("_grey"), F.col("_sum")).when(F.abs("_gap") <= 180, F.col("_sum") / 2).when(F.col("_sum") < 360, (F.col("_sum") + 360) / 2).otherwise((F.col("_sum") - 360) / 2),
            "_l": (p1["l"] + p2["l"]) / 2,
            "_c": (F.col("_c1") + F.col("_c2")) / 2,
        },
        {
            "_t": 1 - D(0.17) * F.cos(F.radians(F.col("_h") - 30)) + D(0.24) * F.cos(F.radians(2 * F.col("_h"))) + D(0.32) * F.cos(F.radians(3 * F.col("_h") + 6)) - D(0.20) * F.cos(F.radians(4 * F.col("_h") - 63)),
            "_rc": 2 * F.sqrt(F.pow("_c", D(7.0)) / (F.pow("_c", D(7.0)) + seven)),
            "_turn": 60 * F.exp(-F.pow((F.col("_h") - 275) / 25, D(2.0))),
            "_off": F.pow(F.col("_l") - 50, D(2.0)),
        },
        {
            "_x": (p2["l"] - p1["l"]) / (D(k_l) * (1 + D(0.015) * F.col("_off") / F.sqrt(20 + F.col("_off")))),
            "_y": (F.col("_c2") - F.col("_c1")) / (D(k_c) * (1 + D(0.045) * F.col("_c"))),
            "_z": 2 * F.sqrt(F.col("_c1") * F.col("_c2")) * F.sin(F.radians(F.col("_dh") / 2)) / (D(k_h) * (1 + D(0.015) * F.col("_c") * F.col("_t"))),
        },
        {out: F.sqrt(F.greatest(D(0.0), F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z") - F.sin(F.radians("_turn")) * F.col("_rc") * F.col("_y") * F.col("_z")))},
    ]
    names = df.columns
    for columns in step:
        df = df.withColumns(columns)
    return df.select(*names, out)


def delta_e_each(pairs: Column, keep: Sequence[str] = (), k_l: float = 1.0) -> Column:
    """array<struct(de, kept fields)> of an array of structs (l1, a1, b1, l2, a2, b2, kept fields): the CIEDE2000 difference of each, within the row.

    Each step is a pass over the array, so that no value is computed twice and no function is nested in another.
    """
    seven, rad = D(25.0**7), F.radians
    hue_of = lambda b, a: F.pmod(F.degrees(F.atan2(b, a)), D(360.0))
    ratio = lambda c: F.sqrt(F.pow(c, D(7.0)) / (F.pow(c, D(7.0)) + seven))
    steps = [
        lambda s: {"c": (F.hypot(s["a1"], s["b1"]) + F.hypot(s["a2"], s["b2"])) / 2},
        lambda s: {"g": 1 + D(0.5) * (1 - ratio(s["c"]))},
        lambda s: {"a1": s["g"] * s["a1"], "a2": s["g"] * s["a2"]},
        lambda s: {"c1": F.hypot(s["a1"], s["b1"]), "c2": F.hypot(s["a2"], s["b2"]), "h1": hue_of(s["b1"], s["a1"]), "h2": hue_of(s["b2"], s["a2"])},
        lambda s: {"gap": s["h2"] - s["h1"], "sum": s["h1"] + s["h2"], "grey": s["c1"] * s["c2"] == 0, "cm": (s["c1"] + s["c2"]) / 2, "off": F.pow((s["l1"] + s["l2"]) / 2 - 50, D(2.0))},
        lambda s: {
            "dh": F.when(s["grey"], 0.0).when(F.abs(s["gap"]) <= 180, s["gap"]).when(s["gap"] > 0, s["gap"] - 360).otherwise(s["gap"] + 360),
            "h": F.when(s["grey"], s["sum"]).when(F.abs(s["gap"]) <= 180, s["sum"] / 2).when(s["sum"] < 360, (s["sum"] + 360) / 2).otherwise((s["sum"] - 360) / 2),
        },
        lambda s: {"t": 1 - D(0.17) * F.cos(rad(s["h"] - 30)) + D(0.24) * F.cos(rad(2 * s["h"])) + D(0.32) * F.cos(rad(3 * s["h"] + 6)) - D(0.20) * F.cos(rad(4 * s["h"] - 63))},
        lambda s: {
            "x": (s["l2"] - s["l1"]) / (D(k_l) * (1 + D(0.015) * s["off"] / F.sqrt(20 + s["off"]))),
            "y": (s["c2"] - s["c1"]) / (1 + D(0.045) * s["cm"]),
            "z": 2 * F.sqrt(s["c1"] * s["c2"]) * F.sin(rad(s["dh"] / 2)) / (1 + D(0.015) * s["cm"] * s["t"]),
            "turn": F.sin(rad(60 * F.exp(-F.pow((s["h"] - 275) / 25, D(2.0))))) * 2 * ratio(s["cm"]),
        },
        lambda s: {"de": F.sqrt(F.greatest(D(0.0), s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"] - s["turn"] * s["y"] * s["z"]))},
    ]
    names = ["l1", "a1", "b1", "l2", "a2", "b2", *keep]
    for k, step in enumerate(steps):
        names = [*(n for n in names if n not in _NEW[k]), *_NEW[k]] if k + 1 < len(steps) else ["de", *keep]
        pairs = F.transform(pairs, _step(step, tuple(names)))
    return pairs


def _step(step: Callable[[Column], dict[str, Column]], names: tuple[str, ...]) -> Callable[[Column], Column]:
    def apply(s: Column) -> Column:
        new = step(s)
        return F.struct(*((new[n] if n in new else s[n]).alias(n) for n in names))

    return apply


#: The fields that each step of delta_e_each adds.
_NEW = (("c",), ("g",), (), ("c1", "c2", "h1", "h2"), ("gap", "sum", "grey", "cm", "off"), ("dh", "h"), ("t",), ("x", "y", "z", "turn"), ("de",))


def _pair(one: Column, two: Column, **more: Column) -> Column:
    return F.struct(*(one[n].alias(f"{n}1") for n in "lab"), *(two[n].alias(f"{n}2") for n in "lab"), *(c.alias(n) for n, c in more.items()))


def delta_e(one: Column, two: Column, k_l: float = 1.0) -> Column:
    """The CIEDE2000 difference of two Lab structs as one expression."""
    return F.get(delta_e_each(F.array(_pair(one, two)), (), k_l), F.lit(0))["de"]


def reference_colors(spark) -> DataFrame:
    rows = [(i, n, *rgb) for i, (n, rgb) in enumerate(dims.COLORS.items())]
    df = spark.createDataFrame(rows, "ord int, name string, r int, g int, b int")
    return df.select("ord", "name", srgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("ref"))


def nearest_color(df: DataFrame, key: str, lab: str) -> DataFrame:
    """(key, color, delta_e): the named colour nearest to a Lab struct; the earlier in the table on ties. The table is of fixed size."""
    rows = [(i, n, *rgb) for i, (n, rgb) in enumerate(dims.COLORS.items())]
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), lab_of(rgb).alias("ref")) for i, n, *rgb in rows))
    best = F.array_min(delta_e_each(F.transform(table, lambda c: _pair(F.col(lab), c["ref"], ord=c["ord"], name=c["name"])), ("ord", "name")))
    return df.select(key, best.alias("_b")).select(key, F.col("_b.name").alias("color"), F.col("_b.de").alias("delta_e"))


def nearest_center(point: Column, centers: Sequence, distance: Callable[..., Column]) -> Column:
    """The least distance of a point to a few centres, within the row."""
    return F.array_min(F.array(*(distance(point, *c) for c in centers)))


def palette_distance(one: Column, two: Column, k_l: float = 2.0) -> Column:
    """The weighted mean of how far each colour of a palette is from the nearest of another. Palettes: arrays of struct(l, a, b, w), a handful."""
    pairs = F.flatten(F.transform(one, lambda p, i: F.transform(two, lambda q: _pair(p, q, i=i))))
    found = delta_e_each(pairs, ("i",), k_l)
    least = F.transform(F.sequence(F.lit(0), F.size(one) - 1), lambda i: F.array_min(F.transform(F.filter(found, lambda x: x["i"] == i), lambda x: x["de"])))
    weights = F.transform(one, lambda p: p["w"])
    total = F.aggregate(F.zip_with(least, weights, lambda d, w: d * w), F.lit(0.0), lambda s, x: s + x)
    return total / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.printf(F.lit("#%02X%02X%02X"), *(F.bround(v.cast("double")).cast("int") for v in (r, g, b)))
