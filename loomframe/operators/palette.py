"""Palettes of pixels: clusters in Lab as rounds of aggregations, merged by CIEDE2000, and distances between palettes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, dims
from ..functions.hashing import drawn
from .relational import cut

MOST_PIXELS = 20_000

_TO_XYZ, _WHITE = np.array(dims.SRGB_TO_XYZ), np.array(dims.WHITE)


def to_lab(rgb: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb, float) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ _TO_XYZ.T / _WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    x, y, z = np.moveaxis(f, -1, 0)
    return np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=-1)


def delta_e(p: np.ndarray, q: np.ndarray, k_l: float = 1.0) -> np.ndarray:
    """CIEDE2000 over the last axis, broadcasting."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(np.asarray(p, float), -1, 0), np.moveaxis(np.asarray(q, float), -1, 0)
    seventh = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    g = 1.5 - 0.5 * seventh((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2)
    c1, c2 = np.hypot(g * a1, b1), np.hypot(g * a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, g * a1)) % 360, np.degrees(np.arctan2(b2, g * a2)) % 360
    grey = c1 * c2 == 0
    gap, far = h2 - h1, np.abs(h1 - h2) > 180
    turn = np.where(grey, 0.0, np.where(~far, gap, np.where(gap > 0, gap - 360, gap + 360)))
    mean = np.where(grey, h1 + h2, (h1 + h2) / 2 + np.where(far, np.where(h1 + h2 < 360, 180.0, -180.0), 0.0))
    cos = lambda d: np.cos(np.radians(d))
    t = 1 - 0.17 * cos(mean - 30) + 0.24 * cos(2 * mean) + 0.32 * cos(3 * mean + 6) - 0.20 * cos(4 * mean - 63)
    c, off = (c1 + c2) / 2, ((l1 + l2) / 2 - 50) ** 2
    dl = (l2 - l1) / (k_l * (1 + 0.015 * off / np.sqrt(20 + off)))
    dc = (c2 - c1) / (1 + 0.045 * c)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * c * t)
    rot = -np.sin(np.radians(60 * np.exp(-(((mean - 275) / 25) ** 2)))) * 2 * seventh(c)
    return np.sqrt(np.maximum(0.0, dl**2 + dc**2 + dh**2 + rot * dc * dh))


def dominant(found: Sequence[tuple[np.ndarray, int, np.ndarray]], least: float = 0.08, near: float = 8.0) -> list[tuple[str, float]]:
    """(colour name, share) of clusters (centre in Lab, size, sum of its RGB), by share; those nearer than ``near`` count as one, shares below ``least`` are left out."""
    groups: list[dict] = []
    for centre, size, rgb in found:
        home = next((g for g in groups if delta_e(g["lab"], centre) < near), None)
        if home is None:
            groups.append({"lab": np.asarray(centre, float), "n": size, "rgb": np.asarray(rgb, float)})
        else:
            n = home["n"] + size
            home.update(lab=(home["lab"] * home["n"] + np.asarray(centre, float) * size) / n, n=n, rgb=home["rgb"] + rgb)
    total = sum(g["n"] for g in groups)
    names, reference = list(dims.COLORS), to_lab(np.array(list(dims.COLORS.values())))
    name = lambda g: names[int(delta_e(to_lab(g["rgb"] / g["n"]), reference).argmin())]
    return [(name(g), round(g["n"] / total, 3)) for g in sorted(groups, key=lambda g: -g["n"]) if g["n"] >= least * total]


def primary_and_secondary(shares: Sequence[tuple[str, float]]) -> tuple[str | None, list[str]]:
    """The first name and the next two others; 멀티 if three colours have a fifth each."""
    if sum(s >= 0.2 for _, s in shares) >= 3:
        return "멀티", []
    names = list(dict.fromkeys(n for n, _ in shares))
    return (names[0], names[1:3]) if names else (None, [])


def palette_distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k_l: float = 2.0) -> float:
    """Mean difference of a's colours (by share) to the nearest of b's: directed."""
    return float((delta_e(a[0][:, None], b[0][None], k_l).min(axis=1) * a[1]).sum())


def border_band(shape: tuple[int, int], share: float = 0.03) -> np.ndarray:
    width = max(2, round(share * min(shape)))
    band = np.ones(shape, bool)
    band[width : shape[0] - width, width : shape[1] - width] = False
    return band


def foreground(lab: np.ndarray, threshold: float = 8.0) -> np.ndarray:
    """Pixels that differ from the border's median colour, opened, closed and filled."""
    from .masks import dilate, erode, fill_holes

    mask = delta_e(lab, np.median(lab[border_band(lab.shape[:2])], axis=0)) > threshold
    mask = dilate(erode(mask, 2), 2)
    return fill_holes(erode(dilate(mask, 4), 4))


# --- palettes of groups of any size --------------------------------------------------------------------


def sampled(pixels: DataFrame, key: str, at: Sequence[str], most: int = MOST_PIXELS, seed: int = 0) -> DataFrame:
    """pixels of which each group keeps ``most`` at most, all alike: the first by a hash of what tells a group's pixels apart (at).

    A group is counted, then only what lies under a limit by its count is sent on: ``most`` and eight deviations, so no task gets a large group. A group
    that is no larger stays as it is.
    """
    counts = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = pixels.join(counts, key).withColumn("_u", drawn(seed, *(F.col(c) for c in at)))
    rows = rows.where(F.col("_u") * F.col("_n") < most + 8 * most**0.5)
    w = Window.partitionBy(key).orderBy("_u", *at)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select(*pixels.columns)


def color_counts(pixels: DataFrame, key: str) -> DataFrame:
    """(key, r, g, b, n, lab): the distinct colours of each group, counted in part before they are sent. A null key is no group."""
    counts = pixels.where(F.col(key).isNotNull()).groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("lab", color.srgb_to_lab(F.col("r"), F.col("g"), F.col("b")))


def _gap(p: Column, q: Column) -> Column:
    return sum((F.pow(p[c] - q[c], F.lit(2.0)) for c in "lab"), F.lit(0.0))


def centres(counts: DataFrame, key: str, k: int, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(key, centres): k-means of color_counts(), centres as an array of struct(l, a, b); as many as the group has colours, k at most.

    Seeds are drawn by a race of hashes: of exponential times with a colour's count times its squared distance to the seeds
    so far as rate, the least wins. Then each round is one aggregation by group and centre; a centre without colours stays. Colours meet their group's few
    centres, and are never gathered. Rounds end early if no centre moves.
    """
    counts = cut(counts)
    race = lambda i, rate: -F.log(drawn(seed, str(i), F.col(key), F.col("r"), F.col("g"), F.col("b"))) / rate
    found = counts.groupBy(key).agg(F.array(F.min_by("lab", race(0, F.col("n")))).alias("centres"))
    for i in range(1, k):
        near = F.array_min(F.transform("centres", lambda c: _gap(c, F.col("lab"))))
        further = counts.join(found, key).withColumn("_d", near).where("_d > 0")
        drawn_next = further.groupBy(key).agg(F.min_by("lab", race(i, F.col("n") * F.col("_d"))).alias("_next"))
        found = cut(found.join(drawn_next, key, "left").select(key, F.when(F.col("_next").isNull(), F.col("centres")).otherwise(F.array_append("centres", F.col("_next"))).alias("centres")))
    for _ in range(rounds):
        sums = owned(counts, found, key).groupBy(key, "owner").agg(*(F.sum(F.col("n") * F.col(f"lab.{c}")).alias(c) for c in "lab"), F.sum("n").alias("n"))
        means = F.struct("owner", F.struct(*((F.col(c) / F.col("n")).alias(c) for c in "lab")).alias("mean"))
        new = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(means)).alias("_means"))
        moved = F.transform("centres", lambda c, i: F.coalesce(F.col("_means")[i], c))
        step = F.array_max(F.zip_with("centres", moved, _gap))
        told = cut(found.join(new, key).select(key, moved.alias("centres"), (step > 1e-12).alias("_moved")))
        found = told.select(key, "centres")
        if not told.where("_moved").limit(1).count():
            break
    return found


def owned(counts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """counts with owner, the number of the nearest centre; of equally near ones the first."""
    gaps = F.transform("centres", lambda c: _gap(c, F.col("lab")))
    return counts.join(found, key).withColumn("_g", gaps).withColumn("owner", (F.array_position("_g", F.array_min("_g")) - 1).cast("int")).drop("_g")


def color_clusters(pixels: DataFrame, key: str, k: int, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(key, owner, lab, n, share, r, g, b): the clusters that have pixels, with their share of the group and the sums of their colours."""
    counts = cut(color_counts(pixels, key))
    found = owned(counts, centres(counts, key, k, rounds, seed), key)
    out = found.groupBy(key, "owner").agg(F.first(F.get("centres", F.col("owner"))).alias("lab"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in "rgb"), F.sum("n").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def palettes(pixels: DataFrame, key: str, k: int = 4, rounds: int = 20, at: Sequence[str] | None = None, max_pixels: int = MOST_PIXELS) -> DataFrame:
    """(key, primary, secondary, shares) of groups of pixels (key, r, g, b): the main colours by name, clusters near to each other as one.

    With ``at`` (columns that tell a group's pixels apart) max_pixels of a group are looked at, without it all of them. Only the clusters of a group meet, k at most.
    """
    rows = pixels if at is None else sampled(pixels, key, at, max_pixels)
    found = color_clusters(rows, key, k, rounds).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("owner", "lab", "n", "r", "g", "b"))).alias("_c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = [dominant([(np.array([c["lab"][x] for x in "lab"]), c["n"], np.array([c[x] for x in "rgb"], float)) for c in row]) for row in pdf["_c"]]
            named = [primary_and_secondary(s) for s in shares]
            yield pd.DataFrame({key: pdf[key], "primary": [p for p, _ in named], "secondary": [s for _, s in named], "shares": [[v for _, v in s] for s in shares]})

    kind = pixels.schema[key].dataType.simpleString()
    return found.mapInPandas(run, f"{key} {kind}, primary string, secondary array<string>, shares array<double>")
