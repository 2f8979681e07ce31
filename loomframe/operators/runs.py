"""Masks as run tables: a row (image, line, a, b) says that a line's pixels from a to b, b exclusive, belong to the mask.

A line is a row of pixels, or a column where masks come as column-major run lengths: areas, overlaps,
components and holes are the same. A mask of any size is many rows, set algebra is interval joins within a line, and shapes
move as whole runs: growing a run by a disc of radius r makes 2 r + 1 rows of it, however long it is. ``keys`` are the
columns that tell masks apart, and a table holds as many masks as it likes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .relational import cut

KEYS = ("image",)
RUN = ("line", "a", "b")
_STEP = 1 << 32  # of a line, in the number of a run
BAND = 256  # lines that are joined in one task
CELLS = 1 << 18  # rows of edges and lines that are in arrays at once


def runs_of(pixels: DataFrame, flag: Column, keys: Sequence[str] = KEYS, line: str = "y", at: str = "x") -> DataFrame:
    """The runs of the pixels with a flag. A pixel that is there twice counts once."""
    rows = pixels.where(flag).select(*keys, F.col(line).cast("int").alias("line"), F.col(at).cast("int").alias("_x"))
    w = Window.partitionBy(*keys, "line").orderBy("_x")
    island = rows.withColumn("_i", F.col("_x") - F.dense_rank().over(w))
    return island.groupBy(*keys, "line", "_i").agg(F.min("_x").alias("a"), (F.max("_x") + 1).alias("b")).drop("_i")


def pixels_of(runs: DataFrame, line: str = "y", at: str = "x") -> DataFrame:
    """A row for each pixel of the runs; the other columns stay."""
    rest = [c for c in runs.columns if c not in RUN]
    return runs.select(*rest, F.col("line").alias(line), F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias(at))


def turned(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of columns as runs of rows, or back."""
    return runs_of(pixels_of(runs, "x", "y").select(*keys, "y", "x"), F.lit(True), keys)


def runs_of_counts(masks: DataFrame, counts: str, height: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs, by column, of column-major run lengths (an array that begins with background); a run over several columns is cut at their ends."""
    ends = F.aggregate(
        F.col(counts),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"), F.lit(False).alias("on")),
        lambda s, c: F.struct((s["at"] + c).alias("at"), F.when(s["on"] & (c > 0), F.array_append(s["out"], F.struct(s["at"].alias("s"), (s["at"] + c).alias("e")))).otherwise(s["out"]).alias("out"), (~s["on"]).alias("on")),
        lambda s: s["out"],
    )
    h = F.col(height)
    flat = masks.select(*keys, h.cast("long").alias("_h"), F.explode(ends).alias("_r")).select(*keys, "_h", "_r.s", "_r.e")
    cols = flat.select("*", F.explode(F.sequence(F.expr("s div _h"), F.expr("(e - 1) div _h"))).alias("line"))
    low = F.col("line") * F.col("_h")
    return cols.select(*keys, F.col("line").cast("int").alias("line"), F.greatest(F.col("s") - low, F.lit(0)).cast("int").alias("a"), F.least(F.col("e") - low, F.col("_h")).cast("int").alias("b"))


def united(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping and touching runs of a line as one: the union of what is in the table."""
    w = Window.partitionBy(*keys, "line").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select(*keys, *RUN).withColumn("_new", (before.isNull() | (F.col("a") > before)).cast("int"))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "line", "_i").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_i")


def met(one: DataFrame, two: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs that two tables of united runs share."""
    other = two.select(*keys, "line", F.col("a").alias("_a"), F.col("b").alias("_b"))
    both = one.select(*keys, *RUN).join(other, [*keys, "line"]).where("a < _b AND _a < b")
    return both.select(*keys, "line", F.greatest("a", "_a").alias("a"), F.least("b", "_b").alias("b"))


def gaps(runs: DataFrame, size: DataFrame, keys: Sequence[str] = KEYS, margin: int = 0) -> DataFrame:
    """What the runs leave free of their frame. size: keys, lines, length; the frame has ``margin`` more on each side."""
    frame = size.select(*keys, F.explode(F.sequence(F.lit(-margin), F.col("lines") - 1 + margin)).alias("line"), F.lit(-margin).alias("_lo"), (F.col("length") + margin).alias("_hi"))
    ends = frame.select(*keys, "line", F.explode(F.array("_lo", "_hi")).alias("a")).withColumn("b", F.col("a"))
    inside = runs.join(size.select(*keys, F.col("length").alias("_n"), F.col("lines").alias("_l")), list(keys)).where(F.col("line").between(-margin, F.col("_l") - 1 + margin))
    clipped = inside.select(*keys, "line", F.greatest(F.col("a"), F.lit(-margin)).alias("a"), F.least(F.col("b"), F.col("_n") + margin).alias("b")).where("a < b")
    w = Window.partitionBy(*keys, "line").orderBy("a", "b")
    line = united(clipped.unionByName(ends), keys).withColumn("_next", F.lead("a").over(w))
    return line.where("_next > b").select(*keys, "line", F.col("b").alias("a"), F.col("_next").alias("b"))


def less(one: DataFrame, two: DataFrame, size: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs of one without those of two."""
    return met(one, gaps(two, size, keys), keys)


def areas(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).cast("long").alias("area"))


def compared(one: DataFrame, two: DataFrame, keys: Sequence[str] = KEYS, empty: float = 0.0) -> DataFrame:
    """(keys, area, other_area, shared, iou, inside) of the masks of two tables that have the same keys: inside is the share of one's that lies in two's.

    ``empty`` is the IoU of two empty masks; a mask of either table that the other lacks meets an empty one.
    """
    a, b = areas(one, keys), areas(two, keys).withColumnRenamed("area", "other_area")
    shared = areas(met(one, two, keys), keys).withColumnRenamed("area", "shared")
    out = a.join(b, list(keys), "full").join(shared, list(keys), "left").na.fill(0, ["area", "other_area", "shared"])
    union = F.col("area") + F.col("other_area") - F.col("shared")
    return out.withColumns({"iou": F.coalesce(F.try_divide(F.col("shared").cast("double"), union), F.lit(empty)), "inside": F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("area")), F.lit(0.0))})


# --- growing and wearing off ---------------------------------------------------------------------------


def disc(px: int) -> list[tuple[int, int]]:
    """(step, reach) of each line of a disc: how far a run reaches further on the line that many steps away."""
    return [(d, round((px * px - d * d) ** 0.5)) for d in range(-px, px + 1)]


def diamond(px: int) -> list[tuple[int, int]]:
    """px steps along rows and columns."""
    return [(d, px - abs(d)) for d in range(-px, px + 1)]


def square(px: int) -> list[tuple[int, int]]:
    return [(d, px) for d in range(-px, px + 1)]


def grown(runs: DataFrame, shape: Sequence[tuple[int, int]], size: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs widened by a shape, within the frame if a size is given."""
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(r).alias("r")) for d, r in shape))
    out = runs.select(*keys, *RUN, F.explode(steps).alias("_s")).select(*keys, (F.col("line") + F.col("_s.d")).alias("line"), (F.col("a") - F.col("_s.r")).alias("a"), (F.col("b") + F.col("_s.r")).alias("b"))
    if size is not None:
        out = out.join(size, list(keys)).where("line >= 0 AND line < lines").select(*keys, "line", F.greatest("a", F.lit(0)).alias("a"), F.least("b", "length").alias("b")).where("a < b")
    return united(out, keys)


def worn(runs: DataFrame, shape: Sequence[tuple[int, int]], size: DataFrame, keys: Sequence[str] = KEYS, frame_counts: bool = True) -> DataFrame:
    """The pixels around which the whole shape lies in the mask; what is beyond the frame belongs to it if frame_counts, else nothing does."""
    margin = 0 if frame_counts else max(max(abs(d), r) for d, r in shape)
    return gaps(grown(gaps(runs, size, keys, margin), shape, size, keys), size, keys)


def opened(runs: DataFrame, shape: Sequence[tuple[int, int]], size: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return grown(worn(runs, shape, size, keys), shape, size, keys)


def closed(runs: DataFrame, shape: Sequence[tuple[int, int]], size: DataFrame, keys: Sequence[str] = KEYS, times: int = 1) -> DataFrame:
    """Grown a number of times, then worn off as often."""
    for f in (grown, worn):
        for _ in range(times):
            runs = f(runs, shape, size, keys)
    return runs


def outline(runs: DataFrame, size: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs of pixels with one of their four neighbours outside the mask, or outside the frame."""
    return less(runs, worn(runs, diamond(1), size, keys, frame_counts=False), size, keys)


# --- components and holes ------------------------------------------------------------------------------


def _near(lines: np.ndarray, a: np.ndarray, b: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs touch which of the line below: pairs of places. lines ascend, runs of a line are apart and ascend; gap is 0 if corners count, else 1."""
    low, width = int(a.min()), int(b.max() - a.min()) + 3
    place = lambda line, at: (line - lines[0]) * width + (at - low) + 1
    first = np.searchsorted(place(lines, b), place(lines + 1, a + gap))
    count = np.maximum(np.searchsorted(place(lines, a), place(lines + 1, b - gap), side="right") - first, 0)
    above = np.repeat(np.arange(len(lines)), count)
    return above, np.arange(len(above)) + np.repeat(first - np.cumsum(count) + count, count)


def _least(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least one that the edges join it to."""
    label = np.arange(n)
    while len(one):
        u, v = label[one], label[two]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[one] != label[two]
        one, two = one[apart], two[apart]
    return label


def _joined_within(runs: DataFrame, keys: Sequence[str], gap: int, band: int) -> DataFrame:
    """runs with _band (so many lines each), node, and _part: the first node of their component within the band. A task holds a band of a mask, and reads the others as a stream."""
    import pyarrow as pa

    w = Window.partitionBy(*keys, "_band").orderBy("line", "a")
    rows = runs.select(*keys, *(F.col(c).cast("long").alias(c) for c in RUN)).dropna(subset=list(keys)).withColumn("_band", F.floor(F.col("line") / band))
    rows = rows.withColumn("node", F.col("line") * _STEP + F.col("a")).withColumn("_part", F.when(F.row_number().over(w) == 1, F.col("node")))  # set where a band begins

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            lines, a, b, node = (table[c].to_numpy() for c in (*RUN, "node"))
            begins = table["_part"].is_valid().to_numpy()
            # bands one below another, three lines apart, so that none touches the next
            own = np.flatnonzero(begins)
            height = np.append(lines[own[1:] - 1] - lines[own[:-1]] + 3, 0)
            shift = np.concatenate(([0], np.cumsum(height)[:-1])) - lines[own]
            part = node[_least(len(lines), *_near(lines + shift[np.cumsum(begins) - 1], a, b, gap))]
            yield from table.set_column(table.schema.get_field_index("_part"), "_part", pa.array(part)).to_batches()

        for batch in batches:
            begins = np.flatnonzero(batch.column(batch.schema.get_field_index("_part")).is_valid().to_numpy(zero_copy_only=False))
            last = int(begins[-1]) if len(begins) else 0
            if last:
                held.append(batch.slice(0, last))
            if held and len(begins):
                yield from closed()
                held.clear()
            held.append(batch.slice(last))
        if held:
            yield from closed()

    return rows.mapInArrow(fold, rows.schema)


def labelled(runs: DataFrame, keys: Sequence[str] = KEYS, connect: int = 8, band: int = BAND) -> DataFrame:
    """united runs with ``part``, the number of their component: that of its first run in reading order.

    Runs of neighbouring lines that touch (at a corner too if connect is 8) are joined: first within bands of lines, each in a task. What is joined there is a
    node for what follows between the bands, if any meet. There labels spread by union of least numbers: in each round a node takes
    the least of its own and its neighbours', then that one's; the rounds grow with the logarithm of a component's
    length in bands, and each is written to the shared folder. All masks of the table go through the same rounds.
    """
    gap = 0 if connect == 8 else 1
    nodes = cut(_joined_within(runs, keys, gap, band))
    top = nodes.where(F.col("line") == F.col("_band") * band).select(*keys, (F.col("line") - 1).alias("line"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("_part").alias("other"))
    bottom = nodes.where(F.col("line") == (F.col("_band") + 1) * band - 1).select(*keys, *RUN, F.col("_part").alias("node"))
    edges = cut(bottom.join(top, [*keys, "line"]).where(F.expr(f"a + {gap} <= _b AND _a + {gap} <= b")).select(*keys, "node", "other").distinct())
    out = nodes.select(*keys, *(F.col(c).cast("int").alias(c) for c in RUN), "_part")
    if edges.isEmpty():
        return out.withColumnRenamed("_part", "part")
    both = cut(edges.unionByName(edges.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))))
    labels, total = both.select(*keys, "node", F.col("node").alias("part")).distinct(), None
    while True:
        near = both.join(labels, [*keys, "node"]).select(*keys, F.col("other").alias("node"), "part")
        least = near.unionByName(labels).groupBy(*keys, "node").agg(F.min("part").alias("part"))
        jump = least.join(labels.select(*keys, F.col("node").alias("part"), F.col("part").alias("_next")), [*keys, "part"])
        labels = cut(jump.select(*keys, "node", F.least("part", "_next").alias("part")))
        now = labels.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]  # labels only fall: an equal sum is no change
        if now == total:
            found = labels.withColumnRenamed("node", "_part")
            return out.join(found, [*keys, "_part"], "left").select(*keys, *RUN, F.coalesce("part", "_part").alias("part"))
        total = now


def parts(labelled_runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, part, area, line0, line1, a0, b1): each component with its box, ends exclusive."""
    return labelled_runs.groupBy(*keys, "part").agg(
        F.sum(F.col("b") - F.col("a")).cast("long").alias("area"), F.min("line").alias("line0"), (F.max("line") + 1).alias("line1"), F.min("a").alias("a0"), F.max("b").alias("b1")
    )


def part_counts(found: DataFrame, share: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, components, largest, total) of parts(): how many have the share of the mask's area, and the area of the largest."""
    w = found.groupBy(*keys).agg(F.sum("area").alias("total"), F.collect_list("area").alias("_areas"), F.max("area").alias("largest"))
    return w.select(*keys, F.size(F.filter("_areas", lambda x: x >= share * F.col("total"))).cast("long").alias("components"), "largest", "total")


def largest(labelled_runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs of the largest component of each mask, of equal ones the first in reading order."""
    best = parts(labelled_runs, keys).groupBy(*keys).agg(F.max_by("part", F.struct("area", -F.col("part"))).alias("part"))
    return labelled_runs.join(best, [*keys, "part"]).select(*keys, *RUN)


def without_holes(runs: DataFrame, size: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The runs and what they enclose: background that no path along rows and columns joins to the frame's outside."""
    around = labelled(gaps(runs, size, keys, margin=1), keys, connect=4)
    holes = around.where(F.col("part") != F.lit(-_STEP - 1))
    return united(runs.select(*keys, *RUN).unionByName(holes.select(*keys, *RUN)), keys)


def quality(runs: DataFrame, size: DataFrame, keys: Sequence[str] = KEYS, share: float = 0.05) -> DataFrame:
    """(keys, area_frac, components, long_side, border_touch) of masks: of the largest component the longer side, and the largest share of an edge of the frame that it covers."""
    marked = labelled(runs, keys)
    found = parts(marked, keys)
    main = largest(marked, keys)
    box = main.join(size, list(keys)).groupBy(*keys).agg(
        F.greatest(F.max("line") + 1 - F.min("line"), F.max("b") - F.min("a")).cast("long").alias("long_side"),
        *(F.sum(F.when(F.col("line") == at, F.col("b") - F.col("a")).otherwise(0)).alias(n) for n, at in (("_top", F.lit(0)), ("_bottom", F.col("lines") - 1))),
        F.count_if(F.col("a") == 0).alias("_left"),
        F.count_if(F.col("b") == F.col("length")).alias("_right"),
    )
    touch = F.greatest(F.col("_top") / F.col("length"), F.col("_bottom") / F.col("length"), F.col("_left") / F.col("lines"), F.col("_right") / F.col("lines"))
    out = part_counts(found, share, keys).join(box, list(keys)).join(size, list(keys))
    return out.select(*keys, (F.col("total") / (F.col("lines") * F.col("length"))).alias("area_frac"), "components", "long_side", touch.alias("border_touch"))


# --- distances -----------------------------------------------------------------------------------------


def distances(pixels: DataFrame, flag: Column, name: str = "distance", keys: Sequence[str] = KEYS) -> DataFrame:
    """pixels (all of an image) with the steps along rows and columns to the nearest flagged one; null where an image has none.

    Two passes: along each row to the nearest in it, then along each column the least of these and the way there. Both are running minima from either side.
    """
    def sides(other: str, at: str) -> tuple:
        w = Window.partitionBy(*keys, other)
        so_far = lambda order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return so_far(F.col(at)), so_far(F.col(at).desc())

    before, after = sides("y", "x")
    hit = F.when(flag, F.col("x"))
    row = pixels.withColumn("_r", F.least(F.col("x") - F.max(hit).over(before), F.min(hit).over(after) - F.col("x")))
    before, after = sides("x", "y")
    away = F.least(F.col("y") + F.min(F.col("_r") - F.col("y")).over(before), F.min(F.col("_r") + F.col("y")).over(after) - F.col("y"))
    return row.withColumn(name, away).drop("_r")


def boundary_scores(pred: DataFrame, truth: DataFrame, size: DataFrame, tolerances: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, tol, f1) for every mask of size and every tolerance: how much of either outline has the other within tol steps.

    Two masks without an outline agree (1), one without does not (0). One distance transform an outline serves all tolerances.
    """
    grid = size.select(*keys, "length", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("y")).select(*keys, "y", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("x"))
    for name, mask in (("p", pred), ("t", truth)):
        grid = grid.join(pixels_of(outline(mask, size, keys)).withColumn(name, F.lit(True)), [*keys, "y", "x"], "left")
    grid = distances(distances(grid.na.fill(False, ["p", "t"]), F.col("p"), "to_p", keys), F.col("t"), "to_t", keys)
    near = lambda flag, way, tol: F.count_if(F.col(flag) & (F.col(way) <= tol))
    counts = [F.struct(F.lit(tol).alias("tol"), near("p", "to_t", tol).alias("p_hit"), near("t", "to_p", tol).alias("t_hit")) for tol in tolerances]
    found = grid.groupBy(*keys).agg(F.count_if("p").alias("n_p"), F.count_if("t").alias("n_t"), F.array(*counts).alias("_c"))
    found = found.select(*keys, "n_p", "n_t", F.explode("_c").alias("_c")).select(*keys, "n_p", "n_t", "_c.*")
    precision, recall = F.col("p_hit") / F.col("n_p"), F.col("t_hit") / F.col("n_t")
    f1 = F.when((F.col("n_p") == 0) | (F.col("n_t") == 0), ((F.col("n_p") == 0) & (F.col("n_t") == 0)).cast("double")).when(F.col("p_hit") + F.col("t_hit") == 0, 0.0)
    return found.select(*keys, "tol", f1.otherwise(2 * precision * recall / (precision + recall)).alias("f1"))


# --- polygons ------------------------------------------------------------------------------------------


def _on_lines(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, line): a row for each line of an edge, from low to high, high exclusive."""
    n = np.maximum(high - low, 0)
    edge = np.repeat(np.arange(len(n)), n)
    return edge, np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + low[edge]


def _enclosed(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(mask, line, a, b): from the odd to the even crossings of a mask's edges with a line. Lines count from low, which is their zero."""
    edge, line = _on_lines(np.maximum(np.minimum(y0, y1), low), np.minimum(np.maximum(y0, y1), high))
    slope = (x1 - x0) / np.where(y0 == y1, 1, y1 - y0)
    span = int((high - low).max())
    crossing = np.empty(len(edge), complex)  # sorts by its real part, then by its imaginary one
    crossing.real = mask[edge] * span + line - low[edge]
    crossing.imag = x0[edge] + (line - y0[edge]) * slope[edge]
    crossing.sort()
    at, x = crossing.real.astype(np.int64), crossing.imag
    k = np.arange(len(at))
    k -= np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1])[: len(at)], k, 0))
    odd = np.flatnonzero((k[:-1] % 2 == 0) & (at[1:] == at[:-1]))
    yield *divmod(at[odd], span), np.ceil(x[odd]).astype(np.int64), np.floor(x[odd + 1]).astype(np.int64) + 1


def _drawn(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(mask, line, a, b) of the edges' own pixels, a run on each of an edge's lines.

    Where the edge is steep it is of one pixel, else of the steps whose height is nearest to the line (halves to the line above).
    """
    n, d = np.abs(x1 - x0), np.abs(y1 - y0)
    for steep in (True, False):
        of = np.flatnonzero((d >= n) == steep)
        edge, line = _on_lines(np.maximum(np.minimum(y0[of], y1[of]), low[of]), np.minimum(np.maximum(y0[of], y1[of]) + 1, high[of]))
        e = of[edge]
        j = np.abs(line - y0[e])
        if steep:
            a = x0[e] + np.floor(j * (x1 - x0)[e] / np.maximum(d, 1)[e] + 0.5).astype(np.int64)
            b = a
        else:
            up, twice = (y1 < y0)[e], 2.0 * np.maximum(d, 1)[e]
            before, until = (2 * j - 1) * n[e] / twice, (2 * j + 1) * n[e] / twice
            first = np.where(up, np.floor(before) + 1, np.ceil(before))
            last = np.where(up, np.floor(until), np.ceil(until) - 1)
            flat = (d == 0)[e]
            first, last = np.where(flat, 0, np.maximum(first, 0)).astype(np.int64), np.where(flat, n[e], np.minimum(last, n[e])).astype(np.int64)
            way = np.sign(x1 - x0)[e]
            a, b = x0[e] + way * first, x0[e] + way * last
            a, b = np.minimum(a, b), np.maximum(a, b)
        yield mask[e], line - low[e], a, b + 1


def _scanned(edges: np.ndarray, mask: np.ndarray, start: np.ndarray, lines: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(mask, line, a, b): the united runs of masks, in parts of about CELLS edges' lines.

    edges: x0, y0, x1, y1, ordered by mask; start, lines, length: for each mask its first line, the number of its lines, and their length. Parts are some of
    the masks, and some of the lines where one mask is more than a part.
    """
    bits = int(length.max(initial=1)).bit_length()
    todo = [(0, len(start), 0, int(lines.max(initial=0)))]
    while todo:
        m0, m1, l0, l1 = todo.pop()
        if m0 == m1 or l0 >= l1:
            continue
        e0, e1 = np.searchsorted(mask, [m0, m1])
        x0, y0, x1, y1 = edges[:, e0:e1]
        of = mask[e0:e1]
        low = start[of] + l0
        high = np.minimum(low - l0 + lines[of], low + (l1 - l0))
        rows = np.maximum(np.minimum(np.maximum(y0, y1) + 1, high) - np.maximum(np.minimum(y0, y1), low), 0).sum()
        span = l1 - l0
        if rows > CELLS or ((m1 - m0) * span).bit_length() + 2 * bits > 62:  # more than a part, or than a number holds
            if m1 - m0 > 1:
                half = (m0 + m1) // 2
                todo += [(half, m1, l0, l1), (m0, half, l0, l1)]
                continue
            if span > 1:
                half = (l0 + l1) // 2
                todo += [(m0, m1, half, l1), (m0, m1, l0, half)]
                continue
        if not rows:
            continue
        given = x0, y0, x1, y1, of - m0, low, np.maximum(high, low)
        width = int((given[-1] - low).max())
        parts = [*_enclosed(*given), *_drawn(*given)]
        m, line, a, b = map(np.concatenate, zip(*parts, strict=True))
        a, b = np.maximum(a, 0), np.minimum(b, length[m + m0])
        there = a < b
        found = (((m[there] * width + line[there]) << bits | a[there]) << bits) | b[there]  # sorts by mask, line, a and b
        found.sort()
        if not len(found):
            continue
        at, a = found >> 2 * bits, (found >> bits) & ((1 << bits) - 1)
        upto = np.maximum.accumulate(at << bits | found & ((1 << bits) - 1))  # the line's largest end so far
        b = upto & ((1 << bits) - 1)
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (a[1:] > b[:-1])))
        m, line = divmod(at[first], width)
        yield m + m0, line + l0 + start[m + m0], a[first], b[np.append(first[1:], len(at)) - 1]


def filled(polygons: DataFrame, size: DataFrame | None = None, keys: Sequence[str] = KEYS, points: str = "points") -> DataFrame:
    """The runs of polygons: what an odd number of their edges encloses, and the edges themselves.

    polygons: keys and points (x0, y0, x1, y1, ...), rounded to whole pixels; those of fewer than three points are left out, and edges of which an end is null.
    size: keys, lines, length; without it these are columns of the polygons, alike in all of a mask.
    A mask's polygons meet as one row for each band of lines, and a task scans many of these rows in arrays: crossings in order enclose from the odd
    to the even ones. An edge's own pixels are those nearest to it along its longer side. Only united runs leave the task.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = polygons.where(F.size(points) >= 6)
    rows = (rows if size is None else rows.drop("lines", "length").join(size, list(keys))).select(*keys, "lines", "length", F.transform(points, lambda p: F.bround(p).cast("int")).alias("_p"))
    ys = F.filter("_p", lambda p, i: (i % 2 == 1) & p.isNotNull())
    top, bottom = F.greatest(F.array_min(ys), F.lit(0)), F.least(F.array_max(ys), F.col("lines") - 1)
    bands = F.when(F.col("lines") <= BAND, F.array(F.lit(0))).when(top <= bottom, F.sequence(F.floor(top / BAND).cast("int"), F.floor(bottom / BAND).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*keys, "lines", "length", "_p", F.explode(bands).alias("_band"))
    masks = rows.groupBy(*keys, "lines", "length", "_band").agg(F.collect_list("_p").alias("_p"))
    masks = masks.select(*keys, F.col("lines").cast("long"), F.col("length").cast("long"), "_band", "_p")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, length, band = (batch.column(c).to_numpy() for c in ("lines", "length", "_band"))
            rings = batch.column("_p")
            of_ring = np.repeat(np.arange(len(rings)), rings.value_lengths().to_numpy())
            rings = rings.flatten()
            size_of = rings.value_lengths().to_numpy()
            begin, n = np.cumsum(size_of) - size_of, size_of // 2
            ring = np.repeat(np.arange(len(n)), n)
            last = np.cumsum(n) - 1
            point = np.arange(len(ring))
            at = begin[ring] + 2 * (point - (last - n + 1)[ring])
            after = point + 1
            after[last] = last - n + 1
            flat = rings.flatten()
            xy, known = pc.fill_null(flat, 0).to_numpy().astype(np.int64), pc.is_valid(flat).to_numpy(zero_copy_only=False)
            x, y, there = xy[at], xy[at + 1], known[at] & known[at + 1]
            whole = there & there[after]
            edges = np.stack([x, y, x[after], y[after]])[:, whole]
            start = band.astype(np.int64) * BAND
            for mask, line, a, b in _scanned(edges, of_ring[ring][whole], start, np.clip(lines - start, 0, BAND), np.maximum(length, 0)):
                kept = batch.select(list(keys)).take(pa.array(mask))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.int32()) for c in (line, a, b))], names=[*keys, *RUN])

    fields = T.StructType([*(masks.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in RUN)])
    return masks.mapInArrow(scan, fields)
