"""Run tables against numpy on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import masks, runs

H, W = 17, 23


def rows_of(name, mask):
    return [(name, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)]


def table(spark, named):
    pixels = spark.createDataFrame([r for n, m in named.items() for r in rows_of(n, m)], "image string, y int, x int")
    return runs.runs_of(pixels, F.lit(True))


def sizes(spark, named):
    return spark.createDataFrame([(n, *m.shape) for n, m in named.items()], "image string, lines int, length int")


def arrays(df, named):
    out = {n: np.zeros_like(m) for n, m in named.items()}
    for r in df.collect():
        assert not out[r["image"]][r["line"], r["a"] : r["b"]].any()  # no run overlaps another
        out[r["image"]][r["line"], r["a"] : r["b"]] = True
    return out


def same(df, want):
    got = arrays(df, want)
    assert all(np.array_equal(got[n], want[n]) for n in want)


@pytest.fixture(scope="module")
def named():
    rng = np.random.default_rng(8)
    ring = np.zeros((H, W), bool)
    ring[2:12, 3:15] = True
    ring[4:9, 5:11] = False
    ring[5, 6] = True
    ring[13:16, 18:22] = True
    spiral = np.zeros((19, 19), bool)
    spiral[::4, :-2] = spiral[2::4, 2:] = True
    spiral[::2, 8] = True
    return {"ring": ring, "few": rng.random((H, W)) < 0.3, "many": rng.random((30, 9)) < 0.6, "all": np.ones((5, 7), bool), "none": np.zeros((4, 4), bool), "spiral": spiral}


def shifted(mask, shape):
    out = np.zeros_like(mask)
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask), strict=True):
        for d, r in shape:
            if 0 <= y + d < h:
                out[y + d, max(0, x - r) : max(0, min(w, x + r + 1))] = True
    return out


def test_there_and_back_and_algebra(spark, named):
    one = table(spark, named)
    same(one, named)
    other = {n: np.roll(m, 2, 1) ^ np.roll(m, 1, 0) for n, m in named.items()}
    two, size = table(spark, other), sizes(spark, named)
    same(runs.united(one.unionByName(two)), {n: named[n] | other[n] for n in named})
    same(runs.met(one, two), {n: named[n] & other[n] for n in named})
    same(runs.gaps(one, size), {n: ~m for n, m in named.items()})
    same(runs.less(one, two, size), {n: named[n] & ~other[n] for n in named})
    for r in runs.compared(one, two).collect():
        a, b = named[r["image"]], other[r["image"]]
        assert (r["area"], r["other_area"], r["shared"]) == (a.sum(), b.sum(), (a & b).sum())
        assert r["iou"] == pytest.approx(masks.iou(a, b)) and r["inside"] == pytest.approx(masks.containment(a, b))


def test_growing_and_wearing_off(spark, named):
    one, size = table(spark, named), sizes(spark, named)
    for shape in (runs.disc(3), runs.diamond(2), runs.square(1)):
        grown = {n: shifted(m, shape) for n, m in named.items()}
        worn = {n: m & ~shifted(~m, shape) for n, m in named.items()}
        same(runs.grown(one, shape, size), grown)
        same(runs.worn(one, shape, size), worn)
        same(runs.opened(one, shape, size), {n: shifted(m, shape) for n, m in worn.items()})
    twice = {n: shifted(shifted(m, runs.square(1)), runs.square(1)) for n, m in named.items()}
    for _ in range(2):
        twice = {n: m & ~shifted(~m, runs.square(1)) for n, m in twice.items()}
    same(runs.closed(one, runs.square(1), size, times=2), twice)
    assert [r for _, r in runs.disc(3)] == [0, 2, 3, 3, 3, 2, 0]


def test_components_largest_and_holes(spark, named):
    one, size = table(spark, named), sizes(spark, named)
    marked = runs.labelled(one)
    counts = {r["image"]: (r["components"], r["largest"], r["total"]) for r in runs.part_counts(runs.parts(marked), 0.05).collect()}
    for n, m in named.items():
        ids, k = masks.label(m)
        areas = np.bincount(ids[m], minlength=k + 1)[1:]
        if k:
            assert counts[n] == ((areas >= 0.05 * m.sum()).sum(), areas.max(), m.sum())
        else:
            assert n not in counts
    want = {}
    for n, m in named.items():
        ids, k = masks.label(m)
        want[n] = ids == 1 + int(np.argmax(np.bincount(ids[m], minlength=k + 1)[1:])) if k else m
    same(runs.largest(marked), want)
    same(runs.without_holes(one, size), {n: masks.fill_holes(m) for n, m in named.items()})
    got = {r["image"]: r for r in runs.quality(one, size).collect()}
    main = want["ring"]
    assert got["ring"]["long_side"] == 12 and got["ring"]["border_touch"] == 0 and got["ring"]["components"] == 2
    assert got["all"]["border_touch"] == 1 and got["ring"]["area_frac"] == pytest.approx(named["ring"].sum() / (H * W)) and main.any()


def test_corners_join_only_where_eight_neighbours_count(spark):
    steps = {"d": np.eye(6, dtype=bool)}
    assert runs.parts(runs.labelled(table(spark, steps), connect=4)).count() == 6 and runs.parts(runs.labelled(table(spark, steps))).count() == 1


def test_boundary_scores_for_every_tolerance(spark, named):
    other = {n: np.roll(m, 1, 0) & np.roll(m, 2, 1) for n, m in named.items()}
    got = {(r["image"], r["tol"]): r["f1"] for r in runs.boundary_scores(table(spark, named), table(spark, other), sizes(spark, named), range(6)).collect()}

    def edge(m):
        p = np.pad(m, 1)
        return m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])

    for n in named:
        p, t = edge(named[n]), edge(other[n])
        for tol in range(6):
            if not p.any() or not t.any():
                want = float(not p.any() and not t.any())
            else:
                a, b = (p & shifted(t, runs.diamond(tol))).sum() / p.sum(), (t & shifted(p, runs.diamond(tol))).sum() / t.sum()
                want = 2 * a * b / (a + b) if a + b else 0.0
            assert got[n, tol] == pytest.approx(want), (n, tol)


def test_polygons_and_run_lengths(spark):
    shapes = {"triangle": [[1, 1, 15, 3, 6, 14]], "two": [[2, 2, 8, 2, 8, 8, 2, 8], [12, 1, 20, 1, 20, 12.4, 12, 11.6]], "hole": [[0, 0, 20, 0, 20, 15, 0, 15], [5, 5, 10, 5, 10, 10, 5, 10]], "bow": [[0, 0, 16, 12, 16, 0, 0, 12]], "line": [[3, 3, 9, 3]], "beyond": [[-5, -5, 40, 4, 10, 40]]}
    rows = [(n, k, [float(v) for v in p]) for n, rings in shapes.items() for k, p in enumerate(rings)]
    size = spark.createDataFrame([(n, H, W) for n in shapes], "image string, lines int, length int")
    got = arrays(runs.filled(spark.createDataFrame(rows, "image string, ring int, points array<double>"), size), {n: np.zeros((H, W), bool) for n in shapes})
    for n, rings in shapes.items():
        want = np.zeros((H, W), bool)
        edges = []
        for p in rings:
            xy = [(round(p[i]), round(p[i + 1])) for i in range(0, len(p), 2)]
            if len(xy) > 2:
                edges += list(zip(xy, xy[1:] + xy[:1], strict=True))
        for y in range(H):
            cuts = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in edges if y0 != y1 and min(y0, y1) <= y < max(y0, y1))
            for x in range(W):
                want[y, x] = any(a <= x <= b for a, b in zip(cuts[::2], cuts[1::2], strict=True))
        for (x0, y0), (x1, y1) in edges:
            k = max(abs(x1 - x0), abs(y1 - y0))
            for i in range(k + 1):
                x, y = x0 + int(np.floor(i * (x1 - x0) / k + 0.5)) if k else x0, y0 + int(np.floor(i * (y1 - y0) / k + 0.5)) if k else y0
                if 0 <= x < W and 0 <= y < H:
                    want[y, x] = True
        assert np.array_equal(got[n], want), n
    rng = np.random.default_rng(1)
    named = {"a": rng.random((7, 9)) < 0.5, "b": np.ones((4, 6), bool), "c": np.zeros((3, 3), bool)}
    packed = spark.createDataFrame([(n, masks.encode(m), m.shape[0]) for n, m in named.items()], "image string, counts array<int>, h int")
    same(runs.turned(runs.runs_of_counts(packed, "counts", "h")), named)


def test_components_within_and_across_bands(spark):
    """Noise of three densities, lines below zero too: the same components whether a band holds the mask, a few lines of it, or one."""
    import random

    draw = random.Random(3)
    there = {(i, y, x) for i in range(3) for y in range(-2, 19) for x in range(13) if draw.random() < (0.35, 0.5, 0.62)[i]}
    table = runs.runs_of(spark.createDataFrame(sorted(there), "image long, y int, x int"), F.lit(True))
    for connect in (8, 4):
        first: dict = {}
        for start in sorted(there):
            todo = [start] if start not in first else []
            first.setdefault(start, start)
            while todo:
                i, y, x = todo.pop()
                for q in ((i, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if connect == 8 or not (dy and dx)):
                    if q in there and q not in first:
                        first[q] = start
                        todo.append(q)
        for band in (256, 4, 1):
            got = {(r["image"], r["line"], x): r["part"] for r in runs.labelled(table, connect=connect, band=band).collect() for x in range(r["a"], r["b"])}
            assert got == {p: (y << 32) + x for p, (_, y, x) in first.items()}


def test_polygons_over_many_bands_and_parts(spark, monkeypatch):
    """A mask of many lines is cut into bands, a task's edges into parts: the runs are those of all its edges together, and only they leave a task."""
    rng = np.random.default_rng(4)
    height, width = 700, 40
    rings = {k: [rng.integers(-30, 760, 2 * rng.integers(3, 7)).astype(float) for _ in range(3)] for k in (1, 2)}
    for ps in rings.values():
        for p in ps:
            p[::2] = p[::2] % 50 - 5
    rings[2].append(np.array([1.0, 2.0, 3.0, 4.0]))
    want = {}
    for k, ps in rings.items():
        m = np.zeros((height, width), bool)
        edges = [(a, b) for p in ps if len(p) > 4 for xy in [p.reshape(-1, 2).astype(int).tolist()] for a, b in zip(xy, xy[1:] + xy[:1], strict=True)]
        for y in range(height):
            cuts = sorted(x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) for (x0, y0), (x1, y1) in edges if y0 != y1 and min(y0, y1) <= y < max(y0, y1))
            for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                m[y, max(0, int(np.ceil(a))) : max(0, int(np.floor(b)) + 1)] = True
        for (x0, y0), (x1, y1) in edges:
            n = max(abs(x1 - x0), abs(y1 - y0))
            for i in range(n + 1):
                x, y = x0 + int(np.floor(i * (x1 - x0) / n + 0.5)) if n else x0, y0 + int(np.floor(i * (y1 - y0) / n + 0.5)) if n else y0
                if 0 <= x < width and 0 <= y < height:
                    m[y, x] = True
        want[k] = m
    rows = [(k, p.tolist(), height, width) for k, ps in rings.items() for p in ps] + [(3, [0.0, 0.0, None, 5.0, 4.0, 4.0], height, width)]
    found = runs.filled(spark.createDataFrame(rows, "image int, points array<double>, lines int, length int"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    for k, m in want.items():
        here = np.zeros_like(m)
        for r in got:
            if r["image"] == k:
                assert not here[r["line"], max(0, r["a"] - 1) : r["b"] + 1].any()  # united
                here[r["line"], r["a"] : r["b"]] = True
        assert np.array_equal(here, m)
    assert {(r["line"], x) for r in got if r["image"] == 3 for x in range(r["a"], r["b"])} >= {(i, i) for i in range(5)}  # the edge that has both ends
    monkeypatch.setattr(runs, "CELLS", 40)
    pairs = [(k, a, b) for k, ps in rings.items() for p in ps if len(p) > 4 for xy in [p.reshape(-1, 2).astype(int).tolist()] for a, b in zip(xy, xy[1:] + xy[:1], strict=True)]
    edges, of = np.array([[*a, *b] for _, a, b in pairs]).T, np.array([k - 1 for k, _, _ in pairs])
    here = {1: np.zeros((height, width), bool), 2: np.zeros((height, width), bool)}
    for mask, line, a, b in runs._scanned(edges, of, np.zeros(2, int), np.full(2, height), np.full(2, width)):
        for k, y, x0, x1 in zip(mask, line, a, b, strict=True):
            here[k + 1][y, x0:x1] = True
    assert all(np.array_equal(here[k], want[k]) for k in want)
