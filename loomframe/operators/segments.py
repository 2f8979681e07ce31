"""Candidates of a photo's segmentation made into its items: small ones go, overlapping ones are merged, pairs and pieces are put together.

What a candidate meets rests on what those before it have become, so the merging of a photo is a fold. Candidates are dealt out by
photo and sorted by area, and each task reads them as a stream: the photos of a batch fold side by side, a candidate of each at a time, and
what is held beyond a batch are the unions of its last photo. Masks are sorted intervals of numbers (line times stride, plus place),
each in a range of its own, so that many are compared and united by one sweep of their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a category is called that is not known, and those of which two pieces are one item.
UNKNOWN = "미상"
PAIRED = ("신발",)
MIN_AREA, MERGE_IOU, MERGE_INSIDE, MAX_ITEMS = 0.004, 0.55, 0.80, 12

Intervals = tuple[np.ndarray, np.ndarray]


def length(x: Intervals) -> int:
    return int((x[1] - x[0]).sum())


def covered(x: Intervals, at: np.ndarray) -> np.ndarray:
    """How much of x lies before each place."""
    starts, ends = x
    before = np.concatenate(([0], np.cumsum(ends - starts)))
    k = np.searchsorted(starts, at, side="right")
    last = np.maximum(k - 1, 0)
    return before[k] - np.where(k > 0, np.maximum(ends[last] - at, 0), 0)


def shared(x: Intervals, y: Intervals) -> int:
    if not len(x[0]) or not len(y[0]):
        return 0
    return int((covered(y, x[1]) - covered(y, x[0])).sum())


def union(x: Intervals, y: Intervals) -> Intervals:
    starts, ends = np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    if not len(starts):
        return starts, ends
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((new[1:], [True]))]


@dataclass(frozen=True)
class Rules:
    merge_iou: float = MERGE_IOU
    merge_inside: float = MERGE_INSIDE
    unknown: str = UNKNOWN
    paired: tuple[str, ...] = PAIRED


_APART = 1 << 40  # between the numbers of masks that are swept together


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of the elements of slices."""
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + (first - ends + count)[owner]


class _Masks:
    """Intervals by mask; a mask that grows is written anew behind the others."""

    def __init__(self) -> None:
        self.ends, self.used = np.zeros((2, 1024), np.int64), 0
        self.first = self.count = self.area = np.zeros(0, np.int64)

    def write(self, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, count, area) of masks whose intervals come one after another."""
        while self.used + len(starts) > self.ends.shape[1]:
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)), axis=1)
        self.ends[:, self.used : self.used + len(starts)] = starts, ends
        first = self.used + np.cumsum(count) - count
        self.used += len(starts)
        total = np.concatenate(([0], np.cumsum(ends - starts)))
        return first, count, total[first - (self.used - len(starts)) + count] - total[first - (self.used - len(starts))]

    def add(self, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The numbers of new masks."""
        new = self.write(starts, ends, count)
        self.first, self.count, self.area = (np.concatenate(x) for x in zip((self.first, self.count, self.area), new, strict=True))
        return np.arange(len(self.first) - len(count), len(self.first))

    def of(self, masks: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, starts, ends) of masks, each slot in a range of its own."""
        owner, at = _spread(self.first[masks], self.count[masks])
        owner = owner if slot is None else slot[owner]
        return owner, self.ends[0, at] + owner * _APART, self.ends[1, at] + owner * _APART

    def shared(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What each mask of one shares with that of two beside it."""
        owner, starts, ends = self.of(one)
        other = self.of(two)[1:]
        return np.bincount(owner, covered(other, ends) - covered(other, starts), len(one)).astype(np.int64)

    def unite(self, masks: np.ndarray, slot: np.ndarray, into: np.ndarray) -> None:
        """into, one for each slot, becomes the union of the slot's masks."""
        _, starts, ends = self.of(masks, slot)
        starts, ends = union((starts, ends), (starts[:0], ends[:0]))
        owner = starts // _APART
        count = np.bincount(owner, minlength=len(into))
        self.first[into], self.count[into], self.area[into] = self.write(starts - owner * _APART, ends - owner * _APART, count)


class _Fold:
    """Items of the photos of a batch. Photos and categories are numbers here; items of a photo are numbered in the order they began in."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.masks, self.categories = rules, _Masks(), {rules.unknown: 0}
        self.photo = self.category = self.parts = self.cand = self.home = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.item = np.zeros(0, np.int64)  # the mask of each item

    def take(self, photo: np.ndarray, cand: np.ndarray, category: np.ndarray, score: np.ndarray, masks: np.ndarray) -> None:
        """The next candidates, by photo and in their order, no larger than those before: each to the first item that it overlaps, or lies in."""
        nth = np.arange(len(photo)) - np.searchsorted(photo, photo)
        turns = np.argsort(nth, kind="stable")
        home = np.zeros(len(photo), np.int64)
        for now in np.split(turns, np.flatnonzero(np.diff(nth[turns])) + 1) if len(turns) else ():
            at = np.searchsorted(photo[now], self.photo)
            at = np.where(at < len(now), at, 0)
            items = np.flatnonzero(photo[now][at] == self.photo)
            items = items[np.argsort(self.photo[items], kind="stable")]
            met = at[items]
            both, n = self.masks.shared(masks[now][met], self.item[items]), self.masks.area[masks[now][met]]
            rest = n + self.masks.area[self.item[items]] - both
            hit = np.flatnonzero((both / np.maximum(rest, 1) >= self.rules.merge_iou) | (both / np.maximum(n, 1) >= self.rules.merge_inside))
            which, first = np.unique(met[hit], return_index=True)
            to, new = items[hit[first]], now[which]
            if len(to):
                self.masks.unite(np.concatenate((self.item[to], masks[new])), np.tile(np.arange(len(to)), 2), self.item[to])
                self.parts[to] += 1
                self.score[to] = np.maximum(self.score[to], score[new])
                self.category[to] = np.where(self.category[to] == 0, category[new], self.category[to])
                home[new] = to
            alone = np.delete(now, which)
            home[alone] = len(self.item) + np.arange(len(alone))
            self.append(photo[alone], category[alone], score[alone], np.ones(len(alone), np.int64), masks[alone])
        self.cand, self.home = np.concatenate((self.cand, cand)), np.concatenate((self.home, home))

    def append(self, photo: np.ndarray, category: np.ndarray, score: np.ndarray, parts: np.ndarray, masks: np.ndarray) -> None:
        for name, more in (("photo", photo), ("category", category), ("score", score), ("parts", parts), ("item", masks)):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    def kept(self, photo: int) -> _Fold:
        """A fold that goes on with one photo, as its number 0."""
        out, own = _Fold(self.rules), np.flatnonzero(self.photo == photo)
        out.categories = dict(self.categories)
        _, starts, ends = self.masks.of(self.item[own], np.zeros(len(own), np.int64))
        out.append(np.zeros(len(own), np.int64), self.category[own], self.score[own], self.parts[own], out.masks.add(starts, ends, self.masks.count[self.item[own]]))
        member = np.isin(self.home, own)
        out.cand, out.home = self.cand[member], np.searchsorted(own, self.home[member])
        return out

    def finish(self, single: np.ndarray, photos: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, members, members of each): the first ``photos`` photos' items by photo and area. single: for each photo, whether it shows one product.

        Pieces of a pair come together; on a photo of a single product also those of one category, and what is not known to the largest.
        """
        root, late = np.arange(len(self.item)), np.zeros(len(self.item), bool)
        live = np.flatnonzero(self.photo < photos)
        live = live[np.argsort(self.photo[live], kind="stable")]

        def absorb(rows: np.ndarray, into: np.ndarray, best: bool) -> None:
            nonlocal live
            moved = into != rows
            if not moved.any():
                return
            targets = np.unique(into[moved])
            group = np.isin(into, targets)
            rows_, slot = rows[group], np.searchsorted(targets, into[group])
            extra = targets[~np.isin(targets, rows_)]  # what others go to without being among the rows
            rows_, slot = np.concatenate((rows_, extra)), np.concatenate((slot, np.searchsorted(targets, extra)))
            self.masks.unite(self.item[rows_], slot, self.item[targets])
            self.parts[targets] = np.bincount(slot, self.parts[rows_], len(targets)).astype(np.int64)
            if best:
                most = np.full(len(targets), -np.inf)
                np.maximum.at(most, slot, self.score[rows_])
                self.score[targets] = most
            goes = np.arange(len(root))
            goes[rows] = into
            root[:] = goes[root]
            live = live[~np.isin(live, rows[moved])]

        def firsts(rows: np.ndarray) -> np.ndarray:
            _, first, of = np.unique(self.photo[rows] * len(self.categories) + self.category[rows], return_index=True, return_inverse=True)
            return rows[first[of]]

        pairs = live[np.isin(self.category[live], [self.categories[c] for c in self.rules.paired if c in self.categories])]
        absorb(pairs, firsts(pairs), False)
        begun = root.copy()
        if single[:photos].any():
            known = live[single[self.photo[live]] & (self.category[live] != 0)]
            absorb(known, firsts(known), True)
            rest = live[single[self.photo[live]]]
            unknown = rest[self.category[rest] == 0]
            best = rest[np.lexsort((rest, -self.masks.area[self.item[rest]], self.category[rest] == 0, self.photo[rest]))]
            best = np.where(self.category[best] == 0, firsts(best) if len(best) else best, best)
            of, at = np.unique(self.photo[best], return_index=True)
            target = best[at][np.searchsorted(of, self.photo[unknown])]
            target = np.where(self.category[target] == 0, firsts(unknown) if len(unknown) else unknown, target)
            late[unknown] = True
            absorb(unknown, target, True)
        live = live[np.lexsort((live, -self.masks.area[self.item[live]], self.photo[live]))]
        place = np.full(len(root), -1)
        place[live] = np.arange(len(live))
        own = np.flatnonzero(place[root[self.home]] >= 0)
        item = self.home[own]
        order = np.lexsort((own, item, begun[item], late[begun[item]], place[root[item]]))
        return live, self.cand[own[order]], np.bincount(place[root[item]], minlength=len(live))


def merged(candidates: DataFrame, runs: DataFrame, size: DataFrame, single: Column | None = None, min_area: float = MIN_AREA, max_items: int = MAX_ITEMS, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(photo, item, category, score, parts, area, members, merged, stride, starts, ends): the items of each photo, largest first, max_items at most.

    candidates: photo, cand (whole number; ties of area go by it), category, score; ``single`` a condition on them, alike for all of a photo: it shows a
    single product. runs: photo, cand, line, a, b. size: photo, lines, length. A candidate below min_area of the photo, or without runs, goes. members: the
    candidates that an item is made of. merged: how many of the photo's candidates have gone into others. A photo of which nothing is left has no row;
    null categories count as unknown. starts and ends are the item's runs (item_runs() has them as a table).
    """
    masks = runs.groupBy("photo", "cand").agg(F.sum(F.col("b") - F.col("a")).cast("long").alias("area"), F.collect_list(F.struct("line", "a", "b")).alias("_r"))
    known = candidates.select("photo", "cand", F.coalesce("category", F.lit(rules.unknown)).alias("category"), F.col("score").cast("double").alias("score"), (F.lit(False) if single is None else F.coalesce(single, F.lit(False))).alias("single"))
    rows = known.join(masks, ["photo", "cand"]).select("photo", F.col("cand").cast("long").alias("cand"), "category", "score", "single", "area", *(F.col(f"_r.{c}").cast("array<int>").alias(c) for c in ("line", "a", "b")))
    # a photo's frame comes before its candidates: it need not be joined to them
    frame = size.select("photo", (F.col("length") + 1).cast("long").alias("_stride"), (F.col("lines").cast("long") * F.col("length")).alias("_pixels")).where("_stride IS NOT NULL AND _pixels IS NOT NULL")
    rows = rows.unionByName(frame, allowMissingColumns=True).where("photo IS NOT NULL")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "photo").sortWithinPartitions("photo", F.desc_nulls_first("area"), "cand")
    kind = rows.schema["photo"].dataType
    names = ["photo", "item", "category", "score", "parts", "area", "members", "merged", "stride", "starts", "ends"]
    longs = T.ArrayType(T.LongType())
    types = [kind, T.IntegerType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), longs, T.IntegerType(), T.LongType(), longs, longs]

    def rows_of(fold: _Fold, photo: pa.Array, photos: int, stride: np.ndarray, single: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        items, members, each = fold.finish(single, photos)
        of = fold.photo[items]
        shown = np.bincount(of, minlength=max(photos, 1))
        _, starts, ends = fold.masks.of(fold.item[items], np.zeros(len(items), np.int64))
        many = lambda v, count: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(v, pa.int64()))
        cuts, category = fold.masks.count[fold.item[items]], pa.array(list(fold.categories), pa.string())
        values = [
            photo.take(pa.array(of)), pa.array((np.arange(len(of)) - np.searchsorted(of, of) + 1).astype(np.int32)), category.take(pa.array(fold.category[items])), pa.array(fold.score[items], mask=np.isneginf(fold.score[items])), pa.array(fold.parts[items].astype(np.int32)),
            pa.array(fold.masks.area[fold.item[items]]), many(members, each), pa.array((seen[of] - shown[of]).astype(np.int32)), pa.array(stride[of]), many(starts, cuts), many(ends, cuts),
        ]
        return pa.RecordBatch.from_arrays(values, names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Fold(rules), None
        l_stride, l_pixels, l_single, l_seen = 0, 0, False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            photo, (cand, category, score, one, area, line, a, b, stride, pixels) = batch.column(0), batch.columns[1:]
            codes = photo.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            goes_on = last is not None and photo[0].as_py() == last[0].as_py()
            # the photo that is held is number 0
            new = np.concatenate(([not goes_on], codes[1:] != codes[:-1])).astype(np.int64)
            of = np.cumsum(new) - (last is None)
            first = photo.filter(pa.array(new == 1))
            whole = first if last is None else pa.concat_arrays([last, first])
            m = len(whole)
            strides, limits, singles, seen = np.zeros(m, np.int64), np.full(m, np.inf), np.zeros(m, bool), np.zeros(m, np.int64)
            if last is not None:
                strides[0], limits[0], singles[0], seen[0] = l_stride, l_pixels, l_single, l_seen
            is_frame = np.asarray(stride.is_valid())
            strides[of[is_frame]] = stride.drop_null().to_numpy(zero_copy_only=False)
            limits[of[is_frame]] = min_area * pixels.drop_null().to_numpy(zero_copy_only=False)
            areas = area.fill_null(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(~is_frame & (areas >= limits[of]))
            kept = pa.array(keep)
            singles[of[keep]] = one.take(kept).to_numpy(zero_copy_only=False)
            seen += np.bincount(of[keep], minlength=m)
            encoded = category.take(kept).dictionary_encode()
            numbers = np.array([held.categories.setdefault(c, len(held.categories)) for c in encoded.dictionary.to_pylist()], np.int64)
            lines, starts, ends = (x.take(kept) for x in (line, a, b))
            count = np.diff(lines.offsets.to_numpy()).astype(np.int64)
            lines, starts, ends = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lines, starts, ends))
            owner = np.repeat(np.arange(len(keep)), count)
            base = lines * strides[of[keep]][owner]
            order = np.lexsort((base + starts, owner))
            masks = held.masks.add((base + starts)[order], (base + ends)[order], count)
            held.take(of[keep], cand.take(kept).to_numpy(zero_copy_only=False), numbers[encoded.indices.to_numpy(zero_copy_only=False)], score.take(kept).fill_null(-np.inf).to_numpy(zero_copy_only=False), masks)
            yield rows_of(held, whole, m - 1, strides, singles, seen)
            held, last = held.kept(m - 1), whole.slice(m - 1)
            l_stride, l_pixels, l_single, l_seen = strides[-1], limits[-1], singles[-1], seen[-1]
        if last is not None:
            yield rows_of(held, last, 1, np.array([l_stride]), np.array([l_single]), np.array([l_seen]))

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    return dealt.mapInArrow(fold, schema).where(F.col("item") <= max_items)


def item_runs(items: DataFrame) -> DataFrame:
    """(photo, item, line, a, b) of merged()."""
    spans = items.select("photo", "item", "stride", F.explode(F.arrays_zip("starts", "ends")).alias("r"))
    line = F.expr("r.starts div stride")
    return spans.select("photo", "item", line.cast("int").alias("line"), (F.col("r.starts") - line * F.col("stride")).cast("int").alias("a"), (F.col("r.ends") - line * F.col("stride")).cast("int").alias("b"))
