"""Outfit candidates, their scores, and the greedy choice of diverse ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, dims, rules

ITEM = ["id", "category", "primary_color", "pattern", "fit", "formality", "style_tags", "days_since_worn"]


def slot_candidates(items: DataFrame, need_outer: bool, context: str = "context") -> DataFrame:
    """(context, items): tops with bottoms, and dresses, each with an outer and shoes where there are any.

    items: usable items with context, slot (top, bottom, dress, outer, shoes) and a struct ``item``. The
    combinations of a context are the result itself; slots are joined on the context, never across contexts.
    """
    slot = {s: items.where(F.col("slot") == s).select(context, F.col("item").alias(s)) for s in ("top", "bottom", "dress", "outer", "shoes")}
    pairs = slot["top"].join(slot["bottom"], context).select(context, F.array("top", "bottom").alias("items"))
    bases = pairs.unionByName(slot["dress"].select(context, F.array("dress").alias("items")))
    for s, wanted in (("outer", need_outer), ("shoes", True)):
        if wanted:
            bases = bases.join(slot[s], context, "left").select(context, F.array_compact(F.concat("items", F.array(s))).alias("items"))
    return bases


def _hue(rgb: tuple[int, int, int]) -> float:
    _, a, b = color.lab_values(rgb)
    return math.degrees(math.atan2(b, a)) % 360


def hue_map() -> Column:
    """Literal map from colour name to hue angle."""
    return F.create_map(*(F.lit(v) for name, rgb in dims.COLORS.items() for v in (name, _hue(rgb))))


def scored(outfits: DataFrame, target: Column, wanted: Column | None = None, body: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """outfits with the parts of the score, score, and ids."""
    field = lambda name: F.transform("items", lambda i: i[name])
    pick = lambda cats: F.get(F.filter("items", lambda i: i["category"].isin(*cats)), F.lit(0))["fit"]
    fresh = F.transform("items", lambda i: rules.freshness(i["days_since_worn"]))
    parts = {
        "color": rules.color_score(F.col("_accents"), field("pattern"), hue_map()),
        "silhouette": rules.silhouette_score(pick(("상의", "원피스")), pick(("하의",))),
        "style": rules.style_score(field("style_tags"), wanted),
        "formality": rules.formality_score(field("formality"), target),
        "freshness": F.aggregate(fresh, F.lit(0.0), lambda s, x: s + x) / F.size("items"),
        "body": body if body is not None else F.lit(1.0),
    }
    out = outfits.withColumn("_accents", rules.accents(field("primary_color"))).withColumns(parts)
    return out.withColumns({"score": rules.outfit_score({k: F.col(k) for k in parts}, weights), "ids": field("id")}).drop("_accents")


def greedy_diverse(outfits: DataFrame, context: str, top_n: int = 3, max_reuse: int = 1) -> DataFrame:
    """(context, rank, ids, score): the best outfits in which no item but shoes comes up more than max_reuse times.

    outfits: context, score, ids (array), core (array: the ids that count). Rows come sorted to
    the task and are read as a stream; of a context only the counts of chosen items are held.
    """
    kind = outfits.schema[context].dataType.simpleString()
    rows = outfits.select(context, "score", "ids", "core").repartition(context).sortWithinPartitions(context, F.desc("score"), "ids")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, taken = None, {}, 0
        for pdf in batches:
            out = []
            for key, score, ids, core in pdf.itertuples(index=False, name=None):
                if key != current:
                    current, used, taken = key, {}, 0
                if taken < top_n and all(used.get(i, 0) < max_reuse for i in core):
                    taken += 1
                    for i in core:
                        used[i] = used.get(i, 0) + 1
                    out.append((key, taken, list(ids), score))
            yield pd.DataFrame(out, columns=[context, "rank", "ids", "score"])

    item = outfits.schema["ids"].dataType.simpleString()
    return rows.mapInPandas(choose, f"{context} {kind}, rank int, ids {item}, score double")
