"""Wear and care of items: a fold over ordered events, in batch and as a keyed stream.

Event kinds: wear, hot, sweaty, snooze, start, wash. State: load since the last
wash, the learned interval (or none), the state's name, the number of wears.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import CLEAN, NEEDS_WASH, WASHING, WORN

FRESH = (0.0, None, CLEAN, 0)
FIELDS = "load double, interval_override double, state string, wear_count long"


def apply(state: tuple, kind: str, base: float) -> tuple:
    """The state after one event; base is the item's interval before any learning."""
    load, override, name, wears = state
    limit = override or base
    if kind in ("wear", "hot", "sweaty"):
        load += {"wear": 1.0, "hot": 1.5, "sweaty": limit}[kind]
        return load, override, NEEDS_WASH if load >= limit - 1e-9 else WORN, wears + 1
    if kind == "snooze" and name == NEEDS_WASH:
        override = min(limit + 1, 2.0 * base)
        return load, override, WORN if load < override else NEEDS_WASH, wears
    if kind == "start":
        return load, override, WASHING, wears
    if kind == "wash":
        return 0.0, override, CLEAN, wears
    return state


def fold(events: DataFrame, item: str, order: list[str], base: Column) -> DataFrame:
    """Last state of each item. events: item, order columns, kind.

    Events reach a task sorted and are folded as they stream by: a long history is never held.
    """
    kind = events.schema[item].dataType.simpleString()
    rows = events.select(item, *order, "kind", base.cast("double").alias("_base")).repartition(item).sortWithinPartitions(item, *order).select(item, "kind", "_base")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, begun = None, FRESH, False
        for pdf in batches:
            out = []
            for key, what, base in pdf.itertuples(index=False, name=None):
                if not begun or key != current:
                    if begun:
                        out.append((current, *state))
                    current, state, begun = key, FRESH, True
                state = apply(state, what, base)
            yield pd.DataFrame(out, columns=[item, "load", "interval_override", "state", "wear_count"])
        if begun:
            yield pd.DataFrame([(current, *state)], columns=[item, "load", "interval_override", "state", "wear_count"])

    return rows.mapInPandas(run, f"{item} {kind}, {FIELDS}")


def last_days(events: DataFrame, item: str, day: str) -> DataFrame:
    """(item, last_worn, last_washed): the last day of a wear and of a wash; they need no order, so no fold."""
    worn, washed = F.col("kind").isin("wear", "hot", "sweaty"), F.col("kind") == "wash"
    return events.groupBy(item).agg(F.max(F.when(worn, F.col(day))).alias("last_worn"), F.max(F.when(washed, F.col(day))).alias("last_washed"))


def stream(events: DataFrame, item: str, order: list[str], base: float) -> DataFrame:
    """The same as a stream in update mode: a row of each item that a micro-batch touches. Within a batch events are put in order; across batches they must arrive in order."""
    kind = events.schema[item].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else FRESH
        state = tuple(None if pd.isna(v) else v for v in state)
        for what in pd.concat(list(batches)).sort_values(order)["kind"]:
            state = apply(state, what, base)
        held.update(state)
        yield pd.DataFrame([(*key, *state)], columns=[item, "load", "interval_override", "state", "wear_count"])

    return events.select(item, *order, "kind").groupBy(item).applyInPandasWithState(run, f"{item} {kind}, {FIELDS}", FIELDS, "update", "NoTimeout")
