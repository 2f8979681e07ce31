"""Circuit breaker: a provider that keeps failing is left alone. Skipped rows don't count, so no window can say it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def circuit_breaker(tries: DataFrame, provider: str, order: list[str], ok: str, least_failures: int = 20, least_share: float = 0.1) -> DataFrame:
    """(provider, n_ok, n_failed, n_skipped): rows come sorted to a task and stream by; only a provider's counts are held."""
    kind = tries.schema[provider].dataType.simpleString()
    rows = tries.select(provider, *order, ok).repartition(provider).sortWithinPartitions(provider, *order).select(provider, ok)
    columns = [provider, "n_ok", "n_failed", "n_skipped"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, counts, begun = None, [0, 0, 0], False
        for pdf in batches:
            out = []
            for key, good in pdf.itertuples(index=False, name=None):
                if not begun or key != current:
                    if begun:
                        out.append((current, *counts))
                    current, counts, begun = key, [0, 0, 0], True
                if counts[1] >= least_failures and counts[0] < least_share * (counts[0] + counts[1]):
                    counts[2] += 1
                else:
                    counts[0 if good else 1] += 1
            yield pd.DataFrame(out, columns=columns)
        if begun:
            yield pd.DataFrame([(current, *counts)], columns=columns)

    return rows.mapInPandas(run, f"{provider} {kind}, n_ok long, n_failed long, n_skipped long")


def stream(tries: DataFrame, provider: str, order: list[str], ok: str, least_failures: int = 20, least_share: float = 0.1) -> DataFrame:
    """The same over a stream, in update mode: counts are kept by provider; within a batch tries are put in order, across batches they must arrive in order."""
    kind = tries.schema[provider].dataType.simpleString()
    fields = "n_ok long, n_failed long, n_skipped long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        counts = list(held.get) if held.exists else [0, 0, 0]
        for good in pd.concat(list(batches)).sort_values(order)[ok]:
            if counts[1] >= least_failures and counts[0] < least_share * (counts[0] + counts[1]):
                counts[2] += 1
            else:
                counts[0 if good else 1] += 1
        held.update(tuple(int(c) for c in counts))
        yield pd.DataFrame([(*key, *counts)], columns=[provider, "n_ok", "n_failed", "n_skipped"])

    return tries.select(provider, *order, ok).groupBy(provider).applyInPandasWithState(run, f"{provider} {kind}, {fields}", fields, "update", "NoTimeout")
