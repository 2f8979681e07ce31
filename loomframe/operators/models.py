"""Boundary to external models: named backends behind one call, one model a Python worker.

No weights are here. A backend is a factory that returns predict(list of rows) -> list of dicts; unknown names fail.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predict = Callable[[list[dict]], list[dict]]
BACKENDS: dict[tuple[str, str], Callable[[], Predict]] = {}


def backend(kind: str, name: str):
    def register(factory: Callable[[], Predict]):
        BACKENDS[kind, name] = factory
        return factory

    return register


def build(kind: str, name: str) -> Callable[[], Predict]:
    if (kind, name) not in BACKENDS:
        raise KeyError(f"no backend {name!r} of kind {kind!r}; known: {sorted(n for k, n in BACKENDS if k == kind)}")
    return BACKENDS[kind, name]


#: The kinds of model behind the boundary, and what a row of each gets. Real weights register themselves under other names.
KINDS = {
    "mask": "mask: the foreground of a picture", "segment": "items: named masks of a picture", "scene": "case and expected items of a picture", "tag": "a record of a garment",
    "complete": "a picture with hidden parts restored", "views": "further views", "mesh": "a mesh", "edit": "an edited picture", "embed": "a vector", "judge": "scores by question",
}


@backend("scene", "none")
def _no_scene() -> Predict:
    return lambda rows: [{"case": None} for _ in rows]


@backend("complete", "passthrough")
def _passthrough() -> Predict:
    return lambda rows: [dict(r) for r in rows]


def _nothing(field: str) -> Callable[[], Predict]:
    return lambda: lambda rows: [{field: None} for _ in rows]


for _kind, _field in (("views", "views"), ("mesh", "mesh_path")):
    BACKENDS[_kind, "none"] = _nothing(_field)


def _digest(row: dict) -> bytes:
    return hashlib.sha1(repr(sorted((k, str(v)) for k, v in row.items())).encode()).digest()


def fake(field: str, make: Callable[[dict, bytes], object]) -> Callable[[], Predict]:
    """A backend that is a function of its row alone: the same answer on every run."""
    return lambda: lambda rows: [{field: make(r, _digest(r))} for r in rows]


for _kind, _field, _make in (
    ("mask", "mask", lambda r, d: [0, int(r.get("width") or 1) * int(r.get("height") or 1)]),  # all foreground, as run lengths
    ("segment", "items", lambda r, d: [{"category": "top", "score": d[0] / 255}]),
    ("scene", "case", lambda r, d: ("case1", "case2", "case3")[d[0] % 3]),
    ("tag", "record", lambda r, d: json.dumps({"formality": 1 + d[0] % 5})),
    ("complete", "ai_restored", lambda r, d: True),
    ("views", "views", lambda r, d: ["front", "back"]),
    ("mesh", "mesh_path", lambda r, d: f"{d.hex()[:8]}.glb"),
    ("edit", "out", lambda r, d: f"{d.hex()[:8]}.png"),
    ("embed", "vector", lambda r, d: (lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v])([b - 127.5 for b in d[:8]])),
    ("judge", "scores", lambda r, d: {"type": d[0] / 64 - 2, "color": d[1] / 64 - 2, "added": d[2] / 64 - 2}),
):
    BACKENDS[_kind, "fake"] = fake(_field, _make)


def chat_backend(transport: Callable[[dict], dict], model: str, prompt: str, schema: dict | None = None, image: str = "url", field: str = "text") -> Callable[[], Predict]:
    """A backend over a chat service: a request for each row with its picture as a URL, the answer's text back. transport takes the body.

    An answer without text raises, so predict() makes its batch rows with an error.
    """

    def one(row: dict) -> dict:
        body = {"model": model, "messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": row[image]}}, {"type": "text", "text": prompt}]}]}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "record", "schema": schema, "strict": True}}
        return {field: transport(body)["choices"][0]["message"]["content"]}

    return lambda: lambda rows: [one(r) for r in rows]


def fit_verifier(rows: DataFrame, vector: str = "vector", label: str = "label", max_iter: int = 100, reg: float = 0.0):
    """A logistic regression over vectors (arrays of doubles), fitted by Spark's own distributed optimiser."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ready = rows.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=reg).fit(ready)


def verify(rows: DataFrame, model, vector: str = "vector", out: str = "prob") -> DataFrame:
    """rows with the model's probability of a good one."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(vector))))
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


def held_out(rows: DataFrame, item: str, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out ones, by item: items 1, 6, 11, ... in their order are held out with all their rows."""
    from .relational import every_nth

    chosen = every_nth(rows.select(item).distinct(), item, every)
    return rows.join(chosen, item, "left_anti"), rows.join(chosen, item, "left_semi")


def relative_error(got: Column, want: Column) -> Column:
    """The norm of the difference of two arrays over that of the second: how far an accelerator's answer is from the plain one."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    gap = F.zip_with(got, want, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(gap) / F.greatest(norm(F.transform(want, lambda x: x.cast("double"))), F.lit(1e-12))


def self_test(rows: DataFrame, kind: str, name: str, want: str, schema: str, field: str, most: float = 0.01) -> DataFrame:
    """(row columns, error, ok): a backend's arrays against wanted ones; a failure is not ok."""
    found = predict(rows, kind, name, schema)
    gap = relative_error(F.col(field), F.col(want))
    return found.withColumn("ok", F.col("error").isNull() & F.coalesce(gap <= most, F.lit(False)))


def predict(rows: DataFrame, kind: str, name: str, schema: str, batch: int = 32) -> DataFrame:
    """Apply a backend in batches. A failing batch becomes rows with ``error``, as the transport of a model may fail; schema must have an error column."""
    factory = build(kind, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            records = pdf.to_dict("records")
            for i in range(0, len(records), batch):
                part = records[i : i + batch]
                try:
                    found = [{**p, **q, "error": None} for p, q in zip(part, model(part), strict=True)]
                except Exception as e:  # the boundary: a model's failure is data
                    found = [{**p, "error": f"{type(e).__name__}: {e}"} for p in part]
                yield pd.DataFrame([{c: x.get(c) for c in columns} for x in found], columns=columns, dtype=object)

    from pyspark.sql.types import _parse_datatype_string

    columns = _parse_datatype_string(schema).names
    return rows.mapInPandas(run, schema)
