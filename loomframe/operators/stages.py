"""Resumable stages over entities: a table of (entity, stage) says what is done."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import resume


@dataclass(frozen=True)
class Stage:
    name: str
    apply: Callable[[DataFrame], DataFrame]


def pending(entities: DataFrame, done: DataFrame, stage: str, key: str = "entity") -> DataFrame:
    return resume(entities, done.where(F.col("stage") == stage), [key])


def run_stages(entities: DataFrame, done: DataFrame, stages: Sequence[Stage], save: Callable[[str, DataFrame], DataFrame], key: str = "entity", reuse: bool = True, partial: Callable[[str, DataFrame, str], None] | None = None) -> dict[str, DataFrame]:
    """Run each stage on the entities that lack it; save(name, rows) writes a stage's rows and returns all that are stored of it.

    A stage that fails raises after the stages before it were saved; ``partial`` gets the entities that it was to take and
    what went wrong, to be stored beside them.
    """
    out = {}
    for stage in stages:
        todo = pending(entities, done, stage.name, key) if reuse else entities
        try:
            out[stage.name] = entities = save(stage.name, stage.apply(todo))
        except Exception as e:
            if partial is not None:
                partial(stage.name, todo, f"{type(e).__name__}: {e}")
            raise
    return out


@dataclass(frozen=True)
class Config:
    """What a run of the stages is given: backends by kind, sizes and limits. An unknown backend fails when it is built."""

    backends: dict[str, str]
    stages: tuple[str, ...] = ("scene", "segment", "refine", "export", "complete", "views", "mesh")
    max_side: int = 1024
    guard_px: int = 6
    max_items: int = 12
    reuse: bool = True

    @classmethod
    def of(cls, options: dict) -> Config:
        """From options of a command line or a file: unknown names fail, backends are given as kind=name."""
        known = {f.name for f in fields(cls)}
        unknown = set(options) - known
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        pairs = options.get("backends", {})
        chosen = dict(p.split("=", 1) for p in pairs) if isinstance(pairs, list | tuple) else dict(pairs)
        return cls(**{**options, "backends": chosen, **({"stages": tuple(options["stages"])} if "stages" in options else {})})


class StageTable:
    """(entity, stage) records in a folder: which stages of which entities are done, appended as they end."""

    def __init__(self, spark, path: str, key: str = "entity", kind: str = "string"):
        self.spark, self.path, self.key, self.schema = spark, path, key, f"{key} {kind}, stage string, at timestamp"

    def done(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def mark(self, rows: DataFrame, stage: str) -> None:
        rows.select(self.key, F.lit(stage).alias("stage"), F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)


def mean_timings(timings: DataFrame) -> DataFrame:
    """(stage, seconds, n): mean seconds of each stage over the entities that have it. timings: entity, timings (map)."""
    flat = timings.select(F.explode("timings").alias("stage", "s")).where("s is not null")
    return flat.groupBy("stage").agg(F.round(F.avg("s"), 3).alias("seconds"), F.count(F.lit(1)).alias("n"))
