"""Ingestion that can be stopped anywhere and run again: the log of what was kept is its only state.

A batch of candidates is filtered, made distinct against itself and the log by each key (id, content), cut
to what the quota leaves, and written to the log as the folder of its number. A batch that is run again after a failure writes the
same folder anew and does not count itself, so nothing is kept twice. What was rejected is not logged: a run
over the source from its start looks at it again, and keeps it if it passes now.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import cut


def first_distinct(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that a walk in order keeps which leaves out every row that shares a key's value with a kept one.

    Null is a value like others. ``order`` tells rows apart. In a round, a row that comes first for all of its values is kept, and whatever shares one with it goes;
    the row that comes first of all is always such a one. Rounds follow the longest chain of rows that leave each other out, which is short; each is a few groupings.
    """
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    left, kept = cut(rows.withColumn("_at", place)), None
    while True:
        first = left
        for k in keys:
            least = left.groupBy(F.col(k).alias("_k")).agg(F.min("_at").alias("_least"))
            first = first.join(least, F.col(k).eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_least")), "left_semi")
        first = cut(first)
        kept = first if kept is None else kept.unionByName(first)
        for k in keys:
            there = first.select(F.col(k).alias("_k")).distinct()
            left = left.join(there, F.col(k).eqNullSafe(F.col("_k")), "left_anti")
        left = cut(left)
        if not left.limit(1).count():
            return kept.drop("_at")


@dataclass
class Log:
    """Kept rows in a folder that all machines share: a table for each batch of a run, below the run's name."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def read(self) -> DataFrame:
        columns = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(self.path)

    def write(self, rows: DataFrame, run: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")


@dataclass
class Ingestion:
    """accepted: a condition on the rows. keys: what makes rows the same. order: what tells them apart, in the order of the source. quota: rows of the log in all."""

    log: str
    accepted: Column
    keys: Sequence[str]
    order: Sequence[str]
    quota: int
    name: str = "run"
    total: int = field(default=0, init=False)  # rows in the log after the last batch

    def take(self, batch: DataFrame, number: int = 0) -> None:
        """One batch to the log."""
        log = Log(batch.sparkSession, self.log, batch.schema)
        others = log.read().where(~((F.col("run") == self.name) & (F.col("batch") == number)))
        before = others.count()
        fresh = batch.where(self.accepted)
        for k in self.keys:
            seen = others.select(F.col(k).alias("_k")).distinct()
            fresh = fresh.join(seen, F.col(k).eqNullSafe(F.col("_k")), "left_anti")
        room = max(0, self.quota - before)
        kept = cut(first_distinct(fresh, self.keys, self.order).orderBy(*self.order).limit(room)) if room else batch.limit(0)
        log.write(kept.select(*batch.columns), self.name, number)
        self.total = before + kept.count()

    def run(self, stream: DataFrame, checkpoint: str, wait: float = 0.2) -> int:
        """Take the stream's batches until the quota is full or all that there is has been read; rows in the log. A run that failed goes on with the same checkpoint and name."""
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            idle = 0
            while query.isActive and self.total < self.quota and idle < 3:
                time.sleep(wait)
                idle = idle + 1 if not (query.status["isDataAvailable"] or query.status["isTriggerActive"]) else 0
                if idle:
                    query.processAllAvailable()
        finally:
            failure = query.exception()
            query.stop()
        if failure:
            raise failure
        return self.total
