"""Line deduplication with levelled sorted runs.

The lines' hashes are written once, dealt to batches by ascending id. Each batch
is reduced to its distinct keys, merge-anti-joined against every run kept so
far, and what is new becomes a run of its own: (key, owner), hash-bucketed and
sorted, so that the next batch joins it without an exchange or a sort. When a
level holds ``fanout`` runs they are compacted into one run of the next level.
As batches ascend by id, a key's owner is the smallest id that holds it.

A line stays where (key, id) is in the runs. That join is on key *and* id, so a
line that a third of all documents hold is spread like any other. Only
DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, parts, scratch_path, stored, whole

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line, stripped of white space and with A-Z (nothing else) in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class RunStore:
    """Disjoint runs of (h1, h2, owner), in levels."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.buckets = spark, fanout, parts(spark)
        self.levels: list[list[tuple[str, str]]] = [[]]

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        path = scratch_path(self.spark, "run")
        name = path.rpartition("/")[2].replace("-", "_")
        (
            rows.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", path)
            .saveAsTable(name)
        )
        return name, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, owner) whose keys are distinct."""
        for run in self.runs():
            batch = batch.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(batch))
        self._compact()

    def _compact(self) -> None:
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                old = self.levels[i]
                merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n, _ in old]))
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)
                for name, path in old:
                    self._drop(name, path)

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, path)

    def close(self) -> None:
        """Take the runs out of the catalog, and their files away."""
        for level in self.levels:
            for name, path in level:
                self._drop(name, path)
        self.levels = [[]]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs())


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    n_batches: int = 3,
    fanout: int = 3,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """docs with text_col replaced by the kept lines, and lines_col and dropped_col (long) added.

    A key of min_chars code points or more stays only in the smallest id that
    holds it (there with all its lines). Null or empty text is one empty line. A
    null id counts as smaller than any other, rows that share an id as one
    document. Keys are compared by 128 bits of hash. Columns of ``docs`` named
    lines_col or dropped_col are replaced, all others stay, whatever they are called. The runs
    and lines that the work wrote are gone when it returns; the marks it reads stay. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    row_id, row_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(low)), F.xxhash64(whole(text_col))
    lines = F.split(whole(text_col), "\n", -1)
    cuts = docs.agg(F.percentile_approx(row_id, [i / n_batches for i in range(1, n_batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    occurrences_at = scratch_path(spark, "lines")
    (
        docs.select(row_id.alias("id"), row_hash.alias("row"), F.posexplode(lines).alias("pos", "line"))
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), batch.cast("int").alias("batch"))
        .write.partitionBy("batch")
        .parquet(occurrences_at)
    )
    occurrences = spark.read.schema("id long, row long, pos int, h1 long, h2 long, batch int").parquet(occurrences_at)
    store = RunStore(spark, fanout)
    for b in range(len(set(cuts)) + 1):
        store.add(occurrences.where(F.col("batch") == b).groupBy(*KEY).agg(F.min("id").alias("owner")))
    owned = store.all().withColumnRenamed("owner", "id")
    dropped = occurrences.select("id", "row", "pos", *KEY).join(owned.hint("merge"), ["id", *KEY], "left_anti")
    own_id, own_row, marked, own_lines = fresh(docs.columns, "id", "row", "gone", "lines")
    dropped = stored(dropped.groupBy(F.col("id").alias(own_id), F.col("row").alias(own_row)).agg(F.collect_set("pos").alias(marked)), "dropped")
    store.close()
    delete(spark, occurrences_at)
    names = [c for c in docs.columns if c not in (lines_col, dropped_col)]
    joined = docs.select(*names).join(dropped, (row_id == F.col(own_id)) & (row_hash == F.col(own_row)), "left")
    gone = F.coalesce(F.col(marked), F.array().cast("array<int>"))
    positions = F.sequence(F.lit(0), F.size(own_lines) - 1)
    kept = F.when(F.size(gone) == 0, whole(text_col)).otherwise(
        F.array_join(F.transform(F.array_except(positions, gone), lambda p: F.get(F.col(own_lines), p)), "\n")
    )
    return joined.withColumn(own_lines, lines).select(
        *(kept.alias(c) if c == text_col else F.col(c) for c in names),
        F.size(own_lines).cast("long").alias(lines_col),
        F.size(gone).cast("long").alias(dropped_col),
    )
