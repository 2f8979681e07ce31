"""What the corpus operators share: table access, the shared scratch folder, the word rule."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without an argument splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder of the warehouse, which executors reach as well.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that lost executors lose none of it."""
    scratch(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: like cut(), but later plans know how large it is, and broadcast it only if it is small."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a table may weigh that goes to every task, and the share of the rows (one in so many) from which a key is hot.
BROADCAST_BYTES, HOT_SHARE, SALTS = 8 << 20, 1000, 32


def with_small(rows: DataFrame, small: DataFrame, on: dict[str, str], weight: Column, salt: Column) -> DataFrame:
    """rows left-joined to a table of one row a key that is usually small; on: its key of each column of rows.

    ``weight`` is a row's bytes. Up to BROADCAST_BYTES in all, summed over the rows themselves, the table is broadcast as it is and rows stay where they
    are. Beyond that both meet in sort-merge joins: keys with more than one in HOT_SHARE of the rows (so fewer than that many keys) in SALTS parts by
    ``salt``, the rest by key alone, so that nothing is repeated for them. small should be stored, as it is read more than once.
    """
    same = lambda names: reduce(lambda a, b: a & b, (F.col(k) == F.col(n) for k, n in zip(on, names, strict=True)))
    if (small.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), same(on.values()), "left")
    taken = [*rows.columns, *small.columns]
    n, part, of, *keys = fresh(taken, "n", "part", "of", *(f"key{i}" for i in range(len(on))))
    counts = stored(rows.groupBy(*(F.col(k).alias(h) for k, h in zip(on, keys, strict=True))).agg(F.count(F.lit(1)).alias(n)), "counts")
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(counts.where(F.col(n) * HOT_SHARE > total).select(*keys))
    in_small = reduce(lambda a, b: a & b, (F.col(s) == F.col(h) for s, h in zip(on.values(), keys, strict=True)))
    spread = small.join(hot, in_small, "left_semi").withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    crowded = rows.join(hot, same(keys), "left_semi").withColumn(part, F.pmod(salt, F.lit(SALTS))).join(spread, same(on.values()) & (F.col(part) == F.col(of)), "left").drop(part, of)
    return crowded.union(rows.join(hot, same(keys), "left_anti").join(small.hint("merge"), same(on.values()), "left"))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like these that clash with none that is taken."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
