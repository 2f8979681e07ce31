"""Hilbert-curve sharding.

Several metadata dimensions (language, source, size, id) are quantised to a few
bits each; the position of a row's cell on the Hilbert curve through the grid
orders the table, and the order is cut into runs of equal row counts. Rows that
are near in every dimension land in the same run, so the min/max statistics of a
run's file prune on each dimension. Only DataFrame operations are used.

Plan: one scan of the text (its size and CRC), one range exchange of rows
without text, one aggregation of a row for each partition. Range partitioning
splits a hot cell (ties go on by CRC and id), so no task gets more than its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, whole


def _rotations(n: int) -> tuple[list[int], list[int]]:
    """For each cell of a 2^n cube in curve order: entry corner and direction."""
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: ((i ^ (i + 1)) >> 1).bit_count()  # noqa: E731  trailing set bits
    entry = [0 if w == 0 else gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turn = [0 if w == 0 else (ones(w) if w & 1 else ones(w - 1)) % n for w in range(1 << n)]
    return entry, turn


def hilbert_index(dims: Sequence[Column], bits: int) -> Column:
    """Position on the Hilbert curve (long) of a cell with len(dims) coordinates of ``bits`` bits.

    Folds over the bit levels, highest first; the state is the index so far with
    the orientation of the sub-cube: its entry corner and its direction.
    """
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the index must fit a long")
    entry, turn = ([F.lit(v) for v in table] for table in _rotations(n))
    mask = (1 << n) - 1
    # a shift by a value of the row: the function takes a column where the wrapper takes a number
    shift_right = lambda v, k: F.call_function("shiftright", v, k)
    shift_left = lambda v, k: F.call_function("shiftleft", v, k)
    right = lambda v, k: (shift_right(v, k).bitwiseOR(shift_left(v, n - k))).bitwiseAND(F.lit(mask))
    left = lambda v, k: (shift_left(v, k).bitwiseOR(shift_right(v, n - k))).bitwiseAND(F.lit(mask))

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for i, d in enumerate(dims):
            bit = shift_right(d, level).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(bit * (1 << i))
        by = (acc["d"] + 1) % n
        seen = right(corner.bitwiseXOR(acc["e"]), by)
        w = seen
        for k in range(1, n):
            w = w.bitwiseXOR(F.shiftright(seen, k))
        return F.struct(
            (acc["h"] * (1 << n) + w).cast("long").alias("h"),
            acc["e"].bitwiseXOR(left(F.element_at(F.array(*entry), w + 1), by)).cast("int").alias("e"),
            ((acc["d"] + F.element_at(F.array(*turn), w + 1) + 1) % n).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def _placed(rows: DataFrame, order: Sequence[str], weight: Column) -> DataFrame:
    """rows in ``order``, with the sum of the weights before each (_before) and of all (_all).

    One range exchange; what lies between partitions is a row for each of them.
    """
    # the range exchange samples anew each time it runs, so its result is fixed by a checkpoint before counting
    placed = cut(rows.withColumn("_w", weight.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum("_w").alias("_n"))
    parts_in_order = Window.orderBy("_part")
    offsets = sizes.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(parts_in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.sum("_n").over(parts_in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return met.withColumn("_before", F.col("_earlier") + F.coalesce(F.sum("_w").over(within), F.lit(0))).drop("_w", "_part", "_p", "_earlier")


def category_cuts(df: DataFrame, col: str, bits: int) -> list[tuple[str, int]]:
    """(first value, code) of the equi-depth classes of a string column in alphabetical order, 2^bits at most; null counts as ''."""
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("")).alias("v")).count()
    code = F.expr(f"_before * {1 << bits} div _all").cast("int")
    found = _placed(counts, ["v"], F.col("count")).groupBy(code.alias("code")).agg(F.min("v").alias("v")).collect()
    return sorted((r["v"], r["code"]) for r in found)


def category_code(col: str, cuts: list[tuple[str, int]]) -> Column:
    """The code of the last class that begins at or before the value."""
    value = F.coalesce(F.col(col).cast("string"), F.lit(""))
    if not cuts:
        return F.lit(0)
    classes = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(c).alias("c")) for v, c in cuts))
    return F.element_at(F.filter(classes, lambda x: x["v"] <= value), -1)["c"]


def _runs(rows: DataFrame, order: Sequence[str], n_shards: int) -> DataFrame:
    """Exact ranks in ``order``, cut into n_shards runs whose counts differ by one at most."""
    # The range exchange samples anew each time it runs, so its result is fixed by a checkpoint before counting.
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    in_part = F.lit((1 << 33) - 1)
    part = F.shiftright("_m", 33)
    # a row for each partition: bounded by their number, whatever the table's size
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    order_parts = Window.orderBy("_part")
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(order_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(order_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    ranked = placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("_rank", F.col("_before") + F.col("_m").bitwiseAND(in_part))
    shard = F.expr(f"_rank * {n_shards} div _all")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.expr(f"_rank - (shard * _all + {n_shards - 1}) div {n_shards}").cast("long"))
        .drop("_m", "_part", "_before", "_all", "_rank")
    )


def hilbert_shards(
    docs: DataFrame,
    n_shards: int = 24,
    bits: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: Sequence[str] = ("lang", "source"),
) -> DataFrame:
    """One row a document: id, size, text_crc32, hilbert, shard, slot.

    Dimensions: each category, the size on a log scale, and the id within its
    range. Null text counts as empty (size 8, CRC 0), null category as '', null id
    as coordinate 0. Equal rows are told apart by nothing and take neighbouring
    slots. An empty table gives no rows. Further columns of ``docs`` are not read.
    """
    top = (1 << bits) - 1
    text = whole(F.col(text_col))
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    low, span = low or 0, (high or 0) - (low or 0) + 1
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(categories)),
    )
    names = [f"_q{i}" for i in range(len(categories))]
    for i, c in enumerate(categories):
        rows = rows.withColumn(names[i], category_code(f"_c{i}", category_cuts(docs, c, bits)))  # counting reads this one column
    # a size doubles over eight steps: 2^32 bytes are the last code of 8 bits
    by_size = F.least(F.floor(F.log2(F.col("size")) * (1 << bits) / 32), F.lit(top)).cast("int")
    by_id = F.coalesce(F.floor((F.col("_id") - F.lit(low)).cast("double") * (1 << bits) / F.lit(float(span))), F.lit(0))
    rows = rows.withColumns({"_qs": by_size, "_qi": F.greatest(F.lit(0), F.least(by_id, F.lit(top))).cast("int")})
    # fixed before the range exchange, which reads its input twice: once to sample it
    indexed = cut(rows.select("_id", "size", "text_crc32", hilbert_index([F.col(c) for c in (*names, "_qs", "_qi")], bits).alias("hilbert")))
    return _runs(indexed, ["hilbert", "text_crc32", "_id"], n_shards).withColumnRenamed("_id", id_col)


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows_a_file: int = 100_000) -> None:
    """Write docs as a folder for each shard, rows in slot order within each file.

    ``shards`` is what hilbert_shards returned for docs. Every row is written once: rows meet by id
    (null equals null), size and CRC of the text, and rows that agree in all three by their number,
    so that repeated rows take each of their slots. A column of docs named shard or slot is replaced.
    """
    text, names = whole(F.col(text_col)), [c for c in docs.columns if c not in ("shard", "slot")]
    size, crc, number = fresh([*docs.columns, "shard", "slot"], "size", "crc", "number")
    keyed = docs.select(*names).withColumns({size: (F.octet_length(text) + 8).cast("long"), crc: F.crc32(text.cast("binary"))})
    keyed = keyed.withColumn(number, F.row_number().over(Window.partitionBy(id_col, size, crc).orderBy(F.lit(0))))
    dealt = shards.select(F.col(id_col).alias("id"), F.col("size").alias("s"), F.col("text_crc32").alias("c"), "shard", "slot")
    dealt = dealt.withColumn("k", F.row_number().over(Window.partitionBy("id", "s", "c").orderBy("shard", "slot")))
    on = keyed[id_col].eqNullSafe(dealt["id"]) & (keyed[size] == dealt["s"]) & (keyed[crc] == dealt["c"]) & (keyed[number] == dealt["k"])
    joined = keyed.join(dealt, on).select(*(keyed[c] for c in names), "shard", "slot")
    joined.repartition("shard", F.floor(F.col("slot") / rows_a_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
