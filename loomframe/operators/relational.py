"""Joins, dedup and sampling with a defined order. Every choice of a row names its order columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the last in ``order``. Aggregated in part before the exchange, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def dedup_id_then_content(df: DataFrame, id_col: str, content: Column, order: Sequence[Column], history: DataFrame | None = None) -> DataFrame:
    """First row of each id, then of each content hash; ``history`` (id, sha1) holds what earlier runs kept."""
    rows = df.withColumn("sha1", F.sha1(content.cast("binary")))
    rows = earliest(rows, [id_col], order).select(*rows.columns)
    rows = earliest(rows, ["sha1"], order).select(*rows.columns)
    if history is not None:
        rows = rows.join(history.select(id_col), id_col, "left_anti").join(history.select("sha1"), "sha1", "left_anti").select(*rows.columns)
    return rows


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def strict_lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails on a row without a partner."""
    marked = df.join(dim.withColumn("_there", F.lit(True)), list(keys), "left")
    return marked.where(F.assert_true(F.col("_there").isNotNull(), F.lit("a key has no row in the dimension")).isNull()).drop("_there")


def top_by_hash(df: DataFrame, group: Sequence[str], name: Column, n: int) -> DataFrame:
    """The first n rows of each group in the order of the SHA-1 of a name, with their rank."""
    w = Window.partitionBy(*group).orderBy(F.sha1(name.cast("string").cast("binary")), name)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def round_robin(df: DataFrame, label: str, name: Column, n: int) -> DataFrame:
    """n rows, one of each label in turn (labels sorted, exhausted ones skipped), by hash within a label.

    Only the first n of each label can be taken, so the final sort sees n rows a label at most.
    """
    ranked = top_by_hash(df, [label], name, n)
    return ranked.orderBy("rank", label).limit(n)


def first_n_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of the whole table in the order of a distinct key.

    Ranks come from the counts of range partitions, so no task sees all rows.
    """
    spread = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = cut(spread.withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))
    return placed.join(F.broadcast(offsets), part == F.col("_p")).where((F.col("_before") + at) % n == 0).select(*df.columns)


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share: spark.checkpoint.dir, or one of the warehouse where none is named."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns to ``spark.sql.shuffle.partitions``, which adaptive execution leaves as they are.

    For steps that make much of few bytes: partitions are put together by their compressed size, whatever a task holds of them later.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """df with, for each weight, its sum over the rows before in the order of the group (name_before) and over the whole group (name_all).

    One range exchange by group and order, so that a large group is many partitions; between them goes a row
    for each partition and group. ``order`` tells rows of a group apart.
    """
    marked = df.withColumns({f"_w_{n}": w for n, w in weights.items()}).repartitionByRange(*by, *order)
    placed = cut(marked.withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", *by).agg(*(F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights))
    group = Window.partitionBy(*by)
    earlier, everything = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select("_part", *by, *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in weights), *(F.sum(f"_s_{n}").over(everything).alias(f"{n}_all") for n in weights))
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    renamed = offsets.select(F.col("_part").alias("_of_part"), *(F.col(c).alias(f"_g_{c}") for c in by), *(c for c in offsets.columns if c not in ("_part", *by)))
    on = F.col("_part") == F.col("_of_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    met = placed.join(renamed, on)
    return met.select(*df.columns, *((F.col(f"_o_{n}") + F.coalesce(F.sum(f"_w_{n}").over(within), F.lit(0))).alias(f"{n}_before") for n in weights), *(f"{n}_all" for n in weights))


def top_by_pair_hash(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str, n: int, block: int = 4096) -> DataFrame:
    """(left_key, right_key, attempt): for each left row the first n right rows of its group by the SHA-1 of "left|right", ties by right_key.

    The order is another one for each left row, so every pair of a group is hashed; but no pair leaves the task that hashes it: blocks
    of a group's left rows meet blocks of its right rows, and each returns n rows a left one at most. Each pair of blocks is dealt out by
    itself, so a group is as many tasks as it has. Keys are whole numbers.
    """
    import numpy as np
    import pyarrow as pa

    def rows_of(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(on).alias("g"), F.col(key).cast("long").alias("k")).where("g is not null AND k is not null").distinct()

    def blocked(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
        return rows.join(sizes, "g").groupBy("g", F.pmod(F.xxhash64("k"), F.col(f"{name}_n")).alias("_block")).agg(F.collect_list("k").alias(name)).drop("_block")

    l_rows, r_rows = rows_of(left, left_key), rows_of(right, right_key)
    l_sizes, r_sizes = (rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"{name}_n")) for rows, size, name in ((l_rows, block, "l"), (r_rows, 4 * block, "r")))
    sizes = cut(l_sizes.join(r_sizes, "g"))  # a row for each group
    meetings = sizes.agg(F.sum(F.col("l_n") * F.col("r_n"))).first()[0] or 1
    pairs = blocked(l_rows, sizes, "l").join(blocked(r_rows, sizes, "r"), "g").select("l", "r").repartition(min(meetings, 4000))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r in zip(*batch.columns, strict=True):  # noqa: E741
                found = []
                for keys, others, heads in hashing.pair_heads(np.asarray(l.values, np.int64), np.asarray(r.values, np.int64)):
                    least = min(n, heads.shape[1]) - 1
                    i, j = np.nonzero(heads <= np.partition(heads, least, axis=1)[:, least, None])
                    found.append((keys[i], others[j], heads[i, j].astype(np.int64)))
                a, b, h = map(np.concatenate, zip(*found, strict=True))
                order = np.lexsort((b, h, a))
                a, b, h = a[order], b[order], h[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                yield pa.RecordBatch.from_arrays([pa.array(c[rank < n]) for c in (a, b, h)], names=["a", "b", "h"])

    found = pairs.mapInArrow(best, "a long, b long, h long")
    w = Window.partitionBy("a").orderBy("h", "b")
    return found.distinct().withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= n).select(F.col("a").alias(left_key), F.col("b").alias(right_key), "attempt")


def attribute_names(pairs: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, attributes): a map from each supercategory to the sorted names of the key's attributes. pairs: key, id; vocab: id, supercategory, name. Unknown ids drop out."""
    named = pairs.join(vocab, "id").select(key, "supercategory", "name").distinct()
    by_kind = named.groupBy(key, "supercategory").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return by_kind.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("supercategory", "names")))).alias("attributes"))


def first_passing(pairs: DataFrame, group: str, candidate: str, order: Column, passes: Column, tries: int) -> DataFrame:
    """For each group the first candidate in ``order`` that passes, among its first ``tries``."""
    ranked = pairs.withColumn("attempt", F.row_number().over(Window.partitionBy(group).orderBy(order, candidate))).where(F.col("attempt") <= tries)
    return ranked.where(passes).groupBy(group).agg(F.min_by(candidate, "attempt").alias(candidate), F.min("attempt").cast("int").alias("attempt"))


def plan_jobs(photos: DataFrame, products: DataFrame, key: str, item: str, per_photo: int) -> DataFrame:
    """The first products of a photo's categories by the hash of key and item. photos: key, cats; products: item, cat."""
    wanted = photos.select(F.col(key).alias("_key"), F.explode("cats").alias("cat")).distinct()
    found = top_by_pair_hash(wanted, products, "cat", "_key", item, per_photo).select(F.col("_key").alias(key), item, F.col("attempt").alias("rank"))
    return found


def chained_jobs(bases: DataFrame, photos: DataFrame, products: DataFrame, key: str, file: str, item: str, per_photo: int) -> DataFrame:
    """(key, file, item, rank): approved bases (key, file, cats) take products as plan_jobs does; bases whose file is no photo drop out."""
    there = bases.join(photos.select(file).distinct(), file, "left_semi")
    return there.select(key, file).join(plan_jobs(there.select(key, "cats"), products, key, item, per_photo), key)


def usable(bank: DataFrame, view: str, excluded: Sequence[str], suspects: DataFrame | None = None) -> DataFrame:
    """The bank's accepted rows of a view, not of an excluded station, without suspects (item) if these are given. bank: item, view, station, accepted."""
    rows = bank.where(F.col("accepted") & (F.col("view") == view) & ~F.coalesce(F.col("station").isin(*excluded), F.lit(False)))
    return rows if suspects is None else rows.join(suspects.select("item").distinct(), "item", "left_anti").select(*bank.columns)


def first_accepted(df: DataFrame, accepted: Column, order: Sequence[str], quota: int) -> DataFrame:
    """The first ``quota`` accepted rows in order: a top-k over the tasks, so that no more than the quota of each is sorted together."""
    return df.where(accepted).orderBy(*order).limit(quota)


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """df, which fails when it is read if a key occurs twice."""
    w = Window.partitionBy(key)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("a key occurs twice: "), F.col(key).cast("string"))).isNull()).drop("_n")


def capped_selection(candidates: DataFrame, name: str, group: str, position: str, groups: Sequence[str], per: int) -> DataFrame:
    """(name, group): names in hash order take their first candidate (ties by group) of a group that is not full; per names a group.

    A round ranks, for each open group, the names that would take it, ``per`` at most, and ends where the first group is
    full; what lies before that is taken. So there are as many rounds as groups at most. What is taken stays in tables of the shared folder; the
    driver sees a key and a count for each group.
    """
    key = F.concat(F.sha1(F.col(name).cast("string").cast("binary")), F.lit("|"), F.col(name).cast("string"))
    rows = cut(candidates.where(F.col(group).isin(*groups)).select(name, group, position, key.alias("_key")))
    need, taken, after = dict.fromkeys(groups, per), rows.select(name, group).limit(0), ""
    while need:
        first = rows.where(F.col(group).isin(*need) & (F.col("_key") > after)).groupBy(name, "_key").agg(F.min(F.struct(position, group))[group].alias(group))
        w = Window.partitionBy(group).orderBy("_key")
        ranked = cut(first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per))
        last = F.lit(False)
        for g, n in need.items():
            last = last | ((F.col(group) == g) & (F.col("_n") == n))
        upto = ranked.where(last).agg(F.min("_key")).first()[0]
        part = ranked if upto is None else ranked.where(F.col("_key") <= upto)
        taken = taken.unionByName(part.select(name, group))
        if upto is None:
            break
        got = {r[group]: r["n"] for r in part.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
        need = {g: n - got.get(g, 0) for g, n in need.items() if n > got.get(g, 0)}
        after = upto
    return taken


def visible_cases(notes: DataFrame, groups: dict[str, str], inner: str, outer: str, min_area: float, min_solidity: float) -> DataFrame:
    """The annotations that show a garment well, with their group: large and solid enough, no crowd, and an inner one only on a file without an outer one.

    notes: file, category, area and pixels (of the file's picture), solidity, iscrowd; groups: category -> group, a short fixed table. A category without a group
    goes. Whether a file has an outer garment is seen from all of its annotations, small ones and crowds too. Nulls fail what they are asked for.
    """
    kinds = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))
    named = notes.withColumn("group", kinds[F.col("category")])
    covered = named.where(F.col("group") == outer).select("file").distinct().withColumn("_outer", F.lit(True))
    large = (F.col("area") >= min_area * F.col("pixels")) & (F.col("solidity") >= min_solidity) & ~F.coalesce(F.col("iscrowd"), F.lit(False))
    seen = named.where(F.col("group").isNotNull() & large).join(covered, "file", "left")
    return seen.where((F.col("group") != inner) | F.col("_outer").isNull()).drop("_outer")


def weighted_sample(df: DataFrame, source: str, name: Column, weights: dict[str, float], n: int) -> DataFrame:
    """n rows without replacement: sources by weight (1 if not given), rows of a source alike. Deterministic by the hash of the name."""
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("_size"))
    weight = F.lit(1.0)
    for s, w in weights.items():
        weight = F.when(F.col(source) == s, F.lit(float(w))).otherwise(weight)
    u = (hashing.head32(name) + 1) / F.lit(4294967297.0)
    key = -F.log(u) * F.col("_size") / weight
    return df.join(sizes, source).withColumn("_key", key).orderBy("_key", name).limit(n).select(*df.columns)
