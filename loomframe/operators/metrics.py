"""Quality metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import cut, running_sums


def overlapping_groups(base: Column, flags: dict[str, Column]) -> Column:
    """Explode to the row's own bin, 'all', and each flag that holds."""
    return F.explode(F.array_compact(F.array(base, F.lit("all"), *(F.when(c, F.lit(n)) for n, c in flags.items()))))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at round-half-even(q (n - 1)) of the sorted values: an element, no interpolation."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.bround(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def nearest_rank_by(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, n, value): nearest-rank quantile by counting equal values, so that no group is gathered in one row.

    Ranks are running sums over a group's distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_sums(counts, [group], [value], {"k": F.col("_k")})
    found = ranked.where(F.col("k_before") + F.col("_k") > F.bround(F.lit(q) * (F.col("k_all") - 1)))
    return found.groupBy(group).agg(F.min(value).alias(value), F.first("k_all").alias("n"))


def auroc(df: DataFrame, score: Column, positive: Column, group: Sequence[str] = ()) -> DataFrame:
    """P(positive > negative) + half P(tie), from average ranks: one row a distinct score, never pairs. Null without both kinds."""
    by = list(group)
    counts = df.where(score.isNotNull() & positive.isNotNull()).groupBy(*by, score.alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    won = F.sum(F.col("_p") * (F.col("n_before") + F.col("_n") / 2))
    out = running_sums(counts, by, ["_s"], {"n": F.col("_n")}).groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), won.alias("_won"))
    return out.select(*by, "n_pos", "n_neg", F.try_divide("_won", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided McNemar test; the binomial tail is summed in log space."""
    n, k = a_only + b_only, F.least(a_only, b_only)
    # term j is the one before it times (n - j + 1) / j
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    term = lambda acc, j: F.when(j == 0, acc["t"]).otherwise(acc["t"] + F.log((n - j + 1).cast("double")) - F.log(F.greatest(j, F.lit(1)).cast("double")))
    step = lambda acc, j: F.struct(term(acc, j).alias("t"), (acc["s"] + F.exp(term(acc, j))).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    return tp / F.greatest(tp + fp, F.lit(1)).cast("double"), tp / F.greatest(tp + fn, F.lit(1)).cast("double")


def multiset_overlap(predicted: DataFrame, expected: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """For each key: shared, n_pred, n_true, accuracy, missing and extra by total counts."""
    by = [*keys, item]
    p = predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("_p"))
    t = expected.groupBy(*by).agg(F.count(F.lit(1)).alias("_t"))
    both = p.join(t, by, "full").fillna(0, ["_p", "_t"])
    out = both.groupBy(*keys).agg(F.sum(F.least("_p", "_t")).alias("shared"), F.sum("_p").alias("n_pred"), F.sum("_t").alias("n_true"))
    true = F.greatest("n_true", F.lit(1)).cast("double")
    return out.withColumns(
        {
            "count_exact": F.col("n_pred") == F.col("n_true"),
            "accuracy": F.col("shared") / true,
            "missing_ratio": F.greatest(F.col("n_true") - F.col("n_pred"), F.lit(0)) / true,
            "extra_ratio": F.greatest(F.col("n_pred") - F.col("n_true"), F.lit(0)) / true,
        }
    )


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean vector; sums are taken in part by position before the exchange."""
    flat = df.select(group, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    pairs = flat.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_c"))
    return pairs.select(group, F.transform("_c", lambda s: s["_m"]).alias("centroid"))


MAX_CATEGORIES = 20_000


def margin_to_others(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(key, margin): cosine to the own group's centroid less the largest to another's; 1 where there is no other.

    All centroids go to every row as one array, so groups are categories: more than MAX_CATEGORIES fail.
    """
    means = centroids(df, group, vector).agg(F.collect_list(F.struct(F.col(group).alias("g"), "centroid")).alias("_all"))
    means = means.where(F.assert_true(F.size("_all") <= MAX_CATEGORIES, F.lit("too many groups for one array of centroids")).isNull())
    near = F.transform("_all", lambda c: F.struct(c["g"].alias("g"), cosine(F.col(vector), c["centroid"]).alias("s")))
    rows = df.select(key, group, vector).join(F.broadcast(means)).select(key, group, near.alias("_near"))  # one row, of a checked size
    best = lambda own: F.array_max(F.transform(F.filter("_near", lambda c: (c["g"] == F.col(group)) if own else (c["g"] != F.col(group))), lambda c: c["s"]))
    return rows.select(key, F.coalesce(best(True) - best(False), F.lit(1.0)).alias("margin"))


def margin_in_photo(results: DataFrame, items: DataFrame, photo: str, target: str, vector: str, block: int = 64) -> DataFrame:
    """results with margin: cosine to the own target less the largest to another item of the same photo; 1 where the photo has no other, null where it lacks the target.

    results: photo, target, vector and any others; items: photo, target, vector. A photo's items travel in arrays of about ``block`` by hash, so
    that a result meets blocks and not single items, and keeps two numbers of each.
    """
    rows = cut(results.withColumn("_row", F.monotonically_increasing_id()))
    count = items.groupBy(photo).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_blocks"))
    dealt = items.join(count, photo).groupBy(photo, F.pmod(F.xxhash64(target), "_blocks").alias("_b"))
    packed = dealt.agg(F.collect_list(F.struct(F.col(target).alias("t"), F.col(vector).alias("v"))).alias("_items"))
    near = F.transform("_items", lambda i: F.struct((i["t"] == F.col(target)).alias("own"), cosine(F.col(vector), i["v"]).alias("s")))
    best = lambda own: F.array_max(F.transform(F.filter("_near", lambda i: i["own"] == F.lit(own)), lambda i: i["s"]))
    met = rows.select("_row", photo, target, vector).join(packed, photo).select("_row", near.alias("_near")).groupBy("_row").agg(F.max(best(True)).alias("_own"), F.max(best(False)).alias("_other"))
    margin = F.when(F.col("_own").isNotNull(), F.coalesce(F.col("_own") - F.col("_other"), F.lit(1.0)))
    return rows.join(met, "_row", "left").withColumn("margin", margin).drop("_row", "_own", "_other")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
