"""Summaries of runs: yields, cases, timings, sweeps, rejections. A group with nothing to divide by gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import auroc, precision_recall


def most_common(df: DataFrame, value: str, order: Column) -> DataFrame:
    """(value, n, first): counts, most frequent first, ties by first appearance; null is not counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first")


def yield_overall(attempts: DataFrame) -> DataFrame:
    """attempts, approved, approval_rate, median_seconds, seconds_per_approved of attempts (approved, seconds)."""
    n, ok = F.count(F.lit(1)), F.count_if("approved")
    return attempts.agg(
        n.alias("attempts"), ok.alias("approved"), F.round(F.try_divide(ok.cast("double"), n), 3).alias("approval_rate"),
        F.round(F.median("seconds"), 1).alias("median_seconds"), F.round(F.try_divide(F.sum("seconds"), ok), 1).alias("seconds_per_approved"),
    )


def yield_by(attempts: DataFrame, column: str) -> DataFrame:
    """(column, n, ok, rate, label): approvals by a bin or a product; rows without one are left out. label: ok/n."""
    found = attempts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if("approved").alias("ok"))
    return found.withColumns({"rate": F.round(F.col("ok") / F.col("n").cast("double"), 3), "label": F.concat_ws("/", F.col("ok").cast("string"), F.col("n").cast("string"))})


def yield_reasons(attempts: DataFrame, order: Column) -> DataFrame:
    """(reason, n, first): the attempts' reasons (array), most common first."""
    flat = attempts.select(order.alias("_at"), F.posexplode("reasons").alias("_i", "reason"))
    return most_common(flat, "reason", F.struct("_at", "_i"))


def case_summary(rows: DataFrame, image: str, k: str = "k") -> DataFrame:
    """cases, faithful_single, faithful_oracle, gate_pass, marker_drawn and the median palette distance of first results (99 if not measured).

    rows: image, k (0 first), faithful, passed, marker_frac, palette_dist.
    """
    images = rows.groupBy(image).agg(
        F.max(F.when(F.col(k) == 0, F.col("faithful").cast("int"))).alias("single"), F.max(F.col("faithful").cast("int")).alias("oracle"),
        F.max(F.when(F.col(k) == 0, F.coalesce("palette_dist", F.lit(99.0)))).alias("palette"), F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("passed"), F.count_if(F.col("marker_frac") > 0.01).alias("marked"),
    )
    share = lambda c: F.round(F.try_divide(F.sum(c).cast("double"), F.sum("n")), 3)
    return images.agg(
        F.count("single").alias("cases"), F.round(F.avg("single"), 3).alias("faithful_single"), F.round(F.avg("oracle"), 3).alias("faithful_oracle"),
        share("passed").alias("gate_pass"), share("marked").alias("marker_drawn"), F.round(F.median("palette"), 2).alias("median_palette_dist"),
    )


def stage_means(results: DataFrame, stages: Sequence[str], totalled: Sequence[str], timings: str = "timings", total: str = "stage1_4_total") -> DataFrame:
    """(stage, seconds): mean seconds of each stage over the results that have it, and the sum of the rounded means of some.

    results: a map column of seconds by stage. Without any stage there are no rows.
    """
    flat = results.select(F.explode(timings).alias("stage", "s")).where(F.col("stage").isin(*stages) & F.col("s").isNotNull())
    means = flat.groupBy("stage").agg(F.round(F.avg("s"), 3).alias("seconds"))
    summed = means.groupBy().agg(F.round(F.sum(F.when(F.col("stage").isin(*totalled), F.col("seconds"))), 3).alias("seconds"), F.count(F.lit(1)).alias("n"))
    return means.unionByName(summed.where("n > 0").select(F.lit(total).alias("stage"), F.coalesce("seconds", F.lit(0.0)).alias("seconds")))


def run_summary(results: DataFrame, items: str = "items") -> DataFrame:
    """images, ok, items_total: all entities, those without an error, and the items of these."""
    ok = F.col("error").isNull()
    return results.agg(F.count(F.lit(1)).alias("images"), F.count_if(ok).alias("ok"), F.coalesce(F.sum(F.when(ok, F.col(items))), F.lit(0)).alias("items_total"))


def question_sweep(rows: DataFrame, questions: Sequence[str], thresholds: Sequence[float], scores: str = "scores", truth: str = "truth") -> DataFrame:
    """(threshold, passed, precision, recall): a row passes if every question's score is over the threshold."""
    least = F.array_min(F.transform(F.array(*(F.lit(q) for q in questions)), lambda q: F.element_at(scores, q)))
    all_there = F.lit(True)
    for q in questions:
        all_there = all_there & F.element_at(scores, q).isNotNull()
    tried = rows.select(F.when(all_there, least).alias("_least"), F.col(truth).alias("_t"), F.explode(F.array(*(F.lit(float(v)) for v in thresholds))).alias("threshold"))
    over = F.coalesce(F.col("_least") > F.col("threshold"), F.lit(False))
    counts = tried.groupBy("threshold").agg(F.count_if(over & F.col("_t")).alias("tp"), F.count_if(over & ~F.col("_t")).alias("fp"), F.count_if(~over & F.col("_t")).alias("fn"))
    p, r = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("threshold", (F.col("tp") + F.col("fp")).alias("passed"), F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"))


def question_medians(rows: DataFrame, questions: Sequence[str], scores: str = "scores", truth: str = "truth") -> DataFrame:
    """(question, good_median, bad_median): each question's scores by the truth."""
    flat = rows.select(F.col(truth).alias("_t"), F.explode(F.array(*(F.struct(F.lit(q).alias("question"), F.element_at(scores, q).alias("s")) for q in questions))).alias("_q")).select("_t", "_q.*")
    return flat.groupBy("question").agg(F.round(F.median(F.when(F.col("_t"), F.col("s"))), 2).alias("good_median"), F.round(F.median(F.when(~F.col("_t"), F.col("s"))), 2).alias("bad_median"))


def candidate_rates(rows: DataFrame, kinds: Sequence[str], positive: str = "pos") -> DataFrame:
    """(kind, n, pass_rate, reject_rate): of each kind of candidate; reject_rate only of the negatives. rows: kind, passed."""
    found = rows.where(F.col("kind").isin(positive, *kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("int")).alias("_r"))
    return found.select("kind", "n", F.round("_r", 3).alias("pass_rate"), F.when(F.col("kind") != positive, F.round(1 - F.col("_r"), 3)).alias("reject_rate"))


def candidate_auroc(rows: DataFrame, kinds: Sequence[str], positive: str = "pos", bin_col: str = "share_bin") -> DataFrame:
    """(bin, kind, auroc): how often a positive scores below a negative of a kind, in each bin and in all; a score of less is better.

    Every positive counts against each kind, so it is listed once for each: kinds are few.
    """
    versus = F.explode(F.when(F.col("kind") == positive, F.array(*(F.lit(k) for k in kinds))).otherwise(F.array("kind")))
    bins = F.explode(F.array(F.coalesce(bin_col, F.lit("?")), F.lit("all")))
    flat = rows.where(F.col("kind").isin(positive, *kinds)).select("score", (F.col("kind") != positive).alias("_negative"), versus.alias("_kind"), bin_col).select("score", "_negative", "_kind", bins.alias("bin"))
    found = auroc(flat, F.col("score"), F.col("_negative"), ["bin", "_kind"])  # P(negative > positive)
    return found.select("bin", F.col("_kind").alias("kind"), F.round(F.coalesce("auroc", F.lit(float("nan"))), 3).alias("auroc"))


def verifier_report(rows: DataFrame, positive: str = "pos", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(test, auroc, pos_pass) over held-out rows (kind, prob), and (kind, neg_reject) of each negative kind."""
    is_pos = F.col("kind") == positive
    overall = auroc(rows, F.col("prob"), is_pos)
    passing = rows.agg(F.count(F.lit(1)).alias("test"), F.round(F.avg(F.when(is_pos, (F.col("prob") >= threshold).cast("int"))), 3).alias("pos_pass"))
    report = overall.select(F.round("auroc", 4).alias("auroc")).crossJoin(passing)  # one row each
    rejects = rows.where(~is_pos).groupBy("kind").agg(F.round(F.avg((F.col("prob") < threshold).cast("int")), 3).alias("neg_reject"))
    return report, rejects


def region_median(pixels: DataFrame, key: str, difference: Column, inside: Column) -> DataFrame:
    """(key, difference): the median difference of the pixels inside; NaN where there is none."""
    found = pixels.groupBy(key).agg(F.median(F.when(inside, difference)).alias("difference"))
    return found.select(key, F.coalesce("difference", F.lit(float("nan"))).alias("difference"))


def laundry_bundles(items: DataFrame, item: str, position: Column, dry: str) -> DataFrame:
    """(method, color, max_temp, n, items, at): bundles of items (method, color, max_temp), numbered as they are listed.

    Dry cleaning is one bundle whatever the colour; items keep their order; dry bundles come last, large ones first, then the
    one seen first. A bundle is what one household washes: its items are one list.
    """
    is_dry = F.col("method") == dry
    rows = items.select(F.col("method"), F.when(~is_dry, F.col("color")).alias("color"), "max_temp", F.struct(position.alias("p"), F.col(item).alias("i")).alias("_x"))
    found = rows.groupBy("method", "color").agg(F.min("max_temp").alias("max_temp"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_x")).alias("_xs"))
    found = found.select("method", "color", "max_temp", "n", F.transform("_xs", lambda x: x["i"]).alias("items"), F.get("_xs", F.lit(0))["p"].alias("_first"))
    return found.orderBy(F.col("method") == dry, F.desc("n"), "_first").drop("_first")
