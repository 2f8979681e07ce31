"""The joins of the item domain: lookups with defaults, reviews, paired runs, positions. None pairs all rows with all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from .metrics import mcnemar
from .relational import earliest, latest


def with_coarse(annotations: DataFrame, categories: DataFrame, classes: dict[str, str]) -> DataFrame:
    """annotations (category_id) with category and its coarse class; categories (id, name) outside the table drop out."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), rules.lookup(F.col("name"), classes).alias("coarse")).where("coarse is not null")
    return annotations.join(named, "category_id")


def with_info(rows: DataFrame, info: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column], blank: str = "") -> DataFrame:
    """rows with text columns of info, blank where the key is unknown; of repeated keys the last in ``order`` counts."""
    last = latest(info, [key], order).select(key, *(F.col(c).cast("string").alias(f"_{c}") for c in columns))
    return rows.join(last, key, "left").select(*rows.columns, *(F.coalesce(f"_{c}", F.lit(blank)).alias(c) for c in columns))


def with_review(items: DataFrame, review: DataFrame, keys: Sequence[str] = ("file", "item")) -> DataFrame:
    """items with the human verdict on (file, item), null where there is none; verdicts other than '0' and '1' don't count."""
    good = review.where(F.col("verdict").isin("0", "1")).select(*keys, (F.col("verdict") == "1").alias("review"))
    return items.join(good, list(keys), "left")


def review_pass(items: DataFrame, file: str = "file") -> DataFrame:
    """(file, review_pass): the share of a file's reviewed items that passed, null if none was reviewed."""
    return items.groupBy(file).agg(F.avg(F.col("review").cast("int")).alias("review_pass"))


def mask_pairs(truth: DataFrame, items: DataFrame, existing: DataFrame, order: str, file: str = "file", category: str = "category") -> DataFrame:
    """Each truth mask (file, category, path) that exists with the first item of its category (by order); a missing one is null and scores (0, 0)."""
    there = truth.join(existing.select("path").distinct(), "path", "left_semi")
    first = earliest(items, [file, category], [F.col(order)])
    return there.join(first, [file, category], "left")


def compare_runs(a: DataFrame, b: DataFrame, key: str, metric: Column, by: Sequence[str] = ()) -> DataFrame:
    """Two runs matched by key: n, rates, how often only one holds, and the exact McNemar p. metric: a boolean column of either.

    Rows of one run alone are left out; a null metric does not hold.
    """
    keys = [*by, key]
    one = a.select(*keys, F.coalesce(metric, F.lit(False)).alias("_a"))
    two = b.select(*keys, F.coalesce(metric, F.lit(False)).alias("_b"))
    out = one.join(two, keys).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_a").cast("int")).alias("a_rate"), F.avg(F.col("_b").cast("int")).alias("b_rate"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("a_only"), F.count_if(F.col("_b") & ~F.col("_a")).alias("b_only"),
    )
    rates = {c: F.round(F.coalesce(c, F.lit(0.0)), 3) for c in ("a_rate", "b_rate")}
    return out.withColumns({**rates, "p": mcnemar(F.col("a_only"), F.col("b_only"))})


def existing_results(cases: DataFrame, files: DataFrame, k: int, name: Column) -> DataFrame:
    """(case columns, k) of the results that are on disk; name: the case's path without _k<n>.png."""
    tries = cases.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    path = F.concat(name, F.lit("_k"), F.col("k").cast("string"), F.lit(".png"))
    return tries.withColumn("_path", path).join(files.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi").drop("_path")


#: The metrics that make colour evidence, and bounds of two of them.
COLOR_METRICS = ("palette_dist", "lightness_gap", "chroma_ratio", "extra_color")


def with_color_evidence(jobs: DataFrame, scores: DataFrame, keys: Sequence[str] = ("file", "k")) -> DataFrame:
    """jobs with a struct color of the four metrics (chroma_ratio cut at 9.99) and whether the target is neutral; null unless all four are there.

    scores: keys and a map ``scores``.
    """
    values = {m: F.element_at("scores", m) for m in COLOR_METRICS}
    values["chroma_ratio"] = F.least(values["chroma_ratio"], F.lit(9.99))
    neutral = F.coalesce(F.element_at("scores", "target_chroma"), F.lit(99.0)) < 3
    there = F.lit(True)
    for m in COLOR_METRICS:
        there = there & F.element_at("scores", m).isNotNull()
    color = F.when(there, F.struct(*(v.alias(m) for m, v in values.items()), neutral.alias("neutral")))
    return jobs.join(scores.select(*keys, color.alias("color")), list(keys), "left")


def by_index(attempts: DataFrame, indexes: Sequence[DataFrame], key: str = "file") -> DataFrame:
    """Approved attempts with their index row; where several indexes have a file, the later one's row holds. ``approved`` is a column of attempts."""
    ranked = [ix.withColumn("_rank", F.lit(i)) for i, ix in enumerate(indexes)]
    together = ranked[0]
    for ix in ranked[1:]:
        together = together.unionByName(ix, allowMissingColumns=True)
    return attempts.where("approved").join(latest(together, [key], [F.col("_rank")]), key)


def accepted_base(rows: DataFrame, base_palette: DataFrame, stem: Column, limit: float | None) -> DataFrame:
    """rows with base_ok: the base's palette distance (stem, palette) is within the limit, unknown ones are."""
    known = base_palette.select(F.col("stem").alias("_stem"), F.col("palette").alias("_palette"))
    ok = F.lit(True) if limit is None else F.coalesce(F.col("_palette") <= limit, F.lit(True))
    return rows.join(known, stem == F.col("_stem"), "left").withColumn("base_ok", ok).drop("_stem", "_palette")


def scene_targets(scenes: DataFrame, items: str = "items", flag: str = "target") -> DataFrame:
    """(scene columns, item fields): the placed items of each scene that are targets."""
    rest = [c for c in scenes.columns if c != items]
    return scenes.select(*rest, F.explode(items).alias("_i")).where(f"_i.{flag}").select(*rest, "_i.*")


def source_major(queries: DataFrame, sources: DataFrame, query: str, source: str) -> DataFrame:
    """(source, query, at): every query of the first source, then of the next, numbered from 0. Both tables are short lists."""
    w = Window.partitionBy(source).orderBy(query)
    count = queries.agg(F.count(F.lit(1)).alias("_n"))
    ranked = sources.withColumn("_s", F.dense_rank().over(Window.orderBy(source)) - 1)
    crossed = ranked.crossJoin(queries).crossJoin(F.broadcast(count))
    return crossed.select(source, query, (F.col("_s") * F.col("_n") + F.row_number().over(w) - 1).cast("long").alias("at"))


def hints_to_blobs(hints: DataFrame, blobs: DataFrame, key: str, hint: str = "hints", area: str = "area", blob: str = "blob") -> DataFrame:
    """(key, position, hint, blob): a scene's hints in their order with its largest blobs in theirs; what has no partner drops out.

    hints: key and an array; blobs: key, blob, area.
    """
    listed = hints.select(key, F.posexplode(hint).alias("position", "hint"))
    w = Window.partitionBy(key).orderBy(F.desc(area), blob)
    ranked = blobs.select(key, (F.row_number().over(w) - 1).alias("position"), F.col(blob).alias("blob"))
    return listed.join(ranked, [key, "position"])


def with_accessory(rows: DataFrame, pieces: DataFrame, name: Column, shares: dict[str, float]) -> DataFrame:
    """rows with an accessory: its kind by fixed shares, a piece of that kind, both by the hash of the row's name.

    pieces: kind, piece (a short table). A kind without pieces gives null.
    """
    from ..functions.hashing import head32, unit

    u, kind, upto = unit(F.concat(name, F.lit("|kind"))), F.when(F.lit(False), F.lit(None).cast("string")), 0.0
    for k, share in shares.items():
        upto += share
        kind = kind.when(u < upto, k)
    kind = kind.otherwise(list(shares)[-1])
    lists = pieces.groupBy("kind").agg(F.array_sort(F.collect_list("piece")).alias("_pieces"))  # a piece table is a short list
    chosen = rows.withColumn("kind", kind).join(lists, "kind", "left")
    at = F.pmod(head32(F.concat(name, F.lit("|piece"))), F.size("_pieces").cast("long")).cast("int")
    return chosen.withColumn("piece", F.when(F.size("_pieces") > 0, F.get("_pieces", at))).drop("_pieces")


#: How many items a scene holds, and how often.
SCENE_SIZES = ((1, 0.25), (2, 0.35), (3, 0.25), (4, 0.15))


def scene_size(name: Column) -> Column:
    """1 to 4 with fixed probabilities, by the hash of a name."""
    from ..functions.hashing import unit

    u, out, upto = unit(name), F.when(F.lit(False), F.lit(None)), 0.0
    for n, share in SCENE_SIZES[:-1]:
        upto += share
        out = out.when(u < upto, n)
    return out.otherwise(SCENE_SIZES[-1][0])
