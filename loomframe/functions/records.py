"""Columns over nested records: scores with defaults, media, labels, names, softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of a garment match (outer share, colour, extra colour, marker), units of natural history and the like, least aspect by kind.
OUTER_OK, COLOR_OK, EXTRA_OK, MARKER_OK = 0.2, 12.0, 15.0, 0.01
EXCLUDED_UNITS = ("NMNH", "NASM", "NPM", "NZP", "SERC", "STRI")


def score(scores: Column, name: str, default: float) -> Column:
    """A score of a map, or what holds when it was not measured."""
    return F.coalesce(F.element_at(scores, name), F.lit(float(default)))


def right_item(scores: Column, margin: Column, same_color: Column | None = None, outer_ok: float = OUTER_OK) -> Column:
    same = F.coalesce(same_color, F.lit(False)) if same_color is not None else F.lit(False)
    return (margin > 0) & (score(scores, "fg_frac", 0) >= 0.02) & (same | (score(scores, "outer_frac", 0) <= outer_ok))


def faithful(scores: Column, margin: Column, marker: Column, same_color: Column | None = None, color_ok: float = COLOR_OK, extra_ok: float = EXTRA_OK, marker_ok: float = MARKER_OK) -> Column:
    """right_item, and colours that hold; a chroma ratio counts only for targets with some chroma."""
    chroma = (score(scores, "target_chroma", 0) <= 8) | score(scores, "chroma_ratio", 0).between(0.5, 2.0)
    near = (score(scores, "palette_dist", 99) <= color_ok) & (score(scores, "extra_color", 99) <= extra_ok)
    return right_item(scores, margin, same_color) & near & chroma & (F.coalesce(marker, F.lit(0.0)) <= marker_ok)


def passes_all(scores: Column, questions: Sequence[str], thresholds: dict[str, float] | None = None) -> Column:
    """Every question's score is over its threshold, 0 where none is given."""
    limits = thresholds or {}
    out = F.lit(True)
    for q in questions:
        out = out & (F.element_at(scores, q) > F.lit(float(limits.get(q, 0.0))))
    return F.coalesce(out, F.lit(False))


def first_media(media: Column, kind: str, access: str, n: int) -> Column:
    """The first n contents of media (array of structs type, usage.access, content) of a kind and access."""
    wanted = F.filter(media, lambda m: (m["type"] == kind) & (m["usage"]["access"] == access) & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.slice(F.transform(F.coalesce(wanted, F.array().cast(f"array<{_STRUCT}>")), lambda m: m["content"]), 1, n)


_STRUCT = "struct<type:string,usage:struct<access:string>,content:string>"


def excluded_unit(code: Column, prefixes: Sequence[str] = EXCLUDED_UNITS) -> Column:
    return F.coalesce(F.upper(code).rlike("^(" + "|".join(prefixes) + ")"), F.lit(False))


def too_small(width: Column, height: Column, least: int) -> Column:
    """A short side under ``least``, if both sides are known."""
    return F.coalesce((width > 0) & (height > 0) & (F.least(width, height) < least), F.lit(False))


def least_aspect(category: Column, bottoms: Sequence[str], onepieces: Sequence[str], bottom: float, onepiece: float, top: float) -> Column:
    return F.when(category.isNull() | category.isin(*onepieces), onepiece).when(category.isin(*bottoms), bottom).otherwise(top)


def category_of(label: Column, table: Column) -> Column:
    """The table's value for a trimmed label, or for the label with only its first letter upper."""
    t = F.trim(label.cast("string"))
    capital = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))
    return F.coalesce(F.element_at(table, t), F.element_at(table, capital))


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def out_stem(out: Column, file: Column) -> Column:
    return F.coalesce(F.nullif(out, F.lit("")), stem(file))


def two_way_softmax(no: Column, yes: Column, temperature: float = 1.0) -> Column:
    """The share of yes; missing log probabilities are -1e9."""
    a, b = ((F.coalesce(x, F.lit(-1e9)) / F.lit(temperature)) for x in (no, yes))
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def log_mass_gap(tokens: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    """log of the yes tokens' probability less that of the no tokens'. tokens: map from a token to its log probability; a side without any counts as -1e9."""

    def mass(names: Sequence[str]) -> Column:
        found = F.array_compact(F.array(*(F.element_at(tokens, n) for n in names)))
        top = F.array_max(found)
        return F.coalesce(top + F.log(F.aggregate(found, F.lit(0.0), lambda s, x: s + F.exp(x - top))), F.lit(-1e9))

    return mass(yes) - mass(no)


def rebuilt(text: Column, schema: str, defaults: dict[str, Column] | None = None) -> Column:
    """A record from its JSON: unknown keys are dropped, missing ones take their default or null; null for a text that is no object."""
    record = F.from_json(text, schema)
    for name, value in (defaults or {}).items():
        record = F.when(record.isNotNull(), record.withField(name, F.coalesce(record[name], value)))
    return F.when(F.json_object_keys(text).isNotNull(), record)


def expected_count(items: Column) -> Column:
    """How many items a scene expects: the sum of their counts, one where none is given."""
    return F.aggregate(F.coalesce(items, F.array().cast("array<struct<category:string,count:int>>")), F.lit(0), lambda s, i: s + F.coalesce(i["count"], F.lit(1)))


def field_scores(fields: Sequence[str]) -> list[tuple[str, Column]]:
    """(field, score) for columns pred (struct) and label (struct of strings): null where the label is blank."""
    out = []
    for f in fields:
        truth = F.trim(F.coalesce(F.col(f"label.{f}"), F.lit("")))
        out.append((f, F.when(truth != "", F.coalesce((F.col(f"pred.{f}") == truth).cast("double"), F.lit(0.0)))))
    season = F.filter(F.transform(F.split(F.coalesce(F.col("label.season"), F.lit("")), ";"), F.trim), lambda s: s != "")
    guess = F.coalesce(F.col("pred.season"), F.array().cast("array<string>"))
    jaccard = F.size(F.array_intersect(guess, season)) / F.size(F.array_union(guess, season)).cast("double")
    level = F.nullif(F.trim(F.coalesce(F.col("label.formality"), F.lit(""))), F.lit("")).cast("int")
    near = (F.abs(F.coalesce(F.col("pred.formality"), F.lit(0)) - level) <= 1).cast("double")
    return [*out, ("season", F.when(F.size(season) > 0, jaccard)), ("formality", F.when(level.isNotNull(), near))]


def evidence_text(palette: Column, lightness: Column, chroma: Column, extra: Column, photo: Column, product: Column, similarity: Column, p_win: Column) -> Column:
    """Measurements as lines of text; a colour line only if all four colour metrics are there."""
    color = F.format_string("- color: palette %.1f, lightness %.1f, chroma %.2f, extra %.1f", palette, lightness, chroma, extra)
    words = F.format_string('- text: photo "%s", product "%s", similarity %.2f', F.coalesce(F.nullif(photo, F.lit("")), F.lit("(none)")), F.coalesce(F.nullif(product, F.lit("")), F.lit("(none)")), similarity)
    any_text = F.concat(F.coalesce(photo, F.lit("")), F.coalesce(product, F.lit(""))) != ""
    measured = palette.isNotNull() & lightness.isNotNull() & chroma.isNotNull() & extra.isNotNull()
    return F.concat_ws("\n", F.when(measured, color), F.when(any_text, words).otherwise("- no text on either garment"), F.when(p_win.isNotNull(), F.format_string("- preferred with probability %.2f", p_win)))


def bundle_title(method: Column, color: Column, max_temp: Column, n: Column, dry: str = "드라이클리닝") -> Column:
    wet = F.format_string("%s 옷 · %s %d℃ 이하 · %d벌", color, method, max_temp, n)
    return F.when(method == dry, F.format_string("드라이클리닝 맡길 옷 %d벌", n)).otherwise(wet)


def join_by_path_or_name(results: DataFrame, labels: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """results with the label row of their path, else of the first label (by order) with their base name, else nulls."""
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    rest = [c for c in labels.columns if c not in (key, order)]
    exact = labels.select(F.col(key).alias("_k"), F.struct(key, *rest).alias("_exact"))
    named = labels.groupBy(name(F.col(key)).alias("_n")).agg(F.min_by(F.struct(key, *rest), order).alias("_named"))
    joined = results.join(exact, F.col(path) == F.col("_k"), "left").join(named, name(F.col(path)) == F.col("_n"), "left")
    found = F.coalesce("_exact", "_named")
    return joined.select(*results.columns, F.coalesce(found[key], name(F.col(path))).alias("label_key"), *(found[c].alias(c) for c in rest))


def cycled(combinations: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n numbered rows that go round the combinations (few, in order)."""
    from pyspark.sql.window import Window

    few = combinations.withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1)
    size = few.agg(F.count(F.lit(1)).alias("_size"))
    numbered = combinations.sparkSession.range(n).join(F.broadcast(size)).withColumn("_at", (F.col("id") % F.col("_size")).cast("int"))
    return numbered.join(F.broadcast(few), "_at").select("id", *combinations.columns)


def timing_summary(df: DataFrame, group: str, order: str, seconds: str, warmup: int) -> DataFrame:
    """count, median, nearest-rank p95 and mean by group, without the first ``warmup`` rows of a group unless it has no others."""
    from ..operators.metrics import nearest_rank_by
    from ..operators.relational import running_sums

    ranked = running_sums(df.select(group, order, seconds), [group], [order], {"row": F.lit(1)})
    kept = ranked.where((F.col("row_before") >= warmup) | (F.col("row_all") <= warmup)).select(group, seconds)
    p95 = nearest_rank_by(kept, group, seconds, 0.95).select(F.col(group).alias("_g"), F.col(seconds).alias("p95"))
    out = kept.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.median(seconds).alias("p50"), F.avg(seconds).alias("mean")).join(p95, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.select(group, "n", *(F.round(c, 3).alias(c) for c in ("p50", "p95", "mean")))
