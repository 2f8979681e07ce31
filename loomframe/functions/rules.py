"""Rule tables as columns: bands, care, fit zones, outfit parts, reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def band(value: Column, bounds: Sequence[float], labels: Sequence[str], shift: Column | float = 0.0) -> Column:
    """The label of the first bound that value is below; the last label otherwise; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(value < F.lit(float(bound)) - shift, label)
    return out.otherwise(labels[-1])


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for key, found in table.items():
        out = out.when(value == key, found)
    return out if default is None else out.otherwise(default)


def first_reason(checks: Sequence[tuple[str, Column]], ok: str = "ok") -> Column:
    """The name of the first check that fails (is true); null checks pass."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, failed in checks:
        out = out.when(F.coalesce(failed, F.lit(False)), name)
    return out.otherwise(ok)


def all_reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """The names of all checks that fail, in order; empty: accepted."""
    return F.array_compact(F.array(*(F.when(failed, F.lit(name)) for name, failed in checks)))


def share_bin(share: Column) -> Column:
    bounds = [b for b, _ in dims.SHARE_BINS if b is not None]
    return band(share, bounds, [label for _, label in dims.SHARE_BINS])


def color_group(color: Column) -> Column:
    white, dark, light = dims.COLOR_GROUPS
    return F.when(color.isin(*dims.WHITE_COLORS), white).when(color.isin(*dims.DARK_COLORS), dark).otherwise(light)


def default_care(material: Column, subcategory: Column) -> Column:
    """struct(method, max_temp) estimated from material and kind."""
    m, s = F.coalesce(material, F.lit("")), F.coalesce(subcategory, F.lit(""))
    out = F.when(F.lit(False), F.lit(None))
    for inside, kinds, method, temp in dims.CARE_RULES:
        hit = F.lit(False)
        for word in inside:
            hit = hit | m.contains(word)
        out = out.when(hit | s.isin(*kinds) if kinds else hit, F.struct(F.lit(method).alias("method"), F.lit(temp).alias("max_temp")))
    return out.otherwise(F.struct(F.lit(dims.CARE_DEFAULT[0]).alias("method"), F.lit(dims.CARE_DEFAULT[1]).alias("max_temp")))


def base_interval(category: Column, subcategory: Column) -> Column:
    return lookup(subcategory, dims.WASH_INTERVAL, lookup(category, dims.CATEGORY_INTERVAL, F.lit(dims.DEFAULT_INTERVAL))).cast("double")


def interval(override: Column, category: Column, subcategory: Column) -> Column:
    """A learned interval of 0 counts as none."""
    return F.coalesce(F.nullif(override, F.lit(0.0)), base_interval(category, subcategory))


def measure(value: Column) -> Column:
    """A measurement of 0 counts as absent."""
    return F.nullif(value.cast("double"), F.lit(0.0))


def landmark(body: Column, name: str) -> Column:
    return F.coalesce(F.element_at(body["landmarks"], name), F.lit(dims.LANDMARKS[name]) * body["height"])


def zone(name: str, label: Column, ease: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("zone"), label.alias("label"), (ease if ease is not None else F.lit(None).cast("double")).alias("ease_cm"))


def shoulder_label(diff: Column) -> Column:
    return F.when(diff < -2, "작음").when(diff <= 2, "정핏").when(diff > 2, "드롭숄더")


def hem_label(length: Column, body: Column) -> Column:
    hem = landmark(body, "hps") - length
    waist, hip, crotch, knee = (landmark(body, n) for n in ("waist", "hip", "crotch", "knee"))
    steps = ((waist + 4, "크롭"), (waist - 4, "허리선"), (hip + 3, "골반"), (hip - 3, "엉덩이 중간"), (crotch - 12, "엉덩이를 덮음"), (knee + 5, "허벅지"), (knee - 5, "무릎"))
    out = F.when(hem.isNull(), F.lit(None).cast("string"))
    for low, label in steps:
        out = out.when(hem >= low, label)
    return out.otherwise("무릎 아래")


def _present(zones: Sequence[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(there, z) for there, z in zones)))


def top_report(garment: Column, body: Column, category: str = "상의", stretch: Column | None = None) -> Column:
    """struct(zones, warnings, estimated) of a top, coat or dress."""
    stretch = F.lit("없음") if stretch is None else stretch
    shift = lookup(stretch, dims.STRETCH).cast("double")
    g = {k: measure(garment[k]) for k in ("shoulder", "chest", "length", "sleeve")}
    diff = g["shoulder"] - measure(body["shoulder_width"])
    ease = g["chest"] * 2 - measure(body["chest"])
    arm = F.coalesce(body["arm_length"], F.bround(F.lit(dims.LENGTHS["arm_length"]) * body["height"], 1))
    ratio = (g["sleeve"] + F.greatest(F.coalesce(diff / 2, F.lit(0.0)), F.lit(0.0))) / arm
    zones = _present(
        (
            (diff.isNotNull(), zone("어깨", shoulder_label(diff), diff)),
            (ease.isNotNull(), zone("가슴", band(ease, dims.FIT_BOUNDS[category, "chest"], dims.FIT_LABELS, shift), F.bround(ease, 1))),
            (g["length"].isNotNull(), zone("기장", hem_label(g["length"], body))),
            (g["sleeve"].isNotNull(), zone("소매", band(ratio, dims.SLEEVE_BOUNDS, dims.SLEEVE_LABELS))),
        )
    )
    warnings = all_reasons([("가슴 둘레가 몸보다 작아 입기 어려울 수 있음", (ease < 0) & (stretch == "없음"))])
    estimated = all_reasons([("arm_length", g["sleeve"].isNotNull() & body["arm_length"].isNull())])
    return F.struct(zones.alias("zones"), warnings.alias("warnings"), estimated.alias("estimated"))


def bottom_report(garment: Column, body: Column, stretch: Column | None = None) -> Column:
    shift = lookup(F.lit("없음") if stretch is None else stretch, dims.STRETCH).cast("double")
    g = {k: measure(garment[k]) for k in ("waist", "hip", "thigh")}
    ease = {k: v * 2 - measure(body[k]) for k, v in g.items()}
    inseam = F.nullif(F.coalesce(garment["inseam"], measure(garment["length"]) - measure(garment["rise"])), F.lit(0.0))
    leg = F.coalesce(body["inseam"], F.bround(F.lit(dims.LENGTHS["inseam"]) * body["height"], 1))
    waist_label = band(ease["waist"] + shift, dims.WAIST_BOUNDS, dims.WAIST_LABELS)
    zones = _present(
        (
            (ease["waist"].isNotNull(), zone("허리", waist_label, F.bround(ease["waist"], 1))),
            (ease["hip"].isNotNull(), zone("엉덩이", band(ease["hip"], dims.FIT_BOUNDS["하의", "hip"], dims.FIT_LABELS, shift), F.bround(ease["hip"], 1))),
            (ease["thigh"].isNotNull(), zone("허벅지", band(ease["thigh"], dims.FIT_BOUNDS["하의", "thigh"], dims.THIGH_LABELS, shift), F.bround(ease["thigh"], 1))),
            (inseam.isNotNull(), zone("기장", band(inseam - leg, dims.INSEAM_BOUNDS, dims.INSEAM_LABELS), F.bround(inseam - leg, 1))),
        )
    )
    warnings = all_reasons([("허리가 작아 잠기지 않을 수 있음", waist_label == "작음")])
    estimated = all_reasons([("inseam", inseam.isNotNull() & body["inseam"].isNull())])
    return F.struct(zones.alias("zones"), warnings.alias("warnings"), estimated.alias("estimated"))


def fit_report(category: Column, garment: Column, body: Column, stretch: Column | None = None) -> Column:
    """The report of a top, coat or dress, by category; another category fails. Bottoms have measures of their own: bottom_report."""
    out = F.when(F.lit(False), F.lit(None))
    for name in ("상의", "아우터", "원피스"):
        out = out.when(category == name, top_report(garment, body, name, stretch))
    return out.otherwise(F.raise_error(F.concat(F.lit("no fit rules for "), F.coalesce(category, F.lit("null")))))


def needs_outer(temp: Column) -> Column:
    return temp < 17


def label_of(report: Column, name: str) -> Column:
    return F.get(F.filter(report["zones"], lambda z: z["zone"] == name), F.lit(0))["label"]


def summary(report: Column) -> Column:
    return F.array_join(F.transform(report["zones"], lambda z: F.concat_ws(" ", z["zone"], z["label"])), ", ")


def seasons_for(temp: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for low, names in dims.SEASONS:
        value = F.array(*(F.lit(n) for n in names))
        out = out.when(temp >= low, value) if low is not None else out.otherwise(value)
    return out


def wearable(available: Column, season: Column, formality: Column, temp: Column, target: Column) -> Column:
    return available & F.arrays_overlap(season, seasons_for(temp)) & (F.abs(formality - target) <= 2)


def freshness(days: Column) -> Column:
    return F.when(days.isNull() | (days >= 4), 1.0).when(days < 2, 0.2).otherwise(0.6)


def silhouette_score(top_fit: Column, bottom_fit: Column) -> Column:
    t, b = lookup(top_fit, dims.VOLUME), lookup(bottom_fit, dims.VOLUME)
    return (
        F.when(t.isNull() | b.isNull(), 0.8)
        .when((t >= 2) & (b >= 2), 0.6)
        .when((t == 0) & (b == 0), 0.85)
        .when(F.abs(t - b) >= 2, 1.0)
        .otherwise(0.9)
    )


def accents(colors: Column) -> Column:
    """The distinct colours that are not neutral, sorted; unknown colours count."""
    return F.array_sort(F.array_distinct(F.filter(colors, lambda c: ~c.isin(*dims.NEUTRALS))))


def color_score(accent_colors: Column, patterns: Column, hues: Column) -> Column:
    """accent_colors: see accents(); patterns: array; hues: map from colour name to hue angle."""
    gap = F.abs(F.element_at(hues, F.get(accent_colors, F.lit(0))) - F.element_at(hues, F.get(accent_colors, F.lit(1))))
    n = F.size(accent_colors)
    two = F.when(F.least(gap, 360 - gap) < 40, 0.8).otherwise(0.55)
    base = F.when(n == 0, 0.85).when(n == 1, 1.0).when(n == 2, two).otherwise(0.3)
    extra = F.greatest(F.size(F.filter(patterns, lambda p: p != "무지")) - 1, F.lit(0))
    return F.greatest(base - F.lit(0.2) * extra, F.lit(0.0))


def style_score(tags: Column, wanted: Column | None = None) -> Column:
    """tags: array of tag arrays. Mean Jaccard similarity of the pairs of tagged items, and the share with the wanted tag."""
    tagged = F.filter(tags, lambda t: F.size(t) > 0)
    k = F.size(tagged)
    after = lambda i: F.slice(tagged, i + 2, F.greatest(k - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform(tagged, lambda a, i: F.transform(after(i), lambda b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double"))))
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(pairs), F.lit(0))
    base = F.when(k < 2, 0.7).otherwise(F.lit(0.4) + F.lit(0.6) * mean)
    if wanted is None:
        return base
    share = F.size(F.filter(tags, lambda t: F.array_contains(t, wanted))) / F.size(tags).cast("double")
    return F.when(wanted.isNull(), base).otherwise(F.lit(0.7) * base + F.lit(0.3) * share)


def formality_score(levels: Column, target: Column) -> Column:
    mean = F.aggregate(levels, F.lit(0.0), lambda s, x: s + x) / F.size(levels)
    return F.greatest(F.lit(0.0), 1 - F.abs(mean - target) / 4)


def outfit_score(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or dims.OUTFIT_WEIGHTS
    total = sum(weights.values())
    return sum((F.lit(w) * parts[k] for k, w in weights.items()), F.lit(0.0)) / F.lit(total)


def gate_score(passed: Column, scores: dict[str, Column]) -> Column:
    """palette + half of extra + 40 outer_frac, and 1000 if not passed; missing scores are 99, 99 and 0."""
    return (
        F.coalesce(scores["palette"], F.lit(99.0)) + 0.5 * F.coalesce(scores["extra"], F.lit(99.0)) + 40 * F.coalesce(scores["outer_frac"], F.lit(0.0))
        + F.when(passed, 0.0).otherwise(1000.0)
    )
