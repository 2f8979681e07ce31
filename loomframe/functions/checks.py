"""Acceptance checks over measured columns: gates, swaps, layers, index rules, prompts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims, rules

# Thresholds of the result gate, of swaps and of layers, kinds with their least aspect, hard patterns.
GATE = {
    "border_std_max": 6.0, "fg_frac_min": 0.06, "fg_frac_max": 0.92, "components_max": 2, "palette_dist_max": 12.0, "extra_color_max": 15.0,
    "chroma_ratio_min": 0.5, "chroma_ratio_max": 2.0, "outer_frac_max": 0.15, "same_color_sep": 10.0, "lightness_gap_max": 35.0,
}
ENGINE = {
    "swap_changed_min": 6.0, "swap_palette_max": 12.0, "swap_leak_max": 0.2, "swap_ring_max": 12.0, "layer_cover_min": 0.3, "layer_cover_max": 0.92,
    "layer_face_max": 0.05, "layer_palette_max": 15.0, "layer_foreign_max": 0.15,
}
ASPECT_MIN = {"top": 0.5, "bottom": 0.25, "onepiece": 0.3}
BOTTOMS = ("trousers", "jeans", "shorts", "skirt", "pants", "rain trousers", "winter trousers", "leggings")
ONEPIECES = ("dress", "jumpsuit")
HARD_PATTERNS = ("letters, numbers", "cartoon", "abstract", "geometric", "floral", "camouflage", "animal", "paisley", "plant", "stripe", "check", "dot")
MIN_PIXELS, MIN_INSIDE, MIN_SOLO_AREA, MIN_SOLO_SOLIDITY, MIN_TARGET_VISIBLE, MIN_SATURATION = 50, 0.5, 0.03, 0.75, 0.4, 0.12
ART_WORDS = (
    "painting", "drawing", "engraving", "illustration", "tapestry", "museum", "statue", "sculpture", "poster", "lithograph", "sketch", "fresco", "mosaic", "icon", "plan", "diagram", "woodcut",
    "etching", "manuscript", "miniature", "portrait", "gemälde", "schilderij", "musée", "museo", "art ",
)
BACKGROUND_SEEDS = ("Category:Beds", "Category:Quilts", "Category:Blankets", "Category:Bedding", "Category:Duvets", "Category:Rugs", "search:hardwood floor", "search:couch living room", "Category:Cushions")


def available(state: Column) -> Column:
    """Clean or worn: not waiting for the wash, not in it."""
    return F.coalesce(state.isin(dims.CLEAN, dims.WORN), F.lit(False))


def unworn(last_worn: Column, today: Column, days: int) -> Column:
    """Not worn for so many days, or never."""
    return last_worn.isNull() | (F.datediff(today, last_worn) >= days)


def least_aspect(category: Column) -> Column:
    """Null counts as one piece, an unknown kind as a top."""
    return (
        F.when(category.isNull() | category.isin(*ONEPIECES), ASPECT_MIN["onepiece"]).when(category.isin(*BOTTOMS), ASPECT_MIN["bottom"]).otherwise(ASPECT_MIN["top"])
    )


def gate_reasons(s: Column, category: Column, thresholds: dict[str, float] | None = None) -> Column:
    """All reasons against a result, in order; empty: passed.

    s: struct(border_std, fg_frac, components, fg_pixels, aspect, lightness_gap, target_chroma, chroma_ratio, palette_dist,
    extra_color, outer_pixels, palette_sep, outer_frac). With too few foreground pixels only the first three are looked at;
    the outer garment's colour counts only if it has pixels and is not the target's own.
    """
    t = GATE | (thresholds or {})
    first = [
        ("배경이 단색이 아님", s["border_std"] > t["border_std_max"]),
        ("옷 크기가 이상함", ~s["fg_frac"].between(t["fg_frac_min"], t["fg_frac_max"])),
        ("옷이 여러 덩어리", s["components"] > t["components_max"]),
    ]
    rest = [
        ("펼친 옷 모양이 아님", s["aspect"] < least_aspect(category)),
        ("밝기가 크게 달라짐", s["lightness_gap"] > t["lightness_gap_max"]),
        ("대상 옷 색이 결과물에 없음", s["palette_dist"] > t["palette_dist_max"]),
        ("대상에 없던 색이 많음", s["extra_color"] > t["extra_color_max"]),
        ("채도가 크게 달라짐", (s["target_chroma"] > 8) & ~s["chroma_ratio"].between(t["chroma_ratio_min"], t["chroma_ratio_max"])),
        ("겉옷 색이 섞임", (s["outer_pixels"] >= MIN_PIXELS) & (s["palette_sep"] >= t["same_color_sep"]) & (s["outer_frac"] > t["outer_frac_max"])),
    ]
    early = rules.all_reasons(first)
    return F.when(s["fg_pixels"] < MIN_PIXELS, F.when(F.size(early) == 0, F.array(F.lit("옷을 찾지 못함"))).otherwise(early)).otherwise(rules.all_reasons([*first, *rest]))


def swap_reasons(s: Column) -> Column:
    """s: struct(changed, palette_dist, old_vs_prod, leak, ring). Whether it changed is not asked if old and new are alike in colour."""
    same = s["old_vs_prod"] < 8
    return rules.all_reasons(
        [
            ("안 바뀜", ~same & (s["changed"] < ENGINE["swap_changed_min"])),
            ("상품 색이 아님", s["palette_dist"] > ENGINE["swap_palette_max"]),
            ("옛 이너가 남음", ~same & (s["leak"] > ENGINE["swap_leak_max"])),
            ("겉옷이 바뀜", s["ring"] > ENGINE["swap_ring_max"]),
        ]
    )


def layer_reasons(s: Column, worn: Column | None = None) -> Column:
    """s: struct(cover, face, jacket_pixels, palette_dist, foreign); colours are asked only of a jacket of more than MIN_PIXELS."""
    there = s["jacket_pixels"] > MIN_PIXELS
    checks = [
        ("겉옷이 안 덮음", s["cover"] < ENGINE["layer_cover_min"]),
        ("상의가 다 가려짐", s["cover"] > ENGINE["layer_cover_max"]),
        ("얼굴 쪽이 바뀜", s["face"] > ENGINE["layer_face_max"]),
        ("은행 겉옷 색이 아님", there & (s["palette_dist"] > ENGINE["layer_palette_max"])),
        ("은행 겉옷에 없는 색", there & (s["foreign"] > ENGINE["layer_foreign_max"])),
        ("겉옷 없음", ~there),
    ]
    return rules.all_reasons(checks if worn is None else [*checks, ("사람이 입은 사진 아님", ~worn)])


def is_hard(attributes: Column) -> Column:
    """attributes: map from a name to its values; patterns that are hard to draw again."""
    patterns = F.coalesce(F.element_at(attributes, "textile pattern"), F.array().cast("array<string>"))
    return F.arrays_overlap(patterns, F.array(*(F.lit(p) for p in HARD_PATTERNS)))


def worn_files(annotations: DataFrame, hints: Sequence[str], file: str = "file", category: str = "category") -> DataFrame:
    """The files that have a companion annotation: a photo of a person who wears the garment."""
    return annotations.where(F.col(category).isin(*hints)).select(file).distinct()


def index_images(annotations: DataFrame, inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """(file, kind, inside, inner_share, share_bin, area_frac, solidity, split) of the images that may be used.

    annotations: file, category, area, hull_area, inside (pixels of the inner one within the outer one's hull), pixels (of the
    image). One inner garment and one outer at most; layered ones need half of the inner within the outer's hull, solo
    ones size and solidity. An image with an empty mask is none.
    """
    from .hashing import split_of

    is_inner, is_outer = F.col("category").isin(*inner), F.col("category").isin(*outer)
    one = annotations.groupBy("file").agg(
        F.count_if(is_inner).alias("n_inner"), F.count_if(is_outer).alias("n_outer"), F.max("pixels").alias("pixels"),
        *(F.max(F.when(is_inner, F.col(c))).alias(c) for c in ("area", "hull_area", "inside")), F.max(F.when(is_outer, F.col("area"))).alias("outer_area"),
    )
    one = one.where((F.col("n_inner") == 1) & (F.col("n_outer") <= 1) & (F.col("area") > 0) & ((F.col("n_outer") == 0) | (F.col("outer_area") > 0)))
    layered, area = F.col("n_outer") == 1, F.col("area").cast("double")
    share = F.when(layered, area / (area + F.col("outer_area")))
    out = one.select(
        "file", F.when(layered, "layered").otherwise("solo").alias("kind"), F.when(layered, F.col("inside") / area).alias("inside"), share.alias("inner_share"), rules.share_bin(share).alias("share_bin"),
        F.when(~layered, area / F.col("pixels")).alias("area_frac"), F.when(~layered, area / F.greatest("hull_area", F.lit(1))).alias("solidity"),
        F.when(layered, split_of(F.col("file").cast("string"), dims.LAYERED_SPLITS, {})).otherwise(split_of(F.col("file").cast("string"), dims.SOLO_SPLITS, {})).alias("split"),
    )
    good = F.when(F.col("kind") == "layered", F.col("inside") >= MIN_INSIDE).otherwise((F.col("area_frac") >= MIN_SOLO_AREA) & (F.col("solidity") >= MIN_SOLO_SOLIDITY))
    return out.where(good)


def visible_enough(visible: Column, full: Column) -> Column:
    return F.coalesce((full > 0) & (visible / full >= MIN_TARGET_VISIBLE), F.lit(False))


def usable_background(seed: Column, title: Column, saturation: Column) -> Column:
    """Of a household category, no work of art by its title, not grey."""
    low = F.lower(F.coalesce(title, F.lit("")))
    art = F.lit(False)
    for word in ART_WORDS:
        art = art | low.contains(word)
    return F.coalesce(seed.isin(*BACKGROUND_SEEDS) & ~art & (saturation >= MIN_SATURATION), F.lit(False))


def over_limit(value: Column, limit: float | None) -> Column:
    """Whether a row goes for its palette distance; a missing one is 0, no limit keeps all."""
    return F.lit(False) if limit is None else F.coalesce(value, F.lit(0.0)) > limit


def json_violations(text: Column, spec: dict) -> Column:
    """All violations of an object's schema: missing and unknown keys, types, enumerations, ranges, array sizes, bad members.

    spec: key -> {"type": "string" | "integer" | "array", "enum", "minimum", "maximum", "minItems", "maxItems", "required"}.
    A text that is no object has one violation. JSON true is no integer.
    """
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  # a value with several uses, worked out once a row
    read = lambda doc: F.struct(F.try_parse_json(doc).alias("v"), F.json_object_keys(doc).alias("keys"))
    return once(text, lambda doc: once(read(doc), lambda d: _violations(d["v"], d["keys"], spec, once)))


def _bad_value(k: str, s: dict) -> Callable[[Column], Column]:
    """What is wrong with a value (kind, value) of a key that is there, by the key's own spec."""

    def bad(x: Column) -> Column:
        kind, value = x["kind"], x["value"]
        if s["type"] == "string":
            bad_type = kind != "STRING"
            checks = [(bad_type, "no string")]
            if "enum" in s:
                checks.append((~bad_type & ~value.isin(*s["enum"]), "value"))
        elif s["type"] == "integer":
            checks = [((kind != "BIGINT") | ~value.between(s["minimum"], s["maximum"]), "range")]
        else:
            is_array = kind.startswith("ARRAY")
            checks = [(~is_array, "no array"), (is_array & ((F.size(value) > s.get("maxItems", 1 << 30)) | (F.size(value) < s.get("minItems", 0))), "size")]
            if "enum" in s:
                checks.append((is_array & F.exists(value, lambda m: m.isNull() | ~m.isin(*s["enum"])), "members"))
        return F.array(*(F.when(F.coalesce(c, F.lit(True) if name.startswith("no") else F.lit(False)), F.lit(f"{k}: {name}")) for c, name in checks))

    return bad


def _violations(v: Column, keys: Column, spec: dict, once: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    out = [F.array(*(F.when(~F.coalesce(F.array_contains(keys, k), F.lit(False)), F.lit(f"{k}: missing")) for k, s in spec.items() if s.get("required", True))).cast("array<string>")]
    extra = F.transform(F.filter(keys, lambda k: ~k.isin(*spec)), lambda k: F.concat(k, F.lit(": unknown")))
    for k, s in spec.items():
        kind = F.schema_of_variant(F.try_variant_get(v, f"$['{k}']", "variant"))
        wanted = {"string": "string", "integer": "long"}.get(s["type"], "array<string>")
        value = F.try_variant_get(v, f"$['{k}']", wanted)
        out.append(F.when(F.array_contains(keys, k), once(F.struct(kind.alias("kind"), value.alias("value")), _bad_value(k, s))).otherwise(F.array().cast("array<string>")))
    found = F.concat(F.array_compact(F.concat(*out)), F.coalesce(extra, F.array().cast("array<string>")))
    return F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(found)


# --- prompts ------------------------------------------------------------------------------------------

# Wide names of kinds and the sentences of the prompts.
GENERIC = {"inner": "top", "outer": "outer garment", "bottom": "bottoms", "onepiece": "dress"}
GROUPS = {
    "inner": ("top", "t-shirt", "shirt", "blouse", "sweater", "tank top", "hoodie", "training top", "tunic"),
    "outer": ("jacket", "blazer", "coat", "winter jacket", "cardigan", "vest", "rain jacket", "denim jacket", "cape"),
    "bottom": ("trousers", "jeans", "shorts", "skirt", "rain trousers", "winter trousers", "pants"),
    "onepiece": ("dress",),
}
DIM_WHAT = {
    "inner": "the {cat} shown bright in image 2, which is worn under the {outer} in the photo (image 1)",
    "flat": "the {cat} shown bright in image 2, which lies among other things in the photo (image 1)",
    "outer": "the {cat} shown bright in image 2, which is the outer layer in the photo (image 1)",
    "single": "the {cat} shown bright in image 2 (a close-up of the photo, image 1)",
}
MARKED_WHAT = {
    "inner": "the {cat} marked with the green outline in image 1 (image 2 is a close-up of it; it is worn under the {outer})",
    "flat": "the {cat} marked with the green outline in image 1 (image 2 is a close-up of it; it lies among other things)",
    "outer": "the {cat} marked with the green outline in image 1 (image 2 is a close-up of it; it is the outer layer)",
    "single": "the {cat} marked with the green outline in image 1 (image 2 is a close-up of it)",
}
DIM_PRODUCT = "Create a store product photo of {what}: the garment alone, laid flat and neatly smoothed, front view, centered on a plain white background. Keep its exact colors, pattern, print and details. Show only this one garment: no person, no other clothing, no accessories, no other objects. In image 2 everything except the garment is darkened only to point at it."  # noqa: E501
SOLO_PRODUCT = "Create a store product photo of {what}: the garment alone, laid flat and neatly smoothed, front view, centered on a plain white background. Keep its exact colors, pattern, print and details. Show only this one garment: no person, no other clothing, no other objects."  # noqa: E501
UNDER_PRODUCT = "Create a store product photo of {what}: the garment alone, laid flat and neatly smoothed, front view, centered on a plain white background. Keep its exact colors, pattern, print and details. Show only this one garment: no {outer}, no person, no other clothing."  # noqa: E501
PEEL = "Remove the {outer} marked with the green outline from the person in image 1. Keep the person, face, hair, pose, the clothes underneath and the background exactly the same."
MARK_NOTE = " The green marks are only pointers; do not draw them."


def generic(category: Column) -> Column:
    """The wide name of a kind; kinds of no group keep theirs."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for group, kinds in GROUPS.items():
        out = out.when(category.isin(*kinds), GENERIC[group])
    return out.otherwise(category)


def filled(text: str | Column, **values: Column) -> Column:
    """A text with its {names} replaced."""
    out = F.lit(text) if isinstance(text, str) else text
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def extract_prompt(category: Column, layer: Column, style: str = "struct") -> Column:
    """struct: a tag of kind and layer. natural, generic: sentences that point by a green outline; dim, dimfine: by brightness. generic and dim name kinds widely."""
    if style == "struct":
        return F.concat(F.lit("[EXTRACT] "), category, F.lit("; layer="), layer)
    if style not in ("natural", "generic", "dim", "dimfine"):
        raise ValueError(f"unknown style {style!r}")
    name = generic(category) if style in ("dim", "generic") else category
    inner, outer = layer.startswith("inner under "), F.substring(layer, len("inner under ") + 1, 1 << 30)
    texts = DIM_WHAT if style in ("dim", "dimfine") else MARKED_WHAT
    what = F.when(inner, filled(texts["inner"], cat=name, outer=outer))
    for k in ("flat", "outer"):
        what = what.when(layer == k, filled(texts[k], cat=name))
    what = what.otherwise(filled(texts["single"], cat=name))
    if style in ("dim", "dimfine"):
        return filled(DIM_PRODUCT, what=what)
    sentence = F.when(inner, filled(UNDER_PRODUCT, what=what, outer=outer)).otherwise(filled(SOLO_PRODUCT, what=what))
    return F.concat(sentence, F.lit(MARK_NOTE))


def peel_prompt(outer: Column, style: str = "struct") -> Column:
    return F.concat(F.lit("[PEEL] "), outer) if style == "struct" else F.concat(filled(PEEL, outer=outer), F.lit(MARK_NOTE))
