"""The registered queries: each operator applied to the tables of a folder, whole tables, fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checks, color, dims, hashing, records, rules, text
from ..operators import metrics, outfits, palette, relational
from ..sources import files
from ..streaming import breaker, care

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def r(c: Column, digits: int = 4) -> Column:
    return F.round(c.cast("double"), digits) + F.lit(0.0)  # no negative zero


# --- filters and reasons ------------------------------------------------------------------------------


@query
def license_audit(spark: SparkSession, at: str) -> DataFrame:
    """Licence notices by name and verdict."""
    name = text.license_notice(F.col("text"))
    return t(spark, at, "documents").select(name.alias("license")).groupBy("license").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", text.license_ok(F.col("license")))


def _doc_checks() -> list[tuple[str, Column]]:
    return [
        ("lang", ~F.col("lang").isin("en", "de")),
        ("small", F.col("n_chars") < 500),
        ("large", F.col("n_chars") > 10_000),
        ("source", F.col("source") == "src3"),
    ]


@query
def first_reject_reason(spark: SparkSession, at: str) -> DataFrame:
    docs = t(spark, at, "documents").select(rules.first_reason(_doc_checks()).alias("reason"))
    return docs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _line_checks() -> list[tuple[str, Column]]:
    return [("discount", F.col("l_discount") > 0.08), ("quantity", F.col("l_quantity") < 5), ("tax", F.col("l_tax") >= 0.07), ("price", F.col("l_extendedprice") > 80_000)]


@query
def all_reject_reasons(spark: SparkSession, at: str) -> DataFrame:
    """Counts of every reason; accepted rows as 'ok'."""
    reasons = rules.all_reasons(_line_checks())
    lines = t(spark, at, "lineitem").select(F.explode(F.when(F.size(reasons) == 0, F.array(F.lit("ok"))).otherwise(reasons)).alias("reason"))
    return lines.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def coco_star_filter(spark: SparkSession, at: str) -> DataFrame:
    """Orders as images, line items as annotations: both filters, then images that keep an annotation."""
    types = ("ECONOMY", "SMALL", "PROMO", "MEDIUM", "LARGE", "STANDARD")
    kinds = F.array_position(F.array(*(F.lit(x) for x in types)), F.col("p_type"))
    parts = t(spark, at, "part").select(F.col("p_partkey").alias("l_partkey"), kinds.cast("int").alias("category_id"))
    tables = {
        "images": t(spark, at, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("license"), "o_orderpriority"),
        "categories": spark.createDataFrame([(i, n) for i, n in enumerate(types, 1)], "id int, name string"),
        "annotations": t(spark, at, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("image_id"), "category_id"),
    }
    kept = files.filter_coco(tables, [1, 2], [2, 3], drop_empty=True)
    per_image = kept["annotations"].groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return kept["images"].join(per_image, "id").select(F.col("id").alias("o_orderkey"), "o_orderpriority", "n")


@query
def strict_and_left_dim_lookup(spark: SparkSession, at: str) -> DataFrame:
    """Nation must exist (strict); the region is looked up only for Asia and Europe, '?' else."""
    nation = t(spark, at, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = t(spark, at, "region").where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    joined = relational.strict_lookup(t(spark, at, "supplier"), nation, ["s_nationkey"]).join(F.broadcast(region), "n_regionkey", "left")
    return joined.groupBy("n_name", F.coalesce("r_name", F.lit("?")).alias("region")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("s_acctbal"), 2).alias("balance"))


@query
def usable_view(spark: SparkSession, at: str) -> DataFrame:
    """Rows accepted, of one view, not of an excluded station, without suspects."""
    suspects = t(spark, at, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("item"))
    bank = t(spark, at, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") <= 30).alias("accepted"), F.lit("front").alias("view"), F.col("p_type").alias("station"), "p_size")
    found = relational.usable(bank, "front", ["LARGE"], suspects)
    return found.select(F.col("item").alias("p_partkey"), F.col("station").alias("p_type"), "p_size")


# --- splits, samples, order ---------------------------------------------------------------------------


@query
def split_by_hash(spark: SparkSession, at: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    split = hashing.split_of(name, dims.LAYERED_SPLITS, {"7": "exp0", "42": "exp0"})
    return t(spark, at, "documents").groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_hash_sample(spark: SparkSession, at: str) -> DataFrame:
    return relational.top_by_hash(t(spark, at, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), 20)


@query
def round_robin_sample(spark: SparkSession, at: str) -> DataFrame:
    return relational.round_robin(t(spark, at, "documents").select("doc_id", "source"), "source", F.col("doc_id"), 60)


@query
def per_seed_cap(spark: SparkSession, at: str) -> DataFrame:
    capped = relational.first_n_per_key(t(spark, at, "events").select("event_id", "user_id", "ts", "value"), "user_id", [F.col("ts"), F.col("event_id")], 10)
    return capped.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"), r(F.sum("value"), 2).alias("total"))


@query
def every_nth(spark: SparkSession, at: str) -> DataFrame:
    return relational.every_nth(t(spark, at, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7)


@query
def lookup_last_wins(spark: SparkSession, at: str) -> DataFrame:
    events = t(spark, at, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.latest(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query
def resume_anti_join(spark: SparkSession, at: str) -> DataFrame:
    done = t(spark, at, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = relational.resume(t(spark, at, "orders"), done, ["o_orderkey"])
    return left.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query
def dedup_id_then_hash(spark: SparkSession, at: str) -> DataFrame:
    docs = t(spark, at, "documents").select("doc_id", "text", "lang")
    kept = relational.dedup_id_then_content(docs, "doc_id", F.coalesce("text", F.lit("")), [F.col("doc_id")])
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@query
def latest_checkpoint(spark: SparkSession, at: str) -> DataFrame:
    """Per customer the last complete order (status F): the largest step that has its file."""
    orders = t(spark, at, "orders")
    weights = F.when(F.col("o_orderstatus") == "F", "weights.bin").otherwise("config.json")
    listed = orders.select("o_custkey", "o_orderpriority", F.concat(F.lit("out/step-"), F.col("o_orderkey").cast("string"), F.lit("/"), weights).alias("path"))
    found = files.latest_checkpoint(listed, by=["o_custkey"])
    return found.join(orders.select(F.col("o_orderkey").alias("step"), "o_orderpriority"), "step").select("o_custkey", "step", F.col("o_orderpriority").alias("path"))


@query
def incremental_history_dedup(spark: SparkSession, at: str) -> DataFrame:
    """Second half of the documents, deduplicated within and against what the first half kept."""
    docs = t(spark, at, "documents").select("doc_id", "text")
    content = F.coalesce("text", F.lit(""))
    seen = relational.dedup_id_then_content(docs.where("doc_id % 2 = 0"), "doc_id", content, [F.col("doc_id")]).select("doc_id", "sha1")
    new = relational.dedup_id_then_content(docs.where("doc_id % 2 = 1"), "doc_id", content, [F.col("doc_id")], seen)
    return new.select("doc_id", "sha1")


# --- outfits, fit, care -------------------------------------------------------------------------------

_SLOTS = {"ECONOMY": "top", "SMALL": "top", "PROMO": "bottom", "MEDIUM": "bottom", "LARGE": "outer", "STANDARD": "shoes"}
_CATEGORY = {"top": "상의", "bottom": "하의", "dress": "원피스", "outer": "아우터", "shoes": "신발"}
_PALETTE = ["블랙", "레드", "화이트", "핑크", "네이비", "옐로우", "블루"]
_FITS = ["슬림", "레귤러", "세미오버", "오버"]


def _at(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)


def _wardrobe(spark: SparkSession, at: str) -> DataFrame:
    """Parts as items of wardrobes of 24 part keys each; the context of a wardrobe is its number."""
    k = F.col("p_partkey")
    season = F.when(k % 3 == 0, F.array(F.lit("여름"))).when(k % 3 == 1, F.array(F.lit("봄"), F.lit("가을"))).otherwise(F.array(F.lit("겨울"), F.lit("가을")))
    parts = t(spark, at, "part").withColumn("slot", rules.lookup(F.col("p_type"), _SLOTS)).where("slot is not null")
    item = F.struct(
        k.alias("id"),
        rules.lookup(F.col("slot"), _CATEGORY).alias("category"),
        _at(_PALETTE, (k % 7).cast("int")).alias("primary_color"),
        F.when(k % 5 == 0, "체크").otherwise("무지").alias("pattern"),
        _at(_FITS, (k % 4).cast("int")).alias("fit"),
        (k % 5 + 1).cast("int").alias("formality"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("a"))).when(k % 4 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c"))).alias("style_tags"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(k % 6).cast("int").alias("days_since_worn"),
    )
    usable = rules.wearable(F.lit(True), season, item["formality"], F.lit(12.0), F.lit(3))
    return parts.where(usable).select(F.floor(k / 24).cast("int").alias("context"), "slot", item.alias("item"))


@query
def slot_cross_join(spark: SparkSession, at: str) -> DataFrame:
    found = outfits.slot_candidates(_wardrobe(spark, at), need_outer=True)
    return found.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("items")).alias("most_items"))


def _scored(spark: SparkSession, at: str) -> DataFrame:
    return outfits.scored(outfits.slot_candidates(_wardrobe(spark, at), need_outer=True), F.lit(3), F.lit("a"))


@query
def weighted_outfit_score(spark: SparkSession, at: str) -> DataFrame:
    parts = ("color", "silhouette", "style", "formality", "freshness", "score")
    return _scored(spark, at).select("context", F.array_join(F.col("ids").cast("array<string>"), "-").alias("ids"), *(r(F.col(p), 6).alias(p) for p in parts))


@query
def greedy_diverse_topn(spark: SparkSession, at: str) -> DataFrame:
    core = F.transform(F.filter("items", lambda i: i["category"] != "신발"), lambda i: i["id"])
    rows = _scored(spark, at).select("context", r(F.col("score")).alias("score"), "ids", core.alias("core"))
    return outfits.greedy_diverse(rows, "context").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), "-"))


@query
def best_size(spark: SparkSession, at: str) -> DataFrame:
    """For each part as a body the size of a fixed chart nearest to the preferred fit, first in the chart on ties."""
    body = t(spark, at, "part").select("p_partkey", (F.lit(80.0) + F.col("p_size")).alias("chest"))
    chart = spark.createDataFrame([(0, "S", 47.0), (1, "M", 51.0), (2, "L", 55.0), (3, "XL", 59.0)], "ord int, size string, half double")
    ease = F.col("half") * 2 - F.col("chest")
    label = rules.band(ease, dims.FIT_BOUNDS["상의", "chest"], dims.FIT_LABELS)
    rank = rules.lookup(label, {name: i for i, name in enumerate(dims.FIT_LABELS)})
    tried = body.join(F.broadcast(chart)).withColumns({"label": label, "gap": F.abs(rank - 2)}).where(ease >= 0)
    return tried.groupBy("p_partkey").agg(F.min_by("size", F.struct("gap", "ord")).alias("size"), F.min("gap").cast("int").alias("gap"))


@query
def fit_bands(spark: SparkSession, at: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    lines = t(spark, at, "lineitem").select(
        rules.band(q, (10, 20, 30, 40), dims.FIT_LABELS).alias("band"),
        rules.shoulder_label(q - 25).alias("shoulder"),
        rules.band(q / 45, dims.SLEEVE_BOUNDS, dims.SLEEVE_LABELS).alias("sleeve"),
        rules.share_bin(q / 50).alias("share"),
        rules.band(F.lit(2.0) * F.col("l_linenumber") - 6, dims.INSEAM_BOUNDS, dims.INSEAM_LABELS).alias("inseam"),
    )
    return lines.groupBy("band", "shoulder", "sleeve", "share", "inseam").agg(F.count(F.lit(1)).alias("n"))


_KINDS = {"view": "wear", "click": "hot", "purchase": "sweaty", "signup": "snooze", "error": "wash"}


@query
def care_state_fold(spark: SparkSession, at: str) -> DataFrame:
    events = t(spark, at, "events").select("user_id", "ts", "event_id", rules.lookup(F.col("event_type"), _KINDS).alias("kind"))
    state = care.fold(events, "user_id", ["ts", "event_id"], F.lit(4.0))
    code = rules.lookup(F.col("state"), {dims.CLEAN: 0, dims.WORN: 1, dims.NEEDS_WASH: 2, dims.WASHING: 3}).cast("int")
    return state.select("user_id", r(F.col("load"), 3).alias("load"), F.coalesce("interval_override", F.lit(0.0)).alias("learned"), code.alias("state"), F.col("wear_count").alias("wears"))


@query
def laundry_bundles(spark: SparkSession, at: str) -> DataFrame:
    """Parts that need washing, by method and colour group; the lowest temperature of the bundle holds."""
    k = F.col("p_partkey")
    cares = rules.default_care(_at(["면", "울", "실크 혼방", "소가죽"], (k % 4).cast("int")), _at(["티셔츠", "코트", "니트"], (k % 3).cast("int")))
    parts = t(spark, at, "part").select(k, cares.alias("care"), rules.color_group(_at(_PALETTE, (k % 7).cast("int"))).alias("group"))
    dry = F.col("care.method") == dims.DRY_ONLY
    bundles = parts.select(F.col("care.method").alias("method"), F.when(~dry, F.col("group")).alias("color"), "care.max_temp", k).groupBy("method", "color")
    return bundles.agg(F.min("max_temp").alias("max_temp"), F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_item"))


@query
def idle_items(spark: SparkSession, at: str) -> DataFrame:
    """Customers without an order for 180 days before 1998-08-02, or ever."""
    last = t(spark, at, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("last_order"))
    today = F.lit("1998-08-02").cast("date")
    customers = t(spark, at, "customer").join(last, "c_custkey", "left").where(checks.unworn(F.col("last_order"), today, 180))
    return customers.select("c_custkey", F.datediff(today, F.col("last_order")).alias("idle_days"))


@query
def cost_per_use(spark: SparkSession, at: str) -> DataFrame:
    """Price by use, half even to a whole number; null where there was none."""
    uses = t(spark, at, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"))
    parts = t(spark, at, "part").join(uses, "p_partkey", "left")
    n = F.coalesce("uses", F.lit(0))
    return parts.select("p_partkey", n.alias("uses"), F.bround(F.try_divide("p_retailprice", n), 0).alias("cost"))


# --- colour -------------------------------------------------------------------------------------------


def _rgb(i: int) -> Column:
    return F.floor(F.least(F.greatest((F.get("embedding", F.lit(i)).cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255)


def _labs(spark: SparkSession, at: str) -> DataFrame:
    return t(spark, at, "embeddings").select("vec_id", color.srgb_to_lab(_rgb(0), _rgb(1), _rgb(2)).alias("lab"), color.srgb_to_lab(_rgb(3), _rgb(4), _rgb(5)).alias("lab2"))


@query
def nearest_color(spark: SparkSession, at: str) -> DataFrame:
    found = color.nearest_color(_labs(spark, at).select("vec_id", "lab"), "vec_id", "lab")
    return found.select("vec_id", "color", r(F.col("delta_e")).alias("delta_e"))


@query
def color_distance_pairs(spark: SparkSession, at: str) -> DataFrame:
    one = color.with_delta_e(_labs(spark, at), "lab", "lab2", "de")
    two = color.with_delta_e(one, "lab", "lab2", "de_soft", k_l=2.0)
    return two.select("vec_id", r(F.col("de")).alias("de"), r(F.col("de_soft")).alias("de_soft"), r(color.chroma(F.col("lab")), 3).alias("chroma"))


# --- metrics ------------------------------------------------------------------------------------------


def _attempts(spark: SparkSession, at: str) -> DataFrame:
    return t(spark, at, "lineitem").select(
        (F.col("l_returnflag") == "N").alias("approved"), F.col("l_quantity").cast("double").alias("seconds"), rules.share_bin(F.col("l_discount") * 10).alias("bin"),
        (F.col("l_tax") > 0.06).alias("hard"), F.col("l_extendedprice").alias("gate"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("k"), F.col("l_orderkey").alias("seq"), "l_linestatus",
    )


@query
def yield_summary(spark: SparkSession, at: str) -> DataFrame:
    a = _attempts(spark, at).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("approved").alias("ok"), r(F.avg(F.col("approved").cast("int")), 3).alias("rate"),
        r(F.median("seconds"), 1).alias("median_seconds"), r(F.try_divide(F.sum("seconds"), F.count_if("approved")), 1).alias("seconds_per_ok"),
    )
    return a.withColumn("label", F.concat_ws("/", F.col("ok").cast("string"), F.col("n").cast("string")))


@query
def overlapping_group_summary(spark: SparkSession, at: str) -> DataFrame:
    """Each row counts in its bin, in 'all', and in 'hard' if it is: first, any and picked of a file, then means over files."""
    rows = _attempts(spark, at).select("*", metrics.overlapping_groups(F.col("bin"), {"hard": F.col("hard")}).alias("grp"))
    order = F.struct("k", "seq")
    files = rows.groupBy("grp", "file").agg(
        F.min_by("approved", order).cast("int").alias("single"), F.max(F.col("approved").cast("int")).alias("oracle"),
        F.min_by("approved", F.struct("gate", "seq", "k")).cast("int").alias("picked"), F.count(F.lit(1)).alias("rows"), F.count_if("approved").alias("passed"),
    )
    return files.groupBy("grp").agg(
        F.count(F.lit(1)).alias("files"), r(F.avg("single")).alias("single"), r(F.avg("oracle")).alias("oracle"), r(F.avg("picked")).alias("picked"), r(F.sum("passed") / F.sum("rows").cast("double")).alias("row_rate")
    )


@query
def group_and_overall(spark: SparkSession, at: str) -> DataFrame:
    lines = t(spark, at, "lineitem")
    groups = lines.groupingSets([[lines["l_returnflag"], lines["l_linestatus"]], []], lines["l_returnflag"], lines["l_linestatus"])
    return groups.agg(F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.round(F.avg(F.nullif("l_discount", F.lit(0.0))), 4).alias("mean_discount"), F.count(F.lit(1)).alias("n"))


@query
def median_by_bin_nan(spark: SparkSession, at: str) -> DataFrame:
    """NaN means no data: it is left out of the median and stays in the count."""
    x = F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.get("embedding", F.lit(0)).cast("double"))
    rows = t(spark, at, "embeddings").select(F.explode(F.array(F.col("label").cast("string"), F.lit("all"))).alias("bin"), x.alias("x"))
    return rows.groupBy("bin").agg(r(F.median(F.when(~F.isnan("x"), F.col("x"))), 3).alias("median"), F.count(F.lit(1)).alias("n"))


@query
def nearest_rank_p95(spark: SparkSession, at: str) -> DataFrame:
    return metrics.nearest_rank_by(t(spark, at, "events").select("event_type", "value"), "event_type", "value", 0.95).select("event_type", "n", F.col("value").alias("p95"))


@query
def field_accuracy(spark: SparkSession, at: str) -> DataFrame:
    """Rule predictions against labels, unpivoted to one row a field."""
    docs = t(spark, at, "documents").select("doc_id", (F.col("n_chars") > 200).cast("int").alias("p_quality"), F.col("text").contains("idiot").cast("int").alias("p_toxic"))
    joined = t(spark, at, "labels").join(docs, "doc_id", "left")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce((F.col(f) == F.col(f"p_{f}")).cast("double"), F.lit(0.0)).alias("s"), F.col(f).alias("label")) for f in ("quality", "toxic"))))
    rows = joined.select(fields.alias("f")).where("f.label is not null")
    return rows.groupBy(F.col("f.field").alias("field")).agg(r(F.avg("f.s"), 3).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query
def multiset_overlap(spark: SparkSession, at: str) -> DataFrame:
    events = t(spark, at, "events").select("user_id", "event_type", F.expr("event_id % 2 = 0").alias("even"))
    out = metrics.multiset_overlap(events.where("even"), events.where("not even"), ["user_id"], "event_type")
    return out.select("user_id", "shared", "n_pred", "n_true", "count_exact", *(r(F.col(c)).alias(c) for c in ("accuracy", "missing_ratio", "extra_ratio")))


@query
def precision_recall_sweep(spark: SparkSession, at: str) -> DataFrame:
    rows = t(spark, at, "labels").join(t(spark, at, "documents").select("doc_id", "n_chars"), "doc_id")
    steps = F.explode(F.array(*(F.lit(v) for v in (100, 500, 1000, 2000, 5000)))).alias("threshold")
    c = rows.select("n_chars", "quality", steps).groupBy("threshold").agg(
        F.count_if((F.col("n_chars") > F.col("threshold")) & (F.col("quality") == 1)).alias("tp"),
        F.count_if((F.col("n_chars") > F.col("threshold")) & (F.col("quality") == 0)).alias("fp"),
        F.count_if((F.col("n_chars") <= F.col("threshold")) & (F.col("quality") == 1)).alias("fn"),
    )
    p, q = metrics.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("threshold", "tp", "fp", "fn", r(p).alias("precision"), r(q).alias("recall"))


@query
def auroc_rank_sum(spark: SparkSession, at: str) -> DataFrame:
    rows = t(spark, at, "labels").join(t(spark, at, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    found = metrics.auroc(rows, F.col("n_chars"), F.col("quality") == 1, ["lang"])
    return found.select("lang", "n_pos", "n_neg", r(F.col("auroc"), 6).alias("auroc"))


@query
def paired_mcnemar(spark: SparkSession, at: str) -> DataFrame:
    rows = t(spark, at, "labels").join(t(spark, at, "documents").select("doc_id", "lang"), "doc_id")
    c = rows.groupBy("lang").agg(F.count_if(F.expr("quality = 1 and toxic = 0")).alias("a_only"), F.count_if(F.expr("quality = 0 and toxic = 1")).alias("b_only"))
    p = metrics.mcnemar(F.col("a_only"), F.col("b_only"))
    log = F.when(p == 0, float("-inf")).otherwise(F.log10(p))  # where p is less than a double can be; Spark's own logarithm of zero is null
    return c.select("lang", "a_only", "b_only", r(log, 6).alias("log10_p"))


@query
def centroid_similarity(spark: SparkSession, at: str) -> DataFrame:
    vectors = t(spark, at, "embeddings")
    joined = vectors.join(metrics.centroids(vectors, "label", "embedding"), "label")
    return joined.select("vec_id", "label", r(metrics.cosine(F.col("embedding"), F.col("centroid"))).alias("similarity"))


@query
def best_rotation(spark: SparkSession, at: str) -> DataFrame:
    """Of four views of a vector (its quarters) the one nearest to the label's centroid, if by a margin over the first."""
    vectors = t(spark, at, "embeddings")
    joined = vectors.join(metrics.centroids(vectors, "label", "embedding"), "label")
    sims = F.array(*(metrics.cosine(F.slice("embedding", 16 * i + 1, 16), F.slice("centroid", 1, 16)) for i in range(4)))
    picked = joined.select("vec_id", F.transform(sims, lambda s: F.round(s, 4)).alias("s"))
    best = F.array_position("s", F.array_max("s")) - 1
    angle = F.when((best != 0) & (F.array_max("s") - F.get("s", F.lit(0)) >= 0.05), best * 90).otherwise(0)
    return picked.select("vec_id", angle.cast("int").alias("angle"), F.array_max("s").alias("best"))


@query
def margin_to_others(spark: SparkSession, at: str) -> DataFrame:
    """Similarity to the own centroid less the best of the others, within the row: vectors are not paired with each other."""
    vectors = t(spark, at, "embeddings")
    return metrics.margin_to_others(vectors, "vec_id", "label", "embedding").select("vec_id", r(F.col("margin")).alias("margin"))


# --- text ---------------------------------------------------------------------------------------------


@query
def json_schema_check(spark: SparkSession, at: str) -> DataFrame:
    """Violations of {k: integer from 1 to 5, nothing else} in the events' JSON."""
    props = F.col("props")
    k = F.get_json_object(props, "$.k")
    checks = [
        ("unparsable", F.try_parse_json(props).isNull()),
        ("missing:k", k.isNull()),
        ("type:k", k.isNotNull() & ~k.rlike("^-?[0-9]+$")),
        ("range:k", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as int)") > 5, F.lit(False)) | F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as int)") < 1, F.lit(False))),
        ("extra", F.size(F.json_object_keys(props)) > 1),
    ]
    reasons = rules.all_reasons(checks)
    rows = t(spark, at, "events").select(F.explode(F.when(F.size(reasons) == 0, F.array(F.lit("valid"))).otherwise(reasons)).alias("violation"))
    return rows.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query
def html_clean_text(spark: SparkSession, at: str) -> DataFrame:
    stripped = text.strip_tags(F.col("html"))
    return t(spark, at, "pages").select("page_id", F.char_length(stripped).cast("long").alias("n_chars"), F.sha2(stripped, 256).alias("sha"))


@query
def html_unescaped_text(spark: SparkSession, at: str) -> DataFrame:
    return t(spark, at, "pages").select("page_id", text.clean(F.col("html")).alias("text"))


@query
def year_and_license_names(spark: SparkSession, at: str) -> DataFrame:
    notice = text.license_notice(F.col("text"))
    code = F.lower(F.regexp_extract(notice, r"^CC ([A-Za-z-]+)", 1))
    rows = t(spark, at, "documents").select(text.year_of(F.col("text")).alias("year"), F.when(code != "", text.license_name(code, F.regexp_extract(notice, r"([0-9]\.[0-9])", 1))).otherwise("-").alias("license"))
    return rows.groupBy("year", "license").agg(F.count(F.lit(1)).alias("n"))


@query
def jaccard_sets(spark: SparkSession, at: str) -> DataFrame:
    """Word sets of each document and the one after it by id."""
    docs = t(spark, at, "documents").select("doc_id", F.array_distinct(text.words(F.col("text"))).alias("w"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    both = docs.join(other, "doc_id")
    shared = F.size(F.array_intersect("w", "v"))
    union = F.size("w") + F.size("v") - shared
    return both.select("doc_id", shared.cast("long").alias("shared"), r(F.coalesce(F.try_divide(shared.cast("double"), union), F.lit(0.0))).alias("jaccard"))


@query
def text_ratio(spark: SparkSession, at: str) -> DataFrame:
    turns = t(spark, at, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", r(text.text_ratio(F.col("text"), F.col("next"))).alias("ratio"))


# --- planning and state -------------------------------------------------------------------------------


@query
def job_planning_topn(spark: SparkSession, at: str) -> DataFrame:
    cats = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("PROMO"), F.lit("SMALL"))).otherwise(F.array(F.lit("LARGE")))
    photos = t(spark, at, "supplier").select("s_suppkey", cats.alias("cats"))
    products = t(spark, at, "part").select("p_partkey", F.col("p_type").alias("cat"))
    return relational.plan_jobs(photos, products, "s_suppkey", "p_partkey", 3)


@query
def first_passing_donor(spark: SparkSession, at: str) -> DataFrame:
    """Targets of a brand try donors of their brand in hash order, five at most, until one is large enough."""
    parts = t(spark, at, "part")
    prices = parts.select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"))
    donors = parts.select(F.col("p_partkey").alias("donor"), "p_brand", F.col("p_retailprice").alias("donor_price"))
    tried = relational.top_by_pair_hash(prices, donors, "p_brand", "p_partkey", "donor", 5)
    tried = tried.join(prices.select("p_partkey", "price"), "p_partkey").join(donors.select("donor", "donor_price"), "donor")
    return relational.first_passing(tried, "p_partkey", "donor", F.col("attempt"), F.col("donor_price") > F.col("price"), 5)


@query
def another_of_category(spark: SparkSession, at: str) -> DataFrame:
    """For each part another one of its type and size: the first by hash that is not itself.

    The two least hashes of a group decide for all its members, so no part is paired with its group.
    """
    parts = t(spark, at, "part").select("p_partkey", "p_type", "p_size", hashing.head32(F.col("p_partkey")).alias("h"))
    w = Window.partitionBy("p_type", "p_size").orderBy("h", "p_partkey")
    firsts = parts.withColumn("n", F.row_number().over(w)).where("n <= 2")
    two = firsts.groupBy("p_type", "p_size").agg(F.max(F.when(F.col("n") == 1, F.col("p_partkey"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("p_partkey"))).alias("b"))
    return parts.join(two, ["p_type", "p_size"]).select("p_partkey", F.when(F.col("p_partkey") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))


@query
def circuit_breaker(spark: SparkSession, at: str) -> DataFrame:
    tries = t(spark, at, "events").select("user_id", "ts", "event_id", (F.col("value") > 60).alias("ok"))
    return breaker.circuit_breaker(tries, "user_id", ["ts", "event_id"], "ok", least_failures=10)


@query
def rle_area_and_iou(spark: SparkSession, at: str) -> DataFrame:
    """Line items of an order as run lengths: area is the sum of the odd runs (mask_pairs has the IoU of masks)."""
    runs = t(spark, at, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("a"))
    area = F.aggregate(F.filter(F.transform("a", lambda s, i: F.struct(s["q"].alias("q"), i.alias("i"))), lambda s: s["i"] % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x["q"])
    total = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["q"])
    return runs.select("l_orderkey", area.alias("area"), total.alias("total"), r(area / F.greatest(total, F.lit(1)).cast("double")).alias("share"))


@query
def capped_selection(spark: SparkSession, at: str) -> DataFrame:
    """Orders in hash order take their first line item of a group that is not full; 25 orders a group."""
    lines = t(spark, at, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("grp"), "l_linenumber")
    return relational.capped_selection(lines, "l_orderkey", "grp", "l_linenumber", ["AF", "RF", "NO", "NF"], 25)


@query
def weighted_source_sample(spark: SparkSession, at: str) -> DataFrame:
    docs = t(spark, at, "documents").select("doc_id", "source")
    return relational.weighted_sample(docs, "source", F.col("doc_id"), {"src1": 3.0, "src2": 0.5}, 100)


@query
def mean_of_ten_steps(spark: SparkSession, at: str) -> DataFrame:
    steps = t(spark, at, "events").where("value is not null").select(F.ceil((F.col("event_id") + 1) / 10).cast("long").alias("block"), "value")
    return steps.groupBy("block").agg(r(F.avg("value"), 3).alias("loss"), F.count(F.lit(1)).alias("n"))


@query
def attribute_names(spark: SparkSession, at: str) -> DataFrame:
    """Per supplier the names of its parts' types by brand: a map, here a row for each entry."""
    vocab = t(spark, at, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("supercategory"), F.col("p_type").alias("name"))
    found = relational.attribute_names(t(spark, at, "lineitem").select("l_suppkey", F.col("l_partkey").alias("id")), vocab, "l_suppkey")
    return found.select("l_suppkey", F.explode("attributes").alias("supercategory", "_n")).select("l_suppkey", "supercategory", F.array_join("_n", ",").alias("names"))


@query
def pixel_palettes(spark: SparkSession, at: str) -> DataFrame:
    """Embeddings as 21 pixels of a label's image: main colours of each."""
    values = t(spark, at, "embeddings").select("label", F.slice("embedding", 1, 63).alias("e"))
    px = values.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("e", i * 3 + 1, F.lit(3)))).alias("p"))
    scale = lambda i: F.floor(F.least(F.greatest((F.get("p", F.lit(i)).cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    found = palette.palettes(px.select("label", scale(0).alias("r"), scale(1).alias("g"), scale(2).alias("b")), "label")
    return found.select("label", "primary", F.array_join("secondary", ",").alias("secondary"), F.size("shares").alias("n_colors"))


@query
def score_predicates(spark: SparkSession, at: str) -> DataFrame:
    """Right item and faithful, from a map of scores that lacks what was not measured."""
    q, tax = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")
    pairs = F.array(
        F.struct(F.lit("fg_frac").alias("k"), (q / 50).alias("v")),
        F.struct(F.lit("outer_frac").alias("k"), F.col("l_discount").cast("double").alias("v")),
        F.struct(F.lit("palette_dist").alias("k"), F.when(F.col("l_linenumber") < 4, q / 4).alias("v")),
        F.struct(F.lit("extra_color").alias("k"), F.when(F.col("l_linenumber") != 2, q / 5).alias("v")),
        F.struct(F.lit("target_chroma").alias("k"), (tax * 200).alias("v")),
        F.struct(F.lit("chroma_ratio").alias("k"), (q / 20).alias("v")),
    )
    scores = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
    rows = t(spark, at, "lineitem").select("l_returnflag", scores.alias("s"), (q - 5).alias("margin"), (tax / 5).alias("marker"))
    right, good = records.right_item(F.col("s"), F.col("margin")), records.faithful(F.col("s"), F.col("margin"), F.col("marker"))
    return rows.groupBy("l_returnflag").agg(F.count_if(right).alias("right_item"), F.count_if(good).alias("faithful"), F.count_if(records.passes_all(F.col("s"), ["fg_frac", "palette_dist"], {"fg_frac": 0.5})).alias("passing"))


@query
def fallback_label_join(spark: SparkSession, at: str) -> DataFrame:
    """Orders as paths priority/number; labels of every third by whole path or by number alone, the first on ties."""
    number = F.col("o_orderkey") % 500
    paths = t(spark, at, "orders").select("o_orderkey", F.concat_ws("/", F.col("o_orderpriority"), number.cast("string")).alias("src"))
    labels = t(spark, at, "orders").where("o_orderkey % 3 = 0").groupBy(F.concat_ws("/", F.col("o_orderpriority"), number.cast("string")).alias("key")).agg(F.min("o_orderkey").alias("pos"))
    found = records.join_by_path_or_name(paths, labels.withColumn("v", F.col("pos")), "src", "key", "pos")
    return found.select("o_orderkey", "label_key", "v")


@query
def cross_cycle(spark: SparkSession, at: str) -> DataFrame:
    """Nations crossed with regions, gone round for 500 rows."""
    combos = t(spark, at, "nation").select("n_name").join(F.broadcast(t(spark, at, "region").select("r_name")))
    return records.cycled(combos, ["n_name", "r_name"], 500)


@query
def warmup_timing(spark: SparkSession, at: str) -> DataFrame:
    return records.timing_summary(t(spark, at, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 20)
