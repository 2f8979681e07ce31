"""More registered queries with their DuckDB SQL: checks, joins and reports of the item side, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, color, dims, records, rules, text
from ..operators import joins, masks, pixels, relational, reports
from ..sources import files
from .catalogue import Query, r, t
from .oracles import _LABS1, _LABS2, _REF, _de

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def _in(items) -> str:
    return "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + ")"


def _pick(names, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (index + 1).cast("int"))


def _reasons_sql(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


_EXPLODED = "SELECT {keys}, reason, count(*) AS n FROM (SELECT {keys}, unnest(CASE WHEN len(rs) = 0 THEN ['ok'] ELSE rs END) AS reason FROM x) GROUP BY ALL"


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(F.when(F.size("rs") == 0, F.array(F.lit("ok"))).otherwise(F.col("rs"))).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


_KINDS = ("shirt", "jeans", "dress", "jacket", "coat")
_D = "l_discount", "l_tax", "l_quantity", "l_linenumber"

_GATE_FIRST = [("배경이 단색이 아님", "l_quantity / 5 > 6"), ("옷 크기가 이상함", "NOT (l_discount * 10 BETWEEN 0.06 AND 0.92)"), ("옷이 여러 덩어리", "l_linenumber > 2")]
_GATE_REST = [
    ("펼친 옷 모양이 아님", "l_tax * 10 < CASE WHEN kind IS NULL OR kind IN ('dress', 'jumpsuit') THEN 0.3 WHEN kind = 'jeans' THEN 0.25 ELSE 0.5 END"),
    ("밝기가 크게 달라짐", "l_quantity > 35"), ("대상 옷 색이 결과물에 없음", "l_quantity / 3 > 12"), ("대상에 없던 색이 많음", "l_discount * 200 > 15"),
    ("채도가 크게 달라짐", "l_linenumber * 3 > 8 AND NOT (l_quantity / 20 BETWEEN 0.5 AND 2)"), ("겉옷 색이 섞임", "l_linenumber * 20 >= 50 AND l_quantity / 2 >= 10 AND l_tax * 4 > 0.15"),
]
_KIND_SQL = f"CASE WHEN l_partkey % 6 < 5 THEN {_sql_list(_KINDS)}[l_partkey % 6 + 1] END"


@query(
    f"""WITH src AS (SELECT *, {_KIND_SQL} AS kind FROM lineitem), x AS (SELECT l_returnflag, CASE WHEN l_quantity * 10 < 50
      THEN CASE WHEN len({_reasons_sql(_GATE_FIRST)}) = 0 THEN ['옷을 찾지 못함'] ELSE {_reasons_sql(_GATE_FIRST)} END ELSE {_reasons_sql([*_GATE_FIRST, *_GATE_REST])} END AS rs FROM src)
    {_EXPLODED.format(keys='l_returnflag')}"""
)
def gate_check(spark: SparkSession, at: str) -> DataFrame:
    """Line items as measured results: every reason of the gate."""
    q, d, tax, k = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    s = F.struct(
        (q / 5).alias("border_std"), (d * 10).alias("fg_frac"), k.alias("components"), (q * 10).alias("fg_pixels"), (tax * 10).alias("aspect"), q.alias("lightness_gap"), (k * 3).alias("target_chroma"),
        (q / 20).alias("chroma_ratio"), (q / 3).alias("palette_dist"), (d * 200).alias("extra_color"), (k * 20).alias("outer_pixels"), (q / 2).alias("palette_sep"), (tax * 4).alias("outer_frac"),
    )
    kind = F.when(F.col("l_partkey") % 6 < 5, _pick(_KINDS, F.col("l_partkey") % 6))
    return _exploded(t(spark, at, "lineitem").select("l_returnflag", s.alias("s"), kind.alias("kind")).select("l_returnflag", checks.gate_reasons(F.col("s"), F.col("kind")).alias("rs")), "l_returnflag")


_SWAP = [("안 바뀜", "l_linenumber * 4 >= 8 AND l_quantity / 4 < 6"), ("상품 색이 아님", "l_quantity / 3 > 12"), ("옛 이너가 남음", "l_linenumber * 4 >= 8 AND l_tax * 4 > 0.2"), ("겉옷이 바뀜", "l_discount * 150 > 12")]
_LAYER = [
    ("겉옷이 안 덮음", "l_discount * 10 < 0.3"), ("상의가 다 가려짐", "l_discount * 10 > 0.92"), ("얼굴 쪽이 바뀜", "l_tax > 0.05"), ("은행 겉옷 색이 아님", "l_linenumber * 15 > 50 AND l_quantity / 2 > 15"),
    ("은행 겉옷에 없는 색", "l_linenumber * 15 > 50 AND l_tax * 3 > 0.15"), ("겉옷 없음", "NOT l_linenumber * 15 > 50"), ("사람이 입은 사진 아님", "l_returnflag = 'N'"),
]


@query(
    f"""WITH x AS (SELECT 'swap' AS kind, {_reasons_sql(_SWAP)} AS rs FROM lineitem UNION ALL SELECT 'layer', {_reasons_sql(_LAYER)} FROM lineitem) {_EXPLODED.format(keys='kind')}"""
)
def engine_checks(spark: SparkSession, at: str) -> DataFrame:
    """Swap and layer checks over measured line items."""
    q, d, tax, k = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    lines = t(spark, at, "lineitem").select("l_returnflag", F.struct((q / 4).alias("changed"), (q / 3).alias("palette_dist"), (k * 4).alias("old_vs_prod"), (tax * 4).alias("leak"), (d * 150).alias("ring")).alias("a"),
        F.struct((d * 10).alias("cover"), tax.alias("face"), (k * 15).alias("jacket_pixels"), (q / 2).alias("palette_dist"), (tax * 3).alias("foreign")).alias("b"))
    both = F.array(F.struct(F.lit("swap").alias("kind"), checks.swap_reasons(F.col("a")).alias("rs")), F.struct(F.lit("layer").alias("kind"), checks.layer_reasons(F.col("b"), F.col("l_returnflag") != "N").alias("rs")))
    return _exploded(lines.select(F.explode(both).alias("x")).select("x.*"), "kind")


_PATTERNS = ("plain", "stripe", "floral", "lining", "dot")


@query(
    f"""SELECT l_orderkey, bool_or(l_linenumber = 1 AND {_sql_list(_PATTERNS)}[l_partkey % 5 + 1] IN ('stripe', 'floral', 'dot')) AS hard,
      bool_or(l_returnflag = 'R') AS worn FROM lineitem GROUP BY 1"""
)
def hard_and_worn(spark: SparkSession, at: str) -> DataFrame:
    """Orders as photos: a hard pattern on the first line, and a companion annotation (flag R)."""
    lines = t(spark, at, "lineitem")
    attributes = F.create_map(F.lit("textile pattern"), F.array(_pick(_PATTERNS, F.col("l_partkey") % 5)))
    hard = lines.groupBy(F.col("l_orderkey").alias("file")).agg(F.max(F.coalesce((F.col("l_linenumber") == 1) & checks.is_hard(attributes), F.lit(False))).alias("hard"))
    worn = checks.worn_files(lines.select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("category")), ["R"]).withColumn("worn", F.lit(True))
    return hard.join(worn, "file", "left").select(F.col("file").alias("l_orderkey"), "hard", F.coalesce("worn", F.lit(False)).alias("worn"))


def _splits_sql(name: str, splits) -> str:
    b = f"(('0x' || substr(sha1({name}::VARCHAR), 1, 8))::BIGINT % 100)"
    return "CASE " + " ".join(f"WHEN {b} >= {lo} AND {b} < {hi} THEN '{n}'" for n, (lo, hi) in splits.items()) + " END"


@query(
    f"""WITH one AS (SELECT l_orderkey AS file, count(*) FILTER (l_returnflag = 'A') AS ni, count(*) FILTER (l_returnflag = 'R') AS no,
        max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS area, max(CASE WHEN l_returnflag = 'A' THEN l_quantity * (1 + l_discount * 8) END) AS hull,
        max(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_tax * 12 END) AS inside, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS oa FROM lineitem GROUP BY 1),
      x AS (SELECT *, no = 1 AS layered, area / (area + oa) AS share FROM one WHERE ni = 1 AND no <= 1 AND area > 0)
    SELECT file, CASE WHEN layered THEN 'layered' ELSE 'solo' END AS kind, round(CASE WHEN layered THEN inside / area END, 4) AS inside, round(CASE WHEN layered THEN share END, 4) AS inner_share,
      CASE WHEN NOT layered THEN NULL WHEN share < 0.15 THEN 'lt15' WHEN share < 0.4 THEN '15_40' WHEN share < 0.7 THEN '40_70' ELSE 'ge70' END AS share_bin,
      round(CASE WHEN NOT layered THEN area / 400 END, 4) AS area_frac, round(CASE WHEN NOT layered THEN area / greatest(hull, 1) END, 4) AS solidity,
      CASE WHEN layered THEN {_splits_sql('file', dims.LAYERED_SPLITS)} ELSE {_splits_sql('file', dims.SOLO_SPLITS)} END AS split
    FROM x WHERE CASE WHEN layered THEN inside / area >= 0.5 ELSE area / 400 >= 0.03 AND area / greatest(hull, 1) >= 0.75 END"""
)
def index_images(spark: SparkSession, at: str) -> DataFrame:
    """Orders as images, lines as garments: flag A inner, R outer."""
    q = F.col("l_quantity")
    notes = t(spark, at, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("category"), q.alias("area"), (q * (1 + F.col("l_discount") * 8)).alias("hull_area"), (q * F.col("l_tax") * 12).alias("inside"), F.lit(400).alias("pixels"))
    found = checks.index_images(notes, ["A"], ["R"])
    return found.select("file", "kind", *(r(F.col(c)).alias(c) for c in ("inside", "inner_share")), "share_bin", *(r(F.col(c)).alias(c) for c in ("area_frac", "solidity")), "split")


@query("""SELECT p_brand AS scene, p_partkey AS item, p_size / 50 AS visible FROM part WHERE p_size / 50 >= 0.4""")
def visible_targets(spark: SparkSession, at: str) -> DataFrame:
    """Brands as scenes of placed parts: the targets that are visible enough."""
    items = F.struct(F.col("p_partkey").alias("item"), (F.col("p_size") / 50).alias("visible"), checks.visible_enough(F.col("p_size"), F.lit(50)).alias("target"))
    scenes = t(spark, at, "part").groupBy(F.col("p_brand").alias("scene"), F.floor(F.col("p_partkey") / 100)).agg(F.collect_list(items).alias("items")).select("scene", "items")
    return joins.scene_targets(scenes).select("scene", "item", "visible")


_CLASSES = {"ECONOMY": "상의", "SMALL": "상의", "PROMO": "하의", "MEDIUM": "하의", "LARGE": "아우터"}


@query(
    f"""SELECT coarse, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _CLASSES.items())}) v(ty, coarse) ON p_type = ty GROUP BY 1"""
)
def coarse_classes(spark: SparkSession, at: str) -> DataFrame:
    notes = t(spark, at, "lineitem").select(F.col("l_partkey").alias("category_id"))
    return joins.with_coarse(notes, t(spark, at, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), _CLASSES).groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey, coalesce(p, '') AS priority, coalesce(k, '') AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p, max(o_orderkey)::VARCHAR AS k FROM orders
    WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey"""
)
def info_or_blank(spark: SparkSession, at: str) -> DataFrame:
    """Customers with what their last open order says, blank where there is none."""
    info = t(spark, at, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("last_order"))
    return joins.with_info(t(spark, at, "customer").select("c_custkey"), info, "c_custkey", ["priority", "last_order"], [F.col("last_order")])


@query(
    """WITH v AS (SELECT l_orderkey AS file, max(CASE WHEN l_linenumber = 2 AND l_quantity < 40 THEN (l_returnflag = 'N')::INT END) AS ok FROM lineitem GROUP BY 1)
    SELECT o_orderpriority, count(ok) AS reviewed, round(avg(ok), 4) AS passed FROM orders LEFT JOIN v ON o_orderkey = file GROUP BY 1"""
)
def review_join(spark: SparkSession, at: str) -> DataFrame:
    """Orders with the verdict on their second line; verdicts over 40 are neither 0 nor 1."""
    lines = t(spark, at, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_quantity") >= 40, "?").when(F.col("l_returnflag") == "N", "1").otherwise("0").alias("verdict"), F.lit(2).alias("item"))
    one = lines.groupBy("file", "item").agg(F.max(F.when(F.col("verdict").isin("0", "1"), F.col("verdict"))).alias("verdict"))
    items = t(spark, at, "orders").select(F.col("o_orderkey").alias("file"), "o_orderpriority", F.lit(2).alias("item"))
    per = joins.review_pass(joins.with_review(items, one), "file").join(items.select("file", "o_orderpriority"), "file")
    return per.groupBy("o_orderpriority").agg(F.count("review_pass").alias("reviewed"), r(F.avg("review_pass")).alias("passed"))


@query(
    """WITH first AS (SELECT p_brand, p_type, min(p_partkey) AS item FROM part GROUP BY 1, 2)
    SELECT b.p_brand, ty, item, coalesce(item % 10 / 10, 0.0) AS iou FROM (SELECT DISTINCT p_brand FROM part) b, (VALUES ('ECONOMY'), ('PROMO'), ('NONE')) v(ty) LEFT JOIN first f ON f.p_brand = b.p_brand AND f.p_type = ty
    WHERE b.p_brand NOT LIKE '%1'"""
)
def truth_masks(spark: SparkSession, at: str) -> DataFrame:
    """Brands as photos: truth masks of three kinds, of the brands whose file exists, with the first part of the kind; a missing one scores 0."""
    parts = t(spark, at, "part")
    truth = parts.select(F.col("p_brand").alias("file")).distinct().select("file", F.explode(F.array(*(F.lit(x) for x in ("ECONOMY", "PROMO", "NONE")))).alias("category")).withColumn("path", F.concat("file", F.lit("/"), F.col("category")))
    existing = truth.where(~F.col("file").endswith("1")).select("path")
    items = parts.select(F.col("p_brand").alias("file"), F.col("p_type").alias("category"), F.col("p_partkey").alias("item"))
    out = joins.mask_pairs(truth, items, existing, "item")
    return out.select(F.col("file").alias("p_brand"), F.col("category").alias("ty"), "item", F.coalesce(F.col("item") % 10 / 10, F.lit(0.0)).alias("iou"))


@query(
    """WITH a AS (SELECT user_id AS file, bool_or(value > 100) AS ok FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS file, bool_or(value > 100) AS ok FROM events WHERE event_id % 2 = 1 GROUP BY 1),
      j AS (SELECT coalesce(a.ok, false) AS x, coalesce(b.ok, false) AS y FROM a JOIN b USING (file))
    SELECT count(*) AS n, round(avg(x::INT), 3) AS a_rate, round(avg(y::INT), 3) AS b_rate, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (y AND NOT x) AS b_only FROM j"""
)
def compare_runs(spark: SparkSession, at: str) -> DataFrame:
    """Users' even events against their odd ones: whether any is over 100."""
    events = t(spark, at, "events").select(F.col("user_id").alias("file"), "event_id", (F.col("value") > 100).alias("over"))
    run = lambda odd: events.where(F.col("event_id") % 2 == odd).groupBy("file").agg(F.max("over").alias("ok"))
    return joins.compare_runs(run(0), run(1), "file", F.col("ok")).drop("p")


@query(
    """SELECT o_orderkey, k::INT AS k FROM orders, range(3) v(k) WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber - 1 = k AND l_returnflag = 'N')"""
)
def existing_results(spark: SparkSession, at: str) -> DataFrame:
    """Orders as cases with three results each, of which those with a line of that number are on disk."""
    lines = t(spark, at, "lineitem").where("l_returnflag = 'N'")
    files = lines.select(F.concat(F.lit("run/"), F.col("l_orderkey").cast("string"), F.lit("_k"), (F.col("l_linenumber") - 1).cast("string"), F.lit(".png")).alias("path"))
    return joins.existing_results(t(spark, at, "orders").select("o_orderkey"), files, 3, F.concat(F.lit("run/"), F.col("o_orderkey").cast("string")))


@query(
    """WITH s AS (SELECT user_id AS file, event_id % 3 AS k, max(CASE WHEN event_type = 'view' THEN value END) AS pd, max(CASE WHEN event_type = 'click' THEN value END) AS lg,
        max(CASE WHEN event_type = 'error' THEN value END) AS cr, max(CASE WHEN event_type = 'signup' THEN value END) AS ec, max(CASE WHEN event_type = 'purchase' THEN value END) AS tc FROM events GROUP BY 1, 2),
      jobs AS (SELECT u AS file, k FROM (SELECT DISTINCT user_id AS u FROM events), range(4) v(k))
    SELECT jobs.file, jobs.k, round(CASE WHEN ok THEN pd END, 4) AS palette_dist, round(CASE WHEN ok THEN least(cr, 9.99) END, 4) AS chroma_ratio, CASE WHEN ok THEN coalesce(tc, 99) < 3 END AS neutral
    FROM jobs LEFT JOIN (SELECT *, pd IS NOT NULL AND lg IS NOT NULL AND cr IS NOT NULL AND ec IS NOT NULL AS ok FROM s) s ON jobs.file = s.file AND jobs.k = s.k"""
)
def color_evidence(spark: SparkSession, at: str) -> DataFrame:
    """Users' events as metrics of three results; colour evidence only where all four metrics were measured."""
    events = t(spark, at, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 3).alias("k"), "event_type", "value")
    names = {"view": "palette_dist", "click": "lightness_gap", "error": "chroma_ratio", "signup": "extra_color", "purchase": "target_chroma"}
    means = events.groupBy("file", "k", rules.lookup(F.col("event_type"), names).alias("m")).agg(F.max("value").alias("v")).where("m is not null and v is not null")
    scores = means.groupBy("file", "k").agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("scores"))
    jobs = events.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    out = joins.with_color_evidence(jobs, scores)
    return out.select("file", "k", r(F.col("color.palette_dist")).alias("palette_dist"), r(F.col("color.chroma_ratio")).alias("chroma_ratio"), F.col("color.neutral").alias("neutral"))


@query(
    """WITH ix AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'solo' ELSE 'layered' END AS kind FROM orders),
      x AS (SELECT l_orderkey AS file, l_linenumber, kind, l_quantity / 4 AS pd, base FROM lineitem JOIN ix ON l_orderkey = file LEFT JOIN (SELECT p_partkey, p_size / 4.0 AS base FROM part WHERE p_size % 2 = 0) ON p_partkey = l_partkey WHERE l_returnflag = 'N')
    SELECT kind, count(*) FILTER (pd > 6) AS skipped, count(*) FILTER (pd <= 6) AS kept, count(*) FILTER (pd <= 6 AND coalesce(base <= 6, true)) AS with_inner FROM x GROUP BY 1"""
)
def training_pairs(spark: SparkSession, at: str) -> DataFrame:
    """Approved lines with their index row (the later index holds), those over the palette limit counted and dropped, and whose base is known to be good."""
    orders = t(spark, at, "orders").select(F.col("o_orderkey").alias("file"))
    layered, solo = orders.withColumn("kind", F.lit("layered")), orders.where("file % 3 = 0").withColumn("kind", F.lit("solo"))
    lines = t(spark, at, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_returnflag") == "N").alias("approved"), F.col("l_partkey").cast("string").alias("base"), (F.col("l_quantity") / 4).alias("pd"))
    base = t(spark, at, "part").where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("stem"), (F.col("p_size") / 4).alias("palette"))
    rows = joins.accepted_base(joins.by_index(lines, [layered, solo]), base, F.col("base"), 6.0)
    over = checks.over_limit(F.col("pd"), 6.0)
    return rows.groupBy("kind").agg(F.count_if(over).alias("skipped"), F.count_if(~over).alias("kept"), F.count_if(~over & F.col("base_ok")).alias("with_inner"))


@query("""SELECT r_name AS source, n_name AS query, ((dense_rank() OVER (ORDER BY r_name) - 1) * (SELECT count(*) FROM nation) + row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1)::BIGINT AS at FROM region, nation""")
def source_major(spark: SparkSession, at: str) -> DataFrame:
    return joins.source_major(t(spark, at, "nation").select(F.col("n_name").alias("query")), t(spark, at, "region").select(F.col("r_name").alias("source")), "query", "source")


@query(
    """WITH h AS (SELECT o_orderkey AS scene, p, ['top', 'bottom', 'shoes'][p + 1] AS hint FROM orders, range(3) v(p) WHERE p < o_custkey % 4),
      b AS (SELECT l_orderkey AS scene, l_partkey AS blob, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) - 1 AS p FROM lineitem)
    SELECT scene, p::INT AS position, hint, blob FROM h JOIN b USING (scene, p)"""
)
def hints_to_blobs(spark: SparkSession, at: str) -> DataFrame:
    """Up to three hints of an order with its largest lines."""
    hints = t(spark, at, "orders").select(F.col("o_orderkey").alias("scene"), F.slice(F.array(F.lit("top"), F.lit("bottom"), F.lit("shoes")), F.lit(1), (F.col("o_custkey") % 4).cast("int")).alias("hints"))
    blobs = t(spark, at, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("blob"), F.col("l_quantity").alias("area"))
    return joins.hints_to_blobs(hints, blobs, "scene")


_U = "('0x' || substr(sha1({0}), 1, 8))::BIGINT"


@query(
    f"""WITH pieces AS (SELECT 'tie' AS kind, list(p_partkey ORDER BY p_partkey) AS ps FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT 'scarf', list(p_partkey ORDER BY p_partkey) FROM part WHERE p_brand = 'Brand#2'),
      x AS (SELECT s_suppkey, {_U.format("s_suppkey::VARCHAR || '|kind'")} / 4294967295.0 AS u, {_U.format("s_suppkey::VARCHAR || '|piece'")} AS h, {_U.format("s_suppkey::VARCHAR")} / 4294967295.0 AS z FROM supplier),
      y AS (SELECT *, CASE WHEN u < 0.6 THEN 'tie' WHEN u < 0.6 + 0.25 THEN 'scarf' ELSE 'bag' END AS kind FROM x)
    SELECT s_suppkey, y.kind, ps[h % len(ps) + 1] AS piece, CASE WHEN z < 0.25 THEN 1 WHEN z < 0.25 + 0.35 THEN 2 WHEN z < 0.25 + 0.35 + 0.25 THEN 3 ELSE 4 END AS size FROM y LEFT JOIN pieces USING (kind)"""
)
def accessories(spark: SparkSession, at: str) -> DataFrame:
    """Suppliers with an accessory of their own and the size of a scene; there is no piece of the kind bag."""
    pieces = t(spark, at, "part").where("p_brand in ('Brand#1', 'Brand#2')").select(F.when(F.col("p_brand") == "Brand#1", "tie").otherwise("scarf").alias("kind"), F.col("p_partkey").alias("piece"))
    name = F.col("s_suppkey").cast("string")
    found = joins.with_accessory(t(spark, at, "supplier").select("s_suppkey"), pieces, name, {"tie": 0.6, "scarf": 0.25, "bag": 0.15})
    return found.select("s_suppkey", "kind", "piece", joins.scene_size(name).alias("size"))


# --- reports ------------------------------------------------------------------------------------------

_YIELD = [("discount", "l_discount > 0.08"), ("tax", "l_tax >= 0.07"), ("quantity", "l_quantity < 5")]


@query(
    f"""WITH a AS (SELECT *, {_reasons_sql(_YIELD)} AS rs, CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.05 THEN 'low' ELSE 'high' END AS bin FROM lineitem JOIN part ON l_partkey = p_partkey),
      o AS (SELECT 'all' AS part, '' AS name, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS ok, round(count(*) FILTER (l_returnflag = 'N') / count(*), 3) AS rate FROM a),
      b AS (SELECT 'bin', bin, count(*), count(*) FILTER (l_returnflag = 'N'), round(count(*) FILTER (l_returnflag = 'N') / count(*), 3) FROM a WHERE bin IS NOT NULL GROUP BY 2),
      p AS (SELECT 'product', p_type, count(*), count(*) FILTER (l_returnflag = 'N'), round(count(*) FILTER (l_returnflag = 'N') / count(*), 3) FROM a GROUP BY 2),
      z AS (SELECT 'reason', x, count(*), NULL::BIGINT, NULL::DOUBLE FROM (SELECT unnest(rs) AS x FROM a) GROUP BY 2)
    SELECT * FROM o UNION ALL SELECT * FROM b UNION ALL SELECT * FROM p UNION ALL SELECT * FROM z"""
)
def yield_report(spark: SparkSession, at: str) -> DataFrame:
    """Line items as attempts: the yield of all, by bin (none is left out), by product, and the reasons."""
    tax = F.col("l_tax")
    reasons = rules.all_reasons([("discount", F.col("l_discount") > 0.08), ("tax", tax >= 0.07), ("quantity", F.col("l_quantity") < 5)])
    a = t(spark, at, "lineitem").join(t(spark, at, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_returnflag") == "N").alias("approved"), F.col("l_quantity").alias("seconds"), reasons.alias("reasons"), F.when(tax < 0.02, None).when(tax < 0.05, "low").otherwise("high").alias("bin"), "p_type", "l_orderkey"
    )
    out = reports.yield_overall(a).select(F.lit("all").alias("part"), F.lit("").alias("name"), F.col("attempts").alias("n"), F.col("approved").alias("ok"), F.col("approval_rate").alias("rate"))
    for part, column in (("bin", "bin"), ("product", "p_type")):
        out = out.unionAll(reports.yield_by(a, column).select(F.lit(part), column, "n", "ok", "rate"))
    return out.unionAll(reports.yield_reasons(a, F.col("l_orderkey")).select(F.lit("reason"), "reason", "n", F.lit(None).cast("long"), F.lit(None).cast("double")))


@query(
    """WITH i AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN (l_returnflag = 'N')::INT END) AS single, max((l_returnflag = 'N')::INT) AS oracle,
        max(CASE WHEN l_linenumber = 1 THEN coalesce(CASE WHEN l_quantity < 45 THEN l_quantity END, 99) END) AS pal, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS passed, count(*) FILTER (l_tax > 0.01) AS marked FROM lineitem GROUP BY 1)
    SELECT count(single) AS cases, round(avg(single), 3) AS faithful_single, round(avg(oracle), 3) AS faithful_oracle, round(sum(passed) / sum(n), 3) AS gate_pass, round(sum(marked) / sum(n), 3) AS marker_drawn, round(median(pal), 2) AS median_palette_dist FROM i"""
)
def case_summary(spark: SparkSession, at: str) -> DataFrame:
    """Orders as images, lines as results."""
    q = F.col("l_quantity")
    rows = t(spark, at, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("k"), (F.col("l_returnflag") == "N").alias("faithful"), (F.col("l_linestatus") == "F").alias("passed"), F.col("l_tax").alias("marker_frac"), F.when(q < 45, q).alias("palette_dist"))
    return reports.case_summary(rows, "l_orderkey")


@query(
    """WITH f AS (SELECT ['scene', 'segment', 'refine', 'mesh'][l_linenumber] AS stage, l_quantity AS s FROM lineitem WHERE l_linenumber <= 4 AND l_discount > 0.01), m AS (SELECT stage, round(avg(s), 3) AS seconds FROM f GROUP BY 1)
    SELECT * FROM m UNION ALL SELECT 'stage1_4_total', round(sum(seconds), 3) FROM m WHERE stage <> 'mesh'"""
)
def stage_means(spark: SparkSession, at: str) -> DataFrame:
    """Lines as timings of stages; the total is of rounded means, without the last stage."""
    names = ("scene", "segment", "refine", "mesh")
    rows = t(spark, at, "lineitem").where("l_linenumber <= 4").select(F.map_from_arrays(F.array(_pick(names, F.col("l_linenumber") - 1)), F.array(F.when(F.col("l_discount") > 0.01, F.col("l_quantity")))).alias("timings"))
    return reports.stage_means(rows, names, names[:3]).withColumn("seconds", r(F.col("seconds"), 3))


@query("""SELECT count(*) AS images, count(*) FILTER (o_orderstatus <> 'P') AS ok, coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 END), 0)::BIGINT AS items_total FROM orders""")
def run_summary(spark: SparkSession, at: str) -> DataFrame:
    rows = t(spark, at, "orders").select(F.when(F.col("o_orderstatus") == "P", "failed").alias("error"), (F.col("o_custkey") % 5).alias("items"))
    return reports.run_summary(rows)


_TRIED = (-2.0, -1.0, 0.0, 1.0, 2.0)


@query(
    f"""WITH x AS (SELECT least(l_quantity / 10 - 2.5, l_discount * 50 - 2.5, CASE WHEN l_tax > 0 THEN l_tax * 60 - 2.5 END) AS least, l_tax > 0 AS there, l_returnflag = 'N' AS truth FROM lineitem),
      y AS (SELECT t::DOUBLE AS threshold, coalesce(there AND least > t, false) AS over, truth FROM x, (VALUES {', '.join(f'({v})' for v in _TRIED)}) v(t))
    SELECT threshold, count(*) FILTER (over) AS passed, round(count(*) FILTER (over AND truth) / greatest(count(*) FILTER (over), 1), 3) AS precision, round(count(*) FILTER (over AND truth) / greatest(count(*) FILTER (truth), 1), 3) AS recall FROM y GROUP BY 1"""
)
def question_sweep(spark: SparkSession, at: str) -> DataFrame:
    """Three questions a line, one not always answered; all must be over the threshold."""
    return reports.question_sweep(_questions(spark, at), ("type", "color", "added"), _TRIED)


def _questions(spark: SparkSession, at: str) -> DataFrame:
    tax = F.col("l_tax")
    pairs = F.array(F.struct(F.lit("type").alias("k"), (F.col("l_quantity") / 10 - 2.5).alias("v")), F.struct(F.lit("color").alias("k"), (F.col("l_discount") * 50 - 2.5).alias("v")), F.struct(F.lit("added").alias("k"), F.when(tax > 0, tax * 60 - 2.5).alias("v")))
    return t(spark, at, "lineitem").select(F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("scores"), (F.col("l_returnflag") == "N").alias("truth"))


@query(
    """WITH x AS (SELECT 'type' AS question, l_quantity / 10 - 2.5 AS s, l_returnflag = 'N' AS truth FROM lineitem UNION ALL SELECT 'color', l_discount * 50 - 2.5, l_returnflag = 'N' FROM lineitem
      UNION ALL SELECT 'added', CASE WHEN l_tax > 0 THEN l_tax * 60 - 2.5 END, l_returnflag = 'N' FROM lineitem)
    SELECT question, round(median(s) FILTER (truth), 2) AS good_median, round(median(s) FILTER (NOT truth), 2) AS bad_median FROM x GROUP BY 1"""
)
def question_medians(spark: SparkSession, at: str) -> DataFrame:
    out = reports.question_medians(_questions(spark, at), ("type", "color", "added"))
    return out.select("question", r(F.col("good_median"), 2).alias("good_median"), r(F.col("bad_median"), 2).alias("bad_median"))


_CAND = ("pos", "other", "outer", "hue")
_CAND_SQL = f"c AS (SELECT {_sql_list(_CAND)}[l_partkey % 4 + 1] AS kind, CASE WHEN l_tax < 0.02 THEN '?' WHEN l_tax < 0.05 THEN 'low' ELSE 'high' END AS bin, l_discount * 100 + l_linenumber AS score, l_returnflag <> 'R' AS passed FROM lineitem)"


def _candidates(spark: SparkSession, at: str) -> DataFrame:
    tax = F.col("l_tax")
    return t(spark, at, "lineitem").select(_pick(_CAND, F.col("l_partkey") % 4).alias("kind"), F.when(tax < 0.02, None).when(tax < 0.05, "low").otherwise("high").alias("share_bin"), (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("score"), (F.col("l_returnflag") != "R").alias("passed"))


@query(f"""WITH {_CAND_SQL} SELECT kind, count(*) AS n, round(avg(passed::INT), 3) AS pass_rate, CASE WHEN kind <> 'pos' THEN round(1 - avg(passed::INT), 3) END AS reject_rate FROM c GROUP BY 1""")
def candidate_rates(spark: SparkSession, at: str) -> DataFrame:
    return reports.candidate_rates(_candidates(spark, at), _CAND[1:])


@query(
    f"""WITH {_CAND_SQL}, d AS (SELECT kind, bin, score FROM c UNION ALL SELECT kind, 'all', score FROM c), g AS (SELECT kind, bin, score, count(*) AS w FROM d GROUP BY ALL)
    SELECT n.bin, n.kind, round(sum(p.w * n.w * CASE WHEN p.score < n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / sum(p.w * n.w), 3) AS auroc FROM g p JOIN g n USING (bin) WHERE p.kind = 'pos' AND n.kind <> 'pos' GROUP BY 1, 2"""
)
def candidate_auroc(spark: SparkSession, at: str) -> DataFrame:
    return reports.candidate_auroc(_candidates(spark, at), _CAND[1:])


@query(
    f"""WITH {_CAND_SQL}, h AS (SELECT kind, score / 20 AS prob FROM c)
    SELECT kind, count(*) AS n, round(avg(CASE WHEN kind = 'pos' THEN (prob >= 0.5)::INT END), 3) AS pos_pass, round(avg(CASE WHEN kind <> 'pos' THEN (prob < 0.5)::INT END), 3) AS neg_reject FROM h GROUP BY 1"""
)
def verifier_report(spark: SparkSession, at: str) -> DataFrame:
    """Scores as probabilities: how many positives pass, and how many of each negative kind are rejected."""
    rows = _candidates(spark, at).select("kind", (F.col("score") / 20).alias("prob"))
    report, rejects = reports.verifier_report(rows)
    n = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.join(rejects, "kind", "left").crossJoin(report.select("pos_pass")).select("kind", "n", F.when(F.col("kind") == "pos", F.col("pos_pass")).alias("pos_pass"), "neg_reject")


@query(
    """SELECT l_orderkey, round(coalesce(median(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 'NaN'::DOUBLE), 3) AS difference FROM lineitem GROUP BY 1"""
)
def region_median(spark: SparkSession, at: str) -> DataFrame:
    """The median of an order's lines with flag N; NaN without any."""
    found = reports.region_median(t(spark, at, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_returnflag") == "N")
    return found.select("l_orderkey", F.round("difference", 3).alias("difference"))


@query(
    """WITH x AS (SELECT o_custkey AS house, o_orderkey AS item, CASE o_orderkey % 3 WHEN 0 THEN '드라이클리닝' WHEN 1 THEN '손세탁' ELSE '일반세탁' END AS method, CASE WHEN o_orderkey % 3 <> 0 THEN ['흰색', '밝은색'][o_orderkey % 2 + 1] END AS color, (o_orderkey % 4 * 10)::INT AS temp FROM orders),
      b AS (SELECT house, method, color, min(temp) AS max_temp, count(*) AS n, min(item) AS first, string_agg(item::VARCHAR, '-' ORDER BY item) AS items FROM x GROUP BY 1, 2, 3)
    SELECT method, color, max_temp, n, items, row_number() OVER (ORDER BY method = '드라이클리닝', n DESC, first) AS at FROM b WHERE house = 1"""
)
def bundle_order(spark: SparkSession, at: str) -> DataFrame:
    """The laundry of one household (the orders of customer 1) in bundles, dry ones last, large ones first."""
    from pyspark.sql.window import Window

    k = F.col("o_orderkey")
    method = F.when(k % 3 == 0, "드라이클리닝").when(k % 3 == 1, "손세탁").otherwise("일반세탁")
    items = t(spark, at, "orders").where("o_custkey = 1").select(k, method.alias("method"), _pick(("흰색", "밝은색"), k % 2).alias("color"), (k % 4 * 10).cast("int").alias("max_temp"))
    found = reports.laundry_bundles(items, "o_orderkey", k, dims.DRY_ONLY)
    at_of = F.row_number().over(Window.orderBy(F.col("method") == dims.DRY_ONLY, F.desc("n"), F.get("items", F.lit(0))))
    return found.withColumn("at", at_of).select("method", "color", "max_temp", "n", F.array_join(F.col("items").cast("array<string>"), "-").alias("items"), "at")


# --- scalar columns -----------------------------------------------------------------------------------

_RIGHTS = ("http://creativecommons.org/publicdomain/mark/1.0/", "http://creativecommons.org/licenses/by-nc/4.0/", "http://creativecommons.org/licenses/by-sa/3.0/", "http://rightsstatements.org/vocab/InC/1.0/", "other")
_UNITS = ("NMNHBOTANY", "nasm", "SAAM", "CHNDM", "serc2")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(regexp_matches(u, '{dims.OPEN_RIGHTS}') AND NOT regexp_matches(u, '{dims.BLOCKED_RIGHTS}'), false) AS rights,
      regexp_matches(upper(unit), '^(NMNH|NASM|NPM|NZP|SERC|STRI)') AS excluded, coalesce(w > 0 AND h > 0 AND least(w, h) < 20, false) AS small,
      CASE WHEN kind IS NULL OR kind = 'dress' THEN 0.3::DOUBLE WHEN kind = 'jeans' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS aspect,
      exp(l_tax * 100 - greatest(l_tax * 100, l_discount * 100)) / (exp(l_tax * 100 - greatest(l_tax * 100, l_discount * 100)) + exp(l_discount * 100 - greatest(l_tax * 100, l_discount * 100))) > 0.5 AS yes,
      coalesce(CASE WHEN l_linenumber > 1 THEN l_quantity END, 99) + 0.5 * coalesce(CASE WHEN l_linenumber > 2 THEN l_tax * 100 END, 99) + 40 * coalesce(CASE WHEN l_linenumber > 3 THEN l_discount END, 0) + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1000 END AS gate
    FROM (SELECT *, CASE WHEN l_partkey % 6 < 5 THEN {_sql_list(_RIGHTS)}[l_partkey % 6 + 1] END AS u, {_sql_list(_UNITS)}[l_suppkey % 5 + 1] AS unit, CASE WHEN l_linenumber <> 3 THEN l_quantity::INT END AS w, (l_quantity * 2)::INT AS h, {_KIND_SQL} AS kind FROM lineitem)"""
)
def small_predicates(spark: SparkSession, at: str) -> DataFrame:
    """Rights, units, short sides, least aspects, two-way softmax and gate scores of every line."""
    k, q, n = F.col("l_partkey"), F.col("l_quantity"), F.col("l_linenumber")
    url, unit = F.when(k % 6 < 5, _pick(_RIGHTS, k % 6)), _pick(_UNITS, F.col("l_suppkey") % 5)
    kind = F.when(k % 6 < 5, _pick(_KINDS, k % 6))
    gate = rules.gate_score(F.col("l_returnflag") == "N", {"palette": F.when(n > 1, q), "extra": F.when(n > 2, F.col("l_tax") * 100), "outer_frac": F.when(n > 3, F.col("l_discount"))})
    return t(spark, at, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.rights_ok(url).alias("rights"), records.excluded_unit(unit).alias("excluded"), records.too_small(F.when(n != 3, q.cast("int")), (q * 2).cast("int"), 20).alias("small"),
        checks.least_aspect(kind).alias("aspect"), (records.two_way_softmax(F.col("l_discount") * 100, F.col("l_tax") * 100) > 0.5).alias("yes"), gate.alias("gate"),
    )


@query(
    """SELECT p_partkey, printf('#%02X%02X%02X', p_size::INT, (p_size * 5 % 256)::INT, round_even(p_size / 2.0, 0)::INT) AS hex, regexp_replace(p_name, ' .*', '') AS out,
      CASE WHEN p_size % 3 = 0 THEN upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) WHEN p_size % 3 = 1 THEN ' ' || split_part(p_name, ' ', 1) || ' ' END AS label,
      CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'photo.' || p_partkey END AS stem, '[EXTRACT] ' || p_name || '; layer=single' AS prompt FROM part"""
)
def small_names(spark: SparkSession, at: str) -> DataFrame:
    """Hex colours, labels, stems and prompts of parts."""
    k, size, first = F.col("p_partkey"), F.col("p_size"), F.split("p_name", " ")[0]
    label = F.when(size % 3 == 0, F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 30))).when(size % 3 == 1, F.concat(F.lit(" "), first, F.lit(" ")))
    stem = records.out_stem(F.when(size % 2 == 0, F.col("p_brand")).otherwise(""), F.concat(F.lit("a/b/photo."), k.cast("string"), F.lit(".jpg")))
    return t(spark, at, "part").select(k, color.to_hex(size, size * 5 % 256, size / 2).alias("hex"), first.alias("out"), label.alias("label"), stem.alias("stem"), checks.extract_prompt(F.col("p_name"), F.lit("single")).alias("prompt"))


@query(
    """SELECT p_partkey, c.cat, coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN p_size % 5 = 1 THEN 7.5 END, 0), CASE sub WHEN '티셔츠' THEN 1 WHEN '니트' THEN 4 WHEN '코트' THEN 30 END, CASE c.cat WHEN '상의' THEN 2 WHEN '신발' THEN 20 ELSE 3 END)::DOUBLE AS wears,
      p_size % 4 < 2 AS available, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_size * 10 END IS NULL OR p_size * 10 >= 180 AS idle
    FROM part, LATERAL (SELECT ['티셔츠', '니트', '코트', 'x'][p_partkey % 4 + 1] AS sub, ['상의', '신발', '모자'][p_size % 3 + 1] AS cat) c"""
)
def care_columns(spark: SparkSession, at: str) -> DataFrame:
    """Wash intervals (a learned 0 is none), availability by state, and what lies idle."""
    k, size = F.col("p_partkey"), F.col("p_size")
    sub, cat = _pick(("티셔츠", "니트", "코트", "x"), k % 4), _pick(("상의", "신발", "모자"), size % 3)
    learned = F.when(size % 5 == 0, 0.0).when(size % 5 == 1, 7.5)
    state = _pick((dims.CLEAN, dims.WORN, dims.NEEDS_WASH, dims.WASHING), size % 4)
    today = F.lit("2024-06-30").cast("date")
    last = F.when(size % 4 != 3, F.date_sub(today, (size * 10).cast("int")))
    return t(spark, at, "part").select(k, cat.alias("cat"), rules.interval(learned, cat, sub).alias("wears"), checks.available(state).alias("available"), checks.unworn(last, today, 180).alias("idle"))



@query(
    """WITH x AS (SELECT p_partkey, p_size AS s, 160.0 + p_size % 30 AS height FROM part),
      y AS (SELECT *, 0.815 * height - (40 + s) AS hem, 0.61 * height AS waist, 0.50 * height AS hip, 0.46 * height AS crotch, 0.28 * height AS knee, (45 + s % 10) * 2 - 92.0 AS ease, 40.0 + s % 12 - 44 AS diff FROM x)
    SELECT p_partkey, CASE WHEN diff < -2 THEN '작음' WHEN diff <= 2 THEN '정핏' ELSE '드롭숄더' END AS shoulder,
      CASE WHEN ease < 3 THEN '타이트' WHEN ease < 8 THEN '슬림' WHEN ease < 14 THEN '레귤러' WHEN ease < 22 THEN '세미오버' ELSE '오버' END AS chest,
      CASE WHEN hem >= waist + 4 THEN '크롭' WHEN hem >= waist - 4 THEN '허리선' WHEN hem >= hip + 3 THEN '골반' WHEN hem >= hip - 3 THEN '엉덩이 중간' WHEN hem >= crotch - 12 THEN '엉덩이를 덮음' WHEN hem >= knee + 5 THEN '허벅지' WHEN hem >= knee - 5 THEN '무릎' ELSE '무릎 아래' END AS hem,
      0 AS n_warnings FROM y"""
)
def fit_reports(spark: SparkSession, at: str) -> DataFrame:
    """Fit reports of parts as tops, on bodies of their own height, a little stretch, no arm length known."""
    s = F.col("p_size")
    garment = F.struct((F.lit(40.0) + s % 12).alias("shoulder"), (F.lit(45.0) + s % 10).alias("chest"), (F.lit(40.0) + s).alias("length"), F.lit(60.0).alias("sleeve"))
    body = F.struct((F.lit(160.0) + s % 30).alias("height"), F.lit(44.0).alias("shoulder_width"), F.lit(92.0).alias("chest"), F.lit(None).cast("double").alias("arm_length"), F.create_map().cast("map<string,double>").alias("landmarks"))
    rows = t(spark, at, "part").select("p_partkey", garment.alias("g"), body.alias("b")).select("p_partkey", rules.fit_report(F.lit("상의"), F.col("g"), F.col("b"), F.lit("약간")).alias("f"))
    label = lambda zone: rules.label_of(F.col("f"), zone)
    return rows.select("p_partkey", label("어깨").alias("shoulder"), label("가슴").alias("chest"), label("기장").alias("hem"), F.size("f.warnings").alias("n_warnings"))


_SPEC = {"k": {"type": "integer", "minimum": 1, "maximum": 50}, "kind": {"type": "string", "enum": ["view", "click"]}, "tags": {"type": "array", "enum": ["a", "b"], "minItems": 1, "maxItems": 2}}


@query(
    """WITH x AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
      y AS (SELECT list_filter([CASE WHEN event_id % 5 = 1 THEN 'kind: missing' END, CASE WHEN NOT k BETWEEN 1 AND 50 THEN 'k: range' END, CASE WHEN event_id % 5 = 2 THEN 'kind: no string' WHEN event_id % 5 <> 1 AND event_type NOT IN ('view', 'click') THEN 'kind: value' END,
        CASE WHEN event_id % 7 = 1 THEN 'tags: no array' END, CASE WHEN event_id % 7 IN (2, 3) THEN 'tags: size' END, CASE WHEN event_id % 7 = 4 THEN 'tags: members' END, CASE WHEN event_id % 3 = 0 THEN 'more: unknown' END], lambda z: z IS NOT NULL) AS rs FROM x)
    SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(rs) = 0 THEN ['ok'] ELSE rs END) AS reason FROM y) GROUP BY 1"""
)
def json_violations(spark: SparkSession, at: str) -> DataFrame:
    """Events as JSON records of three keys, with missing, unknown, mistyped and bad ones among them: every violation."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    kind = F.when(i % 5 == 1, "").when(i % 5 == 2, ', "kind": 5').otherwise(F.concat(F.lit(', "kind": "'), "event_type", F.lit('"')))
    tags = F.when(i % 7 == 1, '"a"').when(i % 7 == 2, "[]").when(i % 7 == 3, '["a", "b", "a"]').when(i % 7 == 4, '["a", "z"]').otherwise('["b"]')
    doc = F.concat(F.lit('{"k": '), k, kind, F.lit(', "tags": '), tags, F.when(i % 3 == 0, ', "more": 1').otherwise(""), F.lit("}"))
    return _exploded(t(spark, at, "events").select(checks.json_violations(doc, _SPEC).alias("rs")))


@query(
    """WITH p AS (SELECT vec_id, unnest([1, 2, 3, 4]) AS i, embedding FROM embeddings), x AS (SELECT vec_id, i, embedding[3 * i - 2]::DOUBLE * 50 AS a, embedding[3 * i - 1]::DOUBLE * 50 AS b FROM p)
    SELECT vec_id, round(min(sqrt(pow(a - 10, 2) + pow(b - 10, 2))), 3) AS nearest, round(max(least(sqrt(pow(a - 10, 2) + pow(b - 10, 2)), sqrt(pow(a + 20, 2) + pow(b, 2)))), 3) AS farthest FROM x GROUP BY 1"""
)
def palette_nearest(spark: SparkSession, at: str) -> DataFrame:
    """Four pixels of a vector (chroma plane) against two centres: the least distance to the first, and the largest of the least."""
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(*((F.get("embedding", 3 * i + j).cast("double") * 50).alias(n) for j, n in enumerate("ab"))))
    gap = lambda p, a, b: F.sqrt(F.pow(p["a"] - a, F.lit(2.0)) + F.pow(p["b"] - b, F.lit(2.0)))
    near = F.transform(points, lambda p: color.nearest_center(p, [(10.0, 10.0), (-20.0, 0.0)], gap))
    return t(spark, at, "embeddings").select("vec_id", r(F.array_min(F.transform(points, lambda p: gap(p, 10.0, 10.0))), 3).alias("nearest"), r(F.array_max(near), 3).alias("farthest"))


# --- images as pixel tables ---------------------------------------------------------------------------

_PIXELS = """px AS (SELECT event_id // 400 AS image, (event_id % 400 // 20)::INT AS y, (event_id % 20)::INT AS x, ((event_id * 37 + floor(coalesce(value, 0))) % 256)::INT AS r,
  (floor(coalesce(value, 0) * 3) % 256)::INT AS g, (user_id * 11 % 256)::INT AS b, user_id % 3 = 0 AS m FROM events)"""


def _pixels(spark: SparkSession, at: str) -> DataFrame:
    """Events as pixels of images of 20 x 20, with a mask."""
    i, v = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    return t(spark, at, "events").select(
        F.floor(i / 400).alias("image"), F.floor(i % 400 / 20).cast("int").alias("y"), (i % 20).cast("int").alias("x"), ((i * 37 + F.floor(v)) % 256).cast("int").alias("r"),
        (F.floor(v * 3) % 256).cast("int").alias("g"), (F.col("user_id") * 11 % 256).cast("int").alias("b"), (F.col("user_id") % 3 == 0).alias("m"),
    )


@query(
    f"""WITH {_PIXELS}, s AS (SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px GROUP BY 1), e AS (SELECT px.*, y = y0 OR y = y1 OR x = x0 OR x = x1 AS edge FROM px JOIN s USING (image)),
      bg AS (SELECT image, median(r) AS br, median(g) AS bgr, median(b) AS bb FROM e WHERE edge GROUP BY 1)
    SELECT image, count(*) FILTER (sqrt(pow(r - br, 2) + pow(g - bgr, 2) + pow(b - bb, 2)) > 40) AS fg FROM px JOIN bg USING (image) GROUP BY 1"""
)
def border_foreground(spark: SparkSession, at: str) -> DataFrame:
    return pixels.border_foreground(_pixels(spark, at)).groupBy("image").agg(F.count_if("fg").alias("fg"))


@query(
    f"""WITH {_PIXELS}, s AS (SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px GROUP BY 1), e AS (SELECT px.*, y < y0 + 8 OR y > y1 - 8 OR x < x0 + 8 OR x > x1 - 8 AS edge,
        0.299 * r + 0.587 * g + 0.114 * b AS lum, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b AS cb, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b AS cr FROM px JOIN s USING (image)),
      f AS (SELECT image, (stddev_pop(r) FILTER (edge) + stddev_pop(g) FILTER (edge) + stddev_pop(b) FILTER (edge)) / 3 AS sd, avg((lum > 60 AND cb > 77 AND cb < 127 AND cr > 133 AND cr < 173)::INT) AS skin FROM e GROUP BY 1)
    SELECT image, round(sd, 2) AS bg_std, round(skin, 4) AS skin, CASE WHEN skin >= 0.02 THEN 'case2' WHEN sd <= 70 THEN 'case1' ELSE 'case3' END AS case_name FROM f"""
)
def scene_cases(spark: SparkSession, at: str) -> DataFrame:
    found = pixels.scene_cases(_pixels(spark, at), 0.02, 70.0)
    return found.select("image", r(F.col("bg_std"), 2).alias("bg_std"), r(F.col("skin")).alias("skin"), F.col("case").alias("case_name"))


@query(
    f"""WITH {_PIXELS}, n AS (SELECT a.image, a.y, a.x, a.m, bool_and(coalesce(b.m, false)) FILTER (b.image IS NOT NULL) AND count(b.image) = 4 AS inside FROM px a
        LEFT JOIN px b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3, 4),
      d AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM px, range(-2, 3) u(dy), range(-2, 3) v(dx) WHERE m)
    SELECT image, count(*) FILTER (m) AS area, count(*) FILTER (m AND NOT inside) AS outline, (SELECT count(*) FROM d WHERE d.image = n.image) AS dilated FROM n GROUP BY 1"""
)
def mask_shapes(spark: SparkSession, at: str) -> DataFrame:
    """Area, outline and dilation of each image's mask."""
    px = _pixels(spark, at)
    shape = pixels.with_outline(px, "m").groupBy("image").agg(F.count_if("m").alias("area"), F.count_if("outline").alias("outline"))
    return shape.join(pixels.dilated(px.where("m"), 2).groupBy("image").agg(F.count(F.lit(1)).alias("dilated")), "image", "left")


@query(
    f"""WITH {_PIXELS}, w AS (SELECT image, y, count(*) FILTER (m AND x < 10) AS v, count(*) FILTER (m) AS t FROM px WHERE y > 3 GROUP BY 1, 2), s AS (SELECT image, min(y) AS a, max(y) AS b FROM w WHERE v > 0 GROUP BY 1),
      sh AS (SELECT image, CASE WHEN sum(v) = 0 THEN 0.0 ELSE sum(v) / greatest(coalesce(sum(t) FILTER (y BETWEEN a AND b), 0), 1) END AS share FROM w LEFT JOIN s USING (image) GROUP BY 1),
      tk AS (SELECT image, y // 4 AS ty, x // 4 AS tx, avg(m::INT) >= 0.5 AS inside FROM px WHERE y // 4 < (SELECT max(y) + 1 FROM px q WHERE q.image = px.image) // 4 GROUP BY 1, 2, 3)
    SELECT image, round(share, 4)::DOUBLE AS share, (SELECT count(*) FILTER (inside) FROM tk WHERE tk.image = sh.image) AS tokens FROM sh"""
)
def visible_shares(spark: SparkSession, at: str) -> DataFrame:
    """How much of the mask's left half shows within its rows, and the tokens of 4 x 4 that the mask fills by half."""
    px = _pixels(spark, at)
    share = pixels.visible_share(px.where("y > 3"), F.col("m") & (F.col("x") < 10), F.col("m"))
    full = pixels.tokens(px, F.col("m"), 0.5, 4).groupBy("image").agg(F.count_if("inside").alias("tokens"))
    return share.join(full, "image", "left").select("image", r(F.col("share")).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query(
    """WITH p AS (SELECT l_orderkey % 50 AS scene, l_partkey AS item, l_orderkey AS ord, (l_suppkey % 7 + dy)::INT AS y, (l_linenumber % 7 + dx)::INT AS x FROM lineitem, range(3) u(dy), range(3) v(dx)),
      q AS (SELECT scene, item, y, x, max(ord) AS ord FROM p GROUP BY 1, 2, 3, 4), w AS (SELECT *, row_number() OVER (PARTITION BY scene, y, x ORDER BY ord DESC, item DESC) = 1 AS top FROM q)
    SELECT scene, item, count(*) AS full_px, count(*) FILTER (top) AS visible_px FROM w GROUP BY 1, 2"""
)
def stacked_items(spark: SparkSession, at: str) -> DataFrame:
    """Lines as squares laid on each other: how much of each item lies free."""
    lines = t(spark, at, "lineitem").select((F.col("l_orderkey") % 50).alias("scene"), F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("ord"), (F.col("l_suppkey") % 7).cast("int").alias("y0"), (F.col("l_linenumber") % 7).alias("x0"))
    three = F.array(*(F.lit(k) for k in range(3)))
    dealt = lines.repartition("scene", "item")  # a line is nine cells: it is dealt out before
    cells = dealt.select("*", F.explode(three).alias("dy")).select("*", F.explode(three).alias("dx")).select("scene", "item", "ord", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))
    found = pixels.stacked(cells)
    return found.select("scene", "item", F.col("full").alias("full_px"), F.col("visible").alias("visible_px"))


# --- more of the library, each held by its SQL --------------------------------------------------------


@query(
    """WITH x AS (SELECT s_suppkey, s_suppkey % 20 + 1 AS a, s_suppkey % 30 + 1 AS b, s_suppkey % 15 AS c, s_suppkey % 25 + 2 AS d FROM supplier),
      y AS (SELECT *, greatest(0, least(a + b, c + d) - greatest(a, c)) AS both_px FROM x)
    SELECT s_suppkey, b::BIGINT AS area, round(both_px / (b + d - both_px), 4) AS iou, round(both_px / b, 4) AS inside FROM y"""
)
def mask_pairs(spark: SparkSession, at: str) -> DataFrame:
    """Two masks of 8 x 8 a supplier, as run lengths: area, IoU and containment."""
    k = F.col("s_suppkey")
    runs = lambda start, n: F.array(start, n, F.lit(64) - start - n).cast("array<int>")
    rows = t(spark, at, "supplier").select(k, runs(k % 20 + 1, k % 30 + 1).alias("a"), runs(k % 15, k % 25 + 2).alias("b"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    found = masks.pairwise(masks.pairwise(rows, "a", "b", "h", "w", "iou", masks.iou), "a", "b", "h", "w", "inside", masks.containment)
    return found.select(k, masks.area(F.col("a")).alias("area"), r(F.col("iou")).alias("iou"), r(F.col("inside")).alias("inside"))


@query(
    f"""WITH p AS ({_LABS1}), q AS ({_LABS2}), c AS ({_REF}), x AS (SELECT vec_id, 0 AS i, l, a, b FROM p UNION ALL SELECT vec_id, 1, l, a, b FROM q),
      d AS ({_de("SELECT vec_id, i, x.l AS l1, x.a AS a1, x.b AS b1, c.l AS l2, c.a AS a2, c.b AS b2 FROM x, c WHERE name IN ('레드', '블루')", 'vec_id, i', 2.0)})
    SELECT vec_id, round(sum(CASE i WHEN 0 THEN 0.75 ELSE 0.25 END * de), 3) AS distance FROM (SELECT vec_id, i, min(de) AS de FROM d GROUP BY 1, 2) GROUP BY 1"""
)
def palette_distances(spark: SparkSession, at: str) -> DataFrame:
    """Palettes of two colours against red and blue."""
    from .catalogue import _labs

    weigh = lambda c, w: F.struct(*(c[n].alias(n) for n in "lab"), F.lit(w).alias("w"))
    fixed = F.array(*(weigh(color.lab_of(dims.COLORS[n]), 1.0) for n in ("레드", "블루")))
    return _labs(spark, at).select("vec_id", r(color.palette_distance(F.array(weigh(F.col("lab"), 0.75), weigh(F.col("lab2"), 0.25)), fixed), 3).alias("distance"))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, p_type, l_quantity, l_linenumber % 3 = 0 AS blank FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT 'category' AS field, round(avg((p_type IN ('PROMO', 'SMALL'))::INT) FILTER (NOT blank), 3) AS accuracy, count(*) FILTER (NOT blank) AS n FROM (SELECT *, p_type FROM x)
    UNION ALL SELECT 'season', round(avg(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 1 / 3 END), 3), count(*) FROM x
    UNION ALL SELECT 'formality', round(avg((abs(l_linenumber - 3) <= 1)::INT), 3), count(*) FROM x"""
)
def tag_scores(spark: SparkSession, at: str) -> DataFrame:
    """Predicted records against sheets of people: exact fields, seasons by Jaccard, formality within one; blank fields don't count."""
    lines = t(spark, at, "lineitem").join(t(spark, at, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, hit = F.col("l_linenumber"), F.col("p_type").isin("PROMO", "SMALL")
    pred = F.struct(F.col("p_type").alias("category"), F.when(n % 2 == 0, F.array(F.lit("봄"))).otherwise(F.array(F.lit("봄"), F.lit("겨울"))).alias("season"), n.alias("formality"))
    label = F.struct(F.when(n % 3 == 0, " ").when(hit, F.concat(F.lit(" "), F.col("p_type"))).otherwise("x").alias("category"), F.lit("봄; 여름").alias("season"), F.lit("3").alias("formality"))
    scores = F.array(*(F.struct(F.lit(f).alias("field"), s.alias("s")) for f, s in records.field_scores(["category"])))
    rows = lines.select(pred.alias("pred"), label.alias("label")).select(F.explode(scores).alias("x")).where("x.s is not null")
    return rows.groupBy(F.col("x.field").alias("field")).agg(r(F.avg("x.s"), 3).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k,
      CASE event_id % 3 WHEN 0 THEN 'outer' WHEN 1 THEN 'inner' END AS kind, CASE WHEN event_id % 5 < 2 THEN 'f' || event_id || '-m' || event_id ELSE 'm' || event_id END AS media, 'a/' || event_id || '.jpg' AS rel FROM events"""
)
def parsed_records(spark: SparkSession, at: str) -> DataFrame:
    """Fenced JSON (some of it broken), category names in any case, the first media that may be used, relative paths."""
    i = F.col("event_id")
    name = i.cast("string")
    fenced = F.when(i % 4 == 0, F.col("props")).when(i % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i % 4 == 2, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise("```json {broken```")
    kinds = F.create_map(F.lit("Winter jacket"), F.lit("outer"), F.lit("Top"), F.lit("inner"))
    label = F.when(i % 3 == 0, "winter JACKET ").when(i % 3 == 1, " Top").otherwise("pyjamas")
    item = lambda kind, access, content: F.struct(F.lit(kind).alias("type"), F.struct(F.lit(access).alias("access")).alias("usage"), content.alias("content"))
    media = F.array(item("Images", "Restricted", F.lit("no")), item("Images", "CC0", F.when(i % 5 < 2, F.concat(F.lit("f"), name))), item("Video", "CC0", F.lit("v")), item("Images", "CC0", F.concat(F.lit("m"), name)))
    path = F.concat(F.when(i % 2 == 0, "/data/run/").otherwise(""), F.lit("a/"), name, F.lit(".jpg"))
    return t(spark, at, "events").select(
        i, F.get_json_object(text.fenced_json(fenced), "$.k").cast("int").alias("k"), records.category_of(label, kinds).alias("kind"),
        F.array_join(records.first_media(media, "Images", "CC0", 2), "-").alias("media"), files.relative_path(path, "/data/run").alias("rel"),
    )


@query(
    """WITH l AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation) SELECT n_nationkey, n_name FROM l WHERE n_regionkey <> 2 ORDER BY n_name, n_nationkey LIMIT 20"""
)
def quota_in_order(spark: SparkSession, at: str) -> DataFrame:
    """The first twenty nations by name outside one region, keys checked to be unique."""
    nations = relational.unique_or_fail(t(spark, at, "nation"), "n_nationkey")
    return relational.first_accepted(nations, F.col("n_regionkey") != 2, ["n_name", "n_nationkey"], 20).select("n_nationkey", "n_name")


@query(
    """WITH k AS (SELECT user_id, ts::DATE AS d, CASE event_type WHEN 'view' THEN 'wear' WHEN 'click' THEN 'hot' WHEN 'purchase' THEN 'sweaty' WHEN 'error' THEN 'wash' END AS kind FROM events)
    SELECT user_id, max(d) FILTER (kind IN ('wear', 'hot', 'sweaty')) AS last_worn, max(d) FILTER (kind = 'wash') AS last_washed FROM k GROUP BY 1"""
)
def care_days(spark: SparkSession, at: str) -> DataFrame:
    from ..streaming import care
    from .catalogue import _KINDS as kinds

    events = t(spark, at, "events").select("user_id", F.to_date("ts").alias("day"), rules.lookup(F.col("event_type"), kinds).alias("kind"))
    return care.last_days(events, "user_id", "day")


def _band_sql(value: str, bounds, labels, shift: str = "0") -> str:
    steps = " ".join(f"WHEN {value} < {b} - {shift} THEN '{n}'" for b, n in zip(bounds, labels, strict=False))
    return f"CASE WHEN {value} IS NULL THEN NULL {steps} ELSE '{labels[-1]}' END"


_SHIFTS = tuple(dims.STRETCH.items())


@query(
    f"""WITH x AS (SELECT p_partkey, p_partkey % 9 AS a, p_size AS s, [{", ".join(str(v) for _, v in _SHIFTS)}][(p_partkey % 3 + 1)::INT] AS sh, 160.0 + 2 * (p_size % 15) AS height FROM part),
      e AS (SELECT *, CASE WHEN a = 0 THEN NULL ELSE (33.0 + a) * 2 - 74 END AS waist, (44.0 + s % 14) * 2 - 95 AS hip, (26.0 + s % 11) * 2 - 55 AS thigh,
        CASE WHEN s % 2 = 0 THEN 64.0 + a ELSE (90.0 + s % 20) - (20.0 + a) END - CASE WHEN s % 3 = 0 THEN round(0.45 * height, 1) ELSE 66.0 + s % 10 END AS hem FROM x)
    SELECT p_partkey, {_band_sql("waist + sh", dims.WAIST_BOUNDS, dims.WAIST_LABELS)} AS waist, {_band_sql("hip", dims.FIT_BOUNDS["하의", "hip"], dims.FIT_LABELS, "sh")} AS hip,
      {_band_sql("thigh", dims.FIT_BOUNDS["하의", "thigh"], dims.THIGH_LABELS, "sh")} AS thigh, {_band_sql("hem", dims.INSEAM_BOUNDS, dims.INSEAM_LABELS)} AS hem,
      (waist + sh < 0 AND waist IS NOT NULL)::INT AS n_warnings, (s % 3 = 0)::INT AS n_estimated FROM e"""
)
def bottom_reports(spark: SparkSession, at: str) -> DataFrame:
    """Fit reports of parts as trousers: waist, hip, thigh and length, some measures absent, some lengths of the body estimated from its height."""
    k, s = F.col("p_partkey"), F.col("p_size")
    a, none = k % 9, F.lit(None).cast("double")
    garment = F.struct(
        F.when(a == 0, 0.0).otherwise(F.lit(33.0) + a).alias("waist"), (F.lit(44.0) + s % 14).alias("hip"), (F.lit(26.0) + s % 11).alias("thigh"),
        F.when(s % 2 == 0, F.lit(64.0) + a).alias("inseam"), (F.lit(90.0) + s % 20).alias("length"), (F.lit(20.0) + a).alias("rise"),
    )
    body = F.struct(F.lit(74.0).alias("waist"), F.lit(95.0).alias("hip"), F.lit(55.0).alias("thigh"), F.when(s % 3 == 0, none).otherwise(F.lit(66.0) + s % 10).alias("inseam"), (F.lit(160.0) + 2 * (s % 15)).alias("height"))
    rows = t(spark, at, "part").select(k, garment.alias("g"), body.alias("b"), _pick([n for n, _ in _SHIFTS], k % 3).alias("stretch"))
    found = rows.select("p_partkey", rules.bottom_report(F.col("g"), F.col("b"), F.col("stretch")).alias("f"))
    label = lambda zone: rules.label_of(F.col("f"), zone)
    return found.select("p_partkey", label("허리").alias("waist"), label("엉덩이").alias("hip"), label("허벅지").alias("thigh"), label("기장").alias("hem"), F.size("f.warnings").alias("n_warnings"), F.size("f.estimated").alias("n_estimated"))


@query(
    f"""WITH x AS (SELECT p_partkey, ['상의', '아우터', '원피스'][(p_partkey % 3 + 1)::INT] AS cat, p_size AS s, (42.0 + p_partkey % 19) * 2 - 92 AS ease, 40.0 + p_size % 12 - 44 AS diff, 150.0 + 10 * (p_size % 5) AS height FROM part),
      y AS (SELECT *, (10.0 + s + greatest(diff / 2, 0)) / CASE WHEN s % 2 = 0 THEN 60.0 ELSE round(0.33 * height, 1) END AS ratio FROM x)
    SELECT p_partkey, cat, CASE WHEN cat = '아우터' THEN {_band_sql("ease", dims.FIT_BOUNDS["아우터", "chest"], dims.FIT_LABELS)} ELSE {_band_sql("ease", dims.FIT_BOUNDS["상의", "chest"], dims.FIT_LABELS)} END AS chest,
      {_band_sql("ratio", dims.SLEEVE_BOUNDS, dims.SLEEVE_LABELS)} AS sleeve, CASE WHEN ease < 0 THEN '가슴 둘레가 몸보다 작아 입기 어려울 수 있음' ELSE '' END AS warnings, CASE WHEN s % 2 = 1 THEN 'arm_length' ELSE '' END AS estimated FROM y"""
)
def fit_by_category(spark: SparkSession, at: str) -> DataFrame:
    """Fit reports of parts as tops, coats and dresses without stretch: those too small are warned of, arms that are not known are estimated."""
    k, s = F.col("p_partkey"), F.col("p_size")
    garment = F.struct((F.lit(40.0) + s % 12).alias("shoulder"), (F.lit(42.0) + k % 19).alias("chest"), F.lit(70.0).alias("length"), (F.lit(10.0) + s).alias("sleeve"))
    arm = F.when(s % 2 == 0, 60.0)
    body = F.struct((F.lit(150.0) + 10 * (s % 5)).alias("height"), F.lit(44.0).alias("shoulder_width"), F.lit(92.0).alias("chest"), arm.alias("arm_length"), F.create_map().cast("map<string,double>").alias("landmarks"))
    rows = t(spark, at, "part").select(k, _pick(("상의", "아우터", "원피스"), k % 3).alias("cat"), garment.alias("g"), body.alias("b"))
    found = rows.select("p_partkey", "cat", rules.fit_report(F.col("cat"), F.col("g"), F.col("b")).alias("f"))
    label = lambda zone: rules.label_of(F.col("f"), zone)
    return found.select("p_partkey", "cat", label("가슴").alias("chest"), label("소매").alias("sleeve"), F.array_join("f.warnings", ",").alias("warnings"), F.array_join("f.estimated", ",").alias("estimated"))
