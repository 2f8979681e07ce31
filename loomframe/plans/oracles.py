"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from ..functions import dims


def _values(rows) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _band(value: str, bounds, labels) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {value} < {b} THEN '{name}'" for b, name in zip(bounds, labels)) + f" ELSE '{labels[-1]}' END"


_HASH = "('0x' || substr(sha1({0}::VARCHAR), 1, 8))::BIGINT"
_NOTICE = r"trim(regexp_extract(coalesce(text, ''), '(?:[Ll]icensed? under|[Rr]eleased under) (?:the )?([^\n.]*(?:\.[0-9][^\n.]*)*)', 1))"
_SHARE = _band("{0}", [b for b, _ in dims.SHARE_BINS if b], [n for _, n in dims.SHARE_BINS])


def _lin(v: str) -> str:
    return f"(CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def _knee(x: str) -> str:
    return f"(CASE WHEN {x} > pow(6.0::DOUBLE / 29, 3) THEN cbrt({x}) ELSE {x} / (3 * pow(6.0::DOUBLE / 29, 2)) + 4.0::DOUBLE / 29 END)"


def _lab_cte(source: str, key: str, r: str, g: str, b: str, keep: str = "") -> str:
    """A query with key, l, a, b columns."""
    keep = f", {keep}" if keep else ""
    return f"""SELECT {key}{keep}, 116.0::DOUBLE * fy - 16 AS l, 500.0::DOUBLE * (fx - fy) AS a, 200.0::DOUBLE * (fy - fz) AS b FROM (
      SELECT {key}{keep}, {_knee('x')} AS fx, {_knee('y')} AS fy, {_knee('z')} AS fz FROM (
        SELECT {key}{keep}, (r * 0.4124564::DOUBLE + g * 0.3575761::DOUBLE + b * 0.1804375::DOUBLE) / 0.95047::DOUBLE AS x,
               r * 0.2126729::DOUBLE + g * 0.7151522::DOUBLE + b * 0.0721750::DOUBLE AS y,
               (r * 0.0193339::DOUBLE + g * 0.1191920::DOUBLE + b * 0.9503041::DOUBLE) / 1.08883::DOUBLE AS z
        FROM (SELECT {key}{keep}, {_lin(r)} AS r, {_lin(g)} AS g, {_lin(b)} AS b FROM {source})))"""


def _de(source: str, keep: str, kl: float = 1.0) -> str:
    """CIEDE2000 over columns l1 a1 b1 l2 a2 b2; gives keep and de."""
    hue = lambda b, a: f"CASE WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
    return f"""SELECT {keep}, sqrt(greatest(0.0, x * x + y * y + z * z - sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::DOUBLE, 7))) * y * z)) AS de FROM (
      SELECT *, (l2 - l1) / ({kl}::DOUBLE * (1 + 0.015::DOUBLE * pow((l1 + l2) / 2 - 50, 2) / sqrt(20 + pow((l1 + l2) / 2 - 50, 2)))) AS x,
             (c2 - c1) / (1 + 0.045::DOUBLE * cm) AS y,
             2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015::DOUBLE * cm * (1 - 0.17::DOUBLE * cos(radians(hm - 30)) + 0.24::DOUBLE * cos(radians(2 * hm)) + 0.32::DOUBLE * cos(radians(3 * hm + 6)) - 0.20::DOUBLE * cos(radians(4 * hm - 63)))) AS z
      FROM (SELECT *, (c1 + c2) / 2 AS cm,
          CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
          CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm
        FROM (SELECT *, sqrt(q1 * q1 + b1 * b1) AS c1, sqrt(q2 * q2 + b2 * b2) AS c2, {hue('b1', 'q1')} AS h1, {hue('b2', 'q2')} AS h2
          FROM (SELECT *, (1 + gg) * a1 AS q1, (1 + gg) * a2 AS q2
            FROM (SELECT *, 0.5::DOUBLE * (1 - sqrt(pow(c0, 7) / (pow(c0, 7) + pow(25.0::DOUBLE, 7)))) AS gg
              FROM (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS c0 FROM ({source})))))))"""


def _e(i: int) -> str:
    return f"floor(least(greatest((embedding[{i}]::DOUBLE + 1) / 2, 0), 1) * 255)"


_LABS1 = _lab_cte("embeddings", "vec_id", _e(1), _e(2), _e(3))
_LABS2 = _lab_cte("embeddings", "vec_id", _e(4), _e(5), _e(6))
_REF = _lab_cte(f"(VALUES {_values([(i, n, *rgb) for i, (n, rgb) in enumerate(dims.COLORS.items())])}) v(ord, name, rr, gg, bb)", "ord", "rr", "gg", "bb", "name")
_PAIRS = f"SELECT vec_id, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM ({_LABS1}) p JOIN ({_LABS2}) q USING (vec_id)"

_PALETTE = ["블랙", "레드", "화이트", "핑크", "네이비", "옐로우", "블루"]
_HUES = _lab_cte(f"(VALUES {_values([(n, *rgb) for n, rgb in dims.COLORS.items() if n in _PALETTE])}) v(name, rr, gg, bb)", "name", "rr", "gg", "bb")

_WARDROBE = f"""
items AS (
  SELECT p_partkey AS id, (p_partkey // 24)::INT AS context,
    CASE p_type WHEN 'ECONOMY' THEN 'top' WHEN 'SMALL' THEN 'top' WHEN 'PROMO' THEN 'bottom' WHEN 'MEDIUM' THEN 'bottom' WHEN 'LARGE' THEN 'outer' WHEN 'STANDARD' THEN 'shoes' END AS slot,
    {_list(_PALETTE)}[p_partkey % 7 + 1] AS color, p_partkey % 5 = 0 AS patterned, ['슬림', '레귤러', '세미오버', '오버'][p_partkey % 4 + 1] AS fit, (p_partkey % 4)::INT AS volume,
    (p_partkey % 5 + 1)::INT AS formality, [[]::VARCHAR[], ['a'], ['a', 'b'], ['b', 'c']][p_partkey % 4 + 1] AS tags, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 6 END AS days
  FROM part WHERE p_partkey % 3 <> 0 AND abs(p_partkey % 5 + 1 - 3) <= 2
), slots AS (SELECT * FROM items WHERE slot IS NOT NULL),
bases AS (SELECT t.context, [t.id, b.id] AS ids FROM slots t JOIN slots b USING (context) WHERE t.slot = 'top' AND b.slot = 'bottom'),
with_outer AS (SELECT x.context, CASE WHEN o.id IS NULL THEN ids ELSE list_append(ids, o.id) END AS ids FROM bases x LEFT JOIN (SELECT * FROM slots WHERE slot = 'outer') o USING (context)),
outfits AS (SELECT x.context, CASE WHEN s.id IS NULL THEN ids ELSE list_append(ids, s.id) END AS ids FROM with_outer x LEFT JOIN (SELECT * FROM slots WHERE slot = 'shoes') s USING (context))
"""

_ATTEMPTS = f"""attempts AS (SELECT l_returnflag = 'N' AS approved, l_quantity::DOUBLE AS seconds, {_SHARE.format('(l_discount * 10)')} AS bin, l_tax > 0.06 AS hard,
  l_extendedprice AS gate, l_suppkey AS file, l_linenumber AS k, l_orderkey AS seq, l_linestatus FROM lineitem)"""
_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / greatest(sqrt(list_sum(list_transform({0}, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform({1}, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12)"
_CENTROIDS = "centroids AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"

ORACLES: dict[str, str] = {
    "license_audit": f"""
      SELECT license, count(*) AS n, license <> '' AND regexp_matches(license, '(?i){dims.ALLOWED_LICENSE}') AND NOT regexp_matches(license, '(?i){dims.BLOCKED_LICENSE}') AS allowed
      FROM (SELECT {_NOTICE} AS license FROM documents) GROUP BY license""",
    "first_reject_reason": """
      SELECT CASE WHEN lang NOT IN ('en', 'de') THEN 'lang' WHEN n_chars < 500 THEN 'small' WHEN n_chars > 10000 THEN 'large' WHEN source = 'src3' THEN 'source' ELSE 'ok' END AS reason, count(*) AS n
      FROM documents GROUP BY 1""",
    "all_reject_reasons": """
      WITH x AS (SELECT list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity < 5 THEN 'quantity' END, CASE WHEN l_tax >= 0.07 THEN 'tax' END,
        CASE WHEN l_extendedprice > 80000 THEN 'price' END], lambda z: z IS NOT NULL) AS rs FROM lineitem)
      SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(rs) = 0 THEN ['ok'] ELSE rs END) AS reason FROM x) GROUP BY 1""",
    "coco_star_filter": """
      SELECT o_orderkey, o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND p_type IN ('PROMO', 'SMALL') GROUP BY 1, 2""",
    "strict_and_left_dim_lookup": """
      SELECT n_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE '?' END AS region, count(*) AS n, round(sum(s_acctbal), 2) AS balance
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "usable_view": """
      SELECT p_partkey, p_type, p_size FROM part WHERE p_size <= 30 AND p_type <> 'LARGE' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)""",
    "split_by_hash": f"""
      SELECT CASE WHEN doc_id IN (7, 42) THEN 'exp0' WHEN h < 20 THEN 'report' WHEN h < 25 THEN 'select' WHEN h < 30 THEN 'tune' ELSE 'train' END AS split, count(*) AS n
      FROM (SELECT doc_id, {_HASH.format('doc_id')} % 100 AS h FROM documents) GROUP BY 1""",
    "stratified_hash_sample": """
      SELECT doc_id, lang, rank::INT AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= 20""",
    "round_robin_sample": """
      SELECT doc_id, source, rank::INT AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id::VARCHAR), doc_id) AS rank FROM documents) ORDER BY rank, source LIMIT 60""",
    "per_seed_cap": """
      SELECT user_id, count(*) AS n, max(event_id) AS last_event, round(sum(value), 2) AS total
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 10 GROUP BY 1""",
    "every_nth": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 7 = 0",
    "lookup_last_wins": """
      SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "resume_anti_join": """
      SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1""",
    "dedup_id_then_hash": """
      SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM (SELECT *, row_number() OVER (PARTITION BY sha1(coalesce(text, '')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 GROUP BY 1""",
    "latest_checkpoint": """
      SELECT o_custkey, max(o_orderkey) AS step, max_by(o_orderpriority, o_orderkey) AS path FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
    "incremental_history_dedup": """
      SELECT min(doc_id) AS doc_id, h AS sha1 FROM (SELECT doc_id, sha1(coalesce(text, '')) AS h FROM documents) WHERE doc_id % 2 = 1
      AND h NOT IN (SELECT sha1(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0) GROUP BY h""",
    "slot_cross_join": f"WITH {_WARDROBE} SELECT context, count(*) AS n, max(len(ids))::INT AS most_items FROM outfits GROUP BY 1",
    "weighted_outfit_score": f"""
      WITH {_WARDROBE}, numbered AS (SELECT context, ids, array_to_string(ids, '-') AS name FROM outfits),
      each AS (SELECT n.context, n.name, len(n.ids) AS k, i.* EXCLUDE (context) FROM numbered n, unnest(n.ids) u(uid) JOIN items i ON i.id = u.uid),
      hues AS (SELECT name AS color, CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END AS hue FROM ({_HUES})),
      accents AS (SELECT context, name, list_sort(list(DISTINCT color)) AS cs FROM each WHERE color NOT IN {tuple(dims.NEUTRALS)} GROUP BY 1, 2),
      accent AS (SELECT a.context, a.name, len(cs) AS n, abs(h1.hue - h2.hue) AS gap FROM accents a LEFT JOIN hues h1 ON h1.color = cs[1] LEFT JOIN hues h2 ON h2.color = cs[2]),
      pairs AS (SELECT a.context, a.name, avg(len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags)))) AS j
        FROM each a JOIN each b ON a.context = b.context AND a.name = b.name AND a.id < b.id WHERE len(a.tags) > 0 AND len(b.tags) > 0 GROUP BY 1, 2),
      parts AS (SELECT context, name, any_value(k) AS k, count(*) FILTER (WHERE len(tags) > 0) AS tagged, count(*) FILTER (WHERE list_contains(tags, 'a')) AS wanted, count(*) FILTER (WHERE patterned) AS patterned,
          avg(formality) AS level, avg(CASE WHEN days IS NULL OR days >= 4 THEN 1.0::DOUBLE WHEN days < 2 THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END) AS freshness,
          max(volume) FILTER (WHERE slot = 'top') AS t, max(volume) FILTER (WHERE slot = 'bottom') AS b FROM each GROUP BY 1, 2),
      scores AS (SELECT p.context, p.name, freshness,
          greatest(CASE WHEN coalesce(a.n, 0) = 0 THEN 0.85::DOUBLE WHEN a.n = 1 THEN 1.0 WHEN a.n = 2 AND least(gap, 360 - gap) < 40 THEN 0.8 WHEN a.n = 2 THEN 0.55 ELSE 0.3 END - 0.2::DOUBLE * greatest(patterned - 1, 0), 0) AS color,
          CASE WHEN t >= 2 AND b >= 2 THEN 0.6::DOUBLE WHEN t = 0 AND b = 0 THEN 0.85 WHEN abs(t - b) >= 2 THEN 1.0 ELSE 0.9 END AS silhouette,
          0.7::DOUBLE * CASE WHEN tagged < 2 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE + 0.6::DOUBLE * j END + 0.3::DOUBLE * wanted / k AS style, greatest(0, 1 - abs(level - 3) / 4) AS formality
        FROM parts p LEFT JOIN accent a USING (context, name) LEFT JOIN pairs USING (context, name))
      SELECT context, name AS ids, round(color, 6) AS color, round(silhouette, 6) AS silhouette, round(style, 6) AS style, round(formality, 6) AS formality, round(freshness, 6) AS freshness,
        round(0.25::DOUBLE * color + 0.15::DOUBLE * silhouette + 0.15::DOUBLE * style + 0.15::DOUBLE * formality + 0.15::DOUBLE * freshness + 0.15::DOUBLE, 6) AS score FROM scores""",
    "best_size": f"""
      WITH chart(ord, size, half) AS (VALUES (0, 'S', 47.0), (1, 'M', 51.0), (2, 'L', 55.0), (3, 'XL', 59.0)),
      tried AS (SELECT p_partkey, ord, size, half * 2 - 80 - p_size AS ease FROM part, chart),
      gaps AS (SELECT *, abs(CASE WHEN ease < 5 THEN 0 WHEN ease < 10 THEN 1 WHEN ease < 16 THEN 2 WHEN ease < 24 THEN 3 ELSE 4 END - 2) AS gap FROM tried WHERE ease >= 0)
      SELECT p_partkey, arg_min(size, gap * 10 + ord) AS size, min(gap)::INT AS gap FROM gaps GROUP BY 1""",
    "fit_bands": f"""
      SELECT {_band('l_quantity::DOUBLE', (10, 20, 30, 40), dims.FIT_LABELS)} AS band, CASE WHEN l_quantity - 25 < -2 THEN '작음' WHEN l_quantity - 25 <= 2 THEN '정핏' ELSE '드롭숄더' END AS shoulder,
        {_band('(l_quantity::DOUBLE / 45)', dims.SLEEVE_BOUNDS, dims.SLEEVE_LABELS)} AS sleeve, {_SHARE.format('(l_quantity::DOUBLE / 50)')} AS share,
        {_band('(2.0 * l_linenumber - 6)', dims.INSEAM_BOUNDS, dims.INSEAM_LABELS)} AS inseam, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "care_state_fold": """
      WITH RECURSIVE seq AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      s(user_id, rn, load, learned, state, wears) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0::BIGINT FROM seq
        UNION ALL
        SELECT user_id, rn, CASE WHEN k = 'error' THEN 0 ELSE after END,
          CASE WHEN k = 'signup' AND state = 2 THEN least(lim + 1, 8) ELSE learned END,
          CASE WHEN k = 'error' THEN 0 WHEN k = 'signup' THEN CASE WHEN state <> 2 THEN state WHEN load < least(lim + 1, 8) THEN 1 ELSE 2 END WHEN after >= lim - 1e-9 THEN 2 ELSE 1 END,
          wears + CASE WHEN k IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END
        FROM (SELECT q.user_id, q.rn, q.k, s.load, s.learned, s.state, s.wears, CASE WHEN s.learned = 0 THEN 4 ELSE s.learned END AS lim,
            s.load + CASE q.k WHEN 'view' THEN 1.0 WHEN 'click' THEN 1.5 WHEN 'purchase' THEN CASE WHEN s.learned = 0 THEN 4 ELSE s.learned END ELSE 0 END AS after
          FROM s JOIN seq q ON q.user_id = s.user_id AND q.rn = s.rn + 1))
      SELECT user_id, round(arg_max(load, rn), 3) AS load, arg_max(learned, rn) AS learned, arg_max(state, rn) AS state, arg_max(wears, rn) AS wears FROM s GROUP BY 1""",
    "laundry_bundles": f"""
      WITH x AS (SELECT p_partkey AS k, ['면', '울', '실크 혼방', '소가죽'][p_partkey % 4 + 1] AS m, ['티셔츠', '코트', '니트'][p_partkey % 3 + 1] AS s, {_list(_PALETTE)}[p_partkey % 7 + 1] AS c FROM part),
      y AS (SELECT k, c, CASE WHEN contains(m, '가죽') OR s = '코트' THEN '드라이클리닝' WHEN contains(m, '실크') THEN '손세탁' WHEN contains(m, '울') OR s = '니트' THEN '울코스' ELSE '일반세탁' END AS method FROM x)
      SELECT method, CASE WHEN method = '드라이클리닝' THEN NULL WHEN c IN ('화이트', '아이보리') THEN '흰색' WHEN c IN {tuple(dims.DARK_COLORS)} THEN '어두운색' ELSE '밝은색' END AS color,
        min(CASE method WHEN '드라이클리닝' THEN 0 WHEN '일반세탁' THEN 40 ELSE 30 END)::INT AS max_temp, count(*) AS n, min(k) AS first_item FROM y GROUP BY 1, 2""",
    "idle_items": """
      SELECT c_custkey, date_diff('day', last, DATE '1998-08-02')::INT AS idle_days FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate::DATE) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey
      WHERE last IS NULL OR date_diff('day', last, DATE '1998-08-02') >= 180""",
    "cost_per_use": """
      SELECT p_partkey, coalesce(uses, 0) AS uses, round_even(p_retailprice / uses, 0) AS cost FROM part LEFT JOIN (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "nearest_color": f"""
      WITH p AS ({_LABS1}), q AS ({_REF}), d AS ({_de('SELECT vec_id, ord, name, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM p, q', 'vec_id, ord, name')})
      SELECT vec_id, name AS color, round(de, 4) AS delta_e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY de, ord) AS rn FROM d) WHERE rn = 1""",
    "color_distance_pairs": f"""
      WITH pairs AS ({_PAIRS}) SELECT vec_id, round(x.de, 4) AS de, round(y.de, 4) AS de_soft, round(sqrt(a1 * a1 + b1 * b1), 3) AS chroma
      FROM ({_de('SELECT * FROM pairs', 'vec_id')}) x JOIN ({_de('SELECT * FROM pairs', 'vec_id', 2.0)}) y USING (vec_id) JOIN pairs USING (vec_id)""",
    "yield_summary": f"""
      WITH {_ATTEMPTS} SELECT l_linestatus, count(*) AS n, count_if(approved)::BIGINT AS ok, round(avg(approved::INT), 3) AS rate, round(median(seconds), 1) AS median_seconds,
        round(sum(seconds) / nullif(count_if(approved), 0), 1) AS seconds_per_ok, count_if(approved) || '/' || count(*) AS label FROM attempts GROUP BY 1""",
    "overlapping_group_summary": f"""
      WITH {_ATTEMPTS}, rows AS (SELECT *, unnest(list_filter([bin, 'all', CASE WHEN hard THEN 'hard' END], lambda z: z IS NOT NULL)) AS grp FROM attempts),
      files AS (SELECT grp, file, arg_min(approved, (k, seq))::INT AS single, max(approved::INT) AS oracle, arg_min(approved, (gate, seq, k))::INT AS picked, count(*) AS n, count_if(approved) AS passed FROM rows GROUP BY 1, 2)
      SELECT grp, count(*) AS files, round(avg(single), 4) AS single, round(avg(oracle), 4) AS oracle, round(avg(picked), 4) AS picked, round(sum(passed)::DOUBLE / sum(n), 4) AS row_rate FROM files GROUP BY 1""",
    "group_and_overall": """
      SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean_quantity, round(avg(nullif(l_discount, 0)), 4) AS mean_discount, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""",
    "median_by_bin_nan": """
      SELECT bin, round(median(CASE WHEN vec_id % 5 <> 0 THEN x END), 3) + 0.0::DOUBLE AS median, count(*) AS n FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, unnest([label::VARCHAR, 'all']) AS bin FROM embeddings) GROUP BY 1""",
    "nearest_rank_p95": """
      SELECT event_type, len(v) AS n, list_sort(v)[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95 FROM (SELECT event_type, list(value) FILTER (WHERE value IS NOT NULL) AS v FROM events GROUP BY 1)""",
    "field_accuracy": """
      WITH j AS (SELECT l.*, (n_chars > 200)::INT AS pq, contains(text, 'idiot')::INT AS pt FROM labels l LEFT JOIN documents USING (doc_id))
      SELECT 'quality' AS field, round(avg(coalesce((quality = pq)::INT, 0)), 3) AS accuracy, count(*) AS n FROM j WHERE quality IS NOT NULL
      UNION ALL SELECT 'toxic', round(avg(coalesce((toxic = pt)::INT, 0)), 3), count(*) FROM j WHERE toxic IS NOT NULL""",
    "multiset_overlap": """
      WITH p AS (SELECT user_id, event_type, count(*) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), q AS (SELECT user_id, event_type, count(*) AS d FROM events WHERE event_id % 2 <> 0 GROUP BY 1, 2),
      x AS (SELECT user_id, sum(least(coalesce(c, 0), coalesce(d, 0)))::BIGINT AS shared, sum(coalesce(c, 0))::BIGINT AS n_pred, sum(coalesce(d, 0))::BIGINT AS n_true FROM p FULL JOIN q USING (user_id, event_type) GROUP BY 1)
      SELECT *, n_pred = n_true AS count_exact, round(shared::DOUBLE / greatest(n_true, 1), 4) AS accuracy, round(greatest(n_true - n_pred, 0)::DOUBLE / greatest(n_true, 1), 4) AS missing_ratio,
        round(greatest(n_pred - n_true, 0)::DOUBLE / greatest(n_true, 1), 4) AS extra_ratio FROM x""",
    "precision_recall_sweep": """
      WITH c AS (SELECT threshold, count_if(n_chars > threshold AND quality = 1)::BIGINT AS tp, count_if(n_chars > threshold AND quality = 0)::BIGINT AS fp, count_if(n_chars <= threshold AND quality = 1)::BIGINT AS fn
        FROM labels JOIN documents USING (doc_id), (SELECT unnest([100, 500, 1000, 2000, 5000]) AS threshold) GROUP BY 1)
      SELECT *, round(tp::DOUBLE / greatest(tp + fp, 1), 4) AS precision, round(tp::DOUBLE / greatest(tp + fn, 1), 4) AS recall FROM c""",
    "auroc_rank_sum": """
      WITH x AS (SELECT lang, n_chars, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
      r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM x),
      s AS (SELECT lang, count_if(quality = 1)::BIGINT AS n_pos, count_if(quality <> 1)::BIGINT AS n_neg, sum(rk) FILTER (WHERE quality = 1) AS rs FROM r GROUP BY 1)
      SELECT lang, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos * n_neg, 0), 6) AS auroc FROM s""",
    "paired_mcnemar": """
      WITH c AS (SELECT lang, count_if(quality = 1 AND toxic = 0)::BIGINT AS a_only, count_if(quality = 0 AND toxic = 1)::BIGINT AS b_only FROM labels JOIN documents USING (doc_id) GROUP BY 1),
      terms AS (SELECT lang, a_only, b_only, lgamma(a_only + b_only + 1) - lgamma(j + 1) - lgamma(a_only + b_only - j + 1) - (a_only + b_only) * ln(2) AS lt FROM c, range(0, least(a_only, b_only) + 1) g(j)),
      p AS (SELECT lang, a_only, b_only, least(1, 2 * sum(exp(lt))) AS p FROM terms GROUP BY 1, 2, 3)
      SELECT lang, a_only, b_only, round(log10(p), 6) AS log10_p FROM p""",
    "centroid_similarity": f"WITH {_CENTROIDS} SELECT vec_id, label, round({_COS.format('embedding', 'centroid')}, 4) AS similarity FROM embeddings JOIN centroids USING (label)",
    "best_rotation": f"""
      WITH {_CENTROIDS}, s AS (SELECT vec_id, [{', '.join(f"round({_COS.format(f'embedding[{16 * i + 1}:{16 * i + 16}]', 'centroid[1:16]')}, 4)" for i in range(4))}] AS s FROM embeddings JOIN centroids USING (label))
      SELECT vec_id, (CASE WHEN list_position(s, list_max(s)) <> 1 AND list_max(s) - s[1] >= 0.05 THEN (list_position(s, list_max(s)) - 1) * 90 ELSE 0 END)::INT AS angle, list_max(s) AS best FROM s""",
    "margin_to_others": f"""
      WITH {_CENTROIDS}, s AS (SELECT vec_id, e.label = c.label AS own, {_COS.format('embedding', 'centroid')} AS s FROM embeddings e, centroids c)
      SELECT vec_id, round(coalesce(max(s) FILTER (WHERE own) - max(s) FILTER (WHERE NOT own), 1.0), 4) AS margin FROM s GROUP BY 1""",
    "json_schema_check": """
      WITH x AS (SELECT json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n FROM events),
      y AS (SELECT list_filter([CASE WHEN k IS NULL THEN 'missing:k' END, CASE WHEN NOT regexp_matches(k, '^-?[0-9]+$') THEN 'type:k' END, CASE WHEN try_cast(k AS INT) > 5 OR try_cast(k AS INT) < 1 THEN 'range:k' END,
        CASE WHEN n > 1 THEN 'extra' END], lambda z: z IS NOT NULL) AS v FROM x)
      SELECT violation, count(*) AS n FROM (SELECT unnest(CASE WHEN len(v) = 0 THEN ['valid'] ELSE v END) AS violation FROM y) GROUP BY 1""",
    "html_clean_text": "SELECT page_id, length(s) AS n_chars, sha256(s) AS sha FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS s FROM pages)",
    "year_and_license_names": f"""
      WITH x AS (SELECT nullif(regexp_extract(coalesce(text, ''), '((?:19|20)[0-9]{{2}})', 1), '')::INT AS year, {_NOTICE} AS notice FROM documents),
      y AS (SELECT year, lower(regexp_extract(notice, '^CC ([A-Za-z-]+)', 1)) AS c, regexp_extract(notice, '([0-9]\\.[0-9])', 1) AS v FROM x)
      SELECT year, CASE WHEN c = '' THEN '-' ELSE trim('CC ' || upper(c) || ' ' || v) END AS license, count(*) AS n FROM y GROUP BY 1, 2""",
    "jaccard_sets": r"""
      WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM documents),
      x AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS n, len(b.w) AS m FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
      SELECT doc_id, shared, round(coalesce(shared::DOUBLE / nullif(n + m - shared, 0), 0), 4) AS jaccard FROM x""",
    "job_planning_topn": f"""
      SELECT s_suppkey, p_partkey, rank::INT AS rank FROM (
        SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY {_HASH.format("(s_suppkey::VARCHAR || '|' || p_partkey::VARCHAR)")}, p_partkey) AS rank
        FROM supplier JOIN part ON list_contains(CASE WHEN s_suppkey % 2 = 0 THEN ['PROMO', 'SMALL'] ELSE ['LARGE'] END, p_type)) WHERE rank <= 3""",
    "first_passing_donor": f"""
      WITH x AS (SELECT a.p_partkey, b.p_partkey AS donor, b.p_retailprice > a.p_retailprice AS ok,
          row_number() OVER (PARTITION BY a.p_partkey ORDER BY {_HASH.format("(a.p_partkey::VARCHAR || '|' || b.p_partkey::VARCHAR)")}, b.p_partkey) AS rn
        FROM part a JOIN part b USING (p_brand))
      SELECT p_partkey, arg_min(donor, rn) AS donor, min(rn)::INT AS attempt FROM x WHERE rn <= 5 AND ok GROUP BY 1""",
    "another_of_category": f"""
      WITH x AS (SELECT *, {_HASH.format('p_partkey')} AS h FROM part)
      SELECT a.p_partkey, (SELECT b.p_partkey FROM x b WHERE b.p_type = a.p_type AND b.p_size = a.p_size AND b.p_partkey <> a.p_partkey ORDER BY b.h, b.p_partkey LIMIT 1) AS other FROM x a""",
    "circuit_breaker": """
      WITH RECURSIVE seq AS (SELECT user_id, value > 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      s(user_id, rn, n_ok, n_failed, n_skipped) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM seq
        UNION ALL
        SELECT s.user_id, q.rn, n_ok + CASE WHEN NOT down AND ok THEN 1 ELSE 0 END, n_failed + CASE WHEN NOT down AND NOT ok THEN 1 ELSE 0 END, n_skipped + CASE WHEN down THEN 1 ELSE 0 END
        FROM (SELECT *, n_failed >= 10 AND n_ok < 0.1 * (n_ok + n_failed) AS down FROM s) s JOIN seq q ON q.user_id = s.user_id AND q.rn = s.rn + 1)
      SELECT user_id, arg_max(n_ok, rn) AS n_ok, arg_max(n_failed, rn) AS n_failed, arg_max(n_skipped, rn) AS n_skipped FROM s GROUP BY 1""",
    "rle_area_and_iou": """
      WITH x AS (SELECT l_orderkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT) - 1 AS i FROM lineitem),
      y AS (SELECT l_orderkey, coalesce(sum(q) FILTER (WHERE i % 2 = 1), 0)::BIGINT AS area, sum(q)::BIGINT AS total FROM x GROUP BY 1)
      SELECT *, round(area::DOUBLE / greatest(total, 1), 4) AS share FROM y""",
    "weighted_source_sample": f"""
      SELECT doc_id, source FROM documents JOIN (SELECT source, count(*) AS size FROM documents GROUP BY 1) USING (source)
      ORDER BY -ln(({_HASH.format('doc_id')} + 1) / 4294967297.0::DOUBLE) * size / CASE source WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END, doc_id LIMIT 100""",
    "mean_of_ten_steps": "SELECT ceil((event_id + 1) / 10.0)::BIGINT AS block, round(avg(value), 3) AS loss, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "attribute_names": """
      SELECT l_suppkey, p_brand AS supercategory, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "score_predicates": """
      WITH x AS (SELECT l_returnflag, l_quantity::DOUBLE / 50 AS fg, l_discount::DOUBLE AS outer_frac, CASE WHEN l_linenumber < 4 THEN l_quantity::DOUBLE / 4 END AS pal, CASE WHEN l_linenumber <> 2 THEN l_quantity::DOUBLE / 5 END AS extra,
        l_tax::DOUBLE * 200 AS chroma, l_quantity::DOUBLE / 20 AS ratio, l_quantity::DOUBLE - 5 AS margin, l_tax::DOUBLE / 5 AS marker FROM lineitem),
      y AS (SELECT *, margin > 0 AND fg >= 0.02 AND outer_frac <= 0.2 AS r FROM x)
      SELECT l_returnflag, count_if(r)::BIGINT AS right_item, count_if(r AND coalesce(pal, 99) <= 12 AND coalesce(extra, 99) <= 15 AND (chroma <= 8 OR ratio BETWEEN 0.5 AND 2.0) AND marker <= 0.01)::BIGINT AS faithful,
        count_if(fg > 0.5 AND coalesce(pal, 0) > 0)::BIGINT AS passing FROM y GROUP BY 1""",
    "capped_selection": """
      WITH RECURSIVE k AS (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS gs, row_number() OVER (ORDER BY sha1(l_orderkey::VARCHAR), l_orderkey::VARCHAR) AS i
          FROM lineitem WHERE l_returnflag || l_linestatus IN ('AF', 'RF', 'NO', 'NF') GROUP BY 1),
        w(i, n, l_orderkey, grp) AS (SELECT 0::BIGINT, MAP {'AF': 0, 'RF': 0, 'NO': 0, 'NF': 0}, NULL::BIGINT, NULL::VARCHAR UNION ALL
          SELECT i, CASE WHEN g IS NULL THEN n ELSE map_concat(n, MAP {g: n[g] + 1}) END, l_orderkey, g FROM (
            SELECT k.i, w.n, k.l_orderkey, list_filter(k.gs, lambda x: w.n[x] < 25)[1] AS g FROM w JOIN k ON k.i = w.i + 1 WHERE list_sum(map_values(w.n)) < 100))
      SELECT l_orderkey, grp FROM w WHERE grp IS NOT NULL
    """,
    "fallback_label_join": """
      WITH p AS (SELECT o_orderkey, o_orderpriority || '/' || (o_orderkey % 500) AS src, (o_orderkey % 500)::VARCHAR AS name FROM orders),
      l AS (SELECT o_orderpriority || '/' || (o_orderkey % 500) AS key, (o_orderkey % 500)::VARCHAR AS name, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
      n AS (SELECT name, arg_min(key, pos) AS key, min(pos) AS pos FROM l GROUP BY 1)
      SELECT o_orderkey, coalesce(l.key, n.key, p.name) AS label_key, coalesce(l.pos, n.pos) AS v FROM p LEFT JOIN l ON l.key = p.src LEFT JOIN n ON n.name = p.name""",
    "cross_cycle": """
      WITH c AS (SELECT n_name, r_name, row_number() OVER (ORDER BY n_name, r_name) - 1 AS place FROM nation, region)
      SELECT id, n_name, r_name FROM (SELECT unnest(range(500)) AS id) JOIN c ON c.place = id % (SELECT count(*) FROM c)""",
    "warmup_timing": """
      WITH x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
      y AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v, median(value) AS p50, avg(value) AS mean FROM x WHERE rn > 20 OR n <= 20 GROUP BY 1)
      SELECT event_type, n, round(p50, 3) AS p50, round(v[round_even(0.95 * (n - 1), 0)::INT + 1], 3) AS p95, round(mean, 3) AS mean FROM y""",
}
