"""DuckDB SQL for the corpus queries that SQL can express."""

#: White space as the contracts have it, for trim().
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8 = f"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), keys AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.*, (owner IS NOT NULL AND owner <> doc_id) AS gone FROM lines l LEFT JOIN keys USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(host_rule, path_rule, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT page_id, max_by(host_rule || path_rule, length(host_rule || path_rule)) AS rule, max_by(rule_verdict, length(host_rule || path_rule)) AS v
  FROM parts, rules WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, 'casino|cheap-pills|free-bets|adult-x|spam-farm|ads-track') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hits USING (page_id)
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM starts) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, s + d AS p FROM late, (SELECT unnest(range(20)) AS d)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s : s + 4], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM shingles a JOIN shingles b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE both_have * 9 >= 4 * (a.n + b.n)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT doc_id, least(doc_id, (SELECT min(y) FROM reach r WHERE r.x = doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.x = doc_id)::BIGINT AS n_links
FROM documents
"""

OP11 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to, true AS intact
FROM best
"""


def _merkle(levels: int = 5, top_levels: int = 2) -> str:
    """Trees of up to 16^levels rows a source and 16^top_levels sources; a finished tree is handed up as it is."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    rest = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    ctes = [
        f"""docs AS (
  SELECT doc_id, coalesce('s' || source, '-') AS tree, sha256({rest} || {field("text")}) AS leaf, sha256({rest} || {field("changed")}) AS claimed
  FROM (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS changed FROM (SELECT *, {_CRC} AS crc FROM documents))
)""",
        "n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS d, doc_id FROM docs)",
        "p0 AS (SELECT doc_id, tree, pos, leaf AS own, claimed AS cur, '' AS proof FROM docs JOIN n0 USING (doc_id, tree))",
    ]

    def climb(nodes: str, paths: str, count: int, name: str) -> tuple[str, str]:
        for k in range(count):
            ctes.append(f"""{name}{k}_sides AS (
  SELECT a.tree, a.pos, a.n, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 GROUP BY ALL
)""")
            ctes.append(f"""{name}{k}_p AS (
  SELECT doc_id, tree, pos // 16 AS pos, own, CASE WHEN n > 1 THEN sha256(l || cur || r) ELSE cur END AS cur, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof
  FROM {paths} JOIN {name}{k}_sides USING (tree, pos)
)""")
            ctes.append(f"""{name}{k}_n AS (
  SELECT tree, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {nodes} GROUP BY tree, pos // 16
)""")
            nodes, paths = f"{name}{k}_n", f"{name}{k}_p"
        return nodes, paths

    subroots, paths = climb("n0", "p0", levels, "t")
    ctes.append(f"m0 AS (SELECT '' AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d FROM {subroots})")
    ctes.append(f"q0 AS (SELECT doc_id, '' AS tree, m0.pos, own, cur, proof FROM {paths} p JOIN m0 ON p.tree = m0.of)")
    root, ends = climb("m0", "q0", top_levels, "r")
    return f"""
WITH {", ".join(ctes)}
SELECT doc_id, own AS leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.d AS verified
FROM {ends} e JOIN docs USING (doc_id) JOIN m0 s ON s.of = docs.tree JOIN {root} t ON e.tree = t.tree
"""


#: Unsigned CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

OP12 = _merkle()

OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS s FROM documents
), h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 :], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {"op7_ngram_jaccard_join": OP7, "op5_substring_dedup": OP5, "op8_line_dedup": OP8, "op10_url_filter": OP10, "op11_warc": OP11, "op12_merkle_manifest": OP12, "op13_fill_in_middle": OP13}
