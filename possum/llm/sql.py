"""DuckDB SQL of the operators' queries that SQL can express.

The others rest on 64-bit hashes or a fitted model that DuckDB has no form
for; their tests hold them against brute-force versions.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP2 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, c, substr(h, 2 * c + 1, 2398) AS part, least(1000, length(h) // 2 - 199 - c) AS n
      FROM (SELECT rid, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 1000)) AS c FROM d)),
w AS (SELECT rid, c + s AS s, md5(substr(part, 2 * s + 1, 400)) AS k FROM (SELECT rid, c, part, unnest(range(0, n)) AS s FROM p)),
r AS (SELECT rid, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
i AS (SELECT rid, s, sum(CASE WHEN s <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS island
      FROM (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS before FROM r)),
c AS (SELECT rid, island, min(s) AS a, max(s) + 200 AS e FROM i GROUP BY rid, island),
g AS (SELECT c.rid, a, e, substr(h, 2 * coalesce(lag(e) OVER o, 0) + 1, 2 * (a - coalesce(lag(e) OVER o, 0))) AS piece
      FROM c JOIN d ON c.rid = d.rid WINDOW o AS (PARTITION BY c.rid ORDER BY a)),
k AS (SELECT rid, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(piece, '' ORDER BY a) AS pieces FROM g GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""

_MARKS = r"\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE>>|<</ROLE>>|<</TURN>>"

_OP3 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(text) + length(regexp_extract_all(text, '{_MARKS}')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
        ELSE 26 + length(role) + length(regexp_extract_all(role, '{_MARKS}')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM f GROUP BY conv_id
"""


def _tree_sql(shards: int) -> str:
    """Shard of ``key`` for the tree of regions of two racks of two shards."""
    cost = lambda child, w: f"-ln((CAST('0x' || substr(md5(key || '|{child}'), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370497.0::DOUBLE) / {w}.0::DOUBLE"

    def draw(children: list[tuple[str, int, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        costs = [cost(name, w) for name, w, _ in children]
        least = f"least({', '.join(costs)})"
        return "CASE " + " ".join(f"WHEN {c} = {least} THEN {v}" for c, (*_, v) in zip(costs, children, strict=True)) + " END"

    regions = []
    for r in range(0, shards, 4):
        racks = []
        for k in range(r, min(r + 4, shards), 2):
            leaves = [(f"s{s}", 1, str(s)) for s in range(k, min(k + 2, shards))]
            racks.append((f"g{r // 4}/k{k % 4 // 2}", len(leaves), f"({draw(leaves)})"))
        regions.append((f"g{r // 4}", min(4, shards - r), f"({draw(racks)})"))
    return f"CAST({draw(regions)} AS INTEGER)"


_OP6 = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, key, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM d, tab),
s AS (SELECT *, {_tree_sql(8)} AS shard, {_tree_sql(9)} AS grown_shard,
  CAST('0x' || substr(md5(key || '|' || text_crc32 || '|' || size), 1, 6) AS BIGINT) % 4096 AS cell FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

_OP9 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT r, vec_id, e FROM v WHERE e IS NOT NULL AND list_count(e) = len(e) AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
l AS (SELECT a.r AS a, b.r AS b, a.vec_id AS ia, b.vec_id AS ib FROM u AS a JOIN u AS b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r, r AS t FROM u UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.t = l.a),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.t = v.r GROUP BY reach.r),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN c ON v.r = c.r LEFT JOIN n ON v.r = n.a
"""

_OP10 = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM p),
rules (verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT r, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rh) DESC, length(rp) DESC) AS k
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.r = m.r AND m.k = 1
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_UPPER.lower()}'), '{_TERMS}')"


_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("coalesce(text, '')")} AS terms FROM documents),
size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (
  SELECT row_number() OVER () AS q, item_id, unnest({_terms_sql("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, size),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM held JOIN w USING (term) JOIN asked USING (term), size GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

_USABLE = "e IS NOT NULL AND list_count(e) = len(e) AND list_bool_and(list_transform(e, lambda x: isfinite(x)))"

_OP12 = f"""
WITH v AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _clusters_sql(rounds: int, k: int = 16) -> str:
    """Assignment and update written out round by round; every row of ``c<i>`` is a centroid after i rounds."""
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WHERE len(e) = 64 AND {_USABLE}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v FROM v QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, vec_id, v, near.cluster AS cluster, near.distance AS distance FROM (
  SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, min({{'distance': CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'cluster': c.cluster}}) AS near
  FROM v, c{i} AS c GROUP BY v.r))""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM (
    SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place)
  GROUP BY cluster) AS m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c USING (cluster)
"""


SQL = {
    "op2_suffix": _OP2,
    "op3_chat": _OP3,
    "op6_sharding": _OP6,
    "op9_vectors": _OP9,
    "op10_urls": _OP10,
    "op11_lexical": _OP11,
    "op12_topk": _OP12,
    "op13_clusters": _clusters_sql(3),
}
