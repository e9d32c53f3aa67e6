"""DuckDB SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM worded, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sizes s ON s.doc_id = u JOIN sizes t ON t.doc_id = v WHERE 100 * both_have >= 80 * (s.n + t.n - both_have)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least_id AS (
  SELECT u, min(v) AS root FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.u = d.doc_id
"""

OP3 = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS most FROM per_source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level, row_number() OVER (ORDER BY most / weight, rank) AS turn
  FROM weighed WINDOW earlier AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, coalesce(first_value(CASE WHEN level * weight <= most THEN level END IGNORE NULLS) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS open_level FROM levels
), goals AS (
  SELECT source, rank, source_size, least(most, open_level * weight) AS target FROM opened
), queued AS (
  SELECT s.*, g.rank, g.source_size, g.target, sum(s.size) OVER (PARTITION BY g.rank ORDER BY ('0x' || s.key[1:4])::INT % 512, s.key, s.size, s.r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT r, rank, size, target, start + c * source_size AS begin, least(greatest(floor(target) - (start + c * source_size), 0), size) AS head FROM queued, (VALUES (0), (1)) AS t(c) WHERE size > 0
), packets AS (
  SELECT r, rank, head AS words, begin + head AS done, target FROM copies UNION ALL SELECT r, rank, size - head, begin + size, target FROM copies
), ordered AS (
  SELECT r, words, coalesce(sum(words) OVER (ORDER BY done / target, rank, done ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM packets WHERE words > 0
), served AS (
  SELECT r, sum(least(greatest((SELECT round(sum(target)) FROM goals) - ahead, 0), words))::BIGINT AS taken FROM ordered GROUP BY r
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(s.taken, 0)::BIGINT AS taken FROM queued q LEFT JOIN served s USING (r)
"""

OP5 = r"""
WITH RECURSIVE rows_of AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), usable AS (
  SELECT * FROM rows_of
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.r AS u, b.r AS v FROM usable a JOIN usable b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.93 ELSE false END
), reach AS (
  SELECT r AS u, r AS v FROM usable UNION SELECT p.u, l.v FROM reach p JOIN links l ON l.u = p.v
), least_id AS (
  SELECT p.u, min(w.vec_id) AS root FROM reach p JOIN rows_of w ON w.r = p.v GROUP BY p.u
), counted AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id)::BIGINT AS component_id, coalesce(vec_id = coalesce(root, vec_id), false) AS kept
FROM rows_of w LEFT JOIN least_id l ON l.u = w.r LEFT JOIN counted c ON c.u = w.r
"""

OP6 = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {FOLD}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fitting USING (r)
"""

OP10 = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS g FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0
), places AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM worded, (SELECT DISTINCT k FROM windows) AS ks, unnest(generate_series(1, len(w) - k + 1)) AS t(i)
), found AS (
  SELECT r, i, k, item_id FROM places JOIN windows USING (k, g)
), hit AS (
  SELECT r, count(DISTINCT i + j) AS n_hit FROM found, unnest(generate_series(0, k - 1)) AS t(j) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP11 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(place, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) // 2, 3988292384::BIGINT * (xor(a, x) % 2))), 4294967295::BIGINT) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, unnest(generate_series(1, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM damaged
), faulty AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS earlier FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows_left FROM faulty GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), steps(conv_id, n, state, cost, audit, told) AS (
  SELECT conv_id, 0::BIGINT, s.state, s.cost, s.audit, s.told FROM ids, (VALUES (0, 0, '', ''), (2, 3, 'I', 'user:'), (3, 6, 'II', 'user:' || chr(10) || 'assistant:')) AS s(state, cost, audit, told)
  UNION ALL
  SELECT conv_id, n, state, best.c, best.a, best.t FROM (
    SELECT conv_id, n, state, min({'c': cost, 'a': audit, 't': told}) AS best FROM (
      WITH kept AS (
        SELECT p.conv_id, f.n, 'D' AS e, p.state AS state, p.cost + 4 AS cost, p.audit || 'D' AS audit, p.told FROM steps p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1
        UNION ALL
        SELECT p.conv_id, f.n, m.e, m.later, p.cost + CASE WHEN m.e = 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, p.audit || m.e,
          p.told || CASE WHEN p.state = 0 THEN '' ELSE chr(10) END || CASE WHEN m.e = 'K' THEN f.role WHEN m.later = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text
        FROM steps p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1
        JOIN (VALUES ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2), ('K', 'u', 3, 2), ('K', 'a', 2, 3), ('R', '', 0, 2), ('R', '', 1, 2), ('R', '', 3, 2), ('R', '', 2, 3)) AS m(e, initial, before, later)
          ON m.before = p.state AND (m.e = 'R' OR m.initial = f.initial)
        WHERE f.fault NOT IN ('blank', 'duplicate')
      )
      SELECT conv_id, n, state, cost, audit, told FROM kept
      UNION ALL
      SELECT conv_id, n, i.later, cost + 3 * length(i.e), audit || i.e, kept.told || CASE WHEN state = 0 THEN '' ELSE chr(10) END || i.told
      FROM kept JOIN (VALUES (0, 2, 'I', 'user:'), (1, 2, 'I', 'user:'), (3, 2, 'I', 'user:'), (2, 3, 'I', 'assistant:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:')) AS i(before, later, e, told) ON i.before = kept.state
    ) GROUP BY conv_id, n, state
  )
), ends AS (
  SELECT s.conv_id, min({'c': s.cost, 'a': s.audit, 't': s.told}) AS best FROM steps s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.state IN (0, 3) AND s.n = coalesce(c.rows_left, 0) GROUP BY s.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  e.best.c::BIGINT AS cost, e.best.a AS audit, sha256(e.best.t) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


#: The given pages have one article element each and references of a few sorts: on them the article's lines are within SQL's reach, the alignment isn't.
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PLAIN = "regexp_replace(line, '<[^>]*>', '', 'g')"
for _entity, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
    _PLAIN = f"regexp_replace({_PLAIN}, '&{_entity};?', '{_char}', 'g')"
OP12 = f"""
WITH lines AS (
  SELECT page_id, url, row_number() OVER () AS r, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1|br)[^>]*>') AS parts FROM pages
), texts AS (
  SELECT page_id, url, r, array_to_string(list_filter(list_transform(parts, lambda line: trim(regexp_replace({_PLAIN}, '{_SPACE}', ' ', 'g'))), lambda t: t <> ''), ' ') AS text FROM lines
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


def _clusters(k: int, rounds: int) -> str:
    """Every round is the same two tables: each vector's nearest centroid, and the centroids' components after it."""
    parts = [
        """kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS MATERIALIZED (
  SELECT r, i, v[i] AS x FROM kept, unnest(generate_series(1, 64)) AS t(i)
), started AS (
  SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept
), c0 AS MATERIALIZED (
  SELECT c, i, x FROM started JOIN flat USING (r) WHERE c < """ + str(k) + "\n)"
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (\n  SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, sum((f.x - m.x) * (f.x - m.x))::BIGINT AS d FROM flat f JOIN c{n} m ON m.i = f.i GROUP BY r, c) GROUP BY r\n)")
        if n < rounds:
            moved = f"SELECT best.c AS c, i, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS x FROM a{n} JOIN flat USING (r) GROUP BY best.c, i"
            parts.append(f"c{n + 1} AS MATERIALIZED (\n  SELECT o.c, o.i, coalesce(w.x, o.x)::BIGINT AS x FROM c{n} o LEFT JOIN ({moved}) w ON w.c = o.c AND w.i = o.i\n)")
    last = f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c) g ON g.c = best.c
"""
    return "WITH " + ", ".join(parts) + last


OP13 = _clusters(8, 10)

ORACLE_SQL = {"op2_ngram_jaccard": OP2, "op3_mix_sources": OP3, "op5_embeddings": OP5, "op6_url_filters": OP6, "op10_decontaminate": OP10, "op11_conversations": OP11, "op12_main_text": OP12, "op13_clusters": OP13}
