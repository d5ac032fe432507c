"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from brineflow.llm import bpe, chat, decontaminate, divergence, idstore, jaccard, mixing, pii, quality, sharding, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_byte_bpe": bpe.op1_query,
        "op2_toxicity_cnn": toxicity.op2_query,
        "op3_pii_contexts": pii.op3_query,
        "op4_chat_masks": chat.op4_query,
        "op5_warc_chain": warc.op5_query,
        "op6_id_shards": idstore.op6_query,
        "op7_decontaminate": decontaminate.op7_query,
        "op8_line_frequency_rules": quality.op8_query,
        "op9_hilbert_shards": sharding.op9_query,
        "op10_jaccard_components": jaccard.op10_query,
        "op11_curriculum_mix": mixing.op11_query,
        "op12_residue_whitening": whitening.op12_query,
        "op13_source_divergence": divergence.op13_query,
    }


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
g3 AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS s FROM g),
r AS (SELECT rid, p FROM g3 QUALIFY count(*) OVER (PARTITION BY rid, s) >= 2),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY rid),
l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY rid),
nl AS (SELECT rid, host, trim(lower(line), ' ') AS line, length(line) AS n FROM lw),
above AS (SELECT host, line FROM (SELECT DISTINCT d.doc_id, d.t, nl.host, nl.line FROM nl JOIN d USING (rid)) GROUP BY ALL HAVING count(*) > 20),
lost AS (SELECT rid, sum(n) AS n FROM nl SEMI JOIN above USING (host, line) GROUP BY rid),
total AS (SELECT rid, sum(length(line)) AS n FROM l GROUP BY rid),
f AS (SELECT d.rid, doc_id, len(ws)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  100 * coalesce(lost.n, 0) > 50 * total.n AS depleted
  FROM d JOIN w USING (rid) JOIN total USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept
FROM f
"""


OP7_SQL = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(ws[p:p + size - 1], ' ') AS win FROM (SELECT item, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
dw AS (SELECT rid, p, size, array_to_string(ws[p:p + size - 1], ' ') AS win FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
h AS (SELECT rid, p, size, item FROM dw JOIN bw USING (size, win)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS h, g FROM (SELECT doc_id, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS p FROM d WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) c ON c.node = d.doc_id
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][turn % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, (ratio, turn)) FROM l WHERE level <= ratio)) AS target FROM l),
c AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS goal, sum(size) OVER (PARTITION BY d.source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(size, goal - place)) + greatest(0, least(size, goal - source_size - place)))::BIGINT AS taken FROM c
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL) USING (lang, source)),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.v) AS p,
  1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_jaccard_components": OP10_SQL, "op11_curriculum_mix": OP11_SQL, "op13_source_divergence": OP13_SQL, "op4_chat_masks": OP4_SQL, "op5_warc_chain": OP5_SQL, "op7_decontaminate": OP7_SQL, "op8_line_frequency_rules": OP8_SQL}
