"""SQL for the training-data queries that SQL can express on whole tables."""

OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS v FROM n, unnest(range(0, n - 49)) AS t(s) WHERE n >= 50),
m AS (SELECT v, min(doc_id) AS f FROM w GROUP BY v),
r AS (SELECT doc_id, s, CASE WHEN s > 50 + lag(s) OVER (PARTITION BY doc_id ORDER BY s) THEN 1 ELSE 0 END AS new FROM w JOIN m USING (v) WHERE f < doc_id),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM r),
u AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY doc_id, k),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM u),
k AS (SELECT p.doc_id, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans FROM p JOIN n USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
c AS (SELECT k, n, min(doc_id) AS c FROM n WHERE n > 0 GROUP BY ALL),
x AS (SELECT doc_id, unnest(s) AS x FROM s WHERE doc_id IN (SELECT c FROM c)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN c p ON p.c = a JOIN c q ON q.c = b WHERE 100 * m >= 75 * (p.n + q.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT c AS node, c AS seen FROM c UNION SELECT t.node, e.b FROM t JOIN e ON e.a = t.seen),
f AS (SELECT node, min(seen) AS component FROM t GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(component, n.doc_id) AS component_id, coalesce(c.c, n.doc_id) AS class_id FROM n LEFT JOIN c ON n.k = c.k AND n.n = c.n LEFT JOIN f ON f.node = c.c
"""

def _tree(k: int) -> str:
    """Level k of the template tree: votes (u), members (b) and the children (n, then g of the next level)."""
    return rf"""
v{k} AS (SELECT m, g, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM g{k}),
u{k} AS (SELECT g, pos, word, votes, total FROM (SELECT g, pos, word, count(*) AS votes FROM v{k} GROUP BY ALL) JOIN (SELECT g, count(*) AS total FROM g{k} GROUP BY g) USING (g)),
h{k} AS (SELECT m, g, count(*) FILTER (2 * votes > total) >= 0.7 * count(*) AND count(*) FILTER (2 * votes > total AND word <> '<*>') > 0 AS member, max(struct_pack(votes := votes, pos := -pos, word := word)) FILTER (votes < total AND (votes > 1 OR 2 * votes > total)) AS next FROM v{k} JOIN u{k} USING (g, pos, word) GROUP BY m, g),
n{k} AS (SELECT g{k}.m, w, n, concat(g, chr(1), next.pos, ' ', next.word) AS g FROM g{k} JOIN h{k} USING (m, g) WHERE NOT member AND next IS NOT NULL),
g{k + 1} AS (SELECT n{k}.* FROM n{k} JOIN (SELECT g FROM n{k} GROUP BY g HAVING count(*) > 1 AND sum(n) >= 5) USING (g)),"""


OP7_SQL = rf"""
WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
q AS (SELECT doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p),
m AS (SELECT *, trim(regexp_replace(regexp_replace(line, '[^\s]*[0-9][^\s]*', '<*>', 'g'), '[\t\r ]+', ' ', 'g')) AS m FROM q),
z AS (SELECT *, string_split(m, ' ') AS w FROM m),
y AS (SELECT DISTINCT doc_id, text, m, w, len(w) || ' ' || array_to_string(w[1:4], ' ') AS leaf FROM z WHERE len(w) >= 3 AND trim(replace(m, '<*>', '')) <> ''),
t AS (SELECT m, w, leaf, text, min(doc_id) AS d FROM y GROUP BY ALL),
c AS (SELECT m, w, leaf, count(*) AS n, min(d) AS first_doc FROM t GROUP BY ALL),
g0 AS (SELECT m, w, n, leaf AS g FROM c JOIN (SELECT leaf FROM c GROUP BY leaf HAVING count(*) > 1 AND sum(n) >= 5) USING (leaf)),{"".join(map(_tree, range(4)))}
b AS ({" UNION ALL ".join(f"SELECT m, g FROM h{k} WHERE member" for k in range(4))}),
s AS (SELECT b.g, t.text, min(d) AS d FROM b JOIN t ON t.m = b.m GROUP BY ALL),
f AS (SELECT g, min(d) AS first_doc FROM s GROUP BY g HAVING count(*) >= 5),
r AS (SELECT m, min(first_doc) AS first_doc FROM (SELECT m, first_doc FROM c WHERE n >= 5 UNION ALL SELECT b.m, f.first_doc FROM b JOIN f USING (g)) GROUP BY m),
k AS (SELECT z.doc_id, z.i, z.line, r.m IS NOT NULL AND z.doc_id <> r.first_doc AS gone FROM z LEFT JOIN r ON r.m = z.m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
"""

CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM g
"""

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS edge FROM s),
l AS (SELECT *, (sum(1.5 * source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT max(level) FROM l WHERE level <= edge), CAST('inf' AS DOUBLE))) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
