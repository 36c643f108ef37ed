"""The SQL twin of the n-gram Jaccard join: all pairs that share a shingle, for tables small enough for that."""

from gristmill.llm.common import LOWER, UPPER

OP13_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT place, doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS MATERIALIZED (SELECT min(place) AS node, g, len(g) AS size FROM s WHERE len(g) > 0 GROUP BY g),
x AS MATERIALIZED (SELECT node, hash(shingle) AS h, shingle FROM (SELECT node, unnest(g) AS shingle FROM n)),
c AS (SELECT a.node AS a, b.node AS b, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.shingle = b.shingle AND a.node < b.node GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.node = a JOIN n q ON q.node = b WHERE 100 * common >= 90 * (p.size + q.size - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) USING KEY (node) AS (SELECT node, node FROM n UNION
  SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS now ON now.node = e.b WHERE r.root < now.root GROUP BY e.b),
m AS (SELECT s.doc_id, len(s.g) AS size, r.root FROM s JOIN n ON n.g = s.g JOIN r ON r.node = n.node)
SELECT doc_id, size::BIGINT AS n_shingles, min(doc_id) OVER (PARTITION BY root) AS component_id FROM m UNION ALL SELECT doc_id, 0, doc_id FROM s WHERE len(g) = 0
"""
