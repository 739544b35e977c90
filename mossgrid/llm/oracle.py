"""SQL counterparts of the queries that SQL can express on whole tables.

Texts are windowed, records matched, related and brought to canonical form by plain SQL. The
other problems' results have no short SQL and are tested against brute force.
"""

from __future__ import annotations

# Records with their files, answer words and question words, by pairs of one training and one other row.
OVERLAPS = r"""n AS (
  SELECT rec_id, split_dir, list_sort(list_distinct(regexp_extract_all(lower(ImageName), '[^/\\\[\]\s"'',]+\.[a-z0-9]+'))) AS f,
    regexp_extract_all(lower(Answer), '[\p{L}\p{N}]+') AS a, list_distinct(regexp_extract_all(lower(Question), '[\p{L}\p{N}]+')) AS q FROM questions),
k AS (SELECT * FROM n WHERE len(f) > 0 AND len(a) > 0 AND len(q) > 0),
o AS (SELECT t.rec_id AS train_id, e.rec_id AS eval_id FROM k t JOIN k e ON t.f = e.f AND t.a = e.a
  WHERE t.split_dir = 'training' AND e.split_dir <> 'training' AND len(list_intersect(t.q, e.q)) * 5 >= 4 * greatest(len(t.q), len(e.q)))"""

# Canonical form of lines: c(raw_id, c).
LETTERS, MARKS = r"\p{L}\p{M}\p{N}", r"\x01-\x07"


def _canonical(x: str) -> str:
    x = rf"regexp_replace({x}, '(^|[^{LETTERS}])[-−](\.?\p{{N}})', '\1' || chr(4) || '\2', 'g')"
    for _ in range(2):  # neighbouring places share a digit
        x = rf"regexp_replace({x}, '(\p{{N}})\.(\p{{N}})', '\1' || chr(5) || '\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{N}})[^{LETTERS}{MARKS}]+(\p{{N}})', '\1' || chr(6) || '\2', 'g')"
    return rf"regexp_replace({x}, '[^{LETTERS}{MARKS}]+', '', 'g')"


def _image(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(lower({x}), ' ' || chr(9) || chr(10) || chr(13)), '[/\\]+', '/', 'g'), '^(\./)+', '')"


LINES = rf"""v AS (SELECT raw_id, record::JSON AS j FROM raw_records WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
k AS (SELECT raw_id, j, unnest(json_keys(j)) AS key FROM v),
p AS (SELECT raw_id, regexp_replace(lower(key), '[^{LETTERS}]+', '', 'g') AS k, json_extract(j, '$."' || key || '"') AS x, json_extract_string(j, '$."' || key || '"') AS s FROM k),
o AS (SELECT raw_id, k, CASE WHEN k <> 'imagename' THEN {_canonical('lower(s)')} WHEN json_type(x) = 'ARRAY'
    THEN array_to_string(list_transform(x::VARCHAR[], lambda f: {_image('f')}), chr(3)) ELSE {_image('s')} END AS t FROM p),
c AS (SELECT raw_id, string_agg(k || chr(1) || coalesce(t, chr(7)), chr(2) ORDER BY k) AS c FROM o GROUP BY raw_id)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {OVERLAPS} SELECT least(train_id, eval_id) AS rec_id_a, greatest(train_id, eval_id) AS rec_id_b FROM o",
    "p1_report": f"""WITH {OVERLAPS}, h AS (SELECT eval_id AS rec_id, count(*) AS n_pairs FROM o GROUP BY ALL)
SELECT split_dir, dataset, count(*) AS n_records, count(n_pairs) AS n_overlapping, coalesce(sum(n_pairs), 0)::BIGINT AS n_pairs
FROM questions LEFT JOIN h USING (rec_id) WHERE split_dir <> 'training' GROUP BY ALL""",
    "p2_found": """WITH q AS (SELECT translate(lower(trim(Modality)), '-_', '  ') AS m, translate(lower(trim(TaskType)), '-_', '  ') AS t FROM questions),
c AS (SELECT m, t, count(*) AS n FROM q GROUP BY ALL), z AS (SELECT count(*) // 10 AS size FROM questions)
SELECT g.Modality, g.TaskType FROM category_targets g CROSS JOIN z
LEFT JOIN c ON c.m = translate(lower(trim(g.Modality)), '-_', '  ') AND c.t = translate(lower(trim(g.TaskType)), '-_', '  ')
WHERE coalesce(c.n, 0) < greatest(g.min_rows, (g.target_permille * z.size + 999) // 1000)""",
    "p3_found": f"WITH {LINES}, g AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY c) AS first_id FROM c) SELECT first_id, raw_id FROM g WHERE raw_id <> first_id",
    "p3_collapsed": f"WITH {LINES} SELECT min(raw_id) AS first_id, count(*) AS n_copies, count(DISTINCT record) AS n_writings FROM c JOIN raw_records USING (raw_id) GROUP BY c",
    # Labels of studies fall to the least one of their neighbours until none does.
    "p4_found": r"""WITH RECURSIVE n AS (SELECT rec_id, list_distinct(list_transform(regexp_extract_all(lower(ImageName), '[^/\\\[\]\s"'',]+\.[a-z0-9]+'),
    lambda f: CASE WHEN contains(f, '_') THEN regexp_replace(f, '_[^_]*$', '') ELSE regexp_replace(f, '\.[^.]*$', '') END)) AS ks FROM questions),
r AS (SELECT rec_id, list_min(ks) AS k FROM n WHERE len(ks) > 0),
e AS (SELECT DISTINCT r.k AS a, u.k AS b FROM r JOIN (SELECT rec_id, unnest(ks) AS k FROM n) u USING (rec_id) WHERE r.k <> u.k),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, label) USING KEY (node) AS (SELECT DISTINCT k, k FROM r UNION
  SELECT l.b, min(c.label) FROM c JOIN l ON l.a = c.node JOIN recurring.c AS old ON old.node = l.b WHERE c.label < old.label GROUP BY l.b),
g AS (SELECT rec_id, label, count(*) OVER (PARTITION BY label) AS n FROM r JOIN c ON c.node = r.k)
SELECT rec_id, label AS group_key FROM g WHERE n >= 2""",
    "p9_found": """WITH w AS (SELECT doc_id, s, md5(substr(text, s, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS s FROM documents WHERE length(text) >= 200)),
h AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
x AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM w SEMI JOIN h USING (h))
SELECT doc_id, sum(CASE WHEN b IS NULL OR s - b >= 200 THEN 200 ELSE s - b END)::BIGINT AS shared_chars FROM x GROUP BY doc_id""",
}
