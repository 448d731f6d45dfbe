"""DuckDB SQL of those registered queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr
  FROM docs),
cut AS (
  SELECT DISTINCT rid, line, regexp_split_to_array(regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g'), '[ \t\r]+') AS toks
  FROM lines WHERE regexp_matches(line, '[^ \t\r]')),
leafed AS (
  SELECT rid, line, toks,
         concat(len(toks), chr(2), array_to_string(list_transform(toks[1:3], lambda t:
           CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), chr(1))) AS leaf
  FROM cut),
hot AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT rid) >= 5),
held AS (SELECT * FROM leafed WHERE leaf IN (SELECT leaf FROM hot)),
uniq AS (SELECT leaf, line, any_value(toks) AS toks, count(*) AS n_docs FROM held GROUP BY leaf, line),
placed AS (SELECT leaf, line, n_docs, unnest(toks) AS token, generate_subscripts(toks, 1) AS place FROM uniq),
fixed AS (
  SELECT leaf, place, token FROM placed WHERE NOT regexp_matches(token, '[0-9]')
  GROUP BY leaf, place, token HAVING sum(n_docs) >= 5),
made AS (
  SELECT p.leaf, p.line,
         string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.place) AS template,
         count(f.token) AS n_fixed, count(*) AS n_tokens
  FROM placed p LEFT JOIN fixed f ON f.leaf = p.leaf AND f.place = p.place AND f.token = p.token
  GROUP BY p.leaf, p.line),
seen AS (
  SELECT h.rid, h.line, m.leaf, m.template FROM held h JOIN made m ON m.leaf = h.leaf AND m.line = h.line
  WHERE m.n_fixed >= 0.5 * m.n_tokens),
recurring AS (SELECT leaf, template FROM seen GROUP BY leaf, template HAVING count(DISTINCT rid) >= 5),
gone AS (SELECT DISTINCT s.rid, s.line FROM seen s JOIN recurring r ON r.leaf = s.leaf AND r.template = s.template)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN 0 ELSE count(*) END AS n_lines,
       CASE WHEN d.text IS NULL THEN 0 ELSE count(g.line) END AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.nr) FILTER (WHERE g.line IS NULL), '') AS text
FROM docs d JOIN lines l ON l.rid = d.rid LEFT JOIN gone g ON g.rid = l.rid AND g.line = l.line
GROUP BY d.rid, d.doc_id, d.text
""",
    "op10_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
