"""SQL that gives the registered queries' results, for an independent engine."""

from .. import schemas as S

_WS = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_EUC = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"
_NOISY = "noisy AS (SELECT doc_id, chr(9679) || chr(8203) || replace(replace(replace(text, '. ', '.' || chr(160)), ' the ', ' ' || chr(8220) || 'the' || chr(8221) || ' '), ', ', ' ' || chr(8211) || ' ') AS text FROM documents)"
_STRIP = f"regexp_replace(%s, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_PAGES = "pages_ AS (SELECT 'c' || conv_id AS doc, CAST(turn + 1 AS INTEGER) AS page, upper(role[1]) || role[2:] || chr(10) || chr(10) || text AS text FROM conversations)"
_SPANS = f"{_PAGES}, spans AS (SELECT doc, page, text, sum(length(text) + 2) OVER (PARTITION BY doc ORDER BY page) - length(text) - 2 AS start FROM pages_)"
_ORDERS = """orders_ AS (SELECT 'o' || l_orderkey AS doc, '1. Summary:' || chr(10) || 'Order ' || l_orderkey || ' has lines.' || chr(10) || '2. Line items:' || chr(10) || 'a. Detail' || chr(10)
  || '| no | quantity | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || CAST(l_quantity AS INTEGER) || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, '| ' || l_linenumber || ' | ' || CAST(l_quantity AS INTEGER) || ' | ' || l_returnflag || ' |')
  || chr(10) || '3. Notes:' || chr(10) || 'None.' AS text, count(*) AS n FROM lineitem GROUP BY l_orderkey)"""


def _windows(key: str, source: str, size: int = 500, step: int = 450) -> str:
    return f"""cuts AS (SELECT {key}, text, i * {step} AS at_ FROM {source}, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT)))) AS s(i) WHERE length(text) > 0),
raw AS (SELECT {key}, at_, substring(text, CAST(at_ + 1 AS BIGINT), {size}) AS body FROM cuts),
windows AS (SELECT {key}, CAST(at_ + length(body) - length(regexp_replace(body, '^[{_WS}]+', '')) AS BIGINT) AS start, regexp_replace(body, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS body FROM raw)"""


#: Fixed chunks of documents, of which none has a heading or a line-wise table: windows of the stripped text.
_FIXED = f"""bare AS (SELECT doc_id, {_STRIP % "text"} AS text, length(text) - length(regexp_replace(text, '^[{_WS}]+', '')) AS lead FROM documents), {_windows('doc_id', 'bare')},
fixed AS (SELECT w.doc_id, CAST(w.doc_id AS VARCHAR) AS doc, 'fixed-' || w.doc_id || '-' || printf('%03d', row_number() OVER (PARTITION BY w.doc_id ORDER BY start)) AS chunk_id, CAST(start + lead AS INTEGER) AS char_start, CAST(start + lead + length(body) AS INTEGER) AS char_end, body,
  string_split(body, chr(10)) AS lines FROM windows w JOIN bare USING (doc_id) WHERE body <> '')"""


def _top(score: str, order: str, k: int) -> str:
    return f"""WITH s AS (SELECT b.vec_id, {score} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0),
r AS (SELECT CAST(row_number() OVER (ORDER BY score {order}, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


_WHITE = f"array_to_string(list_transform(string_split(text, chr(10)), lambda l: (CASE WHEN starts_with(l, '  - ') THEN '  ' ELSE '' END) || regexp_replace(regexp_replace(l, '[ \\t]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g')), chr(10))"
_BULLET = f"regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*o\\x{{200b}}[{_WS}\\x{{200b}}]*', '  - ', 'g'), '(?m)^[ \\t]*\\x{{25cb}}[{_WS}\\x{{200b}}]*', '  - ', 'g'), '(?m)^[ \\t]*[\\x{{25cf}}\\x{{2022}}\\x{{25aa}}][{_WS}\\x{{200b}}]*', '- ', 'g')"
_CHARS = "translate(text, chr(8203) || chr(160) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173), '  ''''\"\"--')"

SQL = {
    "topk_cosine": _top(_COS, "DESC", 10),
    "topk_euclidean": _top(_EUC, "ASC", 10),
    "all_scores_ranked": f"""WITH s AS (SELECT b.vec_id, {_COS} AS c, {_EUC} AS e FROM embeddings a, embeddings b WHERE a.vec_id = 0)
SELECT vec_id, round(c, 6) AS cosine, round(e, 6) AS euclidean, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank_cosine, CAST(row_number() OVER (ORDER BY e, vec_id) AS INTEGER) AS rank_euclidean FROM s""",
    "multi_query_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "knn_edges_k3": f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n FROM s)
SELECT DISTINCT least(q, vec_id) AS src, greatest(q, vec_id) AS dst FROM r WHERE n <= 3""",
    "pair_similarity": f"""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm_a,
round(sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS norm_b, round({_COS}, 6) AS cosine, round({_EUC}, 6) AS euclidean FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1""",
    "vector_norm_stats": "SELECT count(*) AS n, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS min_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS max_norm FROM embeddings",
    "vector_dims": "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "vector_validation": "SELECT CASE WHEN vec_id % 3 <> 0 THEN 'none' ELSE ['json', 'list', 'length', 'values', 'model'][vec_id % 5 + 1] END AS fault, count(*) AS n FROM embeddings GROUP BY 1",
    "ingest_new": "SELECT count(*) AS inserted, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id % 2 = 1",
    "metadata_roundtrip": "SELECT count(*) AS same, count(*) AS n FROM embeddings",
    "indexed_search": f"""WITH s AS (SELECT b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0),
r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT rank, vec_id, round(1 - score, 6) + 0.0 AS distance FROM r WHERE rank <= 5""",
    "normalize_characters": f"WITH {_NOISY} SELECT doc_id, {_CHARS} AS text FROM noisy",
    "normalize_bullets": f"WITH {_NOISY} SELECT doc_id, {_BULLET} AS text FROM noisy",
    "normalize_whitespace": f"WITH {_NOISY} SELECT doc_id, {_WHITE} AS text FROM noisy",
    "collapse_blank_lines": f"WITH {_NOISY} SELECT doc_id, {_STRIP % "regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')"} AS text FROM noisy",
    "slugs": f"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '_') AS snake,
{_STRIP % f"regexp_replace(p_name, '[{_WS}]+', ' ', 'g')"} AS squash FROM part""",
    "stitch_documents": f"WITH {_PAGES} SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS pages FROM pages_ GROUP BY doc",
    "page_spans": f"WITH {_SPANS} SELECT doc, page, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS \"end\" FROM spans",
    "doc_char_totals": f"WITH {_PAGES} SELECT doc, count(*) FILTER (page <> 2) AS kept_pages, CAST(coalesce(sum(length(text)) FILTER (page <> 2), 0) AS BIGINT) AS chars FROM pages_ GROUP BY doc",
    "lines_with_offsets": f"""WITH {_ORDERS}, parts AS (SELECT doc, string_split(text, chr(10)) AS p FROM orders_),
rows_ AS (SELECT doc, i, p[i] AS line FROM parts, unnest(generate_series(1, len(p))) AS s(i))
SELECT doc, CAST(i - 1 AS INTEGER) AS n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY i) - length(line) - 1 AS BIGINT) AS start, line FROM rows_""",
    "table_regions": f"""WITH {_ORDERS}, parts AS (SELECT doc, string_split(text, chr(10)) AS p FROM orders_),
rows_ AS (SELECT doc, i, p[i] AS line FROM parts, unnest(generate_series(1, len(p))) AS s(i)),
at_ AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY i) AS stop, starts_with(line, '|') AS is_table FROM rows_),
flag AS (SELECT *, CASE WHEN is_table IS DISTINCT FROM lag(is_table) OVER (PARTITION BY doc ORDER BY i) THEN 1 ELSE 0 END AS new FROM at_),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY i) AS run FROM flag)
SELECT doc, is_table, CAST(min(stop - length(line) - 1) AS BIGINT) AS start, CAST(max(stop - 1) AS BIGINT) AS "end" FROM runs GROUP BY doc, run, is_table""",
    "table_to_markdown": "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "table_info": f"WITH {_ORDERS} SELECT doc, 'no,quantity,flag' AS columns, n AS n_rows FROM orders_",
    "fixed_windows": f"WITH {_windows('doc_id', 'documents')} SELECT doc_id, start, start + length(body) AS \"end\", md5(body) AS md5 FROM windows WHERE body <> ''",
    "fixed_chunks": f"""WITH {_FIXED} SELECT chunk_id, doc AS section, 1 AS page_start, 1 AS page_end, char_start, char_end, char_end - char_start AS char_count, len(list_filter(lines, lambda x: starts_with(x, '|'))) > 0 AS has_table, md5(doc || chr(10) || chr(10) || body) AS md5 FROM fixed""",
    "chunk_quality": f"""WITH {_FIXED}, f AS (SELECT *, ends_with(chunk_id, '-003') AS gone FROM fixed),
bars AS (SELECT chunk_id, i, lines[i] AS line, i - row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS run FROM f, unnest(generate_series(1, len(lines))) AS s(i) WHERE NOT gone AND starts_with(lines[i], '|')),
poor AS (SELECT chunk_id FROM bars GROUP BY chunk_id, run HAVING count(*) <= 2 OR list_contains(list_transform(string_split(regexp_replace(trim(arg_min(line, i)), '^\\|+|\\|+$', '', 'g'), '|'), lambda x: trim(x)), ''))
SELECT 'missing' AS rule, 'error' AS severity, count(*) AS n FROM f WHERE gone HAVING count(*) > 0
UNION ALL SELECT 'page_order', 'error', count(*) FROM f WHERE ends_with(chunk_id, '-002') HAVING count(*) > 0
UNION ALL SELECT 'table_empty', 'note', count(DISTINCT chunk_id) FROM poor HAVING count(*) > 0
UNION ALL SELECT 'no_heading', 'note', count(*) FROM f WHERE NOT gone AND len(list_filter(lines, lambda x: starts_with(x, doc) AND regexp_matches(x[len(doc) + 1:len(doc) + 2], '^\\.?\\s'))) = 0 HAVING count(*) > 0
UNION ALL SELECT 'short', 'note', count(*) FROM f WHERE NOT gone AND length(body) < @SHORT HAVING count(*) > 0
UNION ALL SELECT 'document_fields', 'note', count(DISTINCT doc) FROM f WHERE NOT gone HAVING count(*) > 0""".replace("@SHORT", str(S.SHORT)),
    "knn_degree_by_label": f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n FROM s),
e AS (SELECT DISTINCT least(q, vec_id) AS src, greatest(q, vec_id) AS dst FROM r WHERE n <= 3),
d AS (SELECT src AS vec_id FROM e UNION ALL SELECT dst FROM e)
SELECT label, count(*) AS degree FROM d JOIN embeddings USING (vec_id) GROUP BY label""",
    "plain_outline": f"""WITH {_PAGES}, docs AS (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc), parts AS (SELECT doc, string_split(text, chr(10)) AS p FROM docs),
rows_ AS (SELECT doc, i, p[i] AS line, sum(length(p[i]) + 1) OVER (PARTITION BY doc ORDER BY i) - length(p[i]) - 1 AS start, lag(p[i]) OVER w AS before, lead(p[i]) OVER w AS after FROM parts, unnest(generate_series(1, len(p))) AS s(i) WINDOW w AS (PARTITION BY doc ORDER BY i))
SELECT doc, trim(line) AS label, CAST(start AS BIGINT) AS start FROM rows_ WHERE coalesce(trim(before), '') = '' AND coalesce(trim(after), '') = '' AND trim(line) <> ''
AND len(list_filter(string_split(line, ' '), lambda x: x <> '')) BETWEEN 1 AND 6 AND regexp_matches(line, '^\\p{{Lu}}') AND NOT regexp_matches(line, '[.:;,?!]$') AND NOT contains(line, '|') AND NOT regexp_matches(line, '^Part\\s+\\d+\\b')""",
    "numbered_outline": f"""WITH {_ORDERS}, h AS (SELECT doc, unnest([{{'b': '1. Summary', 'd': 1}}, {{'b': '2. Line items', 'd': 1}}, {{'b': '2. Line items > a. Detail', 'd': 2}}, {{'b': '3. Notes', 'd': 1}}]) AS x FROM orders_)
SELECT doc, doc || ' > ' || x.b AS breadcrumb, CAST(x.d AS BIGINT) AS depth FROM h""",
    "chunk_pages": f"""WITH {_SPANS}, docs AS (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc), {_windows('doc', 'docs')}
SELECT w.doc, w.start, string_agg(CAST(s.page AS VARCHAR), ',' ORDER BY s.page) AS pages FROM windows w JOIN spans s ON s.doc = w.doc AND s.start < w.start + length(w.body) AND w.start < s.start + length(s.text) WHERE w.body <> '' GROUP BY w.doc, w.start""",
    "raw_and_clean": f"WITH {_PAGES} SELECT doc, page, CASE WHEN page % 3 = 0 THEN 'SKIPPED' ELSE 'KEPT' END AS status, CAST(length(text) AS BIGINT) AS raw_chars, CASE WHEN page % 3 <> 0 THEN CAST(length(text) AS BIGINT) END AS clean_chars FROM pages_",
    "body_text": """WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag || (CASE WHEN l_linenumber % 2 = 0 THEN ' | ' ELSE chr(10) END) || l_linestatus AS body,
  l_linenumber * 20 AS y0, l_returnflag, l_linestatus, l_linenumber * 20 + 10 + (CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 6 END) AS y1 FROM lineitem),
g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS gap FROM b)
SELECT l_orderkey, string_agg((CASE WHEN gap IS NULL THEN '' WHEN gap < 7 THEN chr(10) ELSE chr(10) || chr(10) END) || body, '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS text FROM g GROUP BY l_orderkey""",
    "cover_text": "SELECT s_suppkey, 'Document: ' || chr(10) || 'Version: # ' || s_suppkey || chr(10) || chr(10) || 'Approvals:' || chr(10) || '- Process Owner: ' || s_name || chr(10) || chr(10) || 'Revision History:' || chr(10) || '- 1 (revised , effective ): first issue' AS text FROM supplier",
    "token_info": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{_WS}]+')) + 2 AS BIGINT) AS token_count, len(regexp_extract_all(text, '[^{_WS}]+')) + 2 > 256 AS truncated FROM documents",
    "label_colours": "SELECT vec_id, CAST((dense_rank() OVER (ORDER BY label) - 1) % 6 AS BIGINT) AS colour FROM embeddings",
}
