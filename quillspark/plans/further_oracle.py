"""SQL for the further queries, and for those whose result takes lists or chained cuts to describe."""

from .oracle import _FIXED, _NOISY, _ORDERS, _PAGES, _SPANS, _STRIP, _WS, SQL as BASE, _windows

_LSTRIP = f"regexp_replace(%s, '^[{_WS}]+', '')"
_BLANK = f"regexp_matches(%s, '^[{_WS}]*$')"
#: A line that begins a new item.
_ITEM = f"regexp_matches(%s, '^([{_WS}]*-[{_WS}]|\\||\\p{{Nd}}+\\.(\\p{{Nd}}+\\.?)*[{_WS}]|\\p{{Nd}}+-[A-Z]|[a-z]\\.[{_WS}]|Part[{_WS}]\\p{{Nd}}+[.:]|[A-Z][A-Za-z ()/&.-]{{0,30}}:([{_WS}]|$))')"


def _unwrap(text: str) -> str:
    """A left fold over the lines with their text so far, the last raw line and whether it was joined."""
    last, line = "a.last", "b.last"
    lone = f"regexp_matches({last}, '^[{_WS}]*-[{_WS}]*$')"
    bar = f"starts_with({_LSTRIP % last}, '|')"
    glue = f"(NOT {_BLANK % last} AND NOT {_BLANK % line} AND (({lone} AND NOT a.joined) OR NOT {_ITEM % line}) AND NOT ends_with({last}, ':') AND NOT ({bar} AND NOT a.joined))"
    start = f"list_transform(string_split({text}, chr(10)), lambda l: {{'out': l, 'last': l, 'joined': false}})"
    return f"list_reduce({start}, lambda a, b: {{'out': a.out || (CASE WHEN {glue} THEN ' ' || {_LSTRIP % line} ELSE chr(10) || {line} END), 'last': {line}, 'joined': {glue}}}).out"


def _body(name: str) -> str:
    """The expression of a base query over `text`."""
    return BASE[name].split("SELECT doc_id, ", 2)[2].rsplit(" AS text FROM noisy", 1)[0]


def _thin(source: str, size: int) -> str:
    """From each list of ends `e` on, after `a`: the farthest end within the size, again and again."""
    first = f"list_transform(e, lambda x: {{'done': []::BIGINT[], 'at': a, 'last': x}})"
    fold = f"list_reduce({first}, lambda p, q: CASE WHEN q.last - p.at <= {size} THEN {{'done': p.done, 'at': p.at, 'last': q.last}} ELSE {{'done': list_append(p.done, p.last), 'at': p.last, 'last': q.last}} END)"
    return f"SELECT doc, a, b, list_append({fold}.done, {fold}.last) AS e FROM {source}"


def _recursive(docs: str, size: int) -> str:
    """(doc, a, b): pieces of (doc, text) by paragraphs, lines, sentences, words and signs; every level is packed."""
    signs, out = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"], []
    out.append(f"p0 AS (SELECT doc, CAST(0 AS BIGINT) AS a, CAST(length(text) AS BIGINT) AS b FROM {docs} WHERE length(text) > 0)")
    for k, sign in enumerate(signs):
        # Pieces of level k that are too long, cut after each sign.
        out.append(f"s{k} AS (SELECT p.doc, p.a, p.b, string_split(substring(d.text, p.a + 1, p.b - p.a), {sign}) AS parts FROM p{k} p JOIN {docs} d ON d.doc = p.doc WHERE p.b - p.a > {size})")
        out.append(f"c{k} AS (SELECT doc, a AS pa, b AS pb, i, least(b, a + sum(length(parts[i]) + length({sign})) OVER (PARTITION BY doc, a, b ORDER BY i)) AS stop FROM s{k}, unnest(generate_series(1, len(parts))) AS g(i))")
        out.append(f"p{k + 1} AS (SELECT * FROM (SELECT doc, pa, pb, CAST(coalesce(lag(stop) OVER (PARTITION BY doc, pa, pb ORDER BY i), pa) AS BIGINT) AS a, CAST(stop AS BIGINT) AS b FROM c{k}) WHERE a < b)")
    # From the finest level up: the ends inside each piece, then those of its parent, packed.
    out.append(f"e4 AS (SELECT doc, pa, pb, a, b, list_append(list_filter(generate_series(a + {size}, b, {size}), lambda x: x < b), b) AS e FROM p4)")
    for k in (3, 2, 1, 0):
        out.append(f"u{k} AS (SELECT doc, pa AS a, pb AS b, flatten(list(e ORDER BY a)) AS e FROM e{k + 1} GROUP BY doc, pa, pb)")
        out.append(f"t{k} AS ({_thin(f'u{k}', size)})")
        parent = ", p.pa, p.pb" if k else ""
        out.append(f"e{k} AS (SELECT p.doc{parent}, p.a, p.b, coalesce(t.e, [p.b]) AS e FROM p{k} p LEFT JOIN t{k} t ON t.doc = p.doc AND t.a = p.a AND t.b = p.b)")
    out.append("pieces AS (SELECT doc, CAST(coalesce(lag(stop) OVER (PARTITION BY doc ORDER BY stop), 0) AS BIGINT) AS a, stop AS b FROM (SELECT doc, unnest(e) AS stop FROM e0))")
    return ", ".join(out)


_RECURSIVE = f"""WITH docs AS (SELECT doc_id AS doc, {_STRIP % "text"} AS text, length(text) - length({_LSTRIP % "text"}) AS lead FROM documents), {_recursive("docs", 500)},
raw AS (SELECT p.doc, a + lead AS a, substring(text, a + 1, b - a) AS raw FROM pieces p JOIN docs d ON d.doc = p.doc),
cut AS (SELECT doc, CAST(a + length(raw) - length({_LSTRIP % "raw"}) AS INTEGER) AS char_start, {_STRIP % "raw"} AS body FROM raw),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY char_start) AS n FROM cut WHERE body <> '')
SELECT 'recursive-' || doc || '-' || printf('%03d', n) AS chunk_id, CAST(doc AS VARCHAR) AS section, 1 AS page_start, 1 AS page_end, char_start, CAST(char_start + length(body) AS INTEGER) AS char_end, CAST(length(body) AS INTEGER) AS char_count,
  len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '|'))) > 0 AS has_table, md5(doc || chr(10) || chr(10) || body) AS md5 FROM n"""

#: Orders in three parts: what stands above the table, the table, what stands below it.
_PARTS = f"""{_ORDERS}, parts AS (SELECT doc, text, n, position('| no |' IN text) - 1 AS ta, position(chr(10) || '3. Notes' IN text) - 1 AS tb FROM orders_),
three AS (SELECT 'fixed' AS s, doc, 1 AS i, 0 AS a, ta - 1 AS b, false AS tab, true AS mixes FROM parts UNION ALL SELECT 'fixed', doc, 2, ta, tb, true, false FROM parts UNION ALL SELECT 'fixed', doc, 3, tb + 1, length(text), false, false FROM parts
  UNION ALL SELECT 'recursive', doc, 1, 0, length(text), true, true FROM parts UNION ALL SELECT 'section', doc, 1, 0, length(text), true, true FROM parts),
chunks AS (SELECT s, t.doc, i, a, b, tab, mixes, s || '-' || t.doc || '-' || printf('%03d', i) AS chunk_id, substring(text, a + 1, b - a) AS body FROM three t JOIN parts p ON p.doc = t.doc)"""

#: The same chunks without their texts, each document cut once.
_THREE = _PARTS[: _PARTS.index(",\nchunks AS")].replace("parts AS (", "parts AS MATERIALIZED (", 1).replace("three AS (", "three AS MATERIALIZED (", 1)

#: Vectors of texts by hashed tokens, in single precision.
_HASHED = f"""tok AS (SELECT k, id, lower(w) AS w FROM texts, unnest(regexp_extract_all(text, '[^{_WS}]+')) AS s(w)),
h AS (SELECT k, id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) AS h FROM tok),
v AS (SELECT k, id, h % 64 AS at_, CAST(sum(CASE WHEN (h >> 31) & 1 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM h GROUP BY ALL),
full_ AS (SELECT k, id, at_, x FROM v UNION ALL SELECT k, id, 0, 1.0 FROM texts WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.k = texts.k AND v.id = texts.id AND x <> 0)),
l AS (SELECT k, id, sqrt(sum(x * x)) AS n FROM full_ GROUP BY ALL),
u AS (SELECT full_.k, full_.id, at_, CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS x FROM full_ JOIN l ON l.k = full_.k AND l.id = full_.id WHERE n > 0),
z AS (SELECT k, id, sqrt(sum(x * x)) AS n FROM u GROUP BY ALL),
dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS dot FROM u q JOIN u d ON q.at_ = d.at_ WHERE q.k = 'q' AND d.k = 'd' GROUP BY ALL),
pairs AS (SELECT zq.id AS query_id, zd.id AS doc_id, coalesce(dot, 0) AS dot, zq.n AS nq, zd.n AS nd FROM z zq CROSS JOIN z zd LEFT JOIN dots ON dots.query_id = zq.id AND dots.doc_id = zd.id WHERE zq.k = 'q' AND zd.k = 'd')"""
_TEXTS = "texts AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark %s)"

_FIRST = "(SELECT item_id FROM benchmark ORDER BY item_id LIMIT 1)"
#: Rows of an order's table with the sizes of their lines.
_ROWSPLIT = f"""{_ORDERS}, t AS (SELECT doc, position('| no |' IN text) - 1 AS ta, substring(text, position('| no |' IN text), position(chr(10) || '3. Notes' IN text) - position('| no |' IN text)) AS body FROM orders_),
ls AS (SELECT doc, ta, body, string_split(body, chr(10)) AS p FROM t), top AS (SELECT *, p[1] || chr(10) || p[2] AS head FROM ls),
g AS (SELECT doc, ta, head, list_reduce(list_transform(p[3:], lambda x: {{'done': []::VARCHAR[], 'own': x}}),
  lambda a, b: CASE WHEN length(head) + length(a.own) + 1 + length(b.own) + 1 <= 80 THEN {{'done': a.done, 'own': a.own || chr(10) || b.own}} ELSE {{'done': list_append(a.done, a.own), 'own': b.own}} END) AS r FROM top WHERE length(body) > 80),
f AS (SELECT doc, ta, head, list_append(r.done, r.own) AS gs FROM g),
x AS (SELECT doc, ta, head, gs, i FROM f, unnest(generate_series(1, len(gs))) AS s(i))
SELECT doc, CAST(ta + length(head) + 1 + coalesce(list_sum(list_transform(gs[1:i - 1], lambda y: length(y) + 1)), 0) AS BIGINT) AS start, false AS whole, md5(head || chr(10) || gs[i]) AS md5 FROM x
UNION ALL SELECT doc, CAST(ta AS BIGINT), true, md5(body) FROM t WHERE length(body) <= 80"""

#: Orders longer than 120 signs: the two first parts by themselves or together, the table, the notes.
_SPLIT = f"""{_ORDERS}, p AS (SELECT doc, text, position('2. Line' IN text) - 1 AS two, position('| no |' IN text) - 1 AS ta, position('3. Notes' IN text) - 1 AS three FROM orders_),
c AS (SELECT doc, doc AS section, 0 AS a, length(text) AS b, text FROM p WHERE length(text) <= 120
UNION ALL SELECT doc, doc || ' > 1. Summary', 0, two - 1, text FROM p WHERE length(text) > 120
UNION ALL SELECT doc, doc || ' > 2. Line items', two, three - 1, text FROM p WHERE length(text) > 120 AND three - 1 - two <= 120
UNION ALL SELECT doc, doc || ' > 2. Line items > a. Detail', two, CASE WHEN three - 1 - two <= 120 THEN three - 1 ELSE ta - 1 END, text FROM p WHERE length(text) > 120 AND three - 1 - two > 120
UNION ALL SELECT doc, doc || ' > 2. Line items > a. Detail', ta, three - 1, text FROM p WHERE length(text) > 120 AND three - 1 - two > 120
UNION ALL SELECT doc, doc || ' > 3. Notes', three, length(text), text FROM p WHERE length(text) > 120)
SELECT 'section-' || doc || '-' || printf('%03d', row_number() OVER (PARTITION BY doc ORDER BY a)) AS chunk_id, section, CAST(a AS BIGINT) AS start, md5(substring(text, a + 1, b - a)) AS md5 FROM c"""

_CONV = f"""{_SPANS}, docs AS (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc), {_windows("doc", "docs")},
heads AS (SELECT doc, label, start FROM ({BASE["plain_outline"].replace("WITH " + _PAGES + ", docs AS", "WITH docs AS")})),
asof_ AS (SELECT w.doc, w.start, w.body, CASE WHEN h.label IS NULL THEN w.doc ELSE w.doc || ' > ' || h.label END AS section FROM windows w ASOF LEFT JOIN heads h ON w.doc = h.doc AND w.start >= h.start WHERE w.body <> ''),
numbered AS (SELECT *, 'fixed-' || doc || '-' || printf('%03d', row_number() OVER (PARTITION BY doc ORDER BY start)) AS chunk_id FROM asof_),
touched AS (SELECT n.chunk_id, min(s.page) AS p, max(s.page) AS q FROM numbered n JOIN spans s ON s.doc = n.doc AND s.start < n.start + length(n.body) AND n.start < s.start + length(s.text) GROUP BY 1),
chosen AS (SELECT *, CASE WHEN p = q THEN 'p' || p ELSE 'p' || p || '-' || q END AS pages FROM numbered JOIN touched USING (chunk_id))"""

_PAGE_TEXT = "'1. ' || s_name || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| cell a | cell b |' || chr(10) || chr(10) || 'After:' || chr(10) || 'closing words' || chr(10) || chr(10) || '| late |' || chr(10) || '| --- |'"
#: Label, start, end, end of all below it, heading above it; by hand from the lines' lengths.
_OUTLINE = [("1.0 SCOPE", 6, 17, 42, ""), ("a. First", 17, 32, 32, "1.0 SCOPE > "), ("b. Second", 32, 42, 42, "1.0 SCOPE > "), ("2. Next", 42, 50, 83, ""), ("2.1 Sub", 50, 65, 65, "2. Next > "), ("2.2 Other", 65, 83, 83, "2. Next > "), ("3. End", 83, 89, 89, "")]


def _power(name: str, matrix: str, squarings: int = 14) -> str:
    """name(v): the first eigenvector of a symmetric matrix (one row, column m), from a high power of it by squaring."""
    product = "list_transform(b, lambda p: list_transform(b, lambda q: list_dot_product(p, q)))"
    trace = "list_sum(list_transform(generate_series(1, len(m)), lambda i: m[i][i]))"
    return f"""{name}_p(k, m) AS (SELECT 0, m FROM {matrix} UNION ALL SELECT k + 1, {product} FROM (SELECT k, list_transform(m, lambda r: list_transform(r, lambda x: x / {trace})) AS b FROM {name}_p WHERE k < {squarings})),
{name} AS (SELECT list_transform(m[1], lambda x: x / sqrt(list_dot_product(m[1], m[1]))) AS v FROM {name}_p WHERE k = {squarings})"""


_VALUE = "list_dot_product({v}, list_transform({m}, lambda r: list_dot_product(r, {v})))"
_PCA = f"""WITH RECURSIVE x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(generate_series(1, len(embedding))) AS s(i)),
mean AS (SELECT i, avg(x) AS mu FROM x GROUP BY i), c AS (SELECT vec_id, x.i, x - mu AS x FROM x JOIN mean ON mean.i = x.i),
cells AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
cov AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cells GROUP BY i)), {_power("one", "cov")},
rest AS (SELECT list_transform(generate_series(1, len(m)), lambda i: list_transform(generate_series(1, len(m)), lambda j: m[i][j] - l * v[i] * v[j])) AS m, l FROM (SELECT m, v, {_VALUE.format(v="v", m="m")} AS l FROM cov, one)), {_power("two", "(SELECT m FROM rest)")},
kept AS (SELECT 100 * (l + {_VALUE.format(v="two.v", m="rest.m")}) / list_sum(list_transform(generate_series(1, len(cov.m)), lambda i: cov.m[i][i])) AS kept FROM cov, rest, two),
p AS (SELECT vec_id, list_dot_product(list(x ORDER BY i), any_value(one.v)) AS x, list_dot_product(list(x ORDER BY i), any_value(two.v)) AS y FROM c, one, two GROUP BY vec_id),
z AS (SELECT CASE WHEN x < 0 THEN -1 ELSE 1 END AS sx, CASE WHEN y < 0 THEN -1 ELSE 1 END AS sy FROM p WHERE vec_id = 0)
SELECT vec_id, round(x * sx, 4) + 0.0 AS x, round(y * sy, 4) + 0.0 AS y, round(kept, 4) AS variance_kept FROM p, z, kept"""

SQL = {
    "pca_points": _PCA,
    "unwrap_lines": f"WITH {_NOISY} SELECT doc_id, {_unwrap('text')} AS text FROM noisy",
    "clean_text": f"""WITH {_NOISY}, b AS (SELECT doc_id, {_body("normalize_bullets")} AS text FROM noisy), c AS (SELECT doc_id, {_body("normalize_characters")} AS text FROM b), w AS (SELECT doc_id, {_body("normalize_whitespace")} AS text FROM c),
u AS (SELECT doc_id, {_unwrap('text')} AS text FROM w) SELECT doc_id, {_body("collapse_blank_lines")} AS text FROM u""",
    "recursive_chunks": _RECURSIVE,
    "section_chunks": f"WITH {_ORDERS} SELECT 'section-' || doc || '-001' AS chunk_id, doc AS section, 1 AS page_start, 1 AS page_end, 0 AS char_start, CAST(length(text) AS INTEGER) AS char_end, CAST(length(text) AS INTEGER) AS char_count, true AS has_table, md5(doc || chr(10) || chr(10) || text) AS md5 FROM orders_",
    "section_chunks_split": f"WITH {_SPLIT}",
    "strategy_statistics": f"""WITH {_PARTS} SELECT s AS chunking_strategy, count(*) AS chunks, CAST(round_even(avg(b - a), 0) AS BIGINT) AS avg, CAST(round_even(median(b - a), 0) AS BIGINT) AS median, CAST(min(b - a) AS INTEGER) AS min, CAST(max(b - a) AS INTEGER) AS max,
CAST(0 AS BIGINT) AS cross_page, count(*) FILTER (tab) AS with_table, count(*) FILTER (b - a < 150) AS short, CAST(0 AS BIGINT) AS mid_word_end, count(*) FILTER (mixes) AS mixes_top FROM chunks GROUP BY s""",
    "same_content": f"""WITH {_THREE}, c AS (SELECT *, s || '-' || doc || '-' || printf('%03d', i) AS chunk_id FROM three), m AS (SELECT min(a) AS lo, max(b) AS hi, arg_min(doc, chunk_id) AS doc FROM c WHERE s = 'section' AND contains(lower(doc), 'o1'))
SELECT s AS chunking_strategy, chunk_id, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end, a < lo AS starts_before, b > hi AS runs_past FROM c JOIN m ON m.doc = c.doc WHERE a < hi AND lo < b""",
    "table_check": f"""WITH {_PARTS} SELECT s AS chunking_strategy, contains(body, '| no |') AS has_header, contains(body, 'a. Detail') AS has_intro, count(*) AS n, CAST(sum(len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '| ')))) AS BIGINT) AS model_rows FROM chunks WHERE contains(body, '| 1 |') GROUP BY ALL""",
    "chunks_written": f"WITH {_PARTS} SELECT chunk_id, s AS chunking_strategy, md5(body) AS md5 FROM chunks WHERE chunk_id = 'section-o1-001' OR (s = 'fixed' AND contains(doc, 'o2'))",
    "table_row_split": f"WITH {_ROWSPLIT}",
    "hash_embed_topk": f"""WITH {_TEXTS % ""}, {_HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / (nq * nd), 9) DESC, doc_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(dot / (nq * nd), 5) AS score FROM r WHERE rank <= 3""",
    "topk_both": f"""WITH {_TEXTS % f"WHERE item_id = {_FIRST}"}, {_HASHED},
r AS (SELECT doc_id, dot / (nq * nd) AS c, sqrt(greatest(nq * nq + nd * nd - 2 * dot, 0)) AS e FROM pairs),
k AS (SELECT *, row_number() OVER (ORDER BY c DESC, doc_id) AS rc, row_number() OVER (ORDER BY e, doc_id) AS re FROM r)
SELECT 'cosine' AS method, CAST(rc AS INTEGER) AS rank, doc_id, round(c, 5) AS score FROM k WHERE rc <= 5 UNION ALL SELECT 'euclidean', CAST(re AS INTEGER), doc_id, round(e, 5) FROM k WHERE re <= 5""",
    "ingest_idempotent": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS e, count(*) FILTER (vec_id < 7) AS s FROM embeddings)
SELECT 1 AS step, e AS loaded, e AS inserted, CAST(0 AS BIGINT) AS skipped, e AS count_after FROM c UNION ALL SELECT 2, n, n - e, e, n FROM c UNION ALL SELECT 3, n, 0, n, n FROM c UNION ALL SELECT 4, s, n, 0, n FROM c UNION ALL SELECT 5, 0, 0, 0, 0 FROM c""",
    "refused": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{e}')" for e, cs in {"RetrievalError": ["top_k_zero", "top_k_text", "method", "empty_question", "empty_store", "dimensions", "unknown_id"], "StorageError": ["metric", "repeated_ids"], "ValueError": ["strategy", "overlap"], "FileNotFoundError": ["no_pdf_files"]}.items() for c in cs) + ") AS t(call, outcome)",
    "section_asof": f"WITH {_CONV} SELECT doc, start, section FROM asof_",
    "chosen_chunks": f"""WITH {_CONV} SELECT 1 AS choice, chunk_id, pages FROM chosen WHERE contains(doc, 'c1') AND 1 BETWEEN p AND q UNION ALL SELECT 2, chunk_id, pages FROM chosen WHERE contains(lower(section), '> user') AND 2 BETWEEN p AND q
UNION ALL SELECT 3, chunk_id, pages FROM chosen WHERE chunk_id = 'fixed-c2-001'""",
    "embedding_texts": "SELECT n_name AS doc, n_name || (CASE WHEN n_nationkey % 3 = 1 THEN ' (Land ' || n_name || ')' ELSE '' END) || ' > 1. Scope' || chr(10) || chr(10) || 'Body.' AS text FROM nation",
    "pages_written": f"WITH {_PAGES} SELECT doc, page, CAST(length(text) AS BIGINT) AS chars FROM pages_ WHERE contains(doc, 'c1')",
    "vectors_written": "SELECT 'v' || vec_id AS chunk_id, round(CASE WHEN vec_id % 4 = 0 THEN -1 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings",
    "documents_written": "SELECT n_name AS doc, 'a.pdf' AS source_file, CAST(n_nationkey AS INTEGER) AS total_pages FROM nation",
    "registry_join": """WITH k(file, name) AS (VALUES ('FRANCE.v2.pdf', 'Handbook FRANCE'), ('PERU.v2.pdf', 'Handbook PERU'))
SELECT n_name || '.v2.pdf' AS file, coalesce(name, n_name || '.v2') AS name, CASE WHEN name IS NULL THEN 'plain' ELSE 'sop' END AS template, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS cover_page, CASE WHEN name IS NULL THEN '' ELSE '2,3' END AS skip_pages FROM nation LEFT JOIN k ON file = n_name || '.v2.pdf'""",
    "truncated_texts": f"""WITH t AS (SELECT doc_id, text, length(regexp_extract(text, '^(?:[{_WS}]*[^{_WS}]+){{254}}')) AS seen FROM documents WHERE len(regexp_extract_all(text, '[^{_WS}]+')) > 254)
SELECT doc_id, seen, length({_STRIP % "substring(text, seen + 1)"}) AS unseen FROM t""",
    "run_totals": f"WITH {_PAGES} SELECT count(DISTINCT doc) AS documents, count(*) FILTER (page <> 2) AS pages, CAST(sum(length(text)) FILTER (page <> 2) AS BIGINT) AS chars FROM pages_",
    "names_and_numbers": """SELECT n_nationkey, list_aggregate(list_slice(string_split(lower(n_name), '-'), -1, -1), 'string_agg', '-') || '-001' AS short_id, CASE WHEN n_nationkey > 0 THEN n_name ELSE 'unknown' END AS label,
'[' || printf('%+.3f', n_nationkey / 8.0) || ', ' || printf('%+.3f', -CAST(n_regionkey AS DOUBLE)) || ']' AS numbers, 'Table' || chr(10) || 'table 2' || chr(10) || 'other' || chr(10) || n_name || '<ZWSP>|<NBSP>' AS shown, CAST(2 AS BIGINT) AS n_lines, sha256(n_name) AS sha256 FROM nation""",
    "outline_refusals": "SELECT r_name AS doc, r_name || ' > ' || t.above || t.label AS breadcrumb, t.a AS start, t.b AS \"end\", t.c AS end_full FROM region, (VALUES " + ", ".join(f"('{label}', CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT), '{above}')" for label, a, b, c, above in _OUTLINE) + ") AS t(label, a, b, c, above)",
    "page_with_tables": f"SELECT s_suppkey, {_PAGE_TEXT} AS text, 'document_id=D-' || s_suppkey || ';version=2' AS fields FROM supplier",
    "layout_pages": f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY s_name || '.pdf') AS r FROM supplier), p AS (SELECT *, CAST(i AS INTEGER) AS page, r <= 3 AND i = 1 AS cover FROM s, generate_series(1, 3) AS g(i) WHERE NOT (r <= 3 AND i = 2))
SELECT CASE WHEN r <= 3 THEN 'Doc ' || (r - 1) ELSE s_name END AS doc, page, CASE WHEN cover THEN 'cover' ELSE 'content' END AS page_type, 'D-' || s_suppkey AS document_id, NOT cover AS has_table,
  md5(CASE WHEN cover THEN 'Document: ' || chr(10) || 'Document ID: D-' || s_suppkey || chr(10) || 'Version: 2' ELSE {_PAGE_TEXT} END) AS md5 FROM p""",
    "indexed_recall": "SELECT true AS enough, true AS sparing",
    "descent_recall": "SELECT true AS enough, count(*) AS edges FROM (" + BASE["knn_edges_k3"] + ")",
    "report_lines": BASE["topk_cosine"].replace("SELECT rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10", "SELECT rank, lpad(CAST(rank AS VARCHAR), 3, ' ') || '  ' || printf('%.4f', score) || '  ' || vec_id AS line FROM r WHERE rank <= 5"),
}
