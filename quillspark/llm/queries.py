"""The registered queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, intervals, langid, lempel_ziv, licences, lm, packing, pii, simhash, toxicity, whitening
from .common import fold, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOXIC_AT = 0.3


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 4))
    return scored.select("doc_id", "n_words", mean.alias("mean_log_score"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.col("start").cast("long").alias("first_word"), F.col("end").cast("long").alias("end_word"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net, names = langid.fit(docs.filter(fold() != 2))
    return langid.predict(docs, net, names).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat.preferences(turns, chat.pair_neighbours(turns))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learnt from documents and labels whose crc32(doc_id) modulo 4 is not 2."""
    return toxicity.fit(docs.filter(fold() != 2), read(spark, sf_dir, "labels").filter(fold() != 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.with_edited(read(spark, sf_dir, "documents"))


def op12_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sales_by_sessions(*(read(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # try_cast: a deviation beyond a long, which takes millions of rows, is null here; the operator has it as a decimal.
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ann": op1_ann,
    "op2_simhash": op2_simhash,
    "op3_lm_score": op3_lm_score,
    "op4_decontaminate": op4_decontaminate,
    "op5_langid": op5_langid,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_licences": op9_licences,
    "op10_pii": op10_pii,
    "op11_fingerprint": op11_fingerprint,
    "op12_intervals": op12_intervals,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

#: Words as the operator splits them: A-Z lower-cased, everything in ASCII but digits and letters is a gap.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: The templates as a table, and how much of a template (n words) its k-grams at `places` cover in a span.
_TEMPLATES = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate((label, t) for label, texts in licences.TEMPLATES.items() for t in texts))
_COVER = "len(list_distinct(flatten(list_transform({places}, lambda p: [p, p + 1, p + 2])))) / greatest(n, {high} - {low})"
_PHRASES = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in licences.PHRASES.items())

#: XXH64 in SQL, in 128-bit numbers modulo 2^64. Its five primes.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in _PRIMES)
_2_64 = f"{1 << 64}::UHUGEINT"


def _times(a: str, b: str) -> str:
    return f"(({a}) * {b} % {_2_64})"


def _plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_2_64})"


def _turn(x: str, n: int) -> str:
    return f"((({x}) * {1 << n}::UHUGEINT % {_2_64}) + ({x}) // {1 << (64 - n)}::UHUGEINT)"


def _little(hex_: str, at: str, n: int) -> str:
    """n bytes from byte `at` (from 0) of a text in hex, least significant first."""
    return "(" + " + ".join(f"('0x' || substring({hex_}, CAST(2 * ({at}) AS BIGINT) + {2 * i + 1}, 2))::UTINYINT::UHUGEINT * {1 << (8 * i)}::UHUGEINT" for i in range(n)) + ")"


def _xxh64(source: str, seed: int = 42) -> str:
    """CTEs that end in hashed (s, h): the hash of each distinct text s of `source`."""
    lane = [(seed + _PRIMES[0] + _PRIMES[1]) % (1 << 64), (seed + _PRIMES[1]) % (1 << 64), seed, (seed - _PRIMES[0]) % (1 << 64)]
    word = lambda v, x: f"list_transform([{_plus(v, _times(x, _P2))}], lambda r: {_times(_turn('r', 31), _P1)})[1]"
    lanes = ", ".join(f"list_reduce(list_prepend({v}::UHUGEINT, list_transform(generate_series(0, n // 32 - 1), lambda j: {_little('x', f'j * 32 + {8 * k}', 8)})), lambda a, b: {word('a', 'b')}) AS v{k + 1}" for k, v in enumerate(lane))
    merged = _plus(_plus(_turn("v1", 1), _turn("v2", 7)), _plus(_turn("v3", 12), _turn("v4", 18)))
    for k in range(1, 5):
        merged = f"list_transform([{merged}], lambda m: {_plus(_times(f'xor(m, {word("0::UHUGEINT", f"v{k}")})', _P1), _P4)})[1]"
    steps = [
        f"list_transform(generate_series(0, n % 32 // 8 - 1), lambda j: {{'k': 8, 'w': {_little('x', 'n - n % 32 + 8 * j', 8)}}})",
        f"list_transform(generate_series(0, n % 8 // 4 - 1), lambda j: {{'k': 4, 'w': {_little('x', 'n - n % 8', 4)}}})",
        f"list_transform(generate_series(0, n % 4 - 1), lambda j: {{'k': 1, 'w': {_little('x', 'n - n % 4 + j', 1)}}})",
    ]
    eight = _plus(_times(_turn(f"xor(a.w, {word('0::UHUGEINT', 'b.w')})", 27), _P1), _P4)
    four = _plus(_times(_turn(f"xor(a.w, {_times('b.w', _P1)})", 23), _P2), _P3)
    one = _times(_turn(f"xor(a.w, {_times('b.w', _P5)})", 11), _P1)
    tail = f"list_reduce(list_prepend({{'k': 0, 'w': h0}}, list_concat(list_concat({steps[0]}, {steps[1]}), {steps[2]})), lambda a, b: {{'k': 0, 'w': CASE b.k WHEN 8 THEN {eight} WHEN 4 THEN {four} ELSE {one} END}}).w"
    return f"""x0 AS (SELECT DISTINCT s, lower(hex(encode(s))) AS x, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM {source}),
x1 AS (SELECT *, {lanes} FROM x0 WHERE n >= 32),
x2 AS (SELECT s, x, n, {_plus(merged, "n::UHUGEINT")} AS h0 FROM x1 UNION ALL SELECT s, x, n, {_plus(f"{seed}::UHUGEINT", _P5)} + n::UHUGEINT FROM x0 WHERE n < 32),
x3 AS (SELECT s, {tail} AS h FROM x2),
x4 AS (SELECT s, {_times(f"xor(h, h // {1 << 33}::UHUGEINT)", _P2)} AS h FROM x3), x5 AS (SELECT s, {_times(f"xor(h, h // {1 << 29}::UHUGEINT)", _P3)} AS h FROM x4),
hashed AS (SELECT s, CAST(xor(h, h // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM x5)"""


#: Words as the contract of operator 2 has them.
_BLANKS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

def _crc32(x: str) -> str:
    """CRC-32 of an ASCII text by the 256 numbers `tab` of crc_table."""
    codes = f"list_transform(generate_series(1, length({x})), lambda i: CAST(ascii(substring({x}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295::BIGINT)"

#: Whole microseconds since 1970, slots of six hours, and CRC-32 by its reversed polynomial.
_OP12 = f"""WITH crc_table AS (SELECT list(list_reduce(list_prepend(v::BIGINT, list_transform(generate_series(1, 8), lambda k: 0::BIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY v) AS tab FROM generate_series(0, 255) AS g(v)),
t AS (SELECT client_id, epoch_us(ts) AS at_, kind IS NOT DISTINCT FROM 'error' AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT *, CASE WHEN at_ - lag(at_) OVER w <= 900000000 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY client_id ORDER BY at_)),
g AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY at_ RANGE UNBOUNDED PRECEDING) AS run FROM f),
x AS (SELECT client_id, min(at_) AS first, max(at_) AS last, max(struct_pack(a := at_, b := bad)).b AS open FROM g GROUP BY client_id, run),
s AS (SELECT client_id, first // 21600000000 AS a, CASE WHEN NOT open THEN last // 21600000000 END AS b, {_crc32("CAST(first AS VARCHAR)")} AS crc FROM x, crc_table),
l AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped FROM sale_lines GROUP BY sale_id),
o AS (SELECT sales.sale_id, client_id, epoch_us(sold_at) // 21600000000 AS a, CASE WHEN status IS DISTINCT FROM 'open' THEN greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) // 21600000000 END AS b
  FROM sales LEFT JOIN l ON l.sale_id = sales.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT o.sale_id, sign(o.a - s.a) AS at_start, CASE WHEN o.b IS NULL AND s.b IS NULL THEN 0 WHEN o.b IS NULL THEN 1 WHEN s.b IS NULL THEN -1 ELSE sign(o.b - s.b) END AS at_end, least(o.b, s.b) - greatest(o.a, s.a) + 1 AS slots, crc
  FROM o JOIN s ON s.client_id = o.client_id AND (s.b IS NULL OR o.a <= s.b) AND (o.b IS NULL OR s.a <= o.b)),
r AS (SELECT *, CASE at_start WHEN -1 THEN CASE at_end WHEN 1 THEN 'contains' WHEN 0 THEN 'finished_by' ELSE 'overlaps' END WHEN 0 THEN CASE at_end WHEN 1 THEN 'started_by' WHEN 0 THEN 'equals' ELSE 'starts' END ELSE CASE at_end WHEN 1 THEN 'overlapped_by' WHEN 0 THEN 'finishes' ELSE 'during' END END AS relation FROM p)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(slots) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM r GROUP BY sale_id, relation
"""

SQL = {
    "op12_intervals": _OP12,
    "op2_simhash": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_BLANKS} AS w FROM documents),
sh AS (SELECT r, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS g(i) WHERE len(w) > 0),
{_xxh64("sh")},
bits AS (SELECT r, count(*) AS n, list_value({", ".join(f"count(*) FILTER ((h >> {b}) & 1 = 1)" for b in range(64))}) AS ones FROM sh JOIN hashed ON hashed.s = sh.s GROUP BY r),
fp AS (SELECT d.r, d.doc_id, CASE WHEN bits.r IS NULL THEN 0::UBIGINT ELSE CAST(list_sum(list_transform(generate_series(1, 64), lambda b: CASE WHEN 2 * ones[b] > n THEN 1::HUGEINT << CAST(b - 1 AS HUGEINT) ELSE 0::HUGEINT END)) AS UBIGINT) END AS f FROM d LEFT JOIN bits ON bits.r = d.r),
nodes AS (SELECT f, count(*) AS copies, min(doc_id) AS least FROM fp GROUP BY f),
edges AS (SELECT a.f AS a, b.f AS b FROM nodes a, nodes b WHERE a.f <> b.f AND bit_count(CAST(xor(a.f, b.f) AS BIT)) <= 3),
walk(a, b) AS (SELECT f, f FROM nodes UNION SELECT walk.a, edges.b FROM walk JOIN edges ON edges.a = walk.b),
comp AS (SELECT a AS f, min(least) AS component_id FROM walk JOIN nodes ON nodes.f = walk.b GROUP BY a)
SELECT doc_id, lower(lpad(hex(fp.f), 16, '0')) AS fingerprint, component_id, copies FROM fp JOIN nodes ON nodes.f = fp.f JOIN comp ON comp.f = fp.f
""",
    "op3_lm_score": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM d, unnest(generate_series(1, len(w))) AS s(i)),
c1 AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
c2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT t.doc_id, t.i, c1.n / (SELECT count(*) FROM t) AS p1,
        CASE WHEN c2.n >= 2 THEN c2.n / b1.n ELSE 0.4 * c1.n / (SELECT count(*) FROM t) END AS p2,
        CASE WHEN c3.n >= 2 THEN c3.n / b2.n END AS p3
      FROM t JOIN c1 ON t.c = c1.c LEFT JOIN c1 AS b1 ON t.b = b1.c LEFT JOIN c2 ON t.b = c2.b AND t.c = c2.c
      LEFT JOIN c2 AS b2 ON t.a = b2.b AND t.b = b2.c LEFT JOIN c3 ON t.a = c3.a AND t.b = c3.b AND t.c = c3.c),
s AS (SELECT doc_id, sum(ln(CASE WHEN i = 1 THEN p1 WHEN i = 2 THEN p2 ELSE coalesce(p3, 0.4 * p2) END)) AS l FROM p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(l / len(w), 4) AS mean_log_score FROM d LEFT JOIN s ON d.doc_id = s.doc_id
""",
    "op9_licences": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
phrases(phrase, label, n) AS (VALUES {_PHRASES}),
base AS (SELECT r, i - 1 AS place, label FROM d, phrases, unnest(generate_series(1, len(w) - n + 1)) AS s(i) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r),
templates(t, label, body) AS (VALUES {_TEMPLATES}),
tg AS (SELECT t, label, len(w) AS n, i - 1 AS at_, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT *, string_split(body, ' ') AS w FROM templates), unnest(generate_series(1, len(w) - 2)) AS s(i)),
g AS (SELECT r, i - 1 AS place, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM d, unnest(generate_series(1, len(w) - 2)) AS s(i)),
v AS (SELECT r, t, label, n, place - at_ AS diagonal, list(DISTINCT at_) AS places, min(place) AS low, max(place) + 3 AS high FROM g JOIN tg USING (x, y, z) GROUP BY ALL),
around AS (SELECT v.r, v.t, v.label, v.n, v.diagonal, any_value(v.places) AS places, any_value(v.low) AS low, any_value(v.high) AS high, list_distinct(flatten(list(o.places))) AS all_places, min(o.low) AS all_low, max(o.high) AS all_high
  FROM v JOIN v AS o ON o.r = v.r AND o.t = v.t AND o.diagonal BETWEEN v.diagonal - 3 AND v.diagonal + 3 GROUP BY v.r, v.t, v.label, v.n, v.diagonal),
scored AS (SELECT r, label, greatest({_COVER.format(places="places", high="high", low="low")}, {_COVER.format(places="all_places", high="all_high", low="all_low")}) AS score FROM around),
m AS (SELECT r, list(DISTINCT label) AS more, max(score) AS best FROM scored WHERE score >= 0.7 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels, greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN m ON m.r = d.r
""",
    "op6_chat": """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT conv_id // 2 AS pair_id, min(conv_id) AS c, max(conv_id) AS r FROM t GROUP BY 1 HAVING min(conv_id) <> max(conv_id)),
sizes AS (SELECT conv_id, max(n) AS size FROM t GROUP BY 1),
first AS (SELECT pair_id, min(x.n) AS n FROM pairs JOIN t x ON x.conv_id = pairs.c JOIN t y ON y.conv_id = pairs.r AND y.n = x.n
          WHERE x.role <> y.role OR x.text <> y.text GROUP BY 1),
prefix AS (SELECT pairs.*, coalesce(first.n - 1, least(a.size, b.size)) AS k FROM pairs LEFT JOIN first USING (pair_id)
           JOIN sizes a ON a.conv_id = c JOIN sizes b ON b.conv_id = r),
line AS (SELECT pair_id, k, conv_id = c AS chosen, n, role, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body
         FROM prefix JOIN t ON conv_id IN (c, r)),
place AS (SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, chosen, n > k ORDER BY n) AS stop FROM line)
SELECT pair_id, CAST(max(k) AS INTEGER) AS n_prompt,
  coalesce(string_agg(body, '' ORDER BY n) FILTER (chosen AND n <= k), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY n) FILTER (chosen AND n > k), '') AS chosen,
  coalesce(string_agg((stop - length(body) + length(head)) || ':' || stop, ',' ORDER BY n) FILTER (chosen AND n > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(body, '' ORDER BY n) FILTER (NOT chosen AND n > k), '') AS rejected,
  coalesce(string_agg((stop - length(body) + length(head)) || ':' || stop, ',' ORDER BY n) FILTER (NOT chosen AND n > k AND role = 'assistant'), '') AS rejected_mask
FROM place GROUP BY pair_id
""",
}
