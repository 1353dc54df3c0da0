"""Queries on operators that hold a document of any size: places, lines, joins by ranges, and sweeps; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, corpus, embedding, outline, quality, ranges
from .further_oracle import _CONV, _THREE
from .oracle import _PAGES, _SPANS, _WS
from .oracle import SQL as BASE
from .oracle import _windows
from .queries import _three, conversation_pages, order_documents, read


def placed(spark, sf):
    return corpus.placed_pages(conversation_pages(spark, sf))


def page_places(spark, sf):
    """Where each page stands in its document."""
    return placed(spark, sf).select("doc", "page", "start", "end")


def line_places(spark, sf):
    """Lines of documents of several pages, with their offsets and pages."""
    return corpus.placed_lines(placed(spark, sf)).select("doc", "start", "end", F.md5("text").alias("md5"))


def _windows_of(spark, sf):
    docs = corpus.stitch(conversation_pages(spark, sf)).select("doc", F.posexplode(chunking.windows(F.col("text"))).alias("n", "w"))
    return docs.select("doc", "n", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


def span_pages(spark, sf):
    """Pages that each window of a document touches, by an interval join."""
    spans = _windows_of(spark, sf)
    got = ranges.touched_pages(spans, placed(spark, sf)).join(spans, ["doc", "n"])
    return got.select("doc", "start", F.array_join("pages", ",").alias("pages"))


def offset_sections(spark, sf):
    """The heading that each window stands under, by an as-of join."""
    return outline.headings_at(_windows_of(spark, sf).select("doc", "start"), placed(spark, sf)).select("doc", "start", "section")


def content_overlaps(spark, sf):
    """For each section of each document: how many chunks of each strategy overlap it, and how many stick out at either end."""
    return quality.content_overlaps(_three(spark, sf)[1])


def windows_through_tables(spark, sf):
    """Windows of orders that cut a table, as they would without protection of tables."""
    got = quality.windows_through_tables(order_documents(spark, sf), 100, 10)
    return got.select("doc", "start", "end", "whole", F.md5("text").alias("md5"))


def cover_spans(spark, sf):
    """Documents whose first page is a cover: its place, and where the content starts."""
    kind = F.struct(F.when(F.col("page") == 1, "cover").otherwise("content").alias("page_type"))
    docs = corpus.stitch(conversation_pages(spark, sf).withColumn("metadata", kind))
    return docs.select("doc", *(F.col(f"cover.{c}").cast("long").alias(f"cover_{c}") for c in ("start", "end")), F.col("content_start").cast("long").alias("content_start"))


def pooled_vectors(spark, sf):
    """Token vectors of the first 256 tokens of each document, batched by length, averaged and brought to unit length."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    got = embedding.embed(docs, embedding.TokenModel("hash-states", 4, embedding.HashStates))
    return got.select("doc_id", F.col("token_info.token_count").cast("long").alias("tokens"), *(F.round(F.col("embedding")[i].cast("double"), 4).alias(f"e{i}") for i in range(4)))


_OWN_DOCS = "docs AS (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc)"

QUERIES = {"page_places": page_places, "line_places": line_places, "span_pages": span_pages, "offset_sections": offset_sections, "content_overlaps": content_overlaps, "pooled_vectors": pooled_vectors, "windows_through_tables": windows_through_tables, "cover_spans": cover_spans}

SQL = {
    "page_places": BASE["page_spans"],
    "line_places": f"""WITH {_PAGES}, {_OWN_DOCS}, parts AS (SELECT doc, length(text) AS size, string_split(text, chr(10)) AS p FROM docs),
rows_ AS (SELECT doc, size, i, len(p) AS n, p[i] AS line, sum(length(p[i]) + 1) OVER (PARTITION BY doc ORDER BY i) - length(p[i]) - 1 AS start FROM parts, unnest(generate_series(1, len(p))) AS s(i))
SELECT doc, CAST(start AS BIGINT) AS start, CAST(least(start + length(line) + 1, size) AS BIGINT) AS "end", md5(line) AS md5 FROM rows_ WHERE NOT (i = n AND line = '')""",
    "span_pages": BASE["chunk_pages"],
    "offset_sections": f"WITH {_CONV} SELECT doc, start, section FROM asof_",
    "content_overlaps": f"""WITH {_THREE}
SELECT c.doc, c.doc AS section, c.s AS chunking_strategy, count(*) AS n, count(*) FILTER (c.a < t.a) AS starts_before, count(*) FILTER (c.b > t.b) AS runs_past FROM three t JOIN three c ON c.doc = t.doc AND c.a < t.b AND t.a < c.b WHERE t.s = 'section' GROUP BY c.doc, c.s""",
    "pooled_vectors": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_WS}]+') AS w FROM documents),
h AS (SELECT doc_id, md5(lower(x)) AS h FROM (SELECT doc_id, unnest(w[1:254]) AS x FROM t)),
s AS (SELECT doc_id, {", ".join(f"sum(CAST('0x' || substring(h, {2 * i + 1}, 2) AS INTEGER) / 255.0::DOUBLE - 0.5) AS s{i}" for i in range(4))}, count(*) AS n FROM h GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w) + 2 AS tokens, {", ".join(f"(coalesce(s{i}, 0) - 1) / (coalesce(n, 0) + 2) AS m{i}" for i in range(4))} FROM t LEFT JOIN s ON s.doc_id = t.doc_id)
SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, {", ".join(f"round(m{i} / sqrt(m0 * m0 + m1 * m1 + m2 * m2 + m3 * m3), 4) + 0.0 AS e{i}" for i in range(4))} FROM m""",
    "windows_through_tables": f"""WITH {_THREE}, {_windows("doc", "parts", 100, 90)}
SELECT w.doc, w.start, w.start + length(body) AS "end", w.start <= t.a AND t.b <= w.start + length(body) AS whole, md5(body) AS md5 FROM windows w JOIN three t ON t.doc = w.doc AND t.s = 'fixed' AND t.tab WHERE body <> '' AND w.start < t.b AND t.a < w.start + length(body)""",
    "cover_spans": f"""WITH {_SPANS} SELECT doc, CAST(max(CASE WHEN page = 1 THEN start END) AS BIGINT) AS cover_start, CAST(max(CASE WHEN page = 1 THEN start + length(text) END) AS BIGINT) AS cover_end,
CAST(coalesce(min(CASE WHEN page <> 1 THEN start END), max(start + length(text))) AS BIGINT) AS content_start FROM spans GROUP BY doc""",
}
