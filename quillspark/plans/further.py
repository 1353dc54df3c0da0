"""More registered queries: operators that need written files, a store, titles, tables or faults to be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..durable import cut, workspace
from ..errors import RetrievalError, StorageError
from ..functions import text as X
from ..operators import chunking, corpus, embedding, layout, quality, retrieval
from ..operators.store import Collection
from ..sources import files
from .queries import _three, as_documents, chunks_of, conversation_pages, order_documents, query_zero, read, vectors


def question(spark: SparkSession, sf: str) -> str:
    return read(spark, sf, "benchmark").orderBy("item_id").first()["text"]


def embedded_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    return embedding.embed(docs, embedding.HashEmbedder(64, max_tokens=None)).select(F.col("doc_id").alias("vec_id"), "embedding")


def topk_both(spark, sf):
    """One embedded question, one ranking for each method."""
    found = retrieval.retrieve_all_methods(embedded_documents(spark, sf), question(spark, sf), embedding.HashEmbedder(64, max_tokens=None), 5, "vec_id")
    rows = [df.select(F.lit(m).alias("method"), "rank", F.col("vec_id").alias("doc_id"), F.round("score", 5).alias("score")) for m, df in found.items()]
    return rows[0].unionByName(rows[1])


def ingest_idempotent(spark, sf):
    """What ingesting the even ids, then all, then all again reports, and what a reset leaves."""
    v = vectors(spark, sf)
    out = []
    with workspace(spark) as path:
        for step, rows in enumerate((v.filter("vec_id % 2 = 0"), v, v), 1):
            r = Collection(spark, path, key="vec_id").ingest(rows)
            out.append((step, r.loaded, r.inserted, r.skipped, r.count_after))
        store = Collection(spark, path, key="vec_id")
        out.append((4, store.existing(v.filter("vec_id < 7").select("vec_id")).count(), store.rows().count(), 0, store.count()))
        store.reset()
        left = Collection(spark, path, key="vec_id").count()
    return spark.createDataFrame([*out, (5, 0, 0, 0, left)], "step int, loaded long, inserted long, skipped long, count_after long")


def refused(spark, sf):
    """Calls that must be refused, and whether each was."""
    v = vectors(spark, sf)
    model, none = embedding.HashEmbedder(64), v.limit(0)
    with workspace(spark) as path:
        Collection(spark, path, key="vec_id")
        calls = {
            "top_k_zero": lambda: retrieval.search(v, [1.0], 0),
            "top_k_text": lambda: retrieval.search(v, [1.0], "5"),
            "method": lambda: retrieval.search(v, [1.0], 5, "dot"),
            "empty_question": lambda: retrieval.retrieve(v, "  ", model),
            "empty_store": lambda: retrieval.retrieve(none, "q", model),
            "dimensions": lambda: retrieval.retrieve(v, "q", embedding.HashEmbedder(8)),
            "unknown_id": lambda: retrieval.compare_pair(v, 0, -1),
            "metric": lambda: Collection(spark, path, "euclidean", key="vec_id"),
            "repeated_ids": lambda: Collection(spark, path, key="vec_id").ingest(v.union(v)),
            "strategy": lambda: chunking.units(None, "other"),
            "overlap": lambda: chunking.windows(F.lit("x"), 50, 50),
            "no_pdf_files": lambda: files.pdf_files(spark, sf),
        }
        rows = []
        for name, call in calls.items():
            try:
                call()
                rows.append((name, "accepted"))
            except (RetrievalError, StorageError, ValueError, FileNotFoundError) as e:
                rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "call string, outcome string")


def section_asof(spark, sf):
    """The heading that each fixed chunk of a conversation stands under."""
    docs = corpus.stitch(conversation_pages(spark, sf)).withColumn("metadata", F.struct(F.lit(None).cast("string").alias("title"), F.lit("content").alias("page_type")))
    got = chunking.chunk(docs, "fixed")
    return got.select("doc", F.col("metadata.char_start").cast("long").alias("start"), "section")


def table_row_split(spark, sf):
    """Tables of the orders cut into groups of rows under their first two lines."""
    docs = as_documents(order_documents(spark, sf), "doc", "sop")
    got = chunking.pieces(docs, ("fixed",), table_most=80).filter("u.is_table")
    return got.select("doc", F.col("u.start").cast("long").alias("start"), F.col("u.verbatim").alias("whole"), F.md5("u.text").alias("md5"))


def section_chunks_split(spark, sf):
    """Section chunks of orders that are longer than a chunk may be."""
    docs = as_documents(order_documents(spark, sf), "doc", "sop")
    got = chunking.chunk(docs, "section", section_most=120)
    return got.select("chunk_id", "section", F.col("metadata.char_start").cast("long").alias("start"), F.md5("text").alias("md5"))


def embedding_texts(spark, sf):
    """Context lines with titles: shown where the title says more than the document's name."""
    o = read(spark, sf, "nation").select(F.col("n_name").alias("doc"), F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("Land "), "n_name")).alias("title"))
    section = F.concat("doc", F.lit(" > 1. Scope"))
    return o.select("doc", chunking.embedding_text(F.col("doc"), F.col("title"), section, F.lit("Body.")).alias("text"))


def chosen_chunks(spark, sf):
    """Chunks by document, section, page and id, with a label of their pages."""
    docs = corpus.stitch(conversation_pages(spark, sf)).withColumn("metadata", F.struct(F.lit(None).cast("string").alias("title"), F.lit("content").alias("page_type")))
    rows = chunking.chunk(docs, "fixed").cache()
    some = [chunking.select_chunks(rows, "fixed", doc="C1", page=1), chunking.select_chunks(rows, section="> user", page=2), chunking.select_chunks(rows, chunk_id="fixed-c2-001"), chunking.select_chunks(rows, chunk_id="recursive-c2-001")]
    out = [df.select(F.lit(n).alias("choice"), "chunk_id", chunking.page_range(F.col("page_start"), F.col("page_end")).alias("pages")) for n, df in enumerate(some, 1)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def table_check(spark, sf):
    """Whether chunks that hold a table's first row hold its header and the line before it too, by strategy."""
    got = quality.table_check(_three(spark, sf)[1], "| 1 |", "| no |", "| ", "a. Detail")
    return got.groupBy("chunking_strategy", "has_header", "has_intro").agg(F.count(F.lit(1)).alias("n"), F.sum("model_rows").cast("long").alias("model_rows"))


def chunks_written(spark, sf):
    """Chunks written as one folder for each strategy and read again by it."""
    with workspace(spark) as path:
        files.write_chunks(_three(spark, sf)[1], path)
        back = files.jsonl(spark, path, S.CHUNKS)
        some = chunking.select_chunks(back, chunk_id="section-o1-001").unionByName(chunking.select_chunks(back, "fixed", doc="o2"))
        return cut(some.select("chunk_id", "chunking_strategy", F.md5("text").alias("md5")))


def pages_written(spark, sf):
    """Pages written as JSON lines, read again, and matched by name."""
    with workspace(spark) as path:
        files.write_jsonl(conversation_pages(spark, sf).select("doc", "page", "text"), path)
        back = files.jsonl(spark, path, "doc string, page int, text string")
        return cut(corpus.matching(back, "C1", "doc").select("doc", "page", F.length("text").cast("long").alias("chars")))


def vectors_written(spark, sf):
    """Vector records written as JSON lines, an id twice, read with all checks; the last record of an id stays."""
    v = vectors(spark, sf)
    record = lambda sign: v.select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), F.transform("embedding", lambda x: sign * x.cast("double")).alias("embedding"), F.lit("m").alias("embedding_model"), "vec_id")
    # Part files are numbered in the order of the union's sides, and read in the order of their names.
    both = record(1).unionByName(record(-1).filter("vec_id % 4 = 0"))
    with workspace(spark) as path, workspace(spark) as other:
        files.write_jsonl(both.drop("vec_id"), path)
        kept = files.latest(files.stored_vectors(spark, path, 64, "m"))
        back = files.write_vectors(kept.select("chunk_id", "embedding"), other)
        return cut(back.select("chunk_id", F.round(F.col("embedding")[0], 6).alias("first")))


def documents_written(spark, sf):
    """Document records as a pretty JSON array, read again."""
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("doc"), F.lit("a.pdf").alias("source_file"), F.col("n_nationkey").cast("int").alias("total_pages"))
    with workspace(spark) as path:
        files.write_array(rows, path)
        back = files.json_array(spark, path, "doc string, source_file string, total_pages int")
        return cut(back.select("doc", "source_file", "total_pages"))


def registry_join(spark, sf):
    """Files with their registry entry; unknown ones get their stem and the plain template."""
    nations = read(spark, sf, "nation").select(F.concat("n_name", F.lit(".v2.pdf")).alias("file"), "n_nationkey")
    known = files.registry(spark, [(f"{n}.v2.pdf", f"Handbook {n}", "sop", 1, [2, 3]) for n in ("FRANCE", "PERU")])
    got = corpus.with_registry(nations, known)
    return got.select("file", "name", "template", F.coalesce("cover_page", F.lit(0)).alias("cover_page"), F.array_join("skip_pages", ",").alias("skip_pages"))


def truncated_texts(spark, sf):
    """How much of each long document a model with a window of 256 tokens doesn't see."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    got = embedding.truncated(embedding.embed(docs, embedding.HashEmbedder(8)))
    return got.select("doc_id", F.col("token_info.embedded_chars").cast("long").alias("seen"), F.length("unseen").cast("long").alias("unseen"))


def run_totals(spark, sf):
    """Documents, kept pages and characters of a whole run."""
    pages = conversation_pages(spark, sf)
    per = corpus.char_totals(pages.select("doc").distinct(), pages.filter("page <> 2"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.sum("kept_pages").alias("pages"), F.sum("chars").alias("chars"))


def names_and_numbers(spark, sf):
    """Short ids, labels, signed numbers, hidden spaces, counted lines and hashes of contents."""
    n = read(spark, sf, "nation").withColumn("content", F.col("n_name").cast("binary"))
    text = F.concat(F.lit("Table\ntable 2\nother\n"), "n_name", F.lit("​|\xa0"))
    numbers = F.array(F.col("n_nationkey") / F.lit(8.0), -F.col("n_regionkey").cast("double"))
    return n.select(
        "n_nationkey", X.short_id(F.concat(F.lit("section-x-"), F.lower("n_name"), F.lit("-001"))).alias("short_id"), X.doc_label(F.when(F.col("n_nationkey") > 0, F.concat("n_name", F.lit(".pdf")))).alias("label"),
        X.signed(numbers, 3).alias("numbers"), X.show_invisible(text).alias("shown"), X.count_lines(text, "TABLE").cast("long").alias("n_lines"), embedding.sha256_of(n).alias("sha256"),
    )


def outline_refusals(spark, sf):
    """Numbers and letters that can't follow are body text; sections end where the next one of their depth starts."""
    lines = ["2. No", "1.0 SCOPE:", "a. First", "c. No", "b. Second", "2. Next", "2.1 Sub", "2.3 No", "2.2. Other", "3.2 No", "3. End"]
    docs = read(spark, sf, "region").select(F.col("r_name").alias("doc"), F.lit("\n".join(lines)).alias("text"))
    got = chunking.with_outline(as_documents(docs, "doc", "sop")).select("doc", F.explode("sections").alias("s"))
    return got.select("doc", "s.breadcrumb", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.end_full").cast("long").alias("end_full"))


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLES = f"array<struct<bbox:{BOX},rows:array<array<string>>>>"


def _box(x0, y0, x1, y1):
    return F.struct(*(F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def _page(spark, sf):
    """A page for each supplier: a header box, a heading, a table of two blocks, a text, and a table without a block."""
    s = read(spark, sf, "supplier")
    line = lambda y, text, x=10.0: F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 50).alias("x1"), F.lit(y + 10).alias("y1"), text.alias("text"))
    block = lambda *ls: F.struct(F.array(*ls).alias("lines"))
    blocks = F.array(block(line(5.0, F.lit("in the header"))), block(line(60.0, F.lit("1.")), line(60.0, F.col("s_name"), 70.0)), block(line(100.0, F.lit("cell a"))), block(line(115.0, F.lit("cell b"))), block(line(150.0, F.lit("After:"))), block(line(163.0, F.lit("closing words"))))
    mark = F.array(F.array(F.concat(F.lit(layout.HEADER_MARK), F.lit(" 7"))), F.array(F.concat(F.lit("Document ID: D-"), F.col("s_suppkey").cast("string")), F.lit("Version: 1")), F.array(F.lit("Version : 2 "), F.lit("no label")))
    table = lambda box, *rows: F.struct(box.alias("bbox"), F.array(*(F.array(*map(F.lit, r)) for r in rows)).alias("rows"))
    tables = F.array(F.struct(_box(0, 0, 200, 40).alias("bbox"), mark.alias("rows")), table(_box(0, 95, 200, 130), ("a", "b"), ("cell a", "cell  b")), table(_box(0, 500, 9, 510), ("late",)))
    return s.select("s_suppkey", "s_name", blocks.alias("blocks"), tables.cast(TABLES).alias("tables"))


def page_with_tables(spark, sf):
    """Page texts with header and tables, and the header's fields."""
    header, own = layout.split_header(F.col("tables"))
    rows = _page(spark, sf).withColumn("header", header).withColumn("own", own)
    fields = F.map_entries(layout.parse_header(F.col("header.rows")))
    return rows.select("s_suppkey", layout.body_text(F.col("blocks"), F.col("own"), F.col("header")).alias("text"), F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


def layout_pages(spark, sf):
    """Page records of layouts joined to the registry: a cover page, a page that is skipped, and a page with tables."""
    one = _page(spark, sf).select(F.concat("s_name", F.lit(".pdf")).alias("file"), "blocks", "tables")
    rows = one.select("file", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), F.lit("").alias("raw_text"), "blocks", "tables")
    names = [r["file"] for r in one.select("file").orderBy("file").limit(3).collect()]
    reg = files.registry(spark, [(n, f"Doc {i}", "sop", 1, [2]) for i, n in enumerate(names)])
    got = layout.pages_from_layout(corpus.with_registry(rows, reg))
    return got.select("doc", "page", "metadata.page_type", "metadata.document_id", "metadata.has_table", F.md5("text").alias("md5"))


def indexed_recall(spark, sf):
    """A collection's stored index, filled by two ingests, asked for the neighbours of every id divisible by 20: whether at least nine
    of ten true ones are found, and whether at most a fifth of the rows is scored for it, as is asked of 2,000 rows or more."""
    v = vectors(spark, sf)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    with workspace(spark) as path:
        for rows in (v.filter("vec_id % 2 = 0"), v):
            Collection(spark, path, key="vec_id", indexed=True).ingest(rows)
        store = Collection(spark, path, key="vec_id", indexed=True)
        found = cut(store.index.search(asked, 5))
        store.reset()
    exact = retrieval.search_many(v, asked, 5).select("query_id", "vec_id")
    hits = found.join(exact, ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    facts = found.filter("rank = 1").agg(F.avg("scored").alias("scored"), F.count(F.lit(1)).alias("asked"))
    return facts.crossJoin(hits).select((F.col("hits") >= 0.9 * 5 * F.col("asked")).alias("enough"), (F.col("scored") <= 0.2 * n if (n := v.count()) >= 2000 else F.lit(True)).alias("sparing"))


def descent_recall(spark, sf):
    """Whether neighbour descent finds at least 95 of 100 of the edges of the exact graph."""
    v = vectors(spark, sf)
    exact, found = retrieval.knn_graph(v, 3), retrieval.knn_graph(v, 3, approximate=True)
    both = exact.join(found.withColumn("found", F.lit(True)), ["src", "dst"], "left")
    return both.agg((F.count("found") >= 0.95 * F.count(F.lit(1))).alias("enough"), F.count(F.lit(1)).alias("edges"))


def report_lines(spark, sf):
    """A search as lines for people to read."""
    return retrieval.report(retrieval.search(vectors(spark, sf), query_zero(spark, sf), 5, "cosine", "vec_id"), "vec_id")


QUERIES = {
    "topk_both": topk_both, "ingest_idempotent": ingest_idempotent, "refused": refused, "section_asof": section_asof, "table_row_split": table_row_split, "section_chunks_split": section_chunks_split,
    "embedding_texts": embedding_texts, "chosen_chunks": chosen_chunks, "table_check": table_check, "chunks_written": chunks_written, "pages_written": pages_written, "vectors_written": vectors_written,
    "documents_written": documents_written, "registry_join": registry_join, "truncated_texts": truncated_texts, "run_totals": run_totals, "names_and_numbers": names_and_numbers,
    "outline_refusals": outline_refusals, "page_with_tables": page_with_tables, "layout_pages": layout_pages, "indexed_recall": indexed_recall, "descent_recall": descent_recall, "report_lines": report_lines,
}
