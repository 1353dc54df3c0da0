"""Commands over the tables between stages: python -m quillspark.cli COMMAND ...

Tables are folders that Spark reads and writes. Reports print aggregates and at most k rows; nothing else is collected.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .errors import RetrievalError, StorageError
from .operators import chunking, corpus, embedding, layout, quality, retrieval
from .operators.store import Collection
from .sources import files


def _show(df: DataFrame, title: str) -> None:
    """Print a result that is bounded by its making: an aggregate or a top-k report."""
    print(title)
    for r in df.collect():
        print("  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items()))


def _stitched(spark: SparkSession, a) -> DataFrame:
    docs = corpus.stitch(files.jsonl(spark, a.pages, S.PAGES))
    return chunking.with_outline(docs.withColumn("template", F.lit(a.template)))


def _pages(spark, a):
    """Layouts joined to the registry become page records."""
    known = files.jsonl(spark, a.registry, S.REGISTRY) if a.registry else files.registry(spark, [])
    source = files.layout_json(spark, a.source)
    if a.pdf:
        from .sources.pdf import parse_pdf

        source = files.pdf_layout(files.pdf_files(spark, a.source), parse_pdf)
    files.write_jsonl(layout.pages_from_layout(corpus.with_registry(source, known)), a.out)
    written = files.jsonl(spark, a.out, S.PAGES)
    _show(corpus.char_totals(written.select("doc").distinct(), written).agg(F.count(F.lit(1)).alias("documents"), F.sum("kept_pages").alias("pages"), F.sum("chars").alias("characters")), "Pages")


def _chunk(spark, a):
    docs, out = _stitched(spark, a), None
    for s in a.strategies:
        sizes = {"chunk_size": a.chunk_size, "overlap": a.overlap, "section_most": a.section_most, "table_most": a.table_most}
        rows = chunking.records(chunking.units(docs, s, **sizes), s, **sizes)
        out = rows if out is None else out.unionByName(rows)
    files.write_chunks(out, a.out)
    _show(quality.statistics(files.jsonl(spark, a.out, S.CHUNKS), docs), "Chunks")


def _check(spark, a):
    """Findings by rule; the exit code is 1 if there is an error among them."""
    found = quality.check(chunking.select_chunks(files.jsonl(spark, a.chunks, S.CHUNKS), a.strategy)).select("rule", "severity")
    if a.pages:
        found = found.unionByName(quality.dropped_tables(_stitched(spark, a)).select("rule", "severity"))
    rows = found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy("severity", "rule")
    _show(rows, "Checks")
    return int(not rows.filter("severity = 'error'").isEmpty())


def _compare(spark, a):
    chunks = files.jsonl(spark, a.chunks, S.CHUNKS)
    _show(quality.statistics(chunks, _stitched(spark, a)), "Strategies")
    if a.doc and a.section:
        _show(quality.same_content(chunks, a.doc, a.section), "The same content")
    if a.overlaps:
        _show(quality.content_overlaps(chunks).orderBy("doc", "section", "chunking_strategy"), "Chunks that overlap each section")
    if a.unprotected:
        cut = quality.windows_through_tables(_stitched(spark, a)).groupBy("whole").agg(F.count(F.lit(1)).alias("windows"))
        _show(cut, "Windows over tables, without protection")
    if a.row:
        _show(quality.table_check(chunks, a.row, a.header, a.line_start, a.intro).groupBy("chunking_strategy", "has_header", "has_intro").agg(F.count(F.lit(1)).alias("n"), F.max("model_rows").alias("model_rows")), f"Chunks with {a.row!r}")


def _embed(spark, a):
    chunks = chunking.select_chunks(files.jsonl(spark, a.chunks, S.CHUNKS), a.strategy)
    done = files.write_vectors(embedding.embed(chunks, embedding.HashEmbedder(a.dim)), a.out)
    _show(done.agg(F.count(F.lit(1)).alias("vectors"), F.count_if("token_info.truncated").alias("truncated")), "Vectors")


def _ingest(spark, a):
    store = Collection(spark, a.store, indexed=a.indexed)
    if a.reset:
        store.reset()
    r = store.ingest(spark.read.parquet(a.vectors))
    print(f"loaded {r.loaded}, inserted {r.inserted}, skipped {r.skipped}, stored {r.count_after}")


def _search(spark, a):
    rows = Collection(spark, a.store).rows()
    if rows is None:
        raise RetrievalError("there are no stored vectors")
    dim = rows.select(F.size("embedding").alias("n")).first()["n"]
    if a.indexed:
        retrieval.check_query(" ".join(a.question))
        q = embedding.HashEmbedder(dim).embed([" ".join(a.question)])[0]
        found = retrieval.indexed_search(rows, q, a.top_k, "chunk_id", Collection(spark, a.store, indexed=True).index)
        print("Cosine distance, by the index")
        for r in retrieval.report(found.withColumnRenamed("distance", "score")).orderBy("rank").collect():
            print(r["line"])
        return
    for m in retrieval.METHODS if a.method == "both" else [a.method]:
        found = retrieval.retrieve(rows, " ".join(a.question), embedding.HashEmbedder(dim), a.top_k, m)
        print(retrieval.METHODS[m][0])
        for r in retrieval.report(found).orderBy("rank").collect():
            print(r["line"])


def _graph(spark, a):
    """Points (x, y, colour) and edges of the neighbour graph, as two tables."""
    rows = Collection(spark, a.store).rows()
    points, kept = retrieval.project_2d(rows, "chunk_id")
    retrieval.colour(points.join(rows.select("chunk_id", "doc"), "chunk_id"), "doc").write.mode("overwrite").parquet(f"{a.out}/points")
    retrieval.knn_graph(rows, a.k, "chunk_id").write.mode("overwrite").parquet(f"{a.out}/edges")
    print(f"{kept:.1f} % of the variance kept")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *flags, **options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for f in flags:
            c.add_argument(f)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if v is False else {"default": v, "type": type(v) if v is not None else str}))
        return c

    command("pages", _pages, "source", "out", registry=None, pdf=False)
    c = command("chunk", _chunk, "pages", "out", template="plain", chunk_size=S.CHUNK_SIZE, overlap=S.CHUNK_OVERLAP, section_most=S.SECTION_MOST, table_most=S.TABLE_MOST)
    c.add_argument("--strategies", nargs="+", choices=S.STRATEGIES, default=list(S.STRATEGIES))
    command("check", _check, "chunks", strategy=None, pages=None, template="plain")
    command("compare", _compare, "chunks", "pages", template="plain", doc=None, section=None, overlaps=False, unprotected=False, row=None, header="", line_start="| ", intro="")
    command("embed", _embed, "chunks", "out", strategy=S.PRIMARY, dim=64)
    command("ingest", _ingest, "vectors", "store", reset=False, indexed=False)
    c = command("search", _search, "store", method="cosine", top_k=S.TOP_K, indexed=False)
    c.add_argument("question", nargs="+")
    command("graph", _graph, "store", "out", k=3)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(spark or SparkSession.builder.getOrCreate(), a) or 0
    except (RetrievalError, StorageError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
