"""Passages of stitched documents by three strategies, and their records."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.arrays import let, upto
from ..functions.text import lstrip, slug, strip
from . import outline, spans
from .batches import slices
from .corpus import pages_for

WINDOWS = "array<struct<start:int,end:int,text:string>>"
UNITS = "array<struct<start:int,end:int,text:string,is_table:boolean,verbatim:boolean,section:string>>"
_UNIT = (("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("is_table", pa.bool_()), ("verbatim", pa.bool_()), ("section", pa.string()))
_HEAD = (("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("end_full", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("breadcrumb", pa.string()))
HEADS = "array<struct<label:string,start:int,end:int,end_full:int,parent:int,depth:int,breadcrumb:string>>"


def windows(text: Column, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> Column:
    """Array of (start, end, text): overlapping windows up to the first that reaches the end, trimmed, without empty ones."""
    return F.filter(all_windows(text, size, overlap), lambda w: w["text"] != "")


def all_windows(text: Column, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> Column:
    """windows() with those that are empty."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be from 0 to under the chunk size")
    step = size - overlap
    # The text in blocks of `step` signs: a window is made of the blocks that it touches, never cut from the whole text.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def window(blocks: Column, i: Column) -> Column:
        raw = F.left(F.array_join(F.slice(blocks, i + 1, F.lit(-(-size // step))), ""), F.lit(size))

        def placed(raw: Column) -> Column:
            start = i * step + F.length(raw) - F.length(lstrip(raw))
            return let(strip(raw), lambda b: F.struct(start.alias("start"), (start + F.length(b)).alias("end"), b.alias("text")))

        return let(raw, placed)

    # The last window is the first that reaches the end.
    def made(blocks: Column) -> Column:
        n = (F.size(blocks) - 1) * step + F.length(F.element_at(blocks, -1))
        return F.transform(upto(F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") + 1), lambda i: window(blocks, i))

    some = let(blocks, lambda b: F.when(F.size(b) > 0, made(b)))
    return F.coalesce(some, F.array().cast(WINDOWS))


def _lists(rows: list[list[tuple]], fields) -> pa.Array:
    """A list of structs for each row, from tuples, column by column."""
    flat = list(zip(*(x for r in rows for x in r))) or [()] * len(fields)
    columns = [pa.array(c, kind) for c, (_, kind) in zip(flat, fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in fields]))


def _heads(column: pa.Array) -> list[list[spans.Section]]:
    """The sections of each row."""
    flat = column.flatten()
    made = [spans.Section(*row) for row in zip(*(flat.field(n).to_pylist() for n, _ in _HEAD), strict=True)]
    ends = [0, *accumulate(column.value_lengths().fill_null(0).to_pylist())]
    return [made[a:b] for a, b in zip(ends, ends[1:])]


def _numbered() -> Column:
    return F.col("template").eqNullSafe("sop")


def _title_sections() -> Column:
    """Headings by title lines; a text of template `prose` has none."""
    return F.when(F.col("template").eqNullSafe("prose"), F.array().cast(HEADS)).otherwise(outline.sections(F.col("doc"), F.col("text"), F.col("content_start")).cast(HEADS))


def with_outline(docs: DataFrame) -> DataFrame:
    """docs (doc, text, content_start, template) with `sections`, the headings in document order.

    Outlines of title lines are Columns. Those by numbers (template sop), where each heading depends on all before it, run on Arrow batches.
    Template `prose` stands for texts without headings.
    """

    def run(batches):
        for b in slices(batches, "text"):
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            out = [spans.outline(*row) for row in zip(get("doc"), get("text"), get("content_start"), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(out, _HEAD)], names=[*b.schema.names, "sections"])

    plain = docs.filter(~_numbered()).withColumn("sections", _title_sections())
    return plain.unionByName(docs.filter(_numbered()).mapInArrow(run, f"{_ddl(docs)}, sections {HEADS}"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


DEFAULTS = {"chunk_size": S.CHUNK_SIZE, "overlap": S.CHUNK_OVERLAP, "section_most": S.SECTION_MOST, "table_most": S.TABLE_MOST}
PARAMS = {"fixed": ("chunk_size", "overlap", "table_most"), "recursive": ("chunk_size", "table_most"), "section": ("section_most", "table_most")}


def _check(strategies, chunk_size: int, overlap: int) -> None:
    for strategy in strategies:
        if strategy not in S.STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(S.STRATEGIES)}")
    if not 0 <= overlap < chunk_size:
        raise ValueError("the overlap must be from 0 to under the chunk size")


def _cutter(strategy: str, chunk_size: int, overlap: int, section_most: int, table_most: int):
    """A function of (doc, text, sections, content_start, cover) that gives the units of a text and the headings they stand under."""

    def fixed(text):
        out, step = [], chunk_size - overlap
        for r in spans.regions(text, 0, len(text)):
            if r.is_table:
                out += spans.table_units(text, r, table_most)
                continue
            for at in range(r.start, max(r.start + 1, r.end - overlap), step):
                a, b = spans.trimmed(text, at, min(at + chunk_size, r.end))
                if a < b:
                    out.append(spans.Unit(a, b, text[a:b]))
        return out

    def cut(doc, text, heads, content_start, cover):
        if strategy == "section":
            return [(*u, s) for u, s in spans.section_units(doc, text, heads, content_start, (cover["start"], cover["end"]) if cover else None, section_most, table_most)]
        starts = [h.start for h in heads]
        found = fixed(text) if strategy == "fixed" else spans.prose_and_tables(text, 0, len(text), chunk_size, table_most)
        return [(*u, spans.section_at(doc, starts, heads, u.start, content_start, cover is not None)) for u in found]

    return cut


def units(docs: DataFrame, strategy: str, chunk_size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP, section_most: int = S.SECTION_MOST, table_most: int = S.TABLE_MOST) -> DataFrame:
    """docs with `units`, by strategy: fixed, recursive or section."""
    _check([strategy], chunk_size, overlap)
    cut = _cutter(strategy, chunk_size, overlap, section_most, table_most)

    def run(batches):
        for b in slices(batches, "text"):
            column = lambda c: b.column(b.schema.get_field_index(c))
            rows = zip(column("doc").to_pylist(), column("text").to_pylist(), _heads(column("sections")), column("content_start").to_pylist(), column("cover").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists([cut(*row) for row in rows], _UNIT)], names=[*b.schema.names, "units"])

    return docs.mapInArrow(run, f"{_ddl(docs)}, units {UNITS}")


def pieces(docs: DataFrame, strategies=S.STRATEGIES, **sizes) -> DataFrame:
    """(doc, pages, metadata, strategy, i, u): a row for each unit of each text and strategy, numbered within both; u is the unit.

    Each text is read and outlined once for all strategies; `sections` are taken if docs has them. Nothing else of a document
    than its pages and metadata goes on.
    """
    own = DEFAULTS | sizes
    _check(strategies, own["chunk_size"], own["overlap"])
    cuts = [(s, _cutter(s, **own)) for s in strategies]
    docs = docs if "template" in docs.columns else docs.withColumn("template", F.lit("plain"))
    kind = f"doc string, pages {docs.schema['pages'].dataType.simpleString()}, metadata {docs.schema['metadata'].dataType.simpleString()}, strategy string, i int, u {UNITS[len('array<'):-1]}"

    def run(batches):
        for b in slices(batches, "text"):
            column = lambda c: b.column(b.schema.get_field_index(c))
            name, text, start, cover = (column(c).to_pylist() for c in ("doc", "text", "content_start", "cover"))
            heads = _heads(column("sections")) if "sections" in b.schema.names else [spans.outline(*row) for row in zip(name, text, start, strict=True)]
            made, at, by, number = [], [], [], []
            for k, row in enumerate(zip(name, text, heads, start, cover, strict=True)):
                for s, cut in cuts:
                    found = cut(*row)
                    made += found
                    at += [k] * len(found)
                    by += [s] * len(found)
                    number += range(len(found))
            if made:
                fields = [pa.array(c, kind) for c, (_, kind) in zip(zip(*made), _UNIT, strict=True)]
                at = pa.array(at, pa.int32())
                arrays = [*(column(c).take(at) for c in ("doc", "pages", "metadata")), pa.array(by), pa.array(number, pa.int32()), pa.StructArray.from_arrays(fields, [n for n, _ in _UNIT])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "pages", "metadata", "strategy", "i", "u"])

    needed = ["doc", "text", "content_start", "cover", "pages", "metadata"]
    if "sections" in docs.columns:
        return docs.select(*needed, "sections").mapInArrow(run, kind)
    plain = docs.filter(~_numbered()).withColumn("sections", _title_sections()).select(*needed, "sections")
    return plain.mapInArrow(run, kind).unionByName(docs.filter(_numbered()).select(*needed).mapInArrow(run, kind))


def context_line(doc: Column, title: Column, section: Column) -> Column:
    """The section with the document's title after its name, where the title says more than the name."""
    more = (F.coalesce(title, F.lit("")) != "") & (F.lower(title) != F.lower(doc)) & section.startswith(doc)
    return F.when(more, F.concat(doc, F.lit(" ("), title, F.lit(")"), F.substring(section, F.length(doc) + 1, F.length(section)))).otherwise(section)


def embedding_text(doc: Column, title: Column, section: Column, text: Column) -> Column:
    return F.concat(context_line(doc, title, section), F.lit("\n\n"), text)


def table_info(text: Column, row_split: Column) -> Column:
    """Columns and row counts of the tables of a text: each run of lines that start with a bar."""
    # Runs end at a line without a leading bar, so they are the parts between such lines.
    marked = F.regexp_replace(text, r"(?md)^(?!\|)[^\n]*\n?", "\0")
    runs = F.filter(F.transform(F.split(marked, "\0"), lambda r: F.regexp_replace(r, "^\n+|\n+$", "")), lambda r: r != "")
    cells = lambda row: F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|"), strip)
    one = lambda r: F.struct(cells(F.substring_index(r, "\n", 1)).alias("columns"), F.greatest(F.size(F.split(r, "\n")) - 2, F.lit(0)).alias("rows"), row_split.alias("row_split"))
    return F.transform(runs, one)


def records(docs: DataFrame, strategy: str, **sizes) -> DataFrame:
    """Chunk records of docs that have units (see units()): one row for each, numbered within the document."""
    rows = docs.select("doc", "pages", "metadata", F.lit(strategy).alias("strategy"), F.posexplode("units").alias("i", "u"))
    return _records(rows, (strategy,), DEFAULTS | sizes)


def _records(rows: DataFrame, strategies, sizes: dict[str, int]) -> DataFrame:
    """Chunk records of pieces()."""
    meta = lambda c: F.col(f"metadata.{c}") if c in rows.schema["metadata"].dataType.names else F.lit(None).cast("string")
    rows = rows.withColumn("touched", pages_for(F.col("pages"), F.col("u.start"), F.col("u.end"))).withColumn("body", strip(F.col("u.text")))
    tables = table_info(F.col("body"), F.col("u.is_table") & ~F.col("u.verbatim"))
    fields = [meta(c).alias(c) for c in ("source_file", "title", "document_id", "version", "effective_date")]
    params = None
    for s in strategies:
        one = F.create_map(*(F.lit(x) for p in PARAMS[s] for x in (p, sizes[p])))
        params = one if params is None else F.when(F.col("strategy") == s, one).otherwise(params)
    # A line that starts with a bar is a table's.
    has_table = F.col("body").rlike(r"(\A|\n)\|")
    more = [F.col("touched").alias("pages"), F.length("body").alias("char_count"), has_table.alias("has_table"), F.when(has_table, tables).otherwise(F.array().cast(S.TABLE_INFO)).alias("tables"), F.col("u.start").alias("char_start"), F.col("u.end").alias("char_end"), params.alias("params")]
    chunk_id = F.concat(F.col("strategy"), F.lit("-"), slug(F.col("doc")), F.format_string("-%03d", F.col("i") + 1))
    return rows.select(
        chunk_id.alias("chunk_id"), "doc", F.col("strategy").alias("chunking_strategy"), F.col("u.section").alias("section"),
        F.array_min("touched").alias("page_start"), F.array_max("touched").alias("page_end"), F.col("body").alias("text"),
        embedding_text(F.col("doc"), meta("title"), F.col("u.section"), F.col("body")).alias("embedding_text"), F.struct(*fields, *more).alias("metadata"),
    )


def chunk_all(docs: DataFrame, strategies=S.STRATEGIES, **sizes) -> DataFrame:
    """Chunk records of stitched docs by several strategies, each text read once; `template` defaults to plain. Everything here is narrow: no shuffle."""
    return _records(pieces(docs, strategies, **sizes), tuple(strategies), DEFAULTS | sizes)


def chunk(docs: DataFrame, strategy: str = S.PRIMARY, **sizes) -> DataFrame:
    """chunk_all() by one strategy."""
    return chunk_all(docs, (strategy,), **sizes)


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("p%d", start)).otherwise(F.format_string("p%d-%d", start, end))


def select_chunks(chunks: DataFrame, strategy=None, doc=None, section=None, page=None, chunk_id=None) -> DataFrame:
    """Rows that meet all given conditions. An id names its strategy by its prefix; then only that partition is read."""
    if chunk_id:
        chunks = chunks.filter(F.col("chunk_id") == chunk_id)
        strategy = next((s for s in S.STRATEGIES if chunk_id.startswith(f"{s}-")), strategy)
    if strategy:
        chunks = chunks.filter(F.col("chunking_strategy") == strategy)
    if doc:
        chunks = chunks.filter(F.contains(F.lower("doc"), F.lit(doc.lower())))
    if section:
        chunks = chunks.filter(F.contains(F.lower("section"), F.lit(section.lower())))
    return chunks.filter(F.lit(page).between(F.col("page_start"), F.col("page_end"))) if page else chunks


