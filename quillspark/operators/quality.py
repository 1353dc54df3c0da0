"""Checks and statistics of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..durable import cut
from ..functions.arrays import between, let, parts_of, running
from ..functions.text import count_lines
from .chunking import all_windows, context_line
from .corpus import regions, regions_of
from .ranges import medians, overlap_counts

REQUIRED = ("chunk_id", "doc", "chunking_strategy", "section", "page_start", "page_end", "text", "embedding_text")


def check(chunks: DataFrame) -> DataFrame:
    """(subject, rule, severity) of each finding. Input order is `ordinal` if there is such a column, else the id.

    A chunk that lacks a required field yields that finding alone, and its id is not counted as seen.
    """
    order = "ordinal" if "ordinal" in chunks.columns else "chunk_id"
    names = {f.name: f.dataType.typeName() for f in chunks.schema}
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "" if names[c] == "string" else F.size(c) == 0 if names[c] == "array" else F.lit(False))
    gone = F.lit(False)
    for c in REQUIRED:
        gone = gone | (empty(c) if c in names else F.lit(True))
    rows = chunks.withColumn("gone", gone)
    ids = Window.partitionBy("chunk_id", "gone").orderBy(order)
    docs = Window.partitionBy("doc", "gone").orderBy(order)
    rows = rows.withColumn("again", F.row_number().over(ids) > 1).withColumn("first_of_doc", F.row_number().over(docs) == 1)
    m, leaf = "metadata", F.element_at(F.split("section", " > "), -1)
    head = F.concat(context_line(F.col("doc"), F.col(f"{m}.title"), F.col("section")), F.lit("\n\n"), F.left("text", F.lit(20)))
    token = F.split(leaf, r"\s+")[0]
    number = token.rlike(r"^\p{Nd}") | (F.length(token) == 2)
    bare = F.regexp_replace(token, r"\.+$", "")
    own = F.exists(F.split("text", "\n"), lambda x: F.when(number, x.startswith(bare) & F.substring(x, F.length(bare) + 1, F.lit(2)).rlike(r"^(\.?\s)")).otherwise(x.startswith(F.left(leaf, F.lit(20)))))
    poor = F.exists(f"{m}.tables", lambda t: (t["rows"] == 0) | F.exists(t["columns"], lambda c: c == ""))
    rules = [
        ("duplicate_id", "error", F.col("again")),
        ("page_order", "error", F.col("page_start") > F.col("page_end")),
        ("embedding_text", "error", ~F.col("embedding_text").startswith(head)),
        ("has_table", "error", F.col(f"{m}.has_table") != (F.size(f"{m}.tables") > 0)),
        ("table_empty", "note", poor),
        ("no_heading", "note", (leaf != "Document Information") & ~own),
        ("short", "note", F.length("text") < S.SHORT),
        ("document_fields", "note", F.col("first_of_doc") & (F.col(f"{m}.version").isNull() | F.col(f"{m}.effective_date").isNull())),
    ]
    found = F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules))
    found = F.when(F.col("gone"), F.array(F.struct(F.lit("missing").alias("rule"), F.lit("error").alias("severity")))).otherwise(F.array_compact(found))
    out = rows.select("chunk_id", "doc", F.explode(found).alias("f"))
    return out.select(F.when(F.col("f.rule") == "document_fields", F.col("doc")).otherwise(F.coalesce("chunk_id", F.lit("?"))).alias("subject"), "f.rule", "f.severity")


def dropped_tables(docs: DataFrame, table_most: int = S.TABLE_MOST) -> DataFrame:
    """(subject, rule, severity) for tables that no chunk holds: larger than a chunk may be, and of two lines or fewer."""
    lost = regions(docs).filter(F.col("is_table") & (F.length("text") > table_most) & (F.size(F.split("text", "\n")) <= 2))
    return lost.select(F.concat("doc", F.lit(":"), "start").alias("subject"), F.lit("table_dropped").alias("rule"), F.lit("note").alias("severity"))


def statistics(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each strategy. docs: stitched documents with sections, for the two flags about cuts.

    Whole numbers alone of its chunks are brought to a text.
    """
    n, m = F.col("metadata.char_count"), F.col("metadata")
    rows = chunks.select("doc", "chunking_strategy", n.alias("n"), m["char_start"].alias("a"), m["char_end"].alias("b"), (F.col("page_start") != F.col("page_end")).alias("cross"), m["has_table"].alias("tab"))
    rows = cut(rows)
    # A text meets the list of its chunks once. Both signs at a chunk's end are read from the text in blocks; the last top heading
    # before the end is a running value over headings and ends in their order.
    own = rows.groupBy("doc").agg(F.collect_list(F.struct("chunking_strategy", "n", "a", "b", "cross", "tab")).alias("own"))
    tops = F.transform(F.filter("sections", lambda s: s["parent"] == -1), lambda s: s["start"])
    met = own.join(docs.select("doc", "text", tops.alias("tops")), "doc", "left")
    none = F.lit(None).cast(own.schema["own"].dataType.elementType)
    mark = lambda at, kind, c: F.struct(at.alias("p"), F.lit(kind).alias("k"), c.alias("c"))
    marks = F.array_sort(F.concat(F.transform(F.coalesce("tops", F.array().cast("array<int>")), lambda t: mark(t, 0, none)), F.transform("own", lambda c: mark(c["b"] - 1, 1, c))))
    last = lambda marks: running(F.transform(marks, lambda m: F.when(m["k"] == 0, m["p"]).otherwise(-1)), F.lit(-1), lambda x, y: F.greatest(x, y))
    inside = lambda parts, b: F.when(b > 0, between(parts, b - 1, b + 1).rlike(r"^[\p{L}\p{N}]{2}\z"))

    def flags(parts, marks, last):
        each = F.transform(marks, lambda m, i: F.struct(m["c"].alias("c"), inside(parts, m["c"]["b"]).alias("inside"), (last[i] > m["c"]["a"]).alias("mixes")))
        return F.filter(each, lambda x: x["c"].isNotNull())

    each = let(parts_of(F.col("text")), lambda parts: let(marks, lambda marks: let(last(marks), lambda last: flags(parts, marks, last))))
    flagged = met.select(F.explode(each).alias("x")).select("x.c.*", "x.inside", "x.mixes")
    middle = medians(rows, ["chunking_strategy"], "n")
    sums = flagged.groupBy("chunking_strategy").agg(
        F.count(F.lit(1)).alias("chunks"), F.bround(F.avg("n")).cast("long").alias("avg"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.count_if("cross").alias("cross_page"), F.count_if("tab").alias("with_table"), F.count_if(F.col("n") < S.SHORT).alias("short"), F.count_if("inside").alias("mid_word_end"), F.count_if("mixes").alias("mixes_top"),
    )
    order = ("chunking_strategy", "chunks", "avg", F.bround("median").cast("long").alias("median"), "min", "max", "cross_page", "with_table", "short", "mid_word_end", "mixes_top")
    return sums.join(middle, "chunking_strategy", "left").select(*order)


def table_check(chunks: DataFrame, row: str, header: str, line_start: str, intro: str) -> DataFrame:
    """For the chunks that hold a table row: whether they hold its header and intro too, and how many such rows."""
    t = F.col("text")
    return chunks.filter(t.contains(row)).select("chunking_strategy", "chunk_id", t.contains(header).alias("has_header"), count_lines(t, line_start).alias("model_rows"), t.contains(intro).alias("has_intro"))


def windows_through_tables(docs: DataFrame, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """(doc, start, end, text, whole): fixed windows over whole texts (doc, text), tables and all, that touch a table; `whole` tells whether the
    window holds all of it. Where it does not, rows are cut or parted from their header, which fixed chunks avoid.
    """
    # Windows are numbered by their places, so a table finds those that it may touch by its own; nothing is joined.
    step = size - overlap
    tables = F.filter(regions_of(F.col("text")), lambda r: r["is_table"])
    rows = docs.select("doc", all_windows(F.col("text"), size, overlap).alias("ws"), tables.alias("ts")).filter(F.size("ts") > 0)

    def met(ws, t):
        first = F.greatest(F.floor((t["start"] - size) / step).cast("int"), F.lit(0))
        near = F.slice(ws, first + 1, F.greatest(F.least(F.ceil(t["end"] / step).cast("int"), F.size(ws)) - first, F.lit(0)))
        hit = F.filter(near, lambda w: (w["text"] != "") & (w["start"] < t["end"]) & (t["start"] < w["end"]))
        return F.transform(hit, lambda w: F.struct(w.alias("w"), ((w["start"] <= t["start"]) & (t["end"] <= w["end"])).alias("whole")))

    found = rows.select("doc", "ws", F.explode("ts").alias("t")).select("doc", F.explode(met(F.col("ws"), F.col("t"))).alias("m"))
    return found.select("doc", F.col("m.w.start").cast("long").alias("start"), F.col("m.w.end").cast("long").alias("end"), "m.w.text", "m.whole")


def anchor(chunks: DataFrame, doc: str, section: str) -> DataFrame:
    """(lo, hi, anchor_doc): one row, the range of the section chunks that match, and the document of the first one by id."""
    a, b = F.col("metadata.char_start"), F.col("metadata.char_end")
    match = chunks.filter(F.col("chunking_strategy") == "section").filter(F.contains(F.lower("doc"), F.lit(doc.lower())) & F.contains(F.lower("section"), F.lit(section.lower())))
    return match.agg(F.min(a).alias("lo"), F.max(b).alias("hi"), F.min_by("doc", "chunk_id").alias("anchor_doc"))


def same_content(chunks: DataFrame, doc: str, section: str, found: DataFrame | None = None) -> DataFrame:
    """Chunks of every strategy that overlap the range of the section chunks that match, with flags for what sticks out.

    found: what anchor() gives, if it is known; then chunks may be those of its document alone.
    """
    a, b = F.col("metadata.char_start"), F.col("metadata.char_end")
    # One row: safe to broadcast.
    found = anchor(chunks, doc, section) if found is None else found
    rows = chunks.crossJoin(F.broadcast(found)).filter((F.col("doc") == F.col("anchor_doc")) & (a < F.col("hi")) & (F.col("lo") < b))
    return rows.select("chunking_strategy", "chunk_id", a.alias("char_start"), b.alias("char_end"), (a < F.col("lo")).alias("starts_before"), (b > F.col("hi")).alias("runs_past"))


#: Chunks of a document that are compared pair by pair; a document of more goes through a sweep.
FEW = 64


def content_overlaps(chunks: DataFrame) -> DataFrame:
    """(doc, section, chunking_strategy, n, starts_before, runs_past): same_content() counted for every section of every document at once."""
    own = chunks.select("doc", "chunking_strategy", F.col("section").alias("id"), F.col("metadata.char_start").cast("long").alias("start"), F.col("metadata.char_end").cast("long").alias("end"))
    own = cut(own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc"))))
    ranges = lambda rows: rows.filter("chunking_strategy = 'section'").groupBy("doc", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    few, many = own.filter(F.col("_n") <= FEW), own.filter(F.col("_n") > FEW)
    pairs = few.select("doc", "chunking_strategy", F.col("start").alias("a"), F.col("end").alias("b")).join(ranges(few), "doc").filter((F.col("a") < F.col("end")) & (F.col("start") < F.col("b")))
    got = pairs.groupBy("doc", "id", "chunking_strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") < F.col("start")).alias("starts_before"), F.count_if(F.col("b") > F.col("end")).alias("runs_past"))
    if not many.isEmpty():
        got = got.unionByName(overlap_counts(many.select("doc", "chunking_strategy", "start", "end"), ranges(many), ["doc"], "chunking_strategy"))
    return got.withColumnRenamed("id", "section").select("doc", "section", "chunking_strategy", "n", "starts_before", "runs_past")
