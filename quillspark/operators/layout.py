"""Page geometry to text, and cover pages: Column expressions over arrays of blocks and tables of a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_first, before_first, is_blank, snake, squash, strip, title_case, words
from ..schemas import LINE

#: Distances in points, and texts that are list markers only.
SOFT_WRAP, COLUMN_GAP, SAME_ROW, ROW_STEP = 7.0, 40.0, 2.5, 2.0
MARKER = r"^([●○•▪o]|\p{Nd}+(\.\p{Nd}+)*\.?|[a-z]\.)$"
HEADER_MARK = "Policy & Standard Operating Procedure"
#: Fields of a cover page and their order.
COVER_FIELDS = {"document id": "document_id", "effective date": "effective_date", "version": "version"}
COVER_LINES = (("document_id", "Document ID"), ("version", "Version"), ("effective_date", "Effective Date"), ("issued_by", "Issued By"), ("issued_to", "Issued To"))
REVISION = ("rev_no", "description", "rev_date", "effective_date")
STRINGS = "array<string>"


def same_row(a_y0: Column, a_x1: Column, b_y0: Column, b_x0: Column) -> Column:
    """b starts on a's base line, to its right."""
    return (F.abs(a_y0 - b_y0) < SAME_ROW) & (b_x0 > a_x1 + ROW_STEP)


def separator(left: Column, gap: Column) -> Column:
    bare = F.regexp_replace(left, "^[ \u200b]+|[ \u200b]+$", "")
    return F.when(bare.rlike(MARKER) | (gap < COLUMN_GAP), F.lit(" ")).otherwise(F.lit(" | "))


def text_lines(lines: Column) -> Column:
    """Lines with more than blanks and zero-width spaces."""
    return F.filter(lines, lambda x: F.regexp_replace(x["text"], "[ \u200b]", "") != "")


def join_lines(lines: Column) -> Column:
    """Texts of a block's lines: side by side with a separator, else on lines of their own."""
    start = F.struct(F.lit(None).cast(LINE).alias("last"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        p = s["last"]
        sep = F.when(p.isNull(), F.lit("")).when(same_row(p["y0"], p["x1"], x["y0"], x["x0"]), separator(p["text"], x["x0"] - p["x1"])).otherwise(F.lit("\n"))
        return F.struct(x.alias("last"), F.concat(s["out"], sep, x["text"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def boxed(blocks: Column) -> Column:
    """Blocks with bounding box, vertical centre, text and last line's text; blocks without text are dropped."""
    filled = F.filter(F.transform(blocks, lambda b: text_lines(b["lines"])), lambda ls: F.size(ls) > 0)

    def box(ls: Column) -> Column:
        at = lambda f, c: f(F.transform(ls, lambda x: x[c]))
        y0, y1 = at(F.array_min, "y0"), at(F.array_max, "y1")
        return F.struct(at(F.array_min, "x0").alias("x0"), y0.alias("y0"), at(F.array_max, "x1").alias("x1"), y1.alias("y1"), ((y0 + y1) / 2).alias("cy"), join_lines(ls).alias("text"), F.element_at(ls, -1)["text"].alias("last"))

    return F.transform(filled, box)


def contains(table: Column, block: Column) -> Column:
    """The block's centre lies in the table's box, bounds included."""
    b, x = table["bbox"], (block["x0"] + block["x1"]) / 2
    return (b["x0"] <= x) & (x <= b["x1"]) & (b["y0"] <= block["cy"]) & (block["cy"] <= b["y1"])


def table_to_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table; rows without any text are dropped."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.array_join(words(F.coalesce(c, F.lit(""))), " "))), lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(clean[0])))
    shown = F.concat(F.array(line(clean[0]), rule), F.transform(F.slice(clean, 2, F.size(clean)), line))
    return F.when(F.size(clean) == 0, F.lit("")).otherwise(F.array_join(shown, "\n"))


def split_header(tables: Column) -> tuple[Column, Column]:
    """The header box (the last table whose first cell starts with the mark) and the other tables."""
    marked = lambda t: F.coalesce(strip(F.get(F.get(t["rows"], F.lit(0)), F.lit(0))).startswith(HEADER_MARK), F.lit(False))
    return F.try_element_at(F.filter(tables, marked), F.lit(-1)), F.filter(tables, lambda t: ~marked(t))


def body_text(blocks: Column, tables: Column, header: Column) -> Column:
    """A page's text: header removed, each table once where its first block stands, the rest appended."""
    bottom = F.coalesce(header["bbox"]["y1"], F.lit(0.0))
    shown = F.filter(boxed(blocks), lambda b: b["cy"] >= bottom)
    box = "struct<x0:double,y0:double,x1:double,y1:double,cy:double,text:string,last:string>"
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("any"), F.lit(None).cast(box).alias("last"), F.array().cast("array<int>").alias("done"))
    numbers = lambda: F.sequence(F.lit(1), F.size(tables))
    render = lambda i: F.concat(F.lit("\n\n"), table_to_markdown(F.element_at(tables, i)["rows"]))

    def step(s: Column, b: Column) -> Column:
        inside = F.get(F.filter(F.when(F.size(tables) > 0, numbers()).otherwise(F.array().cast("array<int>")), lambda i: contains(F.element_at(tables, i), b)), F.lit(0))
        fresh = inside.isNotNull() & ~F.array_contains(s["done"], inside)
        p = s["last"]
        sep = (
            F.when(p.isNull(), F.when(s["any"], F.lit("\n\n")).otherwise(F.lit("")))
            .when(same_row(p["y0"], p["x1"], b["y0"], b["x0"]), separator(p["last"], F.lit(float("inf"))))
            .when(b["y0"] - p["y1"] < SOFT_WRAP, F.lit("\n"))
            .otherwise(F.lit("\n\n"))
        )
        out = F.when(fresh, F.concat(s["out"], render(inside))).when(inside.isNotNull(), s["out"]).otherwise(F.concat(s["out"], sep, b["text"]))
        return F.struct(
            out.alias("out"), (s["any"] | fresh | inside.isNull()).alias("any"),
            F.when(fresh, F.lit(None).cast(box)).when(inside.isNotNull(), p).otherwise(b).alias("last"),
            F.when(fresh, F.concat(s["done"], F.array(inside))).otherwise(s["done"]).alias("done"),
        )

    def finish(s: Column) -> Column:
        rest = F.when(F.size(tables) > 0, F.filter(numbers(), lambda i: ~F.array_contains(s["done"], i))).otherwise(F.array().cast("array<int>"))
        return F.concat(s["out"], F.array_join(F.transform(rest, render), ""))

    return F.aggregate(shown, start, step, finish)


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) entries: the first place of each key, its last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def parse_header(rows: Column) -> Column:
    """Fields of a header box: `Label: value` cells after the first row; later ones win."""
    cells = F.transform(F.flatten(F.slice(rows, 2, F.size(rows))), lambda c: squash(F.coalesce(c, F.lit(""))))
    good = F.filter(cells, lambda c: F.contains(c, F.lit(":")) & ~is_blank(after_first(c, ":")))
    return _last_wins(F.transform(good, lambda c: F.struct(snake(before_first(c, ":")).alias("key"), strip(after_first(c, ":")).alias("value"))))


def useful_lines(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "\n"), squash), lambda x: (x != "") & (F.lower(x) != "signature"))


def label_pairs(rows: Column) -> Column:
    """(key, value) entries: a cell whose first line ends with a colon, with its further lines or else the next cell's."""
    entry = "array<struct<key:string,value:string>>"

    def of_row(row: Column) -> Column:
        cells = F.transform(F.filter(row, lambda c: ~is_blank(F.coalesce(c, F.lit("")))), useful_lines)
        start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(entry).alias("out"))

        def step(s: Column, ls: Column) -> Column:
            first, rest = F.get(ls, F.lit(0)), F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))
            pair = lambda k, v: F.concat(s["out"], F.array(F.struct(k.alias("key"), F.array_join(v, " ").alias("value"))))
            label = F.coalesce(first.endswith(":"), F.lit(False))
            name = strip(F.substring(first, F.lit(1), F.length(first) - 1))
            taken = s["open"].isNotNull()
            out = F.when(taken & (F.size(ls) > 0), pair(s["open"], ls)).when(~taken & label & (F.size(rest) > 0), pair(name, rest)).otherwise(s["out"])
            return F.struct(F.when(~taken & label & (F.size(rest) == 0), name).alias("open"), out.alias("out"))

        return F.aggregate(cells, start, step, lambda s: s["out"])

    return F.flatten(F.transform(rows, of_row))


def revision_history(rows: Column) -> Column:
    """Rows after the title and the column names, with any text, as the four fields; missing ones are null."""
    clean = F.filter(F.transform(F.slice(rows, 3, F.size(rows)), lambda r: F.transform(r, lambda c: squash(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    return F.transform(clean, lambda r: F.struct(*(F.get(r, F.lit(i)).alias(n) for i, n in enumerate(REVISION))))


def parse_cover(blocks: Column, tables: Column, header: Column) -> Column:
    """Struct of fields (map of the known ones), approvals (map by role) and revision_history."""
    is_history = lambda t: F.coalesce(strip(F.get(F.get(t["rows"], F.lit(0)), F.lit(0))).startswith("Revision History"), F.lit(False))
    history = F.try_element_at(F.filter(tables, is_history), F.lit(-1))
    pairs = F.flatten(F.transform(F.filter(tables, lambda t: ~is_history(t)), lambda t: label_pairs(t["rows"])))
    known = lambda e: F.lower(e["key"]).isin(*COVER_FIELDS)
    fields = F.transform(F.filter(pairs, known), lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value")))
    roles = F.transform(F.filter(pairs, lambda e: ~known(e)), lambda e: F.struct(title_case(e["key"]).alias("key"), e["value"].alias("value")))
    bottom = F.coalesce(header["bbox"]["y1"], F.lit(float("-inf")))
    loose = F.filter(boxed(blocks), lambda b: (b["cy"] >= bottom) & ~F.exists(tables, lambda t: contains(t, b)))
    pattern = r"^([A-Z][A-Za-z ]{1,30}):\s*(\S.*)$"
    lines = F.filter(F.flatten(F.transform(loose, lambda b: F.transform(F.split(b["text"], "\n"), squash))), lambda x: x.rlike(pattern))
    more = F.transform(lines, lambda x: F.struct(title_case(F.regexp_extract(x, pattern, 1)).alias("key"), F.regexp_extract(x, pattern, 2).alias("value")))
    empty = F.array().cast("array<struct<rev_no:string,description:string,rev_date:string,effective_date:string>>")
    return F.struct(_last_wins(fields).alias("fields"), _last_wins(F.concat(roles, more)).alias("approvals"), F.coalesce(revision_history(history["rows"]), empty).alias("revision_history"))


def render_cover(fields: Column, approvals: Column, history: Column) -> Column:
    """A cover page's text from its metadata: fields in a fixed order, then roles, then revisions."""
    got = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    top = [F.array(F.concat(F.lit("Document: "), got("title")))] + [F.when(got(k) != "", F.array(F.concat(F.lit(f"{name}: "), got(k)))).otherwise(F.array().cast(STRINGS)) for k, name in COVER_LINES]
    listed = lambda head, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit(head)), items)).otherwise(F.array().cast(STRINGS))
    roles = F.transform(F.map_entries(approvals), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    none = lambda c: F.coalesce(c, F.lit(""))
    revs = F.transform(history, lambda r: F.concat(F.lit("- "), none(r["rev_no"]), F.lit(" (revised "), none(r["rev_date"]), F.lit(", effective "), none(r["effective_date"]), F.lit("): "), none(r["description"])))
    return F.array_join(reduce(F.concat, [*top, listed("Approvals:", roles), listed("Revision History:", revs)]), "\n")


def pages_from_layout(layout: DataFrame) -> DataFrame:
    """Page records of layout rows joined to the registry (see corpus.with_registry): doc, page, text, metadata.

    Precedence of metadata: registry name, then the first header found on any page, then cover fields. Listed pages are
    skipped; the cover page's text is rendered, others are cleaned. One shuffle by file gathers the document's metadata.
    """
    from ..functions.text import clean_text

    header, tables = split_header(F.col("tables"))
    rows = layout.withColumn("header", header).withColumn("own", tables)
    rows = rows.withColumn("is_cover", F.coalesce(F.col("page") == F.col("cover_page"), F.lit(False)))
    rows = rows.withColumn("head", F.when(F.col("header").isNotNull(), parse_header(F.col("header.rows")))).withColumn("cov", F.when(F.col("is_cover"), parse_cover(F.col("blocks"), F.col("own"), F.col("header"))))
    docs = rows.groupBy("file").agg(F.max("page").alias("total_pages"), F.min_by("head", F.when(F.col("head").isNotNull(), F.col("page"))).alias("h"), F.first("cov", ignorenulls=True).alias("c"))
    empty = F.create_map().cast("map<string,string>")
    named = F.concat(F.map_entries(F.coalesce("h", empty)), F.map_entries(F.coalesce("c.fields", empty)))
    docs = docs.withColumn("fields", _last_wins(named))
    rows = rows.filter(~F.array_contains("skip_pages", F.col("page"))).join(docs, "file")
    body = clean_text(body_text(F.col("blocks"), F.col("own"), F.col("header")))
    text = F.when(F.col("is_cover"), render_cover(F.col("fields"), F.coalesce("c.approvals", empty), F.col("c.revision_history"))).otherwise(body)
    fields = [F.nullif(F.try_element_at("fields", F.lit(k)), F.lit("")).alias(k) for k in ("title", "document_id", "version", "effective_date", "issued_by", "issued_to")]
    meta = F.struct(F.col("file").alias("source_file"), F.col("total_pages").cast("int").alias("total_pages"), *fields, F.when(F.col("is_cover"), "cover").otherwise("content").alias("page_type"), (~F.col("is_cover") & (F.size("own") > 0)).alias("has_table"), F.length("body").alias("char_count"))
    return rows.withColumn("body", text).select(F.col("name").alias("doc"), F.col("page").cast("int"), F.col("body").alias("text"), meta.alias("metadata"))
