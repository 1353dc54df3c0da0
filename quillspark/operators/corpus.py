"""Documents from pages, lines, regions, page lookup: one row for each document, arrays within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, upto
from ..functions.arrays import running as running_array
from ..functions.text import lstrip, rstrip, strip
from ..schemas import PAGE_GAP
from .ranges import running


def stitch(pages: DataFrame) -> DataFrame:
    """(doc, text, pages, metadata, content_start, cover): pages (doc, page, text, metadata) in page order.

    A gap goes before a page only if there is text already. Metadata are the first page's. The one shuffle is by doc.
    """
    meta = F.col("metadata") if "metadata" in pages.columns else F.lit(None).cast("struct<page_type:string>")
    order = F.col("ordinal") if "ordinal" in pages.columns else F.lit(0)
    rows = pages.select("doc", F.struct(F.col("page").cast("int").alias("page"), order.alias("o"), F.coalesce("text", F.lit("")).alias("text"), meta.alias("m")).alias("p"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise((a["o"] > b["o"]).cast("int") - (a["o"] < b["o"]).cast("int"))).alias("ps"))
    size = lambda p: F.length(p["text"])
    # Once there is text, every further page has a gap before it.
    first = F.array_position(F.transform("ps", lambda p: size(p) > 0), True).cast("int")

    def spans(at: Column, gaps) -> Column:
        begin = lambda i: at[i] + gaps(i)
        return F.transform("ps", lambda p, i: F.struct(p["page"].alias("page"), begin(i).alias("start"), (begin(i) + size(p)).alias("end"), p["m"]["page_type"].alias("page_type")))

    lead = F.when(first == 0, F.size("ps")).otherwise(first - 1)
    docs = docs.withColumn("pages", let(running_array(F.transform("ps", size), F.lit(0)), lambda at: let(lead, lambda f: spans(at, lambda i: F.greatest(i - f, F.lit(0)) * len(PAGE_GAP)))))
    parts = F.zip_with("ps", "pages", lambda p, s: F.concat(F.when(s["start"] > 0, F.lit(PAGE_GAP)).otherwise(F.lit("")), p["text"]))
    docs = docs.withColumn("text", F.array_join(parts, "")).withColumn("metadata", F.col("ps")[0]["m"]).drop("ps")
    cover = F.get(F.filter("pages", lambda p: p["page_type"] == "cover"), F.lit(0))
    content = F.get(F.filter("pages", lambda p: ~F.coalesce(p["page_type"] == "cover", F.lit(False))), F.lit(0))
    return docs.withColumn("cover", cover).withColumn("content_start", F.coalesce(content["start"], F.length("text")))


def placed_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, start, end, page_type, text, gap): each page (doc, page, text, metadata) with its place in the document that stitch()
    would make; gap tells whether a gap stands before it. Documents may be larger than a row or a task can be.
    """
    meta = F.col("metadata.page_type") if "metadata" in pages.columns else F.lit(None).cast("string")
    order = F.col("ordinal") if "ordinal" in pages.columns else F.lit(0)
    rows = pages.select("doc", F.col("page").cast("int").alias("page"), order.alias("_o"), F.coalesce("text", F.lit("")).alias("text"), meta.alias("page_type"))
    # Once there is text, every further page has a gap before it. Of pages that tie in number and order any may come first.
    by = [F.col("page").asc_nulls_first(), F.col("_o").asc_nulls_first(), F.xxhash64("text").asc()]
    size = F.length("text").cast("long")
    at = running(rows, ["doc"], by, sums={"_chars": size})
    # Pages with text before them have a gap; how many of these there are up to a page is a second sum.
    gaps = running(at.withColumn("gap", F.col("_chars") > 0), ["doc"], by, sums={"_gaps": F.col("gap").cast("long")}, inclusive=True)
    start = F.col("_chars") + F.col("_gaps") * len(PAGE_GAP)
    return gaps.select("doc", "page", start.alias("start"), (start + size).alias("end"), "page_type", "text", "gap")


def placed_lines(pages: DataFrame) -> DataFrame:
    """(doc, start, end, text, page): the lines of lines_of() of a stitched document, from placed_pages(), without bringing a document together.

    A gap is a line end and an empty line.
    """
    ends = pages.groupBy("doc").agg(F.max("end").alias("_size"))
    own = F.transform(lines_split(F.col("text")), lambda x: F.struct(x["start"].cast("long").alias("s"), x["text"].alias("t")))
    rows = pages.withColumn("_l", F.concat(F.when(F.col("gap"), F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.lit("").alias("t")))).otherwise(F.array().cast("array<struct<s:bigint,t:string>>")), F.when(F.col("gap") | (F.length("text") > 0), own).otherwise(F.array().cast("array<struct<s:bigint,t:string>>"))))
    lines = rows.select("doc", "page", "start", F.explode("_l").alias("l")).join(ends, "doc")
    at = F.col("start") + F.col("l.s")
    return lines.select("doc", at.alias("start"), F.least(at + F.length("l.t") + 1, "_size").alias("end"), F.col("l.t").alias("text"), "page").filter(F.col("start") < F.col("end"))


def lines_split(text: Column) -> Column:
    """Array of (start, text) of each line; a final line end is followed by an empty line."""

    def lines(parts: Column, at: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(at[i].alias("start"), x.alias("text")))

    return let(F.split(text, "\n", -1), lambda p: let(running_array(F.transform(p, lambda x: F.length(x) + 1), F.lit(0)), lambda at: lines(p, at)))


def pages_for(pages: Column, start: Column, end: Column) -> Column:
    """Numbers of the pages that a span touches; failing that the first page from its start on, else the last."""
    hit = F.filter(pages, lambda p: (p["start"] < end) & (start < p["end"]))
    later = F.filter(pages, lambda p: p["start"] >= start)
    one = F.coalesce(F.get(later, F.lit(0)), F.element_at(pages, -1))
    return F.transform(F.when(F.size(hit) > 0, hit).otherwise(F.array(one)), lambda p: p["page"])


def lines_of(text: Column) -> Column:
    """Array of (start, end with the line end, text) of each line; a final line end opens no further line."""
    parts = let(F.split(text, "\n"), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))

    def lines(parts: Column, at: Column, size: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(at[i].alias("start"), F.least(at[i] + F.length(x) + 1, size).alias("end"), x.alias("text")))

    return let(F.length(text), lambda n: let(parts, lambda p: let(running_array(F.transform(p, lambda x: F.length(x) + 1), F.lit(0)), lambda at: lines(p, at, n))))


def regions_of(text: Column) -> Column:
    """Array of (region, start, end, is_table, text): trimmed runs of table lines and of others, without empty ones."""
    # The sign that marks where one kind of lines ends; a text that holds it goes line by line.
    return F.when(F.contains(text, F.lit("\0")), _regions_by_lines(text)).otherwise(_regions_by_marks(text))


def _regions_by_marks(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, r"(?md)(^\|[^\n]*\n)(?!\|)", "$1\0"), r"(?md)(^(?!\|)[^\n]*\n)(?=\|)", "$1\0")

    def run(x: Column, at: Column, k: Column) -> Column:
        start = at + F.length(x) - F.length(lstrip(x))
        return let(strip(x), lambda b: F.struct((k + 1).alias("region"), start.alias("start"), (start + F.length(b)).alias("end"), x.startswith("|").alias("is_table"), b.alias("text")))

    runs = lambda parts, at: F.filter(F.transform(parts, lambda x, k: run(x, at[k], k)), lambda r: r["text"] != "")
    return let(F.split(marked, "\0"), lambda parts: let(running_array(F.transform(parts, F.length), F.lit(0)), lambda at: runs(parts, at)))


def _regions_by_lines(text: Column) -> Column:
    ended = lambda x: F.concat(x["text"], F.when(x["end"] - x["start"] > F.length(x["text"]), F.lit("\n")).otherwise(F.lit("")))
    bar = lambda x: x["text"].startswith("|")

    def runs(lines: Column, first: Column) -> Column:
        def run(i: Column, k: Column) -> Column:
            own = F.slice(lines, i + 1, F.coalesce(F.get(first, k + 1), F.size(lines)) - i)

            def trimmed(whole: Column) -> Column:
                start, body = lines[i]["start"] + F.length(whole) - F.length(lstrip(whole)), rstrip(lstrip(whole))
                return let(body, lambda b: F.struct((k + 1).alias("region"), start.alias("start"), (start + F.length(b)).alias("end"), bar(lines[i]).alias("is_table"), b.alias("text")))

            return let(F.array_join(F.transform(own, ended), ""), trimmed)

        return F.filter(F.transform(first, run), lambda r: r["text"] != "")

    # A run starts where a line differs from the one before it.
    starts = lambda lines: F.filter(upto(F.size(lines)), lambda i: (i == 0) | (bar(lines[i]) != bar(F.get(lines, i - 1))))
    return let(lines_of(text), lambda lines: let(starts(lines), lambda first: runs(lines, first)))


def regions(docs: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, region, start, end, is_table, text): a row for each region of a document's text. Narrow: no shuffle."""
    return docs.select(key, F.explode(regions_of(F.col("text"))).alias("r")).select(key, "r.*")


def char_totals(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Kept pages and characters of each document; documents without pages count zero."""
    sums = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("kept_pages"), F.sum(F.length("text")).cast("long").alias("chars"))
    return documents.select("doc").join(sums, "doc", "left").na.fill(0, ["kept_pages", "chars"])


def raw_and_clean(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Each page from 1 to a document's last with its raw and cleaned text; SKIPPED where there is no cleaned one."""
    numbers = raw.groupBy("doc").agg(F.max("page").alias("total")).select("doc", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("page"))
    both = numbers.join(raw.select("doc", F.col("page").cast("int"), F.col("text").alias("raw")), ["doc", "page"], "left")
    both = both.join(clean.select("doc", F.col("page").cast("int"), F.col("text").alias("clean")), ["doc", "page"], "left")
    return both.withColumn("status", F.when(F.col("clean").isNull(), "SKIPPED").otherwise("KEPT"))


def matching(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which one of the columns holds the query, letter case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return df.filter(hit)


def with_registry(df: DataFrame, registry: DataFrame, most: int = 100_000) -> DataFrame:
    """df (file) with name, template, cover_page, skip_pages; unknown files get their stem and `plain`."""
    reg = F.broadcast(registry) if registry.count() <= most else registry
    out = df.join(reg, "file", "left")
    stem = F.regexp_replace(F.col("file"), r"(?<=.)\.[^.]*$", "")
    return out.withColumns({"name": F.coalesce("name", stem), "template": F.coalesce("template", F.lit("plain")), "skip_pages": F.coalesce("skip_pages", F.array().cast("array<int>"))})
