"""Outlines of title lines, and the heading that an offset stands under, as Columns and joins: no Python.

A title line stands alone between blank lines (or an end of the text), begins with a capital, holds no bar, ends without a sign
of punctuation and has at most TITLE_WORDS words. "Part 1" and so on is a heading below the last title wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, upto
from ..functions.arrays import running as running_array
from ..functions.text import WS, is_blank, strip, words
from .corpus import lines_of
from .ranges import as_of, running
from .spans import COVER, TITLE_MOST, TITLE_WORDS

#: A part's heading, and what ends a line that is no title.
PART = rf"(?U)^Part[{WS}]+\p{{Nd}}+\b"
ENDS = r"[.:;,?!]\z"


def title_lines(text: Column) -> Column:
    """Array of (start, label, part) of the headings of a text."""

    def heading(x: Column, before: Column, after: Column) -> Column:
        line = x["text"]
        part = line.rlike(PART)
        alone = is_blank(before) & is_blank(after)
        title = line.rlike(r"^\p{IsUppercase}") & ~F.contains(line, F.lit("|")) & ~line.rlike(ENDS) & (F.size(words(line)) <= TITLE_WORDS)
        name = strip(F.regexp_replace(strip(line), ":+$", ""))
        label = F.when(part, F.when(F.length(name) <= TITLE_MOST, name).otherwise(F.regexp_extract(line, PART, 0))).otherwise(strip(line))
        return F.when(part | (alone & title), F.struct(x["start"].alias("start"), label.alias("label"), part.alias("part")))

    near = lambda lines, i: F.coalesce(F.get(lines, i)["text"], F.lit(""))
    return let(lines_of(text), lambda lines: F.filter(F.transform(lines, lambda x, i: heading(x, near(lines, i - 1), near(lines, i + 1))), lambda h: h.isNotNull()))


def sections(doc: Column, text: Column, content_start: Column) -> Column:
    """Array of (label, start, end, end_full, parent, depth, breadcrumb) of a text's headings from content_start on."""
    n = F.length(text)
    size = lambda h: F.size(h)

    def built(h: Column, above: Column, ahead: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            parent = F.when(x["part"], above[i]).otherwise(-1)
            end = F.coalesce(F.get(h, i + 1)["start"] + content_start, n)
            full = F.when(x["part"], end).otherwise(F.least(ahead[size(h) - 1 - i] + content_start, n))
            crumb = F.concat(doc, F.lit(" > "), F.when(parent >= 0, F.concat(F.get(h, F.greatest(parent, F.lit(0)))["label"], F.lit(" > "))).otherwise(""), x["label"])
            return F.struct(
                x["label"].alias("label"), (x["start"] + content_start).alias("start"), end.alias("end"), full.alias("end_full"), parent.alias("parent"), F.when(parent >= 0, 2).otherwise(1).alias("depth"), crumb.alias("breadcrumb")
            )

        return F.transform(h, one)

    never = F.lit(2**31 - 1) - content_start
    titles = lambda h: running_array(F.transform(upto(size(h)), lambda i: F.when(h[i]["part"], -1).otherwise(i)), F.lit(-1), lambda a, b: F.greatest(a, b))
    ahead = lambda h: running_array(F.reverse(F.transform(h, lambda x: F.when(x["part"], never).otherwise(x["start"]))), never, lambda a, b: F.least(a, b))
    body = F.substring(text, content_start + 1, n)
    return let(title_lines(body), lambda h: let(titles(h), lambda above: let(ahead(h), lambda a: built(h, above, a))))


def placed_headings(pages: DataFrame) -> DataFrame:
    """(doc, start, breadcrumb) of the headings of documents given as placed pages (corpus.placed_pages()), covers left out.

    A page ends with a gap, so whether a line stands alone shows within its page.
    """
    first = F.explode(title_lines(F.col("text")))
    content = pages.filter(~(F.coalesce("page_type", F.lit("")) == "cover"))
    rows = content.select("doc", F.col("start").alias("_from"), first.alias("h")).select("doc", (F.col("_from") + F.col("h.start")).alias("start"), "h.label", "h.part")
    title = F.when(~F.col("part"), F.struct("start", "label"))
    rows = running(rows, ["doc"], [F.col("start").asc()], tops={"_title": title})
    above = F.when(F.col("part") & F.col("_title").isNotNull(), F.concat(F.col("_title.label"), F.lit(" > "))).otherwise("")
    return rows.select("doc", "start", F.concat("doc", F.lit(" > "), above, "label").alias("breadcrumb"))


def headings_at(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """offsets (doc, start, ...) with `section`: the breadcrumb of the last heading at or before each, else the document; the cover's where
    a document has a cover page and the offset lies before its content. One document may have any number of offsets and headings.
    """
    marks = placed_headings(pages).withColumnRenamed("breadcrumb", "_crumb")
    cover = F.coalesce("page_type", F.lit("")) == "cover"
    content = pages.groupBy("doc").agg(F.max(cover).alias("_cover"), F.coalesce(F.min(F.when(~cover, F.col("start"))), F.max("end")).alias("_content"))
    found = as_of(offsets, marks, ["doc"], "start", ["_crumb"])
    rows = found.join(content, "doc", "left")
    crumb = F.when(F.col("_cover") & (F.col("start") < F.col("_content")), F.concat("doc", F.lit(f" > {COVER}"))).otherwise(F.coalesce("_crumb", "doc"))
    return rows.withColumn("section", crumb).select(*offsets.columns, "section")
