"""String functions as Column expressions. White space is Unicode's, as in Python's str.strip()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import BLOCK, let, running  # noqa: F401

#: Fixed value: the code points that count as white space, as the inside of a character class.
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same code points as one string, for functions that trim.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
ZWSP = "\u200b"

#: Bullet glyphs at line starts and what they become, in this order.
BULLETS = (
    (rf"(?md)^[ \t]*o\u200b[{WS}\u200b]*", "  - "),
    (rf"(?md)^[ \t]*○[{WS}\u200b]*", "  - "),
    (rf"(?md)^[ \t]*[●•▪][{WS}\u200b]*", "- "),
)
#: Signs and their replacements; those beyond the second string's end are deleted.
SIGNS = ("\u200b\xa0\u2018\u2019\u201c\u201d\u2013\u2014\u200c\u200d\u2060\ufeff\u00ad", "  ''\"\"--")
#: Fixed value: starts of lines that begin a new item.
NEW_ITEM = (
    rf"(?d)^([{WS}]*-[{WS}]|\||\p{{Nd}}+\.(\p{{Nd}}+\.?)*[{WS}]|\p{{Nd}}+-[A-Z]|[a-z]\.[{WS}]"
    rf"|Part[{WS}]\p{{Nd}}+[.:]|[A-Z][A-Za-z ()/&.-]{{0,30}}:([{WS}]|$))"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def words(c: Column) -> Column:
    """Non-empty runs of anything but white space."""
    return F.array_remove(F.split(c, rf"[{WS}]+"), "")


def squash(c: Column) -> Column:
    """Zero-width spaces and white space collapse to single blanks; ends are stripped."""
    return strip(F.regexp_replace(c, rf"[{WS}\u200b]+", " "))


def snake(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, small letters elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def before_first(c: Column, sign: str) -> Column:
    at = F.locate(sign, c)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def after_first(c: Column, sign: str) -> Column:
    at = F.locate(sign, c)
    return F.when(at > 0, F.substring(c, at + len(sign), F.length(c))).otherwise(F.lit(""))


def show_invisible(c: Column) -> Column:
    """Zero-width and non-breaking spaces made visible."""
    return F.replace(F.replace(c, F.lit(ZWSP), F.lit("<ZWSP>")), F.lit("\xa0"), F.lit("<NBSP>"))


def short_id(c: Column) -> Column:
    """The last two parts of an id."""
    parts = F.split(c, "-")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "-")


def doc_label(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"\.pdf\z", ""), F.lit("unknown"))


def signed(c: Column, digits: int = 4) -> Column:
    """Numbers of an array as a bracketed list with signs."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_string(f"%+.{digits}f", x.cast("double"))), ", "), F.lit("]"))


def count_lines(c: Column, start: str) -> Column:
    """Lines that start with `start`, letter case aside."""
    return F.size(F.filter(F.split(c, "\n"), lambda line: F.lower(line).startswith(start.lower())))


def normalize_bullets(c: Column) -> Column:
    for pattern, to in BULLETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def normalize_characters(c: Column) -> Column:
    return F.translate(c, *SIGNS)


def normalize_whitespace(c: Column) -> Column:
    """Blanks of each line collapse and its ends are stripped; a line that begins with two blanks and a dash keeps them."""
    # Single blanks stay as they are, so the pattern passes over them.
    one = lambda line: F.concat(F.when(line.startswith("  - "), F.lit("  ")).otherwise(F.lit("")), strip(F.regexp_replace(line, " [ \t]+|\t[ \t]*", " ")))
    return F.array_join(F.transform(F.split(c, "\n"), one), "\n")


def unwrap_lines(c: Column) -> Column:
    """Lines that only the page's width broke are joined by a blank.

    Whether a line is joined depends on the raw line before it and on whether that one was itself joined: it is a
    function of one truth value. Each line's function is two bits (the result after "not joined" and after "joined");
    running compositions of these give every line's answer, without a state that holds text.
    """

    def seen(line: Column) -> Column:
        return F.struct(line.alias("text"), is_blank(line).alias("blank"), (strip(line) == "-").alias("lone"), lstrip(line).startswith("|").alias("bar"), line.endswith(":").alias("colon"), line.rlike(NEW_ITEM).alias("new"))

    def bits(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(lines, i - 1)
            may = last["text"].isNotNull() & ~last["blank"] & ~x["blank"] & ~last["colon"]
            after_plain, after_joined = may & (last["lone"] | ~x["new"]) & ~last["bar"], may & ~x["new"]
            return F.coalesce(after_plain, F.lit(False)).cast("int") + 2 * F.coalesce(after_joined, F.lit(False)).cast("int")

        return F.transform(lines, one)

    # First a, then b: b's bit after a's bit, for either start. 2 leaves a truth value as it is.
    bit = lambda of, at: F.expr("1").bitwiseAND(F.call_function("shiftright", of, at))
    then = lambda a, b: bit(b, bit(a, F.lit(0))) + 2 * bit(b, bit(a, F.lit(1)))

    def joined(lines: Column, functions: Column, before: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            glue = bit(functions[i], bit(before[i], F.lit(0))) == 1
            return F.when(i == 0, x["text"]).when(glue, F.concat(F.lit(" "), lstrip(x["text"]))).otherwise(F.concat(F.lit("\n"), x["text"]))

        return F.array_join(F.transform(lines, piece), "")

    # 0 and 3 give one result after either; only where a line has another function do those before it count.
    so_far = lambda f: F.when(F.exists(f, lambda x: x.isin(1, 2)), running(f, F.lit(2), then)).otherwise(f)
    return let(F.transform(F.split(c, "\n"), seen), lambda lines: let(bits(lines), lambda f: let(so_far(f), lambda before: joined(lines, f, before))))


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    return collapse_blank_lines(unwrap_lines(normalize_whitespace(normalize_characters(normalize_bullets(c)))))
