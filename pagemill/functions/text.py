"""Column expressions for text: trimming, drop rules, normalising, slugs, XML escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are running matter rather than content.
DROP_PATTERNS = (r"^Page \d+", r"MDE-\w+.+\d{4}$", r"^©\s*\d{4}")
#: Notices that make a page blank, matched at the start.
BLANK_PATTERNS = (
    r"^this\s+page\s+(is\s+)?intentionally\s+(left\s+)?blank",
    r"^intentionally\s+(left\s+)?blank",
    r"^this\s+page\s+left\s+blank",
    r"^blank\s+page$",
)
#: Month names and abbreviations, longest form first as alternatives need.
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
)
#: Patterns of a footer's month, page number, document number, copyright line and blank-page notice.
MONTH_YEAR = rf"(?i)\b({MONTHS})\s+\d{{4}}\b"
PAGE_NUMBER = r"(?i)\bpage\s+\d+\b"
DOCUMENT_ID = r"(?i)\bMDE-[A-Z0-9-]+\b"
COPYRIGHT = r"^[©Â]\s*\d{4}"
NOTICE = r"(?i)this\s+page\s+(is\s+)?intentionally\s+(left\s+)?blank"


def strip(text: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def should_drop(text: Column) -> Column:
    """Whether a line is empty, under 3 characters, or running matter."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) < 3) | any_match(t, DROP_PATTERNS)


def is_blank_page(text: Column) -> Column:
    """Whether a page's text is nothing but dropped lines, or begins with a blank-page notice."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), strip), lambda x: ~should_drop(x))
    full = F.array_join(lines, " ")
    return (F.size(lines) == 0) | any_match(full, tuple(f"(?i){p}" for p in BLANK_PATTERNS))


def casefold(text: Column) -> Column:
    return F.lower(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss")))


def normalize(text: Column) -> Column:
    """Folded text without dates, page numbers and anything but a-z, 0-9 and single spaces."""
    undated = F.regexp_replace(casefold(F.coalesce(text, F.lit(""))), MONTH_YEAR, "")
    return F.trim(F.regexp_replace(F.regexp_replace(undated, PAGE_NUMBER, ""), "[^a-z0-9]+", " "))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def topic_filename(title: Column, number: Column) -> Column:
    """File name from a title, or from the topic's number where the title has none."""
    fallback = F.concat(F.lit("topic_"), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))
    name = slug(F.coalesce(title, F.lit("")))
    return F.concat(F.when(name == "", fallback).otherwise(name), F.lit(".dita"))


def title_case(text: Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    marked = F.regexp_replace(F.lower(text), r"(?<!\p{L})(\p{L})", "\u0001$1")
    pieces = F.split(marked, "\u0001")
    capital = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return F.concat(pieces[0], F.array_join(capital, ""))


def map_title(file_name: Column) -> Column:
    """A document's title from its file name: the stem with spaces, in title case."""
    stem = F.regexp_replace(file_name, r"\.[^.]+$", "")
    return title_case(F.regexp_replace(stem, "[_-]", " "))


def escape(text: Column) -> Column:
    """Text as XML character data."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attribute(text: Column) -> Column:
    return F.replace(escape(text), F.lit('"'), F.lit("&quot;"))


def strip_bullet(text: Column) -> Column:
    return F.regexp_replace(text, r"^[•–\-▪◆●○■□▸▹►]\s*", "")
