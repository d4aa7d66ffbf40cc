"""Document quality checks: per-page facts to findings, findings to a verdict per document.

A check gives rows (doc_id, check_id, status); ``overall`` rolls them up.  The date that
months are compared with is an argument, so a check gives the same answer tomorrow.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagemill.functions import text as T

STATUSES = ("pass", "not_checked", "warn", "fail")  # from best to worst
#: Size of small footer text, and words of a watermark.
SMALL_TEXT = 10.5
WATERMARK_WORDS = ("draft", "preliminary")
#: The checks in the order of a report.
CHECKS = ("footer_month_year", "bookmark_footer_title", "brand_logo", "straight_quotes", "watermark", "change_bar", "even_page_count", "blank_page_notice")
_MONTHS = T.MONTHS.split("|")


def in_footer(top: Column, size: Column, height: Column) -> Column:
    return (top >= height * 0.93) | ((top >= height * 0.90) & (F.coalesce(size, F.lit(99.0)) <= SMALL_TEXT))


def reaching(bottom: Column, height: Column) -> Column:
    return bottom > height * 0.95


def footer_words(words: DataFrame) -> DataFrame:
    """Footer text lines of each page, lowest two at most, as ``lines``.

    Takes words with the page's ``height``; where they have ``bottom``, a page without footer
    words gives those that reach into its lowest twentieth.  Words belong to a line by the distance from its
    first word, so lines are found by a fold over the page's few footer words.
    """
    own = in_footer(F.col("top"), F.col("size"), F.col("height"))
    low = words.where((own | reaching(F.col("bottom"), F.col("height")) if "bottom" in words.columns else own) & (F.trim("text") != ""))
    if "bottom" in words.columns:
        some = F.bool_or(own).over(Window.partitionBy("doc_id", "page_no"))
        low = low.withColumns({"own": own, "some": some}).where("own or not some")
    word = F.struct(F.bround(F.col("top") / 3).alias("band"), "x0", "top", F.trim("text").alias("text"))
    pages = low.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(word)).alias("w"))
    kind = "array<struct<first:double,top:double,words:array<struct<x0:double,text:string>>>>"

    def add(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        one = F.array(F.struct(w["x0"].alias("x0"), w["text"].alias("text")))
        begun = F.concat(done, F.array(F.struct(w["top"].alias("first"), w["top"].alias("top"), one.alias("words"))))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.least(last["top"], w["top"]).alias("top"), F.concat(last["words"], one).alias("words"))))
        return F.when((F.size(done) > 0) & (F.abs(w["top"] - last["first"]) <= 3), joined).otherwise(begun)

    grouped = pages.withColumn("g", F.aggregate("w", F.array().cast(kind), add))
    lines = F.array_sort(F.transform("g", lambda g: F.struct(g["top"].alias("top"), F.array_join(F.transform(F.array_sort(g["words"]), lambda w: w["text"]), " ").alias("text"))))
    found = grouped.withColumn("lines", lines)
    last, before = F.element_at("lines", -1), F.try_element_at(F.col("lines"), F.lit(-2))
    two = F.when((F.size("lines") > 1) & (last["top"] - before["top"] <= 14), F.array(before["text"], last["text"])).otherwise(F.array(last["text"]))
    return found.select("doc_id", "page_no", meaningful(two).alias("lines"))


def meaningful(lines: Column) -> Column:
    """Lines that are not empty, page numbers or copyright notices."""
    return F.filter(F.transform(lines, T.collapse), lambda x: (x != "") & ~x.rlike(r"(?i)^page\s+\d+$") & ~x.rlike(T.COPYRIGHT))


def footer_facts(pages: DataFrame) -> DataFrame:
    """Adds footer_text, month_year, has_signal and title to pages with footer ``lines``."""
    joined = F.array_join("lines", " | ")
    month = F.regexp_extract(joined, T.MONTH_YEAR, 0)
    signal = F.exists("lines", lambda x: x.rlike(T.MONTH_YEAR) | x.rlike(T.DOCUMENT_ID) | x.rlike(T.PAGE_NUMBER) | x.rlike(T.COPYRIGHT))
    numbered = F.filter("lines", lambda x: x.rlike(T.DOCUMENT_ID))
    texts = F.filter("lines", lambda x: ~x.rlike(T.MONTH_YEAR) & ~x.rlike(r"(?i)^page\s+\d+$") & x.rlike("[A-Za-z]") & ~x.rlike("(?i)^(note|warning|caution|danger):"))
    pick = F.when(F.size(numbered) > 0, F.get(numbered, F.lit(0))).when(F.size(texts) > 0, longest(texts)).otherwise(F.coalesce(longest(F.col("lines")), F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(pick, T.MONTH_YEAR, ""), T.PAGE_NUMBER, ""), "[·•]+", " ")
    clean = T.collapse(F.replace(F.replace(clean, F.lit("|"), F.lit(" ")), F.lit(" - "), F.lit(" ")))
    return pages.select("*", joined.alias("footer_text"), F.nullif(month, F.lit("")).alias("month_year"), signal.alias("has_signal"), clean.alias("title"))


def longest(lines: Column) -> Column:
    """The longest line, the first of several; null of none."""
    most = F.array_max(F.transform(lines, lambda x: F.length(x)))
    return F.get(F.filter(lines, lambda x: F.length(x) == most), F.lit(0))


@F.pandas_udf(StringType())
def near_month(texts: pd.Series) -> pd.Series:
    """The first ``word year`` of a footer whose word nearly spells a month."""
    import re

    pattern = re.compile(r"\b([a-z]{3,12})\s+(\d{4})\b", re.IGNORECASE)

    def find(text: str | None) -> str | None:
        for m in pattern.finditer(text or ""):
            if difflib.get_close_matches(m[1].casefold(), _MONTHS, n=1, cutoff=0.8):
                return m[0]
        return None

    return texts.map(find)


def month_of(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "MMMM yyyy"), F.try_to_date(text, "MMM yyyy"))


def footer_consistency(footers: DataFrame, as_of: Column) -> DataFrame:
    """Per document: distinct months, pages without one, and the verdict.

    A nearly spelt month (column ``misspelt``, if there) is a finding of its own and not a
    missing month; it does not decide the verdict.
    """
    misspelt = F.col("misspelt").isNotNull() if "misspelt" in footers.columns else F.lit(False)
    missing = F.col("has_signal") & F.col("month_year").isNull() & ~misspelt
    found = footers.groupBy("doc_id").agg(
        F.countDistinct(F.lower("month_year")).alias("n_months"), F.count_if(missing).alias("n_missing"), F.count_if(F.col("has_signal") & F.col("month_year").isNull() & misspelt).alias("n_misspelt"),
        F.min_by("month_year", F.when(F.col("month_year").isNotNull(), F.col("page_no"))).alias("detected"),
    )
    parsed = month_of(F.col("detected"))
    fine = F.coalesce(parsed >= F.trunc(as_of, "month"), F.lit(False))
    status = F.when(F.col("n_months") > 1, "fail").when(F.col("n_months") == 0, "warn").when(F.col("n_missing") > 0, "fail").when(fine, "pass").otherwise("warn")
    return found.select("doc_id", "n_months", "n_missing", "n_misspelt", status.alias("status"))


def bookmark_match(bookmarks: DataFrame, footers: DataFrame) -> DataFrame:
    """Whether a document's first top-level bookmark and its commonest footer title hold one another.

    Takes bookmarks (doc_id, toc_seq, level, title) and footers (doc_id, page_no, title,
    has_signal); documents come from either side.
    """
    text = T.strip(F.col("title"))
    top = F.min(F.when((F.col("level") == 1) & (text != ""), F.struct("toc_seq", text.alias("title"))))
    marks = bookmarks.groupBy("doc_id").agg(F.coalesce(top["title"], F.min(F.struct("toc_seq", text.alias("title")))["title"]).alias("bookmark"))
    titles = footers.where(F.col("has_signal") & (F.col("title") != "")).groupBy("doc_id", "title").agg(F.count("*").alias("n"), (-F.min("page_no")).alias("early"))
    common = titles.groupBy("doc_id").agg(F.max(F.struct("n", "early", "title"))["title"].alias("footer"))
    docs = footers.select("doc_id").union(bookmarks.select("doc_id")).distinct()
    both = docs.join(marks, "doc_id", "left").join(common, "doc_id", "left")
    a, b = T.normalize(F.col("bookmark")), T.normalize(F.col("footer"))
    same = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    status = F.when(F.col("bookmark").isNull(), "not_checked").when(F.col("footer").isNull(), "warn").when(same, "pass").otherwise("fail")
    return both.select("doc_id", "bookmark", "footer", status.alias("status"))


def expected_brand(docs: DataFrame, rules: list[tuple[str, bool, list[str]]]) -> DataFrame:
    """The brand that a document's text names, or null.

    ``rules`` lists (brand, first class, keywords) in order.  Keywords count wherever they
    stand, within words too.  First-class brands beat others, then more keywords, then order;
    among others order alone decides.
    """
    hay = T.normalize(F.col("text"))
    found = docs.select("doc_id", hay.alias("hay"))
    hits = [sum((F.col("hay").contains(T.normalize(F.lit(k))).cast("int") for k in words[1:]), F.col("hay").contains(T.normalize(F.lit(words[0]))).cast("int")) for _, _, words in rules]
    ranked = F.array(*[F.struct(F.lit(int(first)).alias("first"), (h if first else F.lit(0)).alias("hits"), F.lit(-k).alias("place"), F.lit(brand).alias("brand"), (h > 0).alias("some")) for k, ((brand, first, _), h) in enumerate(zip(rules, hits, strict=True))])
    best = F.array_max(F.filter(ranked, lambda x: x["some"]))
    return found.select("doc_id", best["brand"].alias("brand"))


def straight_quotes(pages: DataFrame) -> DataFrame:
    """Pages with straight quotes: how many, and the first ten."""
    found = F.regexp_extract_all("text", F.lit("([\"'])"), 1)
    return pages.select("doc_id", "page_no", F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, 10), "").alias("evidence")).where("n > 0")


def watermarks(spans: DataFrame, words: tuple[str, ...] = WATERMARK_WORDS) -> DataFrame:
    """Large text with a watermark word in the middle of the page, one a text block."""
    text = T.casefold(T.strip(F.col("text")))
    keyword = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    middle = x.between(F.col("width") * 0.2, F.col("width") * 0.8) & y.between(F.col("height") * 0.2, F.col("height") * 0.8)
    hits = spans.where((F.col("size") >= 20) & keyword & middle)
    first = hits.groupBy("doc_id", "page_no", "block_no").agg(F.min(F.struct("span_no", F.col("text"))).alias("s"))
    return first.select("doc_id", "page_no", "block_no", F.col("s.text").alias("text"))


def change_bars(drawings: DataFrame) -> DataFrame:
    """Pages with a narrow tall mark near a side margin."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    near = (F.col("x0") <= F.col("width") * 0.12) | (F.col("x1") >= F.col("width") * 0.88)
    return drawings.where(near & (w <= 6) & (h >= F.col("height") * 0.2)).select("doc_id", "page_no").distinct()


def even_pages(pages: DataFrame) -> DataFrame:
    n = F.count("*")
    return pages.groupBy("doc_id").agg(n.alias("n_pages"), F.when(n % 2 == 0, "pass").otherwise("fail").alias("status"))


def blank_notices(pages: DataFrame) -> DataFrame:
    """Blank pages but the last need the notice."""
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    found = pages.withColumn("blank", T.is_blank_page(F.col("text"))).withColumn("noticed", T.collapse(F.coalesce(F.col("text"), F.lit(""))).rlike(T.NOTICE)).withColumn("last", last)
    bad = F.count_if(F.col("blank") & ~F.col("noticed") & (F.col("page_no") != F.col("last")))
    return found.groupBy("doc_id").agg(F.count_if("blank").alias("n_blank"), bad.alias("n_missing"), F.when(bad > 0, "fail").otherwise("pass").alias("status"))


def overall(checks: DataFrame) -> DataFrame:
    """The worst status of each document's checks."""
    order = F.array(*[F.lit(s) for s in STATUSES])
    worst = F.max(F.array_position(order, F.col("status")))
    return checks.groupBy("doc_id").agg(F.element_at(order, worst.cast("int")).alias("status"), F.count_if(F.col("status").isin("fail", "warn")).alias("n_flagged"), F.count("*").alias("n_checks"))


def too_short(pages: DataFrame, least: int = 50) -> DataFrame:
    """Documents with too little text to be checked or converted."""
    chars = F.sum(F.length(T.strip(F.coalesce("text", F.lit("")))))
    return pages.groupBy("doc_id").agg(chars.alias("n_chars"), F.when(chars < least, F.lit("no text layer")).alias("error"))
