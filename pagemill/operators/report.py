"""The quality report: eight checks of each document in order, their summaries and findings.

Every check is a verdict per document over page facts; a document that lacks facts of some
kind (no bookmarks, no drawings) still gets all eight rows.  All joins are by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import media as D
from . import quality as Q

#: Messages of findings, by check.
MESSAGES = {
    "misspelt": 'Footer month/year may contain a spelling error: "%s". Please check.',
    "missing": "Footer text found but no month/year was detected.",
    "differs": "Footer month/year differs on this page: %s",
    "quotes": "Straight quote characters detected (%s occurrence(s)).",
}
#: Speed options and what they are unless asked for.
OPTIONS = {"fast_dpi": False, "skip_raster_change_bar": False, "early_exit": False, "sample_pages": False}
DPI, FAST_DPI, POINTS = 200, 100, 72


def render_scale(dpi: Column) -> Column:
    """Pixels for each point of a page that is drawn at so many dots an inch."""
    return dpi / F.lit(float(POINTS))


def speed_options(asked: Column) -> Column:
    """Options from a map of strings: dpi, and three switches; what isn't asked for is off."""
    on = {name: F.coalesce(F.element_at(asked, F.lit(name)) == "true", F.lit(default)) for name, default in OPTIONS.items()}
    dpi = F.when(on["fast_dpi"], F.lit(FAST_DPI)).otherwise(F.lit(DPI))
    return F.struct(dpi.alias("dpi"), *[on[name].alias(name) for name in list(OPTIONS)[1:]])


def scanned_pages(pages: DataFrame, sample: bool, early_exit: bool, hit: Column) -> DataFrame:
    """Pages (doc_id, page_no from 1, total) that a raster scan looks at, with ``hit``.

    A sample takes the first, the last and about five between; an early exit ends at a
    document's first hit.
    """
    from pyspark.sql import Window

    from .lines import sample_pages

    found = pages.where(sample_pages(F.col("page_no"), F.col("total"))) if sample else pages
    found = found.withColumn("hit", F.coalesce(hit, F.lit(False)))
    if early_exit:
        before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("over", F.coalesce(F.bool_or("hit").over(before), F.lit(False))).where("not over").drop("over")
    return found


def checks(pages: DataFrame, footers: DataFrame, toc: DataFrame, spans: DataFrame, drawings: DataFrame, logos: DataFrame, brands: list, as_of: Column) -> DataFrame:
    """doc_id, check_no, check_id, status: eight rows a document, in the report's order.

    ``footers`` are pages with footer facts; ``logos`` (doc_id, ocr, on_first, on_last,
    tagline, mode, wanted) is what text recognition saw, where there is any.
    """
    docs = pages.select("doc_id").distinct()
    status = lambda found, otherwise: docs.join(found.select("doc_id", "status"), "doc_id", "left").select("doc_id", F.coalesce("status", F.lit(otherwise)).alias("status"))
    seen = lambda found, yes, no: status(found.select("doc_id").distinct().withColumn("status", F.lit(yes)), no)
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), " ").alias("text"))
    expected = Q.expected_brand(whole, brands).join(logos, "doc_id", "left")
    brand = expected.select("doc_id", D.brand_verdict(F.col("brand"), F.coalesce("ocr", F.lit(False)), *[F.col(c) for c in ("on_first", "on_last", "tagline", "mode", "wanted")]).alias("status"))
    found = {
        "footer_month_year": status(Q.footer_consistency(footers, as_of), "warn"), "bookmark_footer_title": status(Q.bookmark_match(toc, footers), "not_checked"),
        "brand_logo": status(brand, "not_checked"), "straight_quotes": seen(Q.straight_quotes(pages), "warn", "pass"),
        "watermark": seen(Q.watermarks(spans), "pass", "warn"), "change_bar": seen(Q.change_bars(drawings), "pass", "warn"),
        "even_page_count": Q.even_pages(pages).select("doc_id", "status"), "blank_page_notice": Q.blank_notices(pages).select("doc_id", "status"),
    }
    rows = [found[name].select("doc_id", F.lit(k).cast("long").alias("check_no"), F.lit(name).alias("check_id"), "status") for k, name in enumerate(Q.CHECKS, 1)]
    return reduce(DataFrame.union, rows)


def findings(pages: DataFrame, footers: DataFrame) -> DataFrame:
    """doc_id, page_no, check_id, severity, message, evidence: what the footer and quote checks point at.

    ``footers`` has footer_text, month_year, has_signal and misspelt.
    """
    many = footers.where("month_year is not null").groupBy("doc_id").agg(F.countDistinct(F.lower("month_year")).alias("n_months"))
    row = lambda frame, check, severity, message, evidence: frame.select("doc_id", "page_no", F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), message.alias("message"), evidence.alias("evidence"))
    bare = footers.where("has_signal and month_year is null")
    parts = [
        row(bare.where("misspelt is not null"), "footer_month_year", "error", F.format_string(MESSAGES["misspelt"], "misspelt"), F.col("footer_text")),
        row(bare.where("misspelt is null"), "footer_month_year", "error", F.lit(MESSAGES["missing"]), F.col("footer_text")),
        row(footers.where("month_year is not null").join(many.where("n_months > 1"), "doc_id"), "footer_month_year", "error", F.format_string(MESSAGES["differs"], "month_year"), F.col("month_year")),
        row(Q.straight_quotes(pages), "straight_quotes", "warning", F.format_string(MESSAGES["quotes"], F.col("n").cast("string")), F.col("evidence")),
    ]
    return reduce(DataFrame.union, parts)
