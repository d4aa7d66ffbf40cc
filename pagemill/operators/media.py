"""Images of documents: names, crops by figure, page regions, brand verdicts, small labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

#: Output suffixes by format name, and words for statuses.
SUFFIXES = {"png": ".png", "jpeg": ".jpg", "jpg": ".jpg", "webp": ".webp", "tiff": ".tiff", "bmp": ".bmp"}
LABELS = {"pass": "PASS", "warn": "WARN", "fail": "FAIL", "not_checked": "NOT CHECKED"}
THUMBNAIL = 160


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def media_names(figures: DataFrame, suffix: str = ".png") -> DataFrame:
    """doc_id, seq, fig_no, href: a file name for each figure with an image, unique in its document.

    Names come from captions; one that repeats, or that a numbered name would take, gets the
    next free number by counting within the plain name.
    """
    shown = figures.where("has_image")
    slug = F.coalesce(F.nullif(T.slug(F.coalesce("text", F.lit(""))), F.lit("")), F.lit("image"))
    doc = Window.partitionBy("doc_id").orderBy("seq")
    named = shown.withColumn("slug", slug).withColumn("fig_no", F.row_number().over(doc) - 1)
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("seq")) - 1
    named = named.withColumn("name", F.when(n == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), n)))
    again = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("seq"))
    unique = F.when(again == 1, F.col("name")).otherwise(F.concat("name", F.lit("__"), again))
    return named.withColumn("unique", unique).select("doc_id", "seq", "fig_no", F.concat(F.lit("media/"), "unique", F.lit(suffix)).alias("href"))


def with_crops(named: DataFrame, crops: DataFrame) -> DataFrame:
    """Adds each figure's manual crop, or zeros."""
    sides = ("top", "bottom", "left", "right")
    c = crops.select("doc_id", "fig_no", *sides)
    return named.join(c, ["doc_id", "fig_no"], "left").fillna(0, list(sides))


def output_name(name: Column, suffix: Column, format: Column) -> Column:
    """A processed image's file name: its stem, a suffix, and the format's ending."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, suffix, F.coalesce(lookup(SUFFIXES, F.lower(format)), F.lit(".png")))


def page_regions(pages: DataFrame) -> DataFrame:
    """The two places of a logo: the top strip of page one, bottom left of the last page."""
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    found = pages.withColumn("last", last)
    region = lambda name, x1, y0, y1: F.struct(F.lit(name).alias("region"), F.lit(0.0).alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    top = F.when(F.col("page_no") == 1, region("header", F.col("width"), F.lit(0.0), F.col("height") * 0.22))
    end = F.when(F.col("page_no") == F.col("last"), region("corner", F.col("width") * 0.30, F.col("height") * 0.78, F.col("height")))
    return found.select("doc_id", "page_no", F.explode(F.filter(F.array(top, end), lambda r: r.isNotNull())).alias("r")).select("doc_id", "page_no", "r.*")


def brand_verdict(expected: Column, ocr: Column, on_first: Column, on_last: Column, tagline: Column, mode: Column, wanted: Column) -> Column:
    """Verdict on a logo; without a brand or text recognition it can't be checked."""
    colour = F.when(wanted == "monochrome", mode.isin("blue", "color")).when(wanted == "allow_blue", ~mode.isin("blue", "color", "unknown")).otherwise(False)
    return F.when(expected.isNull() | ~ocr, "not_checked").when(~on_first | ~on_last | ~tagline, "fail").when(colour, "warn").otherwise("pass")


def document_titles(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """The first bookmark of each document, else the first line of its first page."""
    mark = toc.groupBy("doc_id").agg(F.min_by("title", "toc_seq").alias("mark"))
    page = pages.groupBy("doc_id").agg(F.min_by(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), "page_no").alias("line"))
    return page.join(mark, "doc_id", "left").select("doc_id", F.coalesce("mark", "line").alias("title"))


def range_syntax(spec: Column) -> Column:
    """Whether a page range holds only digits, commas, dashes and white space."""
    return spec.rlike(r"^[\d\s,\-]+$")


def starts_with_number(text: Column) -> Column:
    """Whether the first four characters are a number, with its point or bracket."""
    return F.regexp_replace(F.trim(F.substring(text, 1, 4)), r"[.)]+$", "").rlike(r"^\d+$")


def thumbnail_height(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(h * (F.lit(float(THUMBNAIL)) / w)))
