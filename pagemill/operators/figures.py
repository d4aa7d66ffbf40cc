"""Where figures are: the text-free gap above or below a caption, and sizes of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points around captions and page sides; names and pixels of image sizes.
MARGIN, LEAST_HEIGHT, CAPTION_HEIGHT = 54.0, 20.0, 15.0
PRESETS = {"Portrait full": (648, 864), "Portrait inset": (600, 864), "Landscape full": (912, 576), "Landscape inset": (864, 576)}


def figure_gaps(captions: DataFrame, extents: DataFrame) -> DataFrame:
    """Side and clip of each figure: the larger gap beside its caption, above on a tie.

    Takes captions (doc_id, page_no, fig_no, top, width, height) and text extents (doc_id,
    page_no, seq, y0, y1).  A caption's territory ends 2 points short of its neighbours.
    """
    page = ["doc_id", "page_no"]
    e = extents.select(*page, "seq", "y0", "y1")
    own = captions.join(e, page).where(F.abs(F.col("y0") - F.col("top")) < 10).groupBy(*page, "fig_no").agg(F.min(F.struct("seq", "y0", "y1")).alias("own"))
    placed = captions.join(own, [*page, "fig_no"], "left").withColumn("c0", F.coalesce("own.y0", "top")).withColumn("c1", F.coalesce("own.y1", F.col("top") + CAPTION_HEIGHT))
    order = Window.partitionBy(*page).orderBy("top", "fig_no")
    placed = placed.withColumn("from_y", F.coalesce(F.lag("c1").over(order) + 2, F.lit(0.0))).withColumn("to_y", F.coalesce(F.lead("c0").over(order) - 2, F.col("height")))
    inside = placed.select(*page, "fig_no", "c0", "c1", "from_y", "to_y").join(e, page).groupBy(*page, "fig_no").agg(
        F.max(F.when((F.col("y1") >= F.col("from_y")) & (F.col("y1") < F.col("c0") - 3), F.col("y1"))).alias("above"),
        F.min(F.when((F.col("y0") > F.col("c1") + 3) & (F.col("y0") <= F.col("to_y")), F.col("y0"))).alias("below"),
    )
    found = placed.join(inside, [*page, "fig_no"], "left").withColumn("above", F.coalesce("above", "from_y")).withColumn("below", F.coalesce("below", "to_y"))
    up, down = F.col("c0") - F.col("above"), F.col("below") - F.col("c1")
    side = F.when((up >= down) & (up >= LEAST_HEIGHT), "above").when((down >= up) & (down >= LEAST_HEIGHT), "below")
    found = found.withColumn("side", side).where("side is not null")
    return found.select(
        *page, "fig_no", "side", F.lit(MARGIN).alias("x0"), F.when(F.col("side") == "above", F.col("above") + 2).otherwise(F.col("c1") + 2).alias("y0"),
        (F.col("width") - MARGIN).alias("x1"), F.when(F.col("side") == "above", F.col("c0") - 2).otherwise(F.col("below") - 2).alias("y1"),
    )


def fit(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """(w, h) scaled to a width, or to a height where that overflows; truncated, enlarged too."""
    tall = F.floor(h * (to_w / w))
    by_width = F.struct(to_w.cast("long").alias("w"), tall.alias("h"))
    by_height = F.struct(F.floor(w * (to_h / h)).alias("w"), to_h.cast("long").alias("h"))
    return F.when((w == 0) | (h == 0), F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"))).when(tall > to_h, by_height).otherwise(by_width)


def canvas(size: Column, padding: Column, border: Column) -> Column:
    return size + 2 * (padding + border)


def cropped(w: Column, h: Column, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """(x0, y0, x1, y1) that a manual crop keeps: at least a pixel, and null where that fails."""
    x1, y1 = F.greatest(left + 1, w - right), F.greatest(top + 1, h - bottom)
    return F.struct(left.alias("x0"), top.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rgb(colour: Column) -> Column:
    """Red, green and blue of ``#rgb`` or ``#rrggbb``."""
    digits = F.regexp_replace(colour, "^#", "")
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.transform(F.sequence(F.lit(1), F.lit(5), F.lit(2)), lambda i: F.conv(F.substring(six, i, F.lit(2)), 16, 10).cast("int"))


def average_hash(pixels: Column) -> Column:
    """A bit a pixel: whether it is at least the mean."""
    wide = F.transform(pixels, lambda x: x.cast("double"))
    mean = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    return F.array_join(F.transform(wide, lambda x: F.when(x >= mean, "1").otherwise("0")), "")


def hash_distance(a: Column, b: Column) -> Column:
    """Places in which two bit strings of one length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def colour_mode(pixels: Column) -> Column:
    """blue, color or monochrome, from an array of (r, g, b)."""
    n = F.size(pixels)
    blue = F.size(F.filter(pixels, lambda p: (p["b"] > p["r"] + 20) & (p["b"] > p["g"] + 20))) / n
    coloured = F.size(F.filter(pixels, lambda p: (F.abs(p["r"] - p["g"]) > 14) | (F.abs(p["g"] - p["b"]) > 14) | (F.abs(p["r"] - p["b"]) > 14))) / n
    return F.when(n == 0, "unknown").when(blue > 0.02, "blue").when(coloured > 0.04, "color").otherwise("monochrome")
