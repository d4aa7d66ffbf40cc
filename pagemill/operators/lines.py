"""Words to lines, lines to blocks, and joins of marks to lines by their place on the page.

All tables are keyed by doc_id and page_no; every window partitions by them, so one
partitioning of the word table serves the whole layer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

#: Thresholds in points, by which a line's size and weight tell its kind.
DROP_SIZE, H1_SIZE, NOTE_SIZE, H2_SIZE, H3_SIZE = 9.5, 17.0, 14.0, 13.5, 11.5
SUPERSCRIPT_SIZE = 6.0
TRADEMARKS = {"®": "reg", "™": "tm", "SM": "service"}
CODE_STARTS = ("telnet ", "C:\\>", "$ ", "http://")
REACH = 15  # points within which a number or a link belongs to a line
STRIP = 1024  # points of a page, more than twice REACH, that are searched together for marks
SESSION_GAP = 200
DIGIT_WIDTH, RULE_HEIGHT, TEXT_LEFT = (2, 12), 3, 160


def line_key(top: Column) -> Column:
    """Tops within a point of each other share a key: the nearest even number, ties to even."""
    return (F.bround(top / 2) * 2).cast("long")


def assemble(words: DataFrame) -> DataFrame:
    """doc_id, page_no, line_top, n_words, text: words of one line, from left to right."""
    keyed = words.withColumn("line_top", line_key(F.col("top")))
    line = F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text")))
    grouped = keyed.groupBy("doc_id", "page_no", "line_top").agg(line.alias("w"))
    return grouped.select("doc_id", "page_no", "line_top", F.size("w").alias("n_words"), F.array_join(F.col("w.text"), " ").alias("text"))


def line_class(size: Column, bold: Column) -> tuple[Column, Column]:
    """Type and level of a line by its mean size, and whether any word is bold."""
    kind = (
        F.when(size <= DROP_SIZE, "dropped").when(~bold, "paragraph").when(size >= H1_SIZE, "heading")
        .when(size >= NOTE_SIZE, "note_header").when(size >= H3_SIZE, "heading").otherwise("paragraph")
    )
    return kind, F.when(kind != "heading", 0).when(size >= H1_SIZE, 1).when(size >= H2_SIZE, 2).otherwise(3)


def classify(words: DataFrame) -> DataFrame:
    """doc_id, page_no, line_top, type, level: by mean size, and whether any word is bold."""
    bold = F.col("fontname").contains("Bold")
    keyed = words.groupBy("doc_id", "page_no", line_key(F.col("top")).alias("line_top")).agg(F.avg("size").alias("size"), F.bool_or(bold).alias("bold"))
    kind, level = line_class(F.col("size"), F.col("bold"))
    return keyed.select("doc_id", "page_no", "line_top", kind.alias("type"), level.alias("level"))


def styled_runs(words: DataFrame) -> DataFrame:
    """Runs of words of one style in each line, in order; a line is bold if all its words are."""
    bold, italic = F.col("fontname").contains("Bold"), F.col("fontname").contains("Italic") | F.col("fontname").contains("Oblique")
    style = F.when(bold & italic, "bi").when(bold, "b").when(italic, "i").otherwise("")
    keyed = words.select("doc_id", "page_no", line_key(F.col("top")).alias("line_top"), "x0", "word_seq", "text", style.alias("style"), bold.alias("bold"))
    line = Window.partitionBy("doc_id", "page_no", "line_top")
    order = line.orderBy("x0", "word_seq")
    starts = F.coalesce((F.lag("style").over(order) != F.col("style")).cast("int"), F.lit(1))
    keyed = keyed.withColumn("starts", starts).withColumn("run_no", F.sum("starts").over(order))
    keyed = keyed.withColumn("line_is_bold", F.min("bold").over(line))
    run = keyed.groupBy("doc_id", "page_no", "line_top", "run_no", "style", "line_is_bold").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))).alias("w"))
    return run.select("doc_id", "page_no", "line_top", "run_no", "style", "line_is_bold", F.array_join(F.col("w.text"), " ").alias("text"))


def kind_of(text: Column) -> Column:
    """The kind that a line's beginning tells, in order of precedence."""
    code = reduce(lambda a, b: a | b, [text.startswith(s) for s in CODE_STARTS])
    return (
        F.when(T.should_drop(text), "dropped").when(text.rlike(r"^[•–\-▪◆●○■□▸▹►]"), "list_item")
        .when(text.rlike(r"(?i)^Figure\s+\d[\d\-.]*\s*:"), "figure").when(text.rlike(r"(?i)^Notes?:"), "note_inline")
        .when(code, "code_block").otherwise("paragraph")
    )


def kinds(lines: DataFrame) -> DataFrame:
    """Adds ``type`` to lines, and takes the bullet from list items."""
    kind = kind_of(F.col("text"))
    return lines.withColumn("type", kind).withColumn("text", F.when(F.col("type") == "list_item", T.strip_bullet(F.col("text"))).otherwise(F.col("text")))


def merge_paragraphs(lines: DataFrame) -> DataFrame:
    """Joins a paragraph line to the paragraph before it unless that ends in ``.``, ``:`` or ``?``.

    Takes (doc_id, page_no, seq, type, text); dropped lines go first and don't part a
    paragraph, lines of other kinds and page ends do.  Gives (doc_id, page_no, block_no,
    type, text).
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    kept = lines.where("type <> 'dropped'")
    goes_on = (F.col("type") == "paragraph") & (F.lag("type").over(page) == "paragraph") & ~F.lag("text").over(page).rlike(r"[.:?]$")
    kept = kept.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("block_no", F.sum("starts").over(page))
    grouped = kept.groupBy("doc_id", "page_no", "block_no", "type").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("w"))
    return grouped.select("doc_id", "page_no", "block_no", "type", F.array_join(F.col("w.text"), " ").alias("text"))


def outside_bands(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Words whose line key is in no band (doc_id, page_no, y0, y1) of their page."""
    b = bands.select(F.col("doc_id").alias("b_doc"), F.col("page_no").alias("b_page"), "y0", "y1")
    top = line_key(F.col("top"))
    return words.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("page_no") == F.col("b_page")) & top.between(F.col("y0") - 2, F.col("y1") + 2), "left_anti")


def trademark(text: Column, size: Column) -> Column:
    """The trademark that a small superscript stands for, or null."""
    names = F.create_map(*[F.lit(x) for pair in TRADEMARKS.items() for x in pair])
    return F.when(size <= SUPERSCRIPT_SIZE, F.element_at(names, T.strip(text)))


def attach_trademarks(words: DataFrame) -> DataFrame:
    """Superscripts and the words they mark: the last word before them, in reading order, of
    the lowest line within 8 points that has begun by then.

    Line keys are even, so the reach is nine keys and the join is by key.  Takes words with
    ``flow``, their place in reading order; superscripts without such a line are left out.
    """
    keyed = words.withColumn("line_top", line_key(F.col("top"))).withColumn("tm", trademark(F.col("text"), F.col("size")))
    marks = keyed.where("tm is not null").select("doc_id", "page_no", F.col("flow").alias("mark_flow"), "tm", F.explode(F.expr("transform(sequence(-4, 4), d -> line_top + 2 * d)")).alias("line_top"))
    plain = keyed.where("tm is null").select("doc_id", "page_no", "line_top", "flow", "text")
    near = marks.join(plain, ["doc_id", "page_no", "line_top"]).where("flow < mark_flow")
    best = near.groupBy("doc_id", "page_no", "mark_flow", "tm").agg(F.max(F.struct("line_top", "flow", "text")).alias("w"))
    return best.select("doc_id", "page_no", "mark_flow", "tm", F.col("w.line_top").alias("line_top"), F.col("w.flow").alias("flow"), F.col("w.text").alias("text"))


def span_middle(y0: Column, y1: Column) -> Column:
    """The whole point nearest a span's middle, ties to even."""
    return F.bround((y0 + y1) / 2).cast("long")


def narrow_spans(spans: DataFrame) -> DataFrame:
    """Spans (width, height, x0) that may be a step number: a digit wide, no rule, left of the text."""
    return spans.where(F.col("width").between(*DIGIT_WIDTH) & (F.col("height") > RULE_HEIGHT) & (F.col("x0") < TEXT_LEFT))


def nearest_mark(places: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """For each place (doc_id, page_no, id, y) the mark of its page within REACH points with the least y.

    Places stand REACH points up from their y among the marks, so from the bottom of a page up
    the mark last passed is a place's answer if it is within reach; no place is copied.  Strips
    of STRIP points part pages of any length; marks near a strip's beginning also stand in the
    one before.  Marks of one page and y count once, the last by ``id``; if none of them has an
    id or a value, the value is that of the next y within reach.
    """
    strip = lambda y: y - F.pmod(y, F.lit(STRIP))
    y, at = F.col("y"), F.col("y") - REACH
    answers = marks.select("doc_id", "page_no", F.explode(F.array_distinct(F.array(strip(y), strip(y - 2 * REACH)))).alias("strip"), y.alias("at"), F.col("id").alias("mark_id"), F.when(F.col("id").isNotNull(), F.col(value)).alias(value), F.lit(False).alias("asks"))
    asked = places.select("doc_id", "page_no", strip(at).alias("strip"), at.alias("at"), "id", F.lit(True).alias("asks"))
    both = answers.unionByName(asked, allowMissingColumns=True).where("doc_id is not null and page_no is not null and at is not null")
    up = Window.partitionBy("doc_id", "page_no", "strip").orderBy(F.desc("at"), "asks", "mark_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = {"mark_y": F.when(~F.col("asks"), F.col("at")), "m": F.when(F.col(value).isNotNull(), F.struct("at", value))}
    found = both.withColumns({c: F.last(x, ignorenulls=True).over(up) for c, x in passed.items()})
    reach = F.col("at") + 2 * REACH
    found = found.where(F.col("asks") & (F.col("mark_y") <= reach)).withColumn("m", F.when(F.col("m.at") <= reach, F.col("m")))
    found = found.groupBy("doc_id", "page_no", "id").agg(F.min("mark_y").alias("mark_y"), F.min("m").alias("m"))
    return found.select("doc_id", "page_no", "id", "mark_y", F.col(f"m.{value}").alias(value))


def beside(places: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` to places: that of ``nearest_mark``, or null.

    The marks of a page, one a point of its height at most, are one row that each place meets:
    places are neither copied nor joined back, and stay where they are if they are dealt by page.
    """
    one = marks.groupBy("doc_id", "page_no", "y").agg(F.max_by(value, "id").alias(value))
    pages = one.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("at"), value))).alias("near"))
    first = F.get(F.filter("near", lambda m: m["at"].between(F.col("y") - REACH, F.col("y") + REACH)), F.lit(0))
    return places.join(pages, ["doc_id", "page_no"], "left").select(*places.columns, first[value].alias(value))


def number_sessions(marks: DataFrame) -> DataFrame:
    """Numbers marks down each page of a document, from 1 again after a gap of more than SESSION_GAP.

    One sort of a page serves all: a mark's number is its place on the page, counted from the last beginning.
    Marks without a y come last, so they take no number from others; so do those without an id at one y.
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy(F.asc_nulls_last("y"), F.asc_nulls_last("id"))
    gap = F.col("y") - F.lag("y").over(page)
    found = marks.withColumn("new", F.when(gap > SESSION_GAP, 1).otherwise(0)).withColumn("place", F.row_number().over(page))
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.coalesce(F.max(F.when(F.col("new") == 1, F.col("place"))).over(so_far), F.lit(1))
    return found.withColumn("session", F.sum("new").over(so_far)).withColumn("number", F.col("place") - begun + 1).drop("new", "place")


def number_steps(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Paragraphs near a number become numbered list items, with it as ``num``.

    Takes blocks with doc_id, page_no and y, and numbers (doc_id, page_no, y, id, number).
    """
    found = beside(blocks, numbers.withColumnRenamed("number", "num"), "num").withColumn("num", F.when(F.col("type") == "paragraph", F.col("num")))
    hit = F.col("num").isNotNull()
    return found.withColumns({"type": F.when(hit, "list_item").otherwise(F.col("type")), "list_kind": F.when(hit, "numbered").otherwise(F.col("list_kind"))})


def attach_links(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``href``: the link near a paragraph or list item, or null.  ``links`` is (doc_id, page_no, y, id, uri)."""
    found = beside(blocks, links.withColumnRenamed("uri", "href"), "href")
    return found.withColumn("href", F.when(F.col("type").isin("paragraph", "list_item"), F.col("href")))


def _line_facts(words: DataFrame) -> DataFrame:
    """doc_id, page_no, line_top, text, marked, bold, size, any_bold: each line plain, and with sentinels where a style begins or ends.

    Bold and italic begin and end on their own; ends come before beginnings.  ``bold`` tells
    whether the whole line is, ``any_bold`` whether any word is; ``size`` is the mean.
    """
    bold, italic = F.col("fontname").contains("Bold"), F.col("fontname").contains("Italic") | (F.col("fontname").contains("Oblique") & ~F.col("fontname").contains("Bold"))
    keyed = words.select("doc_id", "page_no", line_key(F.col("top")).alias("line_top"), "x0", "word_seq", "text", "size", bold.alias("b"), italic.alias("i"))
    order = Window.partitionBy("doc_id", "page_no", "line_top").orderBy("x0", "word_seq")
    was = {c: F.coalesce(F.lag(c).over(order), F.lit(False)) for c in "bi"}
    last = F.lead("word_seq").over(order).isNull()
    signs = [
        F.when(was["b"] & ~F.col("b"), "__BOLD_END__"), F.when(was["i"] & ~F.col("i"), "__ITALIC_END__"), F.when(F.col("b") & ~was["b"], "__BOLD_START__"), F.when(F.col("i") & ~was["i"], "__ITALIC_START__"),
        F.col("text"), F.when(last & F.col("b"), "__BOLD_END__"), F.when(last & F.col("i"), "__ITALIC_END__"),
    ]
    keyed = keyed.withColumn("signed", F.concat_ws(" ", *signs))
    line = keyed.groupBy("doc_id", "page_no", "line_top").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text", "signed"))).alias("w"), F.min("b").alias("bold"), F.avg("size").alias("size"), F.max("b").alias("any_bold"))
    return line.select("doc_id", "page_no", "line_top", F.array_join(F.col("w.text"), " ").alias("text"), F.array_join(F.col("w.signed"), " ").alias("marked"), "bold", "size", "any_bold")


def marked_text(words: DataFrame) -> DataFrame:
    """doc_id, page_no, line_top, text, marked, bold: each line plain and marked, and whether all of it is bold."""
    return _line_facts(words).drop("size", "any_bold")


def line_blocks(words: DataFrame) -> DataFrame:
    """Blocks of a page's lines: by how they begin, else by size and weight; paragraph lines that go on are joined.

    doc_id, page_no, y, seq, type, level, list_kind, text, marked, rows; dropped lines are left out.
    """
    kind, level = line_class(F.col("size"), F.col("any_bold"))
    lines = _line_facts(words).withColumns({"type": kind, "level": level}).drop("size", "any_bold")
    kind = kind_of(F.col("text"))
    lines = lines.withColumn("kind", F.when((kind == "dropped") | (F.col("type") == "dropped"), "dropped").when(kind != "paragraph", kind).otherwise(F.col("type"))).where("kind <> 'dropped'")
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_top")
    goes_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(page) == "paragraph") & ~F.lag("text").over(page).rlike(r"[.:?]$")
    lines = lines.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("block_no", F.sum("starts").over(page))
    item = F.col("kind") == "list_item"
    text = F.when(item, T.strip_bullet(F.col("text"))).otherwise(F.col("text"))
    grouped = lines.groupBy("doc_id", "page_no", "block_no", "kind").agg(
        F.array_sort(F.collect_list(F.struct("line_top", text.alias("text"), "marked", "bold"))).alias("w"), F.max("level").alias("level"),
    )
    styled = (F.col("kind") == "paragraph") & F.exists("w", lambda x: x["marked"].contains("__"))
    return grouped.select(
        "doc_id", "page_no", F.col("w")[0]["line_top"].alias("y"), F.col("block_no").alias("seq"), F.col("kind").alias("type"), F.when(F.col("kind") == "heading", F.col("level")).otherwise(0).alias("level"),
        F.when(F.col("kind") == "list_item", "bullet").alias("list_kind"), F.array_join(F.col("w.text"), " ").alias("text"), F.when(styled, F.array_join(F.col("w.marked"), " ")).alias("marked"),
        F.lit(None).cast("array<array<string>>").alias("rows"),
    )


def page_order(sources: list[DataFrame]) -> DataFrame:
    """Blocks of several passes over a page, in reading order: by page and y, earlier passes first on ties.

    Each source has doc_id, page_no, y, seq and the same further columns; ``id`` numbers the
    blocks of a document from 0.
    """
    every = reduce(DataFrame.unionByName, [s.withColumn("rank", F.lit(k)) for k, s in enumerate(sources)])
    place = Window.partitionBy("doc_id").orderBy("page_no", "y", "rank", "seq")
    return every.withColumn("id", (F.row_number().over(place) - 1).cast("long")).drop("rank", "seq")


def page_numbers(spec: Column, total: Column) -> Column:
    """Zero-based pages of a range like ``1-5, 8``; null for all pages; raises on other text.

    Parts out of range or reversed give nothing, and nothing at all means all pages.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), T.strip), lambda p: p != "")

    def pages(part: Column) -> Column:
        low = F.greatest(F.lit(1), F.substring_index(part, "-", 1).cast("int"))
        high = F.least(total, F.when(part.contains("-"), T.strip(F.substring_index(part, "-", -1)).cast("int")).otherwise(part.cast("int")))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    return F.when(F.size(found) > 0, F.transform(found, lambda p: p - 1))


def page_numbers_ok(spec: Column) -> Column:
    """Whether a page range can be read."""
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), T.strip), lambda p: p != "")
    return F.forall(parts, lambda p: p.rlike(r"^\d+$|^\d+\s*-\s*\d+$"))


def sample_pages(number: Column, total: Column) -> Column:
    """Whether a page is scanned: all of up to six, else first, last and about five between."""
    step = F.greatest(F.lit(1), F.floor(total / 5))
    return (total <= 6) | (number == 1) | (number == total) | (((number - 2) % step == 0) & number.between(2, total - 1))
