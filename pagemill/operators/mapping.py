"""Blocks to target elements: split headings, callout tables, notes, paths, captions.

Takes the blocks table (doc_id, seq, type, level, list_kind, note_type, text, rows) and adds
``element``.  Rules that the reference profile fixes are constants here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

#: One-cell header of a callout table, and the note it becomes.
CALLOUTS = {"WARNING": "warning", "CAUTION": "caution", "DANGER": "danger", "IMPORTANT INFORMATION": "notice", "IMPORTANT": "notice"}
#: Note types that are hazards, words that begin a note, signs of a reference document, and figure captions.
HAZARDS = ("notice", "caution", "warning", "danger")
NOTE_WORDS = ("note", "notes", "notice", "tip", "important")
REFERENCE_SIGNALS = ("parts list", "the following table", "field name", "abbreviations and acronyms", "appendix", "product codes")
DEFAULT_TYPE = "concept"
PATH = r".+\s*>\s*.+"
FIGURE = r"(?i)^Figure\s+\d[\d\-.]*\s*:\s*(.+)"


@dataclass(frozen=True)
class Profile:
    """What a mapping profile may set: signs of a reference document, menu paths, the type and element of the rest."""

    signals: tuple[str, ...] = REFERENCE_SIGNALS
    path: str = PATH
    default_type: str = DEFAULT_TYPE
    fallback: str = "drop"


USUAL = Profile()


def merge_split_headings(blocks: DataFrame) -> DataFrame:
    """Joins level-1 headings that follow one another, two by two."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    h1 = F.coalesce((F.col("type") == "heading") & (F.col("level") == 1), F.lit(False))
    found = blocks.withColumn("h1", h1).withColumn("run", F.row_number().over(doc) - F.row_number().over(Window.partitionBy("doc_id", "h1").orderBy("seq")))
    run = Window.partitionBy("doc_id", "h1", "run").orderBy("seq")
    second = F.col("h1") & (F.row_number().over(run) % 2 == 0)
    found = found.withColumn("second", second).withColumn("next", F.when(F.col("h1"), F.lead("text").over(run))).where("not second")
    text = F.when(F.col("h1"), T.strip(F.concat_ws(" ", "text", "next"))).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*blocks.columns)


def reclassify_callouts(blocks: DataFrame) -> DataFrame:
    """Tables whose first row is one cell with a callout word become notes of their other cells."""
    names = F.create_map(*[F.lit(x) for pair in CALLOUTS.items() for x in pair])
    head = F.when((F.col("type") == "table") & (F.size("rows") > 0), F.when(F.size(F.col("rows")[0]) == 1, F.upper(T.strip(F.col("rows")[0][0]))))
    kind = F.element_at(names, head)
    cells = F.filter(F.transform(F.flatten(F.slice("rows", F.lit(2), F.size("rows"))), T.strip), lambda c: c != "")
    found = blocks.withColumn("callout", kind)
    is_note = F.col("callout").isNotNull()
    return found.select(
        *[
            {"type": F.when(is_note, "note_header").otherwise(F.col("type")), "text": F.when(is_note, F.array_join(cells, " ")).otherwise(F.col("text")), "note_type": F.when(is_note, F.col("callout")).otherwise(F.col("note_type")), "rows": F.when(~is_note, F.col("rows"))}.get(c, F.col(c)).alias(c)
            for c in blocks.columns
        ]
    )


def note_element(text: Column, note_type: Column) -> Column:
    first = F.lower(F.regexp_replace(F.element_at(F.split(T.strip(text), r"\s+"), 1), ":+$", ""))
    note = F.when((T.strip(text) == "") | first.isin(*NOTE_WORDS), "note:note").otherwise("sectiondiv_title")
    return F.when(note_type.isin(*HAZARDS), F.concat(F.lit("hazard:"), note_type)).otherwise(note)


def is_path(text: Column, pattern: str = PATH) -> Column:
    """Whether a whole line is a menu path: single words around ``>``."""
    return text.contains(">") & text.rlike(f"^(?:{pattern})") & ~T.strip(F.replace(text, F.lit(" > "), F.lit(""))).contains(" ")


def path_steps(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\s*>\s*"), T.strip), lambda x: x != "")


def split_bold_path(text: Column, bold: Column) -> Column:
    """Elements of a paragraph whose first bold run is a menu path: the text before, then the path."""
    path = F.struct(F.lit("menucascade").alias("element"), T.strip(bold).alias("text"))
    before = T.strip(F.split_part(text, bold, F.lit(1)))
    plain = F.struct(F.when(is_path(text), "menucascade").otherwise("p").alias("element"), text.alias("text"))
    mixed = F.when(before == "", F.array(path)).otherwise(F.array(F.struct(F.lit("p").alias("element"), before.alias("text")), path))
    return F.when(bold.contains(">"), mixed).otherwise(F.array(plain))


def caption(text: Column) -> Column:
    found = T.strip(F.regexp_extract(text, FIGURE, 1))
    return F.when(found == "", text).otherwise(found)


def strip_note(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^Notes?:\s*", "")


def assign_elements(blocks: DataFrame, profile: Profile = USUAL) -> DataFrame:
    """Adds ``element``; inline notes lose their prefix, figures get ``caption``."""
    doc = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    h1 = (F.col("type") == "heading") & (F.col("level") == 1)
    nth = F.sum(F.when(h1, 1).otherwise(0)).over(doc)
    kind = F.col("type")
    element = (
        F.when(h1, F.when(nth == 1, "title").otherwise("section_title")).when(kind == "heading", F.when(F.col("level").isin(2, 3), "sectiondiv_title").otherwise("p"))
        .when(kind == "paragraph", F.when(is_path(F.col("text"), profile.path), "menucascade").otherwise("p"))
        .when(kind == "list_item", F.when(F.col("list_kind") == "numbered", "numbered_li").otherwise("ul_li"))
        .when(kind == "note_header", note_element(F.col("text"), F.col("note_type"))).when(kind == "note_inline", "note:note")
        .when(kind == "table", "table").when(kind == "figure", "fig").when(kind == "code_block", "codeblock").when(kind == "dropped", "dropped").otherwise(profile.fallback)
    )
    found = blocks.withColumn("element", element).withColumn("caption", F.when(kind == "figure", caption(F.col("text"))))
    return found.withColumn("text", F.when(kind == "note_inline", strip_note(F.col("text"))).otherwise(F.col("text")))


def map_blocks(blocks: DataFrame, profile: Profile = USUAL) -> DataFrame:
    """The three passes in order."""
    return assign_elements(reclassify_callouts(merge_split_headings(blocks)), profile)


def split_paths(mapped: DataFrame) -> DataFrame:
    """Parts paragraphs whose first bold run is a menu path into the text before it and the path.

    Takes ``marked``, the text with sentinels; ``seq`` is renumbered by tens to make room.
    """
    bold = F.regexp_extract("marked", r"__BOLD_START__\s*(.*?)\s*__BOLD_END__", 1)
    whole = F.array(F.struct(F.col("element"), F.col("text")))
    parts = F.when((F.col("type") == "paragraph") & F.coalesce(bold.contains(">"), F.lit(False)), split_bold_path(F.col("text"), bold)).otherwise(whole)
    found = mapped.select("*", F.size(parts).alias("n_parts"), F.posexplode(parts).alias("part_no", "part"))
    same = (F.col("n_parts") == 1) & (F.col("part.element") == F.col("element"))
    new = {"element": F.col("part.element"), "text": F.col("part.text"), "marked": F.when(same, F.col("marked")), "seq": F.col("seq") * 10 + F.col("part_no")}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in mapped.columns])


def document_types(blocks: DataFrame, profile: Profile = USUAL) -> DataFrame:
    """doc_id, topic_type: two numbered items make a task, tables or signal words a reference."""
    signal = F.lit(False)
    for word in profile.signals:
        signal = signal | F.lower("text").contains(word)
    counted = blocks.groupBy("doc_id").agg(
        F.count_if(F.col("list_kind") == "numbered").alias("numbered"), F.count_if(F.col("type") != "heading").alias("body"),
        F.count_if(F.col("type") == "table").alias("tables"), F.bool_or(F.coalesce(signal, F.lit(False))).alias("signal"),
    )
    kind = F.when(F.col("numbered") >= 2, "task").when((F.col("body") > 0) & (F.col("tables") * 2 >= F.col("body")), "reference").when(F.col("signal"), "reference").otherwise(profile.default_type)
    return counted.select("doc_id", kind.alias("topic_type"))
