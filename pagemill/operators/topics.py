"""Mapped blocks to topics: splitting, types, sub-topics, list runs, XML and maps.

A block's place in the output has three keys: topic_no, subtopic_no and seq.  Each block
renders to a fragment; containers open and close where a run of list items begins and ends;
one ordered concatenation a sub-topic, and one a topic, makes the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

from .mapping import HAZARDS, path_steps

#: Name space, document types and body elements of the output format.
NAMESPACE = "https://docs.oasis-open.org/dita/ns/2.0"
DECLARATION = "<?xml version='1.0' encoding='UTF-8'?>"
DOCTYPES = {
    "concept": '<!DOCTYPE concept PUBLIC "-//OASIS//DTD DITA 2.0 Concept//EN" "concept.dtd">',
    "task": '<!DOCTYPE task PUBLIC "-//OASIS//DTD DITA 2.0 Task//EN" "task.dtd">',
    "reference": '<!DOCTYPE reference PUBLIC "-//OASIS//DTD DITA 2.0 Reference//EN" "reference.dtd">',
    "topic": '<!DOCTYPE topic PUBLIC "-//OASIS//DTD DITA 2.0 Topic//EN" "topic.dtd">',
    "dita": '<!DOCTYPE dita PUBLIC "-//OASIS//DTD DITA 2.0 Composite//EN" "ditabase.dtd">',
    "map": '<!DOCTYPE map PUBLIC "-//OASIS//DTD DITA 2.0 Map//EN" "map.dtd">',
    "bookmap": '<!DOCTYPE bookmap PUBLIC "-//OASIS//DTD DITA 2.0 BookMap//EN" "bookmap.dtd">',
}
BODIES = {"concept": "conbody", "task": "taskbody", "reference": "refbody", "topic": "body"}
UNTITLED = "Untitled Topic"
_TITLES = ("title", "section_title", "sectiondiv_title", "dropped")


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def split_topics(mapped: DataFrame) -> DataFrame:
    """Adds topic_no, from 0: a section title begins a topic, as its title, unless it comes first."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    starts = (F.col("element") == "section_title") & (F.row_number().over(doc) > 1)
    found = mapped.withColumn("starts", starts.cast("int")).withColumn("topic_no", F.sum("starts").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("element", F.when(F.col("starts") == 1, "title").otherwise(F.col("element")))
    real = F.max((F.coalesce(F.col("element"), F.lit("dropped")) != "dropped").cast("int")).over(Window.partitionBy("doc_id", "topic_no"))
    return found.withColumn("real", real).where("real = 1").drop("starts", "real")


def chunk_type(appendix: Column, body: Column, steps: Column, numbered: Column, tables: Column, paragraphs: Column) -> Column:
    return (
        F.when(appendix, "reference").when(body == 0, "topic").when((steps > 0) | (numbered >= 2), "task")
        .when(tables * 2 >= body, "reference").when(paragraphs > 0, "concept").otherwise("topic")
    )


def _counts() -> dict[str, Column]:
    """Aggregates that tell the type of a run of blocks."""
    e = F.col("element")
    return {
        "body": F.count_if(e.isNotNull() & ~e.isin(*_TITLES)), "steps": F.count_if(e == "step"), "numbered": F.count_if(e == "numbered_li"),
        "tables": F.count_if(e == "table"), "paragraphs": F.count_if(e == "p"), "n_blocks": F.count("*"),
    }


def topic_types(split: DataFrame) -> DataFrame:
    """doc_id, topic_no, title, topic_type and counts of each topic."""
    heads = F.when(F.col("element").isin("title", "section_title"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    own = F.when(F.col("element") == "title", F.struct("seq", "text"))
    found = split.groupBy("doc_id", "topic_no").agg(F.min(heads).alias("head"), F.min(own).alias("own"), *[c.alias(n) for n, c in _counts().items()])
    appendix = F.lower(F.element_at(F.split(T.strip(F.col("head.text")), r"\s+"), 1)) == "appendix"
    kind = chunk_type(F.coalesce(appendix, F.lit(False)), *(F.col(c) for c in ("body", "steps", "numbered", "tables", "paragraphs")))
    return found.select("doc_id", "topic_no", F.col("head.text").alias("file_title"), F.coalesce("own.text", F.lit(UNTITLED)).alias("title"), F.col("own.seq").alias("title_seq"), kind.alias("topic_type"), "n_blocks", "numbered", "tables", "paragraphs")


def subtopics(split: DataFrame) -> DataFrame:
    """Adds subtopic_no: 0 up to the first sub-heading of a topic, then one for each."""
    topic = Window.partitionBy("doc_id", "topic_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return split.withColumn("subtopic_no", F.sum((F.col("element") == "sectiondiv_title").cast("int")).over(topic))


def subtopic_types(numbered: DataFrame) -> DataFrame:
    """doc_id, topic_no, subtopic_no, sub_title, sub_type of each sub-topic."""
    found = numbered.where("subtopic_no > 0").groupBy("doc_id", "topic_no", "subtopic_no").agg(F.min(F.when(F.col("element") == "sectiondiv_title", F.struct("seq", "text"))).alias("head"), *[c.alias(n) for n, c in _counts().items()])
    kind = chunk_type(F.lit(False), *(F.col(c) for c in ("body", "steps", "numbered", "tables", "paragraphs")))
    return found.select("doc_id", "topic_no", "subtopic_no", F.col("head.text").alias("sub_title"), kind.alias("sub_type"))


def short_descriptions(split: DataFrame) -> DataFrame:
    """doc_id, topic_no, shortdesc, short_seq: the first paragraph after a topic's title, if it has text."""
    topic = Window.partitionBy("doc_id", "topic_no")
    title = F.min(F.when(F.col("element") == "title", F.col("seq"))).over(topic)
    found = split.withColumn("title_seq", title).where("element = 'p' and seq > title_seq")
    first = found.groupBy("doc_id", "topic_no").agg(F.min(F.struct("seq", "text")).alias("p"))
    return first.where("p.text <> ''").select("doc_id", "topic_no", F.col("p.text").alias("shortdesc"), F.col("p.seq").alias("short_seq"))


def placed(mapped: DataFrame) -> DataFrame:
    """Every block with its keys, its topic's and sub-topic's facts, and whether it is rendered.

    All facts are window aggregates over keys that begin with doc_id, so one partitioning by
    doc_id serves them and what follows; nothing is joined back.
    """
    found = subtopics(split_topics(mapped))
    topic, sub = Window.partitionBy("doc_id", "topic_no"), Window.partitionBy("doc_id", "topic_no", "subtopic_no")
    e, order = F.col("element"), F.col("seq")
    head = F.min(F.when(e.isin("title", "section_title"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).over(topic)
    own = F.min(F.when(e == "title", F.struct("seq", "text"))).over(topic)
    names = list(_counts())
    found = found.withColumns({"head": head, "own": own} | {f"t_{n}": c.over(topic) for n, c in _counts().items()} | {f"s_{n}": c.over(sub) for n, c in _counts().items()})
    appendix = F.coalesce(F.lower(F.element_at(F.split(T.strip(F.col("head.text")), r"\s+"), 1)) == "appendix", F.lit(False))
    kind = chunk_type(appendix, *(F.col(f"t_{c}") for c in names[:5]))
    sub_kind = chunk_type(F.lit(False), *(F.col(f"s_{c}") for c in names[:5]))
    title = F.coalesce("own.text", F.lit(UNTITLED))
    found = found.withColumns({"title": title, "file_title": F.col("head.text"), "title_seq": F.col("own.seq"), "topic_type": kind, "sub_type": F.when(F.col("subtopic_no") > 0, sub_kind)})
    paragraph = F.min(F.when((e == "p") & (order > F.col("title_seq")), F.struct("seq", "text"))).over(topic)
    first_word = F.coalesce(F.element_at(F.split(T.strip(F.col("title")), r"\s+"), 1), F.lit(""))
    shape = F.when(F.lower("title").contains("introduction"), "intro").when((F.col("topic_type") == "reference") & (first_word == "Appendix"), "appendix").otherwise("composite")
    found = found.withColumns({"short": paragraph, "shape": shape, "sub_title": F.min(F.when(e == "sectiondiv_title", F.struct("seq", "text"))).over(sub)["text"]})
    shown = F.col("short.text") != ""
    found = found.withColumns({"shortdesc": F.when(shown, F.col("short.text")), "short_seq": F.when(shown, F.col("short.seq"))})
    rendered = (order > F.col("title_seq")) & (F.col("short_seq").isNull() | (order != F.col("short_seq"))) & ~e.isin("title", "dropped", "drop")
    effective = F.when((F.col("shape") == "intro") | (F.col("subtopic_no") == 0), F.col("topic_type")).otherwise(F.col("sub_type"))
    return found.withColumns({"rendered": F.coalesce(rendered, F.lit(False)), "effective_type": effective}).drop("head", "own", "short", *[f"{k}_{n}" for k in "ts" for n in names])


def container(element: Column, effective: Column) -> Column:
    """The list that an item stands in, or null."""
    return F.when(element == "step", "steps").when(element == "ul_li", "ul").when(element == "ol_li", "ol").when(element == "numbered_li", F.when(effective == "task", "steps").otherwise("ol"))


def list_runs(blocks: DataFrame) -> DataFrame:
    """Adds container, opens and closes: where a list begins and ends among rendered blocks."""
    order = Window.partitionBy("doc_id", "topic_no", "subtopic_no", "rendered").orderBy("seq")
    found = blocks.withColumn("container", F.when(F.col("rendered"), container(F.col("element"), F.col("effective_type"))))
    same = lambda c: F.coalesce(c == F.col("container"), F.lit(False))
    return found.withColumn("opens", F.col("container").isNotNull() & ~same(F.lag("container").over(order))).withColumn("closes", F.col("container").isNotNull() & ~same(F.lead("container").over(order)))


def _wrap(tag: str, body: Column) -> Column:
    """``<tag>body</tag>``, or ``<tag/>`` around nothing."""
    name = tag.split(" ")[0]
    return F.when(body == "", F.lit(f"<{tag}/>")).otherwise(F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{name}>")))


def inline_xml(text: Column, bold: Column | None = None) -> Column:
    """Text with style marks as XML: bold spans win over italic ones, which drop trademarks."""

    def marks(t: Column) -> Column:
        return F.regexp_replace(t, r"((?:(?!__TM__)[^ ])*)\s*__TM__([a-z]+)__", '<tm tmtype="$2">$1</tm>')

    whole = text.startswith("__BOLD__") | (F.lit(False) if bold is None else bold)
    t = T.escape(F.regexp_replace(text, "^__BOLD__", ""))
    with_bold = marks(F.regexp_replace(t, r"__ITALIC_(?:START|END)__\s*", ""))
    with_bold = F.replace(F.replace(with_bold, F.lit("__BOLD_START__"), F.lit("<b>")), F.lit("__BOLD_END__"), F.lit("</b>"))
    with_italic = F.regexp_replace(t, r"__BOLD_(?:START|END)__\s*", "")
    with_italic = F.replace(F.replace(with_italic, F.lit("__ITALIC_START__"), F.lit("<i>")), F.lit("__ITALIC_END__"), F.lit("</i>"))
    in_bold = lambda x: F.when(whole, F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x)
    return F.when(text == "", "").when(t.contains("__BOLD_START__"), with_bold).when(t.contains("__ITALIC_START__"), in_bold(with_italic)).otherwise(in_bold(marks(t)))


def link_xml(href: Column) -> Column:
    """An empty external ``xref`` before the text of a paragraph with a link; nothing without one."""
    email = F.when(href.startswith("mailto:"), ' format="email"').otherwise("")
    return F.when(F.coalesce(href, F.lit("")) == "", "").otherwise(F.concat(F.lit('<xref href="'), T.attribute(href), F.lit('" scope="external"'), email, F.lit("/>")))


def table_xml(rows: Column) -> Column:
    """A table of ragged rows: the first is the head, short rows are filled with empty entries.

    Further head rows follow while they hold a cell ``__STRADDLE__n``, by which the cell
    before it spans n columns.
    """
    n = F.array_max(F.transform(rows, lambda r: F.size(r)))
    straddles = F.transform(rows, lambda r: F.exists(r, lambda c: c.startswith("__STRADDLE__")))
    plain = F.array_position(F.slice(straddles, F.lit(2), F.size(rows)), False)
    heads = F.when(plain == 0, F.size(rows)).otherwise(plain).cast("int")
    specs = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit('<colspec colname="col'), i, F.lit('" colnum="'), i, F.lit('"/>'))), "")

    def row_xml(row: Column, head: bool) -> Column:
        def step(done: Column, i: Column) -> Column:
            value, after = F.get(row, i), F.coalesce(F.get(row, i + 1), F.lit(""))
            spans = after.startswith("__STRADDLE__")
            width = F.coalesce(F.regexp_extract(after, r"^__STRADDLE__(\d+)", 1).try_cast("int"), n)
            plain = T.escape(F.trim(F.regexp_replace(F.regexp_replace(value, "__TM__[a-z]+__", ""), "^__BOLD__", "")))
            text = plain if head else F.when(spans, F.when(plain == "", "").otherwise(F.concat(F.lit("<b>"), plain, F.lit("</b>")))).otherwise(inline_xml(value))
            named = F.concat(F.lit('<entry namest="col'), i + 1, F.lit('" nameend="col'), i + width, F.lit('">'), text, F.lit("</entry>"))
            entry = F.concat(done["xml"], F.when(spans, named).otherwise(_wrap("entry", text)))
            return F.when(i < done["next"], done).otherwise(F.struct(F.when(spans, i + width).otherwise(i + 1).alias("next"), entry.alias("xml")))

        done = F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), F.struct(F.lit(0).alias("next"), F.lit("").alias("xml")), step)
        cells = F.when(F.size(row) > 0, done).otherwise(F.struct(F.lit(0).alias("next"), F.lit("").alias("xml")))
        return F.concat(F.lit("<row>"), cells["xml"], F.repeat(F.lit("<entry/>"), F.greatest(F.lit(0), n - cells["next"])), F.lit("</row>"))

    thead = F.array_join(F.transform(F.slice(rows, F.lit(1), heads), lambda r: row_xml(r, True)), "")
    body = F.array_join(F.transform(F.slice(rows, heads + 1, F.size(rows)), lambda r: row_xml(r, False)), "")
    return F.concat(
        F.lit('<table frame="all"><tgroup cols="'), n, F.lit('">'), specs, F.lit("<thead>"), thead, F.lit("</thead>"),
        F.when(F.size(rows) > heads, F.concat(F.lit("<tbody>"), body, F.lit("</tbody>"))).otherwise(""), F.lit("</tgroup></table>"),
    )


def fragments(runs: DataFrame) -> DataFrame:
    """Adds ``fragment``: the XML of each rendered block, with the tags that open and close its list.

    Where blocks have them, ``href`` is a paragraph's link and ``image`` a figure's file.
    """
    e, text = F.col("element"), T.escape(F.col("text"))
    own_text = F.coalesce("marked", "text") if "marked" in runs.columns else F.col("text")
    marked = F.when(own_text.contains("__"), inline_xml(own_text)).otherwise(T.escape(own_text))
    link = link_xml(F.col("href")) if "href" in runs.columns else F.lit("")
    source = T.attribute(F.coalesce("image", F.lit(""))) if "image" in runs.columns else F.lit("")
    shown = F.when(source == "", F.concat(F.lit("[IMAGE — "), T.escape(F.col("caption")), F.lit("]"))).otherwise(T.escape(F.col("caption")))
    hazard = F.substring_index(e, ":", -1)
    figure = F.concat(F.lit("<fig>"), _wrap("title", T.escape(F.col("caption"))), F.lit('<image href="'), source, F.lit('" placement="inline"><alt>'), shown, F.lit("</alt></image></fig>"))
    path = F.concat(F.lit("<p><menucascade>"), F.array_join(F.transform(path_steps(F.col("text")), lambda s: _wrap("uicontrol", T.escape(s))), ""), F.lit("</menucascade></p>"))
    section = F.when(F.col("shape") == "intro", F.concat(F.lit("<section>"), _wrap("title", text))).otherwise("")
    own = (
        F.when(e == "p", _wrap("p", F.concat(link, marked))).when(e == "menucascade", path).when(F.col("container") == "steps", F.concat(F.lit("<step>"), _wrap("cmd", text), F.lit("</step>")))
        .when(F.col("container").isNotNull(), F.concat(F.lit("<li>"), _wrap("p", text), F.lit("</li>")))
        .when(hazard.isin(*HAZARDS), F.concat(F.lit('<hazardstatement type="'), hazard, F.lit('"><messagepanel>'), _wrap("typeofhazard", text), F.lit("</messagepanel></hazardstatement>")))
        .when(e.startswith("note:"), F.concat(F.lit('<note type="'), hazard, F.lit('">'), _wrap("p", text), F.lit("</note>")))
        .when(e == "fig", figure).when(e == "codeblock", _wrap("codeblock", text)).when((e == "table") & (F.size("rows") > 0), table_xml(F.col("rows"))).when(e == "sectiondiv_title", section).otherwise("")
    )
    opens = F.when(F.col("opens"), F.concat(F.lit("<"), F.col("container"), F.lit(">"))).otherwise("")
    closes = F.when(F.col("closes"), F.concat(F.lit("</"), F.col("container"), F.lit(">"))).otherwise("")
    return runs.withColumn("fragment", F.when(F.col("rendered"), F.concat(opens, own, closes)))


def render(mapped: DataFrame) -> DataFrame:
    """doc_id, topic_no, filename, topic_type, root, xml of each topic.

    Topics are composites whose sub-topics stand side by side, but for introductions, whose
    sub-headings are sections, and appendices, whose sub-topics nest.  File names that would
    repeat within a document get a number.
    """
    done = fragments(list_runs(placed(mapped)))
    facts = ("title", "file_title", "topic_type", "shape", "shortdesc")
    parts = F.array_sort(F.collect_list(F.when(F.col("rendered"), F.struct("seq", "fragment"))))
    sub = done.groupBy("doc_id", "topic_no", "subtopic_no").agg(parts.alias("w"), F.max("sub_type").alias("sub_type"), F.max("sub_title").alias("sub_title"), *[F.max(c).alias(c) for c in facts])
    inside = F.array_join(F.col("w.fragment"), "")
    body = lookup(BODIES, F.col("sub_type"))
    tagged = lambda tag, x: F.when(x == "", F.concat(F.lit("<"), tag, F.lit("/>"))).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">")))
    opened = F.concat(F.lit("<"), F.col("sub_type"), F.lit(">"), _wrap("title", T.escape(F.col("sub_title"))), tagged(body, inside))
    closed = F.concat(F.lit("</"), F.col("sub_type"), F.lit(">"))
    first = F.col("subtopic_no") == 0
    sub = sub.withColumns({
        "main": F.when(first, inside).when(F.col("shape") == "intro", F.concat(inside, F.lit("</section>"))).otherwise(""),
        "after": F.when(first | (F.col("shape") == "intro"), "").when(F.col("shape") == "appendix", opened).otherwise(F.concat(opened, closed)),
        "end": F.when(~first & (F.col("shape") == "appendix"), closed).otherwise(""),
    })
    found = sub.groupBy("doc_id", "topic_no").agg(F.array_sort(F.collect_list(F.struct("subtopic_no", "main", "after", "end"))).alias("w"), *[F.max(c).alias(c) for c in facts])
    found = found.withColumns({"main": F.array_join(F.col("w.main"), ""), "after": F.array_join(F.col("w.after"), ""), "end": F.array_join(F.reverse(F.col("w.end")), "")})
    lang, ns = 'xml:lang="en-US"', f'xmlns="{NAMESPACE}"'
    t = F.col("topic_type")
    head = F.concat(_wrap("title", T.escape(F.col("title"))), F.when(F.col("shortdesc").isNotNull(), _wrap("shortdesc", T.escape(F.col("shortdesc")))).otherwise(""), tagged(lookup(BODIES, t), F.col("main")))
    composite = F.concat(F.lit(f"<dita {ns} {lang}><"), t, F.lit(f" {lang}>"), head, F.lit("</"), t, F.lit(">"), F.col("after"), F.lit("</dita>"))
    single = F.concat(F.lit("<"), t, F.lit(f" {ns} {lang}>"), head, F.col("after"), F.col("end"), F.lit("</"), t, F.lit(">"))
    root = F.when(F.col("shape") == "composite", "dita").otherwise(t)
    xml = F.concat(F.lit(f"{DECLARATION}\n"), lookup(DOCTYPES, root), F.lit("\n"), F.when(F.col("shape") == "composite", composite).otherwise(single))
    named = found.withColumn("stem", T.topic_filename(F.col("file_title"), F.col("topic_no") + 1))
    return with_unique_names(named, "stem", "topic_no").select("doc_id", "topic_no", F.col("name").alias("filename"), "topic_type", root.alias("root"), "title", xml.alias("xml"))


def with_unique_names(files: DataFrame, column: str, order: str) -> DataFrame:
    """Adds ``name``: the first file of a name keeps it, later ones get _1, _2 before the suffix."""
    n = F.row_number().over(Window.partitionBy("doc_id", column).orderBy(order)) - 1
    stem, suffix = F.regexp_replace(column, r"\.[^.]*$", ""), F.regexp_extract(column, r"(\.[^.]*)$", 1)
    return files.withColumn("name", F.when(n == 0, F.col(column)).otherwise(F.concat(stem, F.lit("_"), n, suffix)))


def map_item(kind: str) -> Column:
    """A topic's entry in a map or bookmap."""
    href = T.attribute(F.col("filename"))
    if kind == "bookmap":
        return F.concat(F.lit('<chapter href="'), href, F.lit('"/>'))
    of_type = F.when(F.col("root") == "dita", "topic").otherwise(F.col("root"))
    return F.concat(F.lit('<topicref href="'), href, F.lit('" type="'), of_type, F.lit('"/>'))


def map_xml(items: Column, title: Column, kind: str) -> Column:
    """A map (or bookmap) of entries in order."""
    head = T.escape(title)
    top = _wrap("title", head) if kind == "map" else F.concat(F.lit("<booktitle>"), _wrap("mainbooktitle", head), F.lit("</booktitle><bookmeta/>"))
    begin = F.lit(f'{DECLARATION}\n{DOCTYPES[kind]}\n<{kind} xmlns="{NAMESPACE}" xml:lang="en-US">')
    return F.concat(begin, top, F.array_join(items, ""), F.lit(f"</{kind}>"))


def maps(topics: DataFrame, title: Column, kind: str = "map") -> DataFrame:
    """doc_id, kind, xml: a map (or bookmap) of each document's topics, in order."""
    listed = topics.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic_no", map_item(kind).alias("item")))).alias("w"))
    return listed.select("doc_id", F.lit(kind).alias("kind"), map_xml(F.col("w.item"), title, kind).alias("xml"))
