"""DOCX files to blocks: a parser behind Arrow batches, then classification by style in SQL.

Paragraphs come first, all tables after them, as a document's body lists them apart.  A file
that can't be read gives one row with an error and fails nothing else.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_PARTS = "doc_id long, seq int, style string, text string, rows array<array<string>>, images array<string>, error string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), ("style", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("images", pa.list_(pa.string())), ("error", pa.string())])
#: Paragraph styles and what they become.
HEADINGS = {"Heading 1": 1, "Heading 2": 2, "Heading 3": 3, "Heading 4": 3, "Title": 1, "Subtitle": 2}
NOTE_STYLES = ("Caution", "Warning", "Note", "Important")


def _text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def read_docx(data: bytes) -> list[dict]:
    """Paragraphs with style and image targets, then tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        names = set(file.namelist())
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_W}body")
        styles, targets = {}, {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(file.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else s.get(f"{_W}styleId")
        if "word/_rels/document.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(file.read("word/_rels/document.xml.rels")).iter(f"{_REL}Relationship")}
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val") if style is not None else ""
        images = [targets.get(b.get(f"{_R}embed"), b.get(f"{_R}embed")) for b in p.iter(f"{_A}blip")]
        out.append({"style": styles.get(name, name), "text": _text(p), "rows": None, "images": images})
    for t in body.findall(f"{_W}tbl") if body is not None else []:
        rows = [["\n".join(_text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        out.append({"style": "", "text": "", "rows": rows, "images": []})
    return out


def parse(files: DataFrame) -> DataFrame:
    """Parts of each row (doc_id, content): style, text, rows, images, or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"doc_id": name, "seq": k, "error": None, **part} for k, part in enumerate(read_docx(data))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as wrong:
                    rows = [{"doc_id": name, "seq": 0, "style": None, "text": None, "rows": None, "images": None, "error": str(wrong)}]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, _PARTS)


def blocks(parts: DataFrame) -> DataFrame:
    """Parts as blocks, by style first and by text after; empty and dropped paragraphs go."""
    style, text = F.coalesce("style", F.lit("")), T.strip(F.coalesce("text", F.lit("")))
    found = parts.where("error is null").withColumn("style", style).withColumn("text", text)
    found = found.where(F.col("rows").isNotNull() | ((F.col("text") != "") & ~T.should_drop(F.col("text"))))
    level = F.element_at(F.create_map(*[x for k, v in HEADINGS.items() for x in (F.lit(k), F.lit(v))]), F.col("style"))
    numbered, bullet = F.col("text").rlike(r"^\d{1,2}[.)]\s+.+"), F.col("text").rlike("^[•–▪]")
    listed = F.col("style").contains("List")
    kind = (
        F.when(F.col("rows").isNotNull(), "table").when(level.isNotNull(), "heading").when(F.col("style").isin(*NOTE_STYLES), "note_header").when(listed, "list_item")
        .when(F.col("text").rlike("(?i)^Notes?:"), "note_inline").when(F.col("text").rlike(r"(?i)^Figure\s+\d[\d\-.]*\s*:"), "figure")
        .when(F.col("style").contains("Code") | F.col("style").contains("Preformatted"), "code_block").when(bullet | numbered, "list_item").otherwise("paragraph")
    )
    list_kind = F.when(kind == "list_item", F.when(listed, F.when(F.col("style").contains("Number"), "numbered").otherwise("bullet")).when(bullet, "bullet").otherwise("numbered"))
    plain = F.when((kind == "list_item") & ~listed & bullet, F.regexp_replace("text", r"^[•–▪]\s*", "")).when((kind == "list_item") & ~listed, F.regexp_extract("text", r"^\d{1,2}[.)]\s+(.+)", 1)).otherwise(F.col("text"))
    main = found.select("doc_id", (F.col("seq") * 2 + 1).alias("seq"), kind.alias("type"), F.coalesce(level, F.lit(0)).alias("level"), list_kind.alias("list_kind"), F.lit(None).cast("string").alias("note_type"), plain.alias("text"), "rows")
    images = found.where(F.size("images") > 0).select("doc_id", (F.col("seq") * 2).alias("seq"), F.lit("figure").alias("type"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("list_kind"), F.lit(None).cast("string").alias("note_type"), "text", F.lit(None).cast("array<array<string>>").alias("rows"))
    return main.unionByName(images)


def errors(parts: DataFrame) -> DataFrame:
    """doc_id, error of the files that could not be read."""
    return parts.where("error is not null").select("doc_id", "error")


def write_docx(paragraphs: list[tuple[str, str]], tables: list[list[list[str]]] = ()) -> bytes:
    """A small DOCX of (style, text) paragraphs and tables, the same bytes for the same content."""
    from xml.sax.saxutils import escape, quoteattr

    names = sorted({s for s, _ in paragraphs if s})
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={quoteattr(s.replace(" ", ""))}/></w:pPr>" if s else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    body += "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>" for table in tables)
    space = _W.strip("{}")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId={quoteattr(n.replace(" ", ""))}><w:name w:val={quoteattr(n)}/></w:style>' for n in names)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in (("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>'), ("word/styles.xml", f'<w:styles xmlns:w="{space}">{styles}</w:styles>')):
            file.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()
