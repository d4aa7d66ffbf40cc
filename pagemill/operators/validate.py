"""Checks and counts on rendered XML, their roll-ups and the report."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topics import NAMESPACE

ROOTS = ("concept", "task", "reference", "topic", "bookmap", "map", "dita")
_TOPICS = ("concept", "task", "reference", "topic")
_NS = f"{{{NAMESPACE}}}"


def strip_declaration(xml: Column) -> Column:
    """XML without its declaration and document type lines."""
    return F.array_join(F.filter(F.split(xml, "\n"), lambda x: ~F.ltrim(x).rlike(r"^(<\?xml|<!DOCTYPE)")), "\n")


def findings(xml: str) -> tuple[bool, list[str], list[str]]:
    """(well-formed, errors, warnings); only bad syntax makes a file invalid."""
    text = "\n".join(x for x in xml.split("\n") if not x.strip().startswith(("<?xml", "<!DOCTYPE")))
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as wrong:
        return False, [f"XML syntax error: {wrong}"], []
    errors, warnings = [], []
    name = re.sub(r"^\{.*\}", "", root.tag)
    if name not in ROOTS:
        errors.append(f"Root element <{name}> is not a recognised topic or map type.")
    topic = next((x for x in root if re.sub(r"^\{.*\}", "", x.tag) in _TOPICS), root) if name == "dita" else root
    titles = topic.findall(f"{_NS}title")
    if not titles:
        errors.append("The topic has no <title>.")
    elif not (titles[0].text or "").strip():
        warnings.append("The topic's <title> is empty.")
    warnings += ["A section has no content." for x in root.iter(f"{_NS}section") if all(k.tag == f"{_NS}title" for k in x)]
    warnings += ["A step has no <cmd>." for x in root.iter(f"{_NS}step") if x.find(f"{_NS}cmd") is None]
    warnings += ["A note has no type." for x in root.iter(f"{_NS}note") if not x.get("type")]
    warnings += ["A table has no head." for x in root.iter(f"{_NS}tgroup") if x.find(f"{_NS}thead") is None]
    return True, errors, warnings


def validate(topics: DataFrame, *also: str | Column) -> DataFrame:
    """doc_id, topic_no, is_valid, errors, warnings of each XML text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [findings(x or "") for x in batch.column(2).to_pylist()]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], texts), pa.array([f[2] for f in found], texts), *batch.columns[3:]], ["doc_id", "topic_no", "is_valid", "errors", "warnings", *batch.schema.names[3:]])

    rows = topics.select(F.col("doc_id").cast("long"), F.col("topic_no").cast("long"), "xml", *also)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(run, f"doc_id long, topic_no long, is_valid boolean, errors array<string>, warnings array<string>{extra}")


def counts() -> dict[str, Column]:
    """Counts of elements and words in ``xml``, without parsing it."""
    text = F.regexp_replace(F.regexp_replace("xml", r"(?s)^.*?<!DOCTYPE[^>]*>", ""), "<[^>]*>", " ")
    tags = {"sections": "section", "notes": "note", "steps": "step", "tables": "table", "figures": "fig"}
    found = {name: F.regexp_count("xml", F.lit(f"<{tag}[ >/]")).cast("long") for name, tag in tags.items()}
    return found | {"words": F.regexp_count(text, F.lit(r"\S+")).cast("long")}


def inventory(topics: DataFrame) -> DataFrame:
    """Counts of elements and words in each XML text."""
    return topics.select("doc_id", "topic_no", *[c.alias(name) for name, c in counts().items()])


def rollup(counts: DataFrame) -> DataFrame:
    """Totals by topic, by document and over all, in one pass."""
    sums = [F.sum(c).alias(c) for c in ("sections", "notes", "steps", "tables", "figures", "words")]
    return counts.rollup("doc_id", "topic_no").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_topics"), *sums)


def report(checked: DataFrame) -> DataFrame:
    """A text report of each file: name, verdict, counts, issues."""
    line = "─" * 60
    issues = F.concat(F.transform("errors", lambda x: F.concat(F.lit("  ✗ "), x)), F.transform("warnings", lambda x: F.concat(F.lit("  ⚠ "), x)))
    listed = F.when(F.size(issues) == 0, F.lit("  No issues found.")).otherwise(F.array_join(issues, "\n"))
    counts = F.array_join(F.array(*[F.concat(F.rpad(F.lit(f"  {label}"), 14, " "), F.lit(": "), F.col(c).cast("string")) for label, c in (("Sections", "sections"), ("Notes", "notes"), ("Steps", "steps"), ("Tables", "tables"), ("Figures", "figures"), ("Word count", "words"))]), "\n")
    text = F.concat(
        F.lit("╔" + "═" * 60 + "╗\n║"), F.rpad(F.concat(F.lit("  File: "), F.col("filename")), 60, " "), F.lit("║\n╚" + "═" * 60 + "╝\n\n  Status : "),
        F.when(F.col("is_valid"), "VALID").otherwise("INVALID"), F.lit("\n  Errors : "), F.size("errors"), F.lit("\n  Warnings: "), F.size("warnings"), F.lit(f"\n{line}\n"), counts, F.lit(f"\n{line}\n"), listed,
    )
    return checked.select("doc_id", "topic_no", text.alias("report"))


def preview(xml: Column, most: int = 50_000) -> Column:
    """XML for display, cut where it is very long."""
    return F.when(F.length(xml) > most, F.concat(F.substring(xml, 1, most), F.lit("\n<!-- truncated -->"))).otherwise(xml)


def pretty(xml: str) -> str:
    """Indented XML; text that can't be parsed as it is."""
    try:
        root = ElementTree.fromstring("\n".join(x for x in xml.split("\n") if not x.strip().startswith(("<?xml", "<!DOCTYPE"))))
    except ElementTree.ParseError:
        return xml
    ElementTree.register_namespace("", NAMESPACE)
    ElementTree.indent(root, "  ")
    return ElementTree.tostring(root, encoding="unicode")
