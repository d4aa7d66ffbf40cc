"""Queries that go through file formats: documents written as files in memory and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from pagemill.operators import mapping as M
from pagemill.operators import topics as P
from pagemill.sources import docx, schemas, sinks

from . import views as V
from .line_queries import _DROPPED
from .topic_queries import _RENDER

#: Style of each line of a document, by its place; then the kinds that the styles give.
_STYLES = ["Heading 1", "Heading 2", "Heading 3", "Warning", "List Number", "List Bullet", "Code", "", "", "Normal"]


def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as DOCX files, parsed and classified."""

    @F.pandas_udf(BinaryType())
    def file(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: docx.write_docx([(_STYLES[k % len(_STYLES)], x) for k, x in enumerate(t.split("\n"))], [[["a", "b"], [t[:1], "c"]]]))

    docs = V.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", file("text").alias("content"))
    bad = V.literal(spark, "doc_id long", [(-1,)]).select("doc_id", F.lit(b"not a file").alias("content"))
    found = docx.blocks(docx.parse(docs.union(bad)))
    return schemas.checked_blocks(found).select("doc_id", "seq", "type", "level", "list_kind", "text", F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"))


DOCX_SQL = V.with_views("v_lines", f"""s as (select doc_id, line_no, line_no % 10 as k, trim(line) as t, line_no * 2 + 1 as seq from v_lines),
k as (select *, case when k <= 2 then 'heading' when k = 3 then 'note_header' when k in (4, 5) then 'list_item' when regexp_matches(t, '(?i)^Notes?:') then 'note_inline'
    when regexp_matches(t, '(?i)^Figure\\s+\\d[\\d\\-.]*\\s*:') then 'figure' when k = 6 then 'code_block' when regexp_matches(t, '^[•–▪]') or regexp_matches(t, '^\\d{{1,2}}[.)]\\s+.+') then 'list_item' else 'paragraph' end as type from s where t <> '' and not {_DROPPED.format("t")})
select doc_id, cast(seq as int) as seq, type, case when k <= 2 then cast(k + 1 as int) else 0 end as level, case when type = 'list_item' then case when k = 4 then 'numbered' when k = 5 then 'bullet' when regexp_matches(t, '^[•–▪]') then 'bullet' else 'numbered' end end as list_kind,
  case when type = 'list_item' and k not in (4, 5) then case when regexp_matches(t, '^[•–▪]') then regexp_replace(t, '^[•–▪]\\s*', '') else regexp_extract(t, '^\\d{{1,2}}[.)]\\s+(.+)', 1) end else t end as text, 0 as n_rows from k
union all select doc_id, cast(len(string_split(text, chr(10))) * 2 + 1 as int), 'table', 0, null, '', 2 from documents where text is not null""")  # fmt: skip


def zip_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics as archives, opened again: how many files and characters each holds."""

    @F.pandas_udf(LongType())
    def characters(files: pd.Series) -> pd.Series:
        def count(data: bytes) -> int:
            with zipfile.ZipFile(io.BytesIO(data)) as file:
                return sum(len(file.read(n).decode()) for n in file.namelist() if n.endswith(".dita"))

        return files.map(count)

    topics = P.render(M.map_blocks(V.blocks(spark, sf_dir)))
    return sinks.archives(topics).select("doc_id", F.col("n_files").cast("long").alias("n_files"), characters("content").alias("n_chars"))


ZIP_SQL = V.with_views("v_blocks", _RENDER + " select doc_id, count(*) + 1 as n_files, cast(sum(length(xml)) as bigint) as n_chars from topics_out group by 1")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and items of web pages as blocks, in order."""
    found = V.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<(?:h1|p|li)>.*?</(?:h1|p|li)>"), 0)).alias("seq", "x"))
    tag = F.regexp_extract("x", "^<(h1|p|li)>", 1)
    kind = F.when(tag == "h1", "heading").when(tag == "li", "list_item").otherwise("paragraph")
    return found.select("page_id", "seq", kind.alias("type"), F.regexp_replace("x", "<[^>]*>", "").alias("text"))


PAGE_SQL = """with f as (select page_id, regexp_extract_all(html, '(?s)<(?:h1|p|li)>.*?</(?:h1|p|li)>') as xs from pages),
x as (select page_id, unnest(xs) as x, unnest(range(len(xs))) as seq from f)
select page_id, cast(seq as int) as seq, case when starts_with(x, '<h1') then 'heading' when starts_with(x, '<li') then 'list_item' else 'paragraph' end as type, regexp_replace(x, '<[^>]*>', '', 'g') as text from x"""

QUERIES = {f.__name__: f for f in (docx_blocks, zip_export, page_blocks)}
ORACLES = dict(zip(QUERIES, (DOCX_SQL, ZIP_SQL, PAGE_SQL), strict=True))
