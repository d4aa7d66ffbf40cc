"""Queries that put pages together, and those of exports, badges, media and small arithmetic."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from pagemill.operators import images as I
from pagemill.operators import lines as L
from pagemill.operators import mapping as M
from pagemill.operators import pages as G
from pagemill.operators import tables as B
from pagemill.operators import topics as P
from pagemill.sources import sinks

from . import views as V
from .line_queries import _DROPPED, _KIND_SQL
from .report_queries import _CHECKS, _report
from .topic_queries import _RENDER


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.marked_text(V.words(spark, sf_dir))


MARKED_SQL = V.with_views("v_words", """f as (select doc_id, page_no, cast(round_even(top / 2, 0) * 2 as bigint) as line_top, x0, word_seq, text, contains(fontname, 'Bold') as b, contains(fontname, 'Italic') as i from v_words),
g as (select *, coalesce(lag(b) over w, false) as pb, coalesce(lag(i) over w, false) as pi, lead(word_seq) over w is null as z from f window w as (partition by doc_id, page_no, line_top order by x0, word_seq)),
h as (select *, case when pb and not b then '__BOLD_END__ ' else '' end || case when pi and not i then '__ITALIC_END__ ' else '' end || case when b and not pb then '__BOLD_START__ ' else '' end
  || case when i and not pi then '__ITALIC_START__ ' else '' end || text || case when z and b then ' __BOLD_END__' else '' end || case when z and i then ' __ITALIC_END__' else '' end as s from g)
select doc_id, page_no, line_top, string_agg(text, ' ' order by x0, word_seq) as text, string_agg(s, ' ' order by x0, word_seq) as marked, bool_and(b) as bold from h group by 1, 2, 3""")  # fmt: skip


def span_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spans(spark, sf_dir).select("id", L.span_middle(F.col("y"), F.col("y") + F.col("height")).alias("y"))


MIDDLE_SQL = V.with_views("v_spans", "select id, cast(round_even((y + y + height) / 2, 0) as bigint) as y from v_spans")


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words and rules of tables: five lines of a document make one, of five columns at most."""
    found = V.lines(spark, sf_dir).select("doc_id", "line_no", F.expr("filter(split(line, ' '), x -> x <> '')").alias("w"))
    place = {"page_no": F.expr("cast(line_no div 5 as int)"), "row": F.col("line_no") % 5}
    words = found.withColumns(place).select("doc_id", "page_no", "row", F.posexplode(F.slice("w", 1, 5)).alias("word_seq", "text"))
    x0 = (F.col("word_seq") * 100 + 10).cast("double")
    words = words.select("doc_id", "page_no", "word_seq", "text", x0.alias("x0"), (x0 + 60).alias("x1"), (F.col("row") * 20 + 105).cast("double").alias("top"), F.lit(11.0).alias("size"), F.lit("ArialMT").alias("fontname"))
    rule = F.array(*[F.struct(F.lit(float(t)).alias("top"), F.lit(float(t) + (2 if t <= 120 else 0.5)).alias("bottom")) for t in (100, 120, 140, 160, 180, 200)])
    rules = found.withColumns(place).select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(0.0).alias("x0"), F.lit(520.0).alias("x1"), F.explode(rule).alias("r")).select("doc_id", "page_no", "x0", "x1", "r.*")
    return words, rules


def borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.borderless(*_grid(spark, sf_dir))
    return found.select("doc_id", "page_no", "top", "bottom", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


BORDERLESS_SQL = V.with_views("v_lines", """tk as (select doc_id, line_no // 5 as page_no, line_no % 5 as r, list_filter(string_split(line, ' '), lambda x: x <> '')[1:5] as w from v_lines),
n as (select doc_id, page_no, case when max(len(w)) filter (r = 0) >= 2 then max(len(w)) filter (r = 0) else max(len(w)) end as n from tk group by 1, 2 having max(len(w)) > 0),
rw as (select doc_id, page_no, r, len(w) as k, list_transform(range(1, n + 1), lambda i: case when i < n then coalesce(w[i], '') else array_to_string(w[i:], ' ') end) as row from tk join n using (doc_id, page_no))
select doc_id, cast(page_no as int) as page_no, 100.0::double as top, 200.5::double as bottom, cast(count(*) as int) as n_rows, string_agg(array_to_string(row, '|'), chr(10) order by r) as rows
from rw where r = 0 or k > 0 group by 1, 2""")  # fmt: skip


def fullest_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two header bands of a table has the most column starts; words stand as far apart as they are long."""
    words = V.lines(spark, sf_dir).select("doc_id", F.expr("cast(line_no div 2 as int)").alias("page_no"), (F.col("line_no") % 2).alias("band_no"), F.posexplode(F.split("line", " ")).alias("word_seq", "text")).where("word_seq < 8")
    words = words.withColumns({"gx0": F.lit(0.0), "gx1": F.lit(500.0), "kind": F.lit("header"), "x0": (F.col("word_seq") * 5 * F.length("text")).cast("double")})
    bands = words.select("doc_id", "page_no", "gx0", "gx1", "kind").distinct().withColumn("band_no", F.explode(F.array(F.lit(0), F.lit(1))))
    return B.fullest_header(words, bands).select("doc_id", "page_no", "band_no", "n_starts")


FULLEST_SQL = V.with_views("v_lines", """t as (select doc_id, line_no // 2 as page_no, line_no % 2 as band_no, unnest(string_split(line, ' ')) as text, unnest(range(len(string_split(line, ' ')))) as p from v_lines),
x as (select distinct doc_id, page_no, band_no, p * 5 * length(text) as x from t where p < 8),
g as (select *, x - lag(x) over (partition by doc_id, page_no, band_no order by x) as gap from x), c as (select doc_id, page_no, band_no, count(*) filter (gap > 40) + 1 as n from g group by 1, 2, 3),
b as (select distinct doc_id, page_no, unnest([0, 1]) as band_no from x), j as (select doc_id, page_no, band_no, coalesce(n, 1) as n from b left join c using (doc_id, page_no, band_no)),
r as (select *, row_number() over (partition by doc_id, page_no order by n desc, band_no) as rn from j)
select doc_id, cast(page_no as int) as page_no, band_no, cast(n as int) as n_starts from r where rn = 1""")  # fmt: skip


def _found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the three passes, each from lines of one kind."""
    k = F.expr("cast((doc_id * 31 + line_no * 17) % 20 as int)")
    top = F.lit(14.3) * (F.col("line_no") % 50)
    places = V.lines(spark, sf_dir).select("doc_id", F.expr("cast(line_no div 50 as int)").alias("page_no"), k.alias("k"), top.alias("top"), (top + 9).alias("bottom"), F.lit(720.0).alias("height"))
    cell = lambda *rows: F.array(*[F.array(*[F.lit(c).cast("string") for c in row]) for row in rows])
    of = lambda kind, rows: places.where(F.col("k") == kind).withColumn("rows", rows)
    return B.all_tables(of(8, cell(["a", None], ["b", "c"])), of(9, cell(["r"])), of(10, cell(["t", "u"], ["", ""])))


def table_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found_tables(spark, sf_dir)
    return found.select("doc_id", "page_no", "top", "pass", F.array_join(F.flatten("rows"), "|").alias("cells"))


_TABLES = """pl as (select doc_id, line_no // 50 as page_no, (doc_id * 31 + line_no * 17) % 20 as k, 14.3::double * (line_no % 50) as top from v_lines),
t0 as (select *, 0 as pass from pl where k = 8),
t1 as (select *, 1 as pass from pl a where k = 9 and not exists (select 1 from t0 b where b.doc_id = a.doc_id and b.page_no = a.page_no and a.top between b.top - 20 and b.top + 9 + 20)),
t01 as (select * from t0 union all select * from t1),
t2 as (select *, 2 as pass from pl a where k = 10 and not exists (select 1 from t01 b where b.doc_id = a.doc_id and b.page_no = a.page_no and a.top between b.top - 20 and b.top + 9 + 20)),
tabs as (select * from t01 union all select * from t2)"""
PASSES_SQL = V.with_views("v_lines", _TABLES + " select doc_id, cast(page_no as int) as page_no, top, pass, case pass when 0 then 'a||b|c' when 1 then 'r' else 't|u||' end as cells from tabs")


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tables of documents, with step numbers and links beside some of their lines."""
    k, top = F.expr("cast((doc_id * 31 + line_no * 17) % 20 as int)"), F.bround(F.lit(14.3) * (F.col("line_no") % 50)).cast("long")
    marks = V.lines(spark, sf_dir).select("doc_id", F.expr("cast(line_no div 50 as int)").alias("page_no"), F.col("line_no").cast("long").alias("id"), k.alias("k"), top.alias("top"))
    spans = marks.where("k = 13").select("doc_id", "page_no", "id", (F.col("top") + 3).alias("y"), F.lit(5.0).alias("width"), F.lit(8.0).alias("height"), F.lit(100.0).alias("x0"))
    uri = F.when(F.col("doc_id") % 2 == 1, "mailto:x@example.org").otherwise(F.concat(F.lit("https://example.org/?a=1&b="), F.col("id")))
    links = marks.where("k = 16").select("doc_id", "page_no", "id", (F.col("top") - 4).alias("y"), uri.alias("uri"))
    return G.blocks(V.words(spark, sf_dir, by_page=True), _found_tables(spark, sf_dir), spans, links)


def page_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to blocks: tables and lines in reading order, numbered steps and links found."""
    found = _page_blocks(spark, sf_dir)
    return found.select("doc_id", "page_no", "seq", "type", "level", "list_kind", "text", F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), F.coalesce("num", F.lit(0)).cast("long").alias("num"), "href")


CONVERSION_SQL = V.with_views("v_words", _TABLES + rf""",
bw as (select *, cast(round_even(top / 2, 0) * 2 as bigint) as line_top from v_words w
  where not exists (select 1 from tabs t where t.doc_id = w.doc_id and t.page_no = w.page_no and round_even(w.top / 2, 0) * 2 between t.top - 2 and t.top + 9 + 2)),
ln as (select doc_id, page_no, line_top, string_agg(text, ' ' order by x0, word_seq) as text, avg(size) as s, bool_or(contains(fontname, 'Bold')) as b from bw group by 1, 2, 3),
cl as (select *, {_KIND_SQL.format(drop=_DROPPED.format("text"))} as kind, case when s <= 9.5 then 'dropped' when not b then 'paragraph' when s >= 17 then 'heading' when s >= 14 then 'note_header' when s >= 11.5 then 'heading' else 'paragraph' end as class from ln),
kd as (select *, case when kind = 'dropped' or class = 'dropped' then 'dropped' when kind <> 'paragraph' then kind else class end as type from cl),
st as (select *, case when type = 'paragraph' and lag(type) over w = 'paragraph' and not regexp_matches(lag(text) over w, '[.:?]$') then 0 else 1 end as st from kd where type <> 'dropped'
  window w as (partition by doc_id, page_no order by line_top)),
bn as (select *, sum(st) over (partition by doc_id, page_no order by line_top rows unbounded preceding) as block_no from st),
bl as (select doc_id, page_no, block_no, type, min(line_top) as y, case when type = 'heading' then max(case when s >= 17 then 1 when s >= 13.5 then 2 else 3 end) else 0 end as level,
  string_agg(case when type = 'list_item' then regexp_replace(text, '^[•–\-▪◆●○■□▸▹►]\s*', '') else text end, ' ' order by line_top) as text from bn group by 1, 2, 3, 4),
al as (select doc_id, page_no, top as y, 0 as rank, pass as seq, 'table' as type, 0 as level, '' as text, case pass when 1 then 1 else 2 end as n_rows from tabs
  union all select doc_id, page_no, y::double, 1, block_no, type, level, text, 0 from bl),
od as (select *, row_number() over (partition by doc_id order by page_no, y, rank, seq) - 1 as id, cast(round_even(y, 0) as bigint) as yk from al),
mk as (select doc_id, page_no, line_no, k, cast(round_even(14.3::double * (line_no % 50), 0) as bigint) as top from (select doc_id, line_no // 50 as page_no, line_no, (doc_id * 31 + line_no * 17) % 20 as k from v_lines)),
n0 as (select *, top + 3 as my, case when top - lag(top) over (partition by doc_id, page_no order by top, line_no) > 200 then 1 else 0 end as n from mk where k = 13),
n1 as (select *, sum(n) over (partition by doc_id, page_no order by top, line_no rows unbounded preceding) as ss from n0),
n2 as (select *, row_number() over (partition by doc_id, page_no, ss order by top, line_no) as number from n1),
nn as (select o.doc_id, o.id, arg_min(n2.number, n2.my) as num from od o join n2 on n2.doc_id = o.doc_id and n2.page_no = o.page_no and n2.my between o.yk - 15 and o.yk + 15 where o.type = 'paragraph' group by 1, 2),
ll as (select o.doc_id, o.id, arg_min(case when m.doc_id % 2 = 1 then 'mailto:x@example.org' else 'https://example.org/?a=1&b=' || m.line_no end, m.top) as href
  from od o join mk m on m.k = 16 and m.doc_id = o.doc_id and m.page_no = o.page_no and m.top - 4 between o.yk - 15 and o.yk + 15 where o.type in ('paragraph', 'list_item') group by 1, 2)
select doc_id, cast(page_no as int) as page_no, cast(id as int) as seq, case when num is not null then 'list_item' else type end as type, level, case when num is not null then 'numbered' when type = 'list_item' then 'bullet' end as list_kind,
  text, n_rows, coalesce(num, 0) as num, href from od left join nn using (doc_id, id) left join ll using (doc_id, id)""")  # fmt: skip


def page_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to topic XML: the conversion above, mapped, split and rendered with marks, paths and links."""
    return P.render(G.mapped(_page_blocks(spark, sf_dir)))


_ODD = [(-1, 0, "<concept><title>x</concept>"), (-1, 1, "not xml"), (-1, 2, '<?xml version="1.0"?>\n<!DOCTYPE task>\n<task id="a"/>'), (-1, 3, "<map></map>"), (-1, 4, ""), (-1, 5, "<topic></concept>")]


def topic_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = P.render(M.map_blocks(V.blocks(spark, sf_dir))).select("doc_id", F.col("topic_no").cast("int").alias("topic_no"), "xml")
    return topics.union(V.literal(spark, "doc_id long, topic_no int, xml string", _ODD)).select("doc_id", "topic_no", G.badge(F.col("xml")).alias("badge"))


BADGE_SQL = V.with_views("v_blocks", V.values("odd", "doc_id long, topic_no int, xml string", _ODD) + ", " + _RENDER + r""", al as (select doc_id, cast(topic_no as int) as topic_no, xml from topics_out union all select * from odd),
p as (select doc_id, topic_no, trim(array_to_string(list_filter(string_split(xml, chr(10)), lambda x: not starts_with(trim(x), '<?') and not starts_with(trim(x), '<!DOCTYPE')), chr(10)), E' \n') as t from al),
r as (select *, regexp_extract(t, '^<([\w.-]+)', 1) as root from p)
select doc_id, topic_no, case when root in ('concept', 'task', 'reference', 'topic') and (ends_with(t, '</' || root || '>') or regexp_matches(t, '^<[\w.-]+[^<>]*/>$')) then root else 'topic' end as badge from r""")  # fmt: skip


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, as a document's: four documents share them out."""
    part = V.table(spark, sf_dir, "part")
    return part.select((F.col("p_partkey") % 97).cast("long").alias("doc_id"), F.concat(F.lit("media/p"), "p_partkey", F.lit(".png")).alias("href"), F.encode("p_name", "utf-8").alias("content"))


def _figured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics whose figures show a file: the part numbered as the figure's place and document say."""
    blocks = V.blocks(spark, sf_dir).withColumn("image", F.when(F.col("type") == "figure", F.concat(F.lit("media/p"), F.col("doc_id") % 97 + 97 * (F.col("seq") % 3), F.lit(".png"))))
    return P.render(M.map_blocks(blocks))


def topic_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.media_of(_figured(spark, sf_dir), _media(spark, sf_dir)).select("doc_id", "topic_no", "href", "used")


MEDIA_SQL = V.with_views("v_blocks", _RENDER + """, md as (select p_partkey % 97 as doc_id, p_partkey, 'media/p' || p_partkey || '.png' as href from part),
sh as (select distinct p.doc_id, p.topic_no, 'media/p' || (p.doc_id % 97 + 97 * (p.seq % 3)) || '.png' as href from body0 p where p.element = 'fig')
select t.doc_id, t.topic_no, m.href, s.href is not null as used from topics_out t join md m using (doc_id) left join sh s on s.doc_id = t.doc_id and s.topic_no = t.topic_no and s.href = m.href""")  # fmt: skip


@F.pandas_udf(StringType())
def _listing(files: pd.Series) -> pd.Series:
    def names(data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as file:
            return " ".join(sorted(n for n in file.namelist() if not n.endswith(".dita")))

    return files.map(names)


def selection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of every document's even topics, with all of its media: what lies in each beside the topics."""
    found = sinks.archives(_figured(spark, sf_dir).where("topic_no % 2 = 0"), media=_media(spark, sf_dir), selected=True)
    return found.select("doc_id", F.col("n_files").cast("long").alias("n_files"), _listing("content").alias("others"))


SELECTION_SQL = V.with_views("v_blocks", _RENDER + """, md as (select p_partkey % 97 as doc_id, count(*) as n, string_agg('media/p' || p_partkey || '.png', ' ' order by 'media/p' || p_partkey || '.png') as names from part group by 1)
select t.doc_id, t.n + 1 + coalesce(m.n, 0) as n_files, 'document_selection.ditamap' || coalesce(' ' || m.names, '') as others from (select doc_id, count(*) as n from topics_out where topic_no % 2 = 0 group by 1) t left join md m using (doc_id)""")  # fmt: skip


def image_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as PNGs, figure-cropped, in one archive for each hundred."""

    @F.pandas_udf(BinaryType())
    def png(values: pd.Series) -> pd.Series:
        def one(v: np.ndarray | None) -> bytes | None:
            return None if v is None or not len(v) else I.figure_crop(I.write_png(np.clip(np.nan_to_num(np.array(v, dtype=float)) * 500, 0, 255).astype(np.uint8).reshape(1, -1, 1)))

        return values.map(one)

    found = V.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 100").alias("group_id"), F.concat(F.lit("v"), F.col("vec_id"), F.lit(".png")).alias("name"), png("embedding").alias("content"))
    return sinks.image_archives(found).select("group_id", F.col("n_files").cast("long").alias("n_files"))


IMAGE_ZIP_SQL = "select vec_id // 100 as group_id, count(*) as n_files from embeddings where embedding is not null and len(embedding) > 0 group by 1"


def quality_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.trace(_report(spark, sf_dir))


TRACE_SQL = V.with_views("v_lines", _CHECKS + " select doc_id, cast(check_no as int) as line_no, '[QUALITY] ' || check_id || ': ' || status as message from checks")


def binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8 bytes in base64, and back."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text", F.replace(F.base64(F.encode("text", "utf-8")), F.lit("\r\n"), F.lit("")).alias("coded"))
    return docs.select("doc_id", F.sha2("coded", 256).alias("coded_sha256"), F.length("coded").cast("long").alias("n"), (F.decode(F.unbase64("coded"), "utf-8") == F.col("text")).alias("same"))


BINARY_SQL = """select doc_id, sha256(base64(encode(text))) as coded_sha256, length(base64(encode(text))) as n, decode(from_base64(base64(encode(text)))) = text as same from documents"""


def edge_drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.table(spark, sf_dir, "lineitem")
    found = G.drag(F.col("l_extendedprice").cast("double"), F.lit(0.0), F.col("l_quantity").cast("double") * 1000 - 1)
    return items.select("l_orderkey", "l_linenumber", found.alias("edge"))


DRAG_SQL = "select l_orderkey, l_linenumber, least(greatest(cast(l_extendedprice as double), 0.0::double), cast(l_quantity as double) * 1000 - 1) as edge from lineitem"

ORACLES = {
    "marked_lines": MARKED_SQL, "span_middles": MIDDLE_SQL, "borderless_tables": BORDERLESS_SQL, "fullest_headers": FULLEST_SQL, "table_passes": PASSES_SQL, "page_conversion": CONVERSION_SQL,
    "topic_badges": BADGE_SQL, "topic_media": MEDIA_SQL, "selection_export": SELECTION_SQL, "image_zips": IMAGE_ZIP_SQL, "quality_trace": TRACE_SQL, "binary_text": BINARY_SQL, "edge_drags": DRAG_SQL,
}
QUERIES = {f.__name__: f for f in (
    marked_lines, span_middles, borderless_tables, fullest_headers, table_passes, page_conversion, page_topics, topic_badges, topic_media, selection_export, image_zips, quality_trace, binary_text, edge_drags,
)}
