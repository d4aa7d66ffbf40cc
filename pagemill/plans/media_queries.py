"""Queries of media names, crops, regions, titles and small labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators import media as D

from . import views as V
from .quality_queries import _DOC_PAGES, _doc_pages


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    figures = part.select((F.col("p_partkey") % 40).alias("doc_id"), F.col("p_partkey").alias("seq"), F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name")).alias("text"), (F.col("p_size") > 3).alias("has_image"))
    crops = part.select((F.col("p_partkey") % 40).alias("doc_id"), F.floor(F.col("p_partkey") / 40).cast("int").alias("fig_no"), F.col("p_size").alias("top"), F.lit(1).alias("bottom"), F.lit(0).alias("left"), F.lit(2).alias("right")).where("top > 25")
    return D.with_crops(D.media_names(figures), crops).select("doc_id", "seq", "fig_no", "href", "top", "right")


NAMES_SQL = """with f as (select p_partkey % 40 as doc_id, p_partkey as seq, coalesce(nullif(trim(regexp_replace(lower(case when p_size < 10 then '' else p_name end), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'image') as slug from part where p_size > 3),
n as (select *, cast(row_number() over (partition by doc_id order by seq) - 1 as int) as fig_no, row_number() over (partition by doc_id, slug order by seq) - 1 as k from f),
m as (select *, slug || case when k = 0 then '' else '_' || k end as name from n),
u as (select *, row_number() over (partition by doc_id, name order by seq) as r from m),
c as (select p_partkey % 40 as doc_id, cast(p_partkey // 40 as int) as fig_no, p_size as top from part where p_size > 25)
select u.doc_id, seq, fig_no, 'media/' || name || case when r = 1 then '' else '__' || r end || '.png' as href, coalesce(c.top, 0) as top, case when c.top is null then 0 else 2 end as "right" from u left join c using (doc_id, fig_no)"""

_FILES = [(-1, "a.b.png", "_x", "jpeg"), (-2, "photo.TIFF", "", "webp"), (-3, "noext", "_s", "gif"), (-4, ".hidden", "", "PNG")]
_FORMATS = ("png", "JPEG", "jpg", "webp", "tiff", "bmp", "gif")


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of processed images: parts as files in formats by turns, and some written ones."""
    format = F.element_at(F.array(*[F.lit(x) for x in _FORMATS]), (F.col("p_partkey") % len(_FORMATS) + 1).cast("int"))
    files = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat("p_name", F.lit(".v"), "p_size", F.lit(".png")).alias("name"), F.when(F.col("p_size") > 20, "_big").otherwise("").alias("suffix"), format.alias("format"))
    found = files.union(V.literal(spark, "id long, name string, suffix string, format string", _FILES))
    return found.select("id", D.output_name(F.col("name"), F.col("suffix"), F.col("format")).alias("name"))


OUTPUT_SQL = "with " + V.values("x", "id long, name string, suffix string, format string", _FILES) + r""", al as (
  select cast(p_partkey as bigint) as id, p_name || '.v' || p_size || '.png' as name, case when p_size > 20 then '_big' else '' end as suffix, ['png', 'JPEG', 'jpg', 'webp', 'tiff', 'bmp', 'gif'][p_partkey % 7 + 1] as format from part
  union all select id, name, suffix, format from x)
select id, case when regexp_matches(name, '.\.[^.]*$') then regexp_replace(name, '\.[^.]*$', '') else name end || suffix
  || case lower(format) when 'jpeg' then '.jpg' when 'jpg' then '.jpg' when 'webp' then '.webp' when 'tiff' then '.tiff' when 'bmp' then '.bmp' else '.png' end as name from al"""


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _doc_pages(spark, sf_dir).select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return D.page_regions(pages)


REGION_SQL = V.with_views("v_lines", _DOC_PAGES + """, p as (select doc_id, cast(page_no + 1 as int) as page_no, max(page_no + 1) over (partition by doc_id) as l from v_pages)
select doc_id, page_no, 'header' as region, 0.0::double as x0, 0.0::double as y0, 600.0::double as x1, 800 * 0.22::double as y1 from p where page_no = 1
union all select doc_id, page_no, 'corner', 0.0, 800 * 0.78::double, 600 * 0.30::double, 800.0 from p where page_no = l""")  # fmt: skip


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("toc_seq"), F.col("text").alias("title"))
    return D.document_titles(toc, _doc_pages(spark, sf_dir))


TITLES_SQL = V.with_views("v_lines", _DOC_PAGES + """, f as (select doc_id, arg_min(string_split(text, chr(10))[1], page_no) as line from v_pages group by 1)
select f.doc_id, coalesce(b.text, f.line) as title from f left join benchmark b on b.item_id = f.doc_id""")  # fmt: skip

_MODES, _WANTED = ("color", "blue", "monochrome", "unknown"), ("monochrome", "allow_blue", "any")


def brand_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on logos for every mix of what may be seen: each part is a case."""
    k, pick = F.col("p_partkey"), lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    cases = V.table(spark, sf_dir, "part").select(
        k.cast("long").alias("id"), F.when(k % 7 != 0, F.col("p_brand")).alias("brand"), (k % 5 != 0).alias("ocr"), (k % 11 != 0).alias("a"), (k % 13 != 0).alias("b"), (k % 17 != 0).alias("t"),
        pick(_MODES, F.col("p_size")).alias("mode"), pick(_WANTED, k).alias("wanted"),
    )
    status = D.brand_verdict(*[F.col(c) for c in ("brand", "ocr", "a", "b", "t", "mode", "wanted")])
    return cases.select("id", status.alias("status"), D.lookup(D.LABELS, status).alias("label"))


VERDICT_SQL = """with c as (select cast(p_partkey as bigint) as id, ['color', 'blue', 'monochrome', 'unknown'][p_size % 4 + 1] as mode, ['monochrome', 'allow_blue', 'any'][p_partkey % 3 + 1] as wanted from part),
s as (select id, case when id % 7 = 0 or id % 5 = 0 then 'not_checked' when id % 11 = 0 or id % 13 = 0 or id % 17 = 0 then 'fail'
  when wanted = 'monochrome' and mode in ('blue', 'color') or wanted = 'allow_blue' and mode = 'monochrome' then 'warn' else 'pass' end as status from c)
select id, status, upper(replace(status, '_', ' ')) as label from s"""


def line_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a number, and lines that would pass as page ranges, by document."""
    extra = V.literal(spark, "line_no int, line string", [(0, "1. go"), (1, "12) x"), (2, "1-5, 8"), (3, "1a"), (4, "2024 was"), (5, "")])
    found = V.lines(spark, sf_dir).union(extra.select(F.lit(-1).cast("long"), "line_no", "line"))
    return found.groupBy("doc_id").agg(F.count_if(D.starts_with_number(F.col("line"))).alias("n_numbered"), F.count_if(D.range_syntax(F.col("line"))).alias("n_ranges"))


DIAGNOSTIC_SQL = V.with_views("v_lines", """al as (select doc_id, line from v_lines union all select -1, unnest(['1. go', '12) x', '1-5, 8', '1a', '2024 was', '']))
select doc_id, count(*) filter (regexp_matches(regexp_replace(trim(substring(line, 1, 4)), '[.)]+$', ''), '^\\d+$')) as n_numbered, count(*) filter (regexp_matches(line, '^[\\d\\s,\\-]+$')) as n_ranges from al group by 1""")  # fmt: skip


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return part.select("p_partkey", D.thumbnail_height(F.col("p_size") + 1, F.col("p_partkey") % 97).alias("height"), F.floor((number - 1) / 4).alias("grid_row"))


THUMB_SQL = """select p_partkey, greatest(1, cast(floor((p_partkey % 97) * (160.0::double / (p_size + 1))) as bigint)) as height, (row_number() over (partition by p_brand order by p_partkey) - 1) // 4 as grid_row from part"""

QUERIES = {f.__name__: f for f in (media_names, output_names, page_regions, document_titles, brand_verdicts, line_diagnostics, thumbnails)}
ORACLES = dict(zip(QUERIES, (NAMES_SQL, OUTPUT_SQL, REGION_SQL, TITLES_SQL, VERDICT_SQL, DIAGNOSTIC_SQL, THUMB_SQL), strict=True))
