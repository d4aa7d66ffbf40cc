"""Queries of the quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import quality as Q

from . import views as V
from .line_queries import _DROPPED

_MON = T.MONTHS
_NORM = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce({{0}}, '')), 'ß', 'ss'), '\b({_MON})\s+\d{{{{4}}}}\b', '', 'g'),
  '\bpage\s+\d+\b', '', 'g'), '[·•]+', ' ', 'g'), '[–—\-_/|]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


NORM_SQL = f"select doc_id, {_NORM.format('text')} as text from documents"


def quote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_no"), "text")
    pages = V.table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.lit(0).alias("page_no"), F.col("html").alias("text"))
    return Q.straight_quotes(docs.union(pages)).select("doc_id", "n", "evidence")


QUOTE_SQL = """with p as (select doc_id, text from documents union all select -page_id - 1, html from pages), q as (select doc_id, regexp_extract_all(text, '["'']') as f from p)
select doc_id, len(f) as n, array_to_string(f[1:10], '') as evidence from q where len(f) > 0"""

_FOOT = [(-1, 0, 746.0, 12.0, 50.0, "Pump"), (-1, 0, 744.5, 12.0, 10.0, "The"), (-1, 0, 733.0, 9.0, 10.0, "MDE-1"), (-1, 0, 733.5, 9.0, 60.0, "March 2024"), (-1, 0, 700.0, 9.0, 10.0, "body"), (-1, 1, 722.0, 9.0, 5.0, "far line"), (-1, 1, 790.0, 9.0, 5.0, "Page 4"), (-1, 1, 778.0, 9.0, 5.0, "title here"), (-1, 2, 730.0, 11.0, 5.0, "large but high")]
_FOOT_SCHEMA = "doc_id long, page_no int, top double, size double, x0 double, text string"
_FOOT_OUT = [(-1, 0, "MDE-1 March 2024 | The Pump"), (-1, 1, "title here")]


def footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words(spark, sf_dir).select("doc_id", "page_no", "top", "size", "x0", "text", F.lit(720.0).alias("height"))
    fixed = V.literal(spark, _FOOT_SCHEMA, _FOOT).withColumn("height", F.lit(800.0))
    return Q.footer_words(words.unionByName(fixed)).select("doc_id", "page_no", F.array_join("lines", " | ").alias("lines"))


FOOTER_SQL = V.with_views("v_words", V.values("fixed", "doc_id long, page_no int, lines string", _FOOT_OUT) + r""", low as (select * from v_words where top >= 720 * 0.93 or (top >= 720 * 0.90 and size <= 10.5)),
ln as (select doc_id, page_no, top, string_agg(text, ' ' order by x0) as line from low group by 1, 2, 3),
r as (select *, row_number() over (partition by doc_id, page_no order by top desc) as rn from ln)
select doc_id, page_no, case when regexp_matches(line, '(?i)^page\s+\d+$') or regexp_matches(line, '^[©Â]\s*\d{4}') then '' else line end as lines from r where rn = 1
union all select doc_id, page_no, lines from fixed""")  # fmt: skip

_TITLED = [(-1, ["MDE-5 Guide March 2024", "A much longer footer line than that"]), (-2, ["March 2024", "Short", "Longer title"]), (-3, ["Note: see", "ab | cd - ef"]), (-4, ["12345", "678"]), (-5, []), (-6, ["April 2023 • Start - Up"]), (-7, ["Page 3 of Pumps", "x"])]


def footer_title_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of footers: the lines of documents, three at a time, beside some written ones."""
    three = V.lines(spark, sf_dir).groupBy((F.col("doc_id") * 100_000 + F.expr("line_no div 3")).alias("id")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("w"))
    found = Q.footer_facts(three.select("id", F.col("w.line").alias("lines")).union(V.literal(spark, "id long, lines array<string>", _TITLED)))
    return found.select("id", "title", "month_year", "has_signal")


_DATED = rf"(?i)\b(?:{_MON})\s+\d{{4}}\b"
_PAGED, _COPIED, _NUMBERED = r"(?i)\bpage\s+\d+\b", r"^[©Â]\s*\d{4}", r"(?i)\bMDE-[A-Z0-9-]+\b"
_LONGEST = "list_filter({0}, lambda x: length(x) = list_max(list_transform({0}, lambda y: length(y))))[1]"
TITLE_SQL = V.with_views("v_lines", V.values("fixed", "id long, lines array<string>", _TITLED) + rf""",
al as (select doc_id * 100000 + line_no // 3 as id, list(line order by line_no) as lines from v_lines group by 1 union all select id, lines from fixed),
p as (select id, lines, list_filter(lines, lambda x: regexp_matches(x, '{_NUMBERED}')) as ns,
  list_filter(lines, lambda x: not regexp_matches(x, '{_DATED}') and not regexp_matches(x, '(?i)^page\s+\d+$') and regexp_matches(x, '[A-Za-z]') and not regexp_matches(x, '(?i)^(note|warning|caution|danger):')) as ts from al),
q as (select id, lines, case when len(ns) > 0 then ns[1] when len(ts) > 0 then {_LONGEST.format("ts")} else coalesce({_LONGEST.format("lines")}, '') end as pick from p),
c as (select id, lines, regexp_replace(regexp_replace(regexp_replace(pick, '{_DATED}', '', 'g'), '{_PAGED}', '', 'g'), '[·•]+', ' ', 'g') as t from q)
select id, trim(regexp_replace(replace(replace(t, '|', ' '), ' - ', ' '), '\s+', ' ', 'g')) as title, nullif(regexp_extract(array_to_string(lines, ' | '), '{_DATED}', 0), '') as month_year,
  len(list_filter(lines, lambda x: regexp_matches(x, '{_DATED}') or regexp_matches(x, '{_NUMBERED}') or regexp_matches(x, '{_PAGED}') or regexp_matches(x, '{_COPIED}'))) > 0 as has_signal from c""")  # fmt: skip

_F14 = [(-1, 1, "March 2024", True), (-1, 2, "March 2024", True), (-2, 1, "April 2024", True), (-3, 1, "February 2024", True), (-4, 1, "Sept 2024", True), (-5, 1, "March 2024", True), (-5, 2, "April 2024", True), (-6, 1, None, False), (-7, 1, "March 2024", True), (-7, 2, None, True), (-8, 1, "mar 2024", True)]
_F_SCHEMA = "doc_id long, page_no int, month_year string, has_signal boolean"


def footer_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    footers = V.footers(spark, sf_dir).withColumn("doc_id", F.col("doc_id") * 10 + F.col("page_no") % 10)
    fixed = Q.footer_consistency(V.literal(spark, _F_SCHEMA, _F14), F.to_date(F.lit("2024-03-15")))
    return Q.footer_consistency(footers, F.to_date(F.lit("1997-06-15"))).union(fixed).drop("n_misspelt")


CONSISTENCY_SQL = V.with_views("v_footers", V.values("fixed", _F_SCHEMA, _F14) + """, al as (select doc_id * 10 + page_no % 10 as doc_id, page_no, month_year, has_signal, date '1997-06-01' as m from v_footers union all select *, date '2024-03-01' from fixed),
g as (select doc_id, m, count(distinct lower(month_year)) as n_months, count(*) filter (has_signal and month_year is null) as n_missing, arg_min(month_year, page_no) filter (month_year is not null) as d from al group by 1, 2)
select doc_id, n_months, n_missing, case when n_months > 1 then 'fail' when n_months = 0 then 'warn' when n_missing > 0 then 'fail'
  when coalesce(coalesce(try_strptime(d, '%B %Y'), try_strptime(d, '%b %Y')) >= m, false) then 'pass' else 'warn' end as status from g""")  # fmt: skip

_SPELT = [(1, "MDE-1A Manual Marhc 2024"), (2, "Guide 2024"), (3, "Septembr 2023 | x"), (4, None), (5, "Serial 1234 Augst 2020")]


def month_misspelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly spelt months in footers of orders, whose month names lose a letter by a rule, beside written ones."""
    name, at = F.date_format("o_orderdate", "MMMM"), (F.col("o_orderkey") % 8 + 1).cast("int")
    spelt = F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + 1))
    footers = V.table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("id"), F.concat(F.lit("Guide "), spelt, F.date_format("o_orderdate", " yyyy"), F.lit(" Page 3")).alias("text"))
    return footers.union(V.literal(spark, "id long, text string", _SPELT)).select("id", Q.near_month(F.col("text")).alias("found"))


_TOC = [(1, 0, 1, " Pump Guide "), (1, 1, 2, "x"), (2, 0, 2, "Only second"), (3, 0, 1, "Other"), (4, 0, 1, "Valve"), (6, 0, 1, "—")]
_TOC_FOOT = [(1, 1, "The Pump Guide", True), (1, 2, "Else", True), (1, 3, "The Pump Guide", True), (2, 1, "only second level", True), (3, 1, "Guide", True), (4, 1, "Valve", False), (5, 1, "x", True), (6, 1, "a", True), (1, 4, "Else", True), (1, 5, "", True)]


def bookmark_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bookmark_match(V.literal(spark, "doc_id long, toc_seq int, level int, title string", _TOC), V.literal(spark, "doc_id long, page_no int, title string, has_signal boolean", _TOC_FOOT))


BOOKMARK_SQL = "with " + V.values("toc", "doc_id long, toc_seq int, level int, title string", _TOC) + ", " + V.values("ft", "doc_id long, page_no int, title string, has_signal boolean", _TOC_FOOT) + f""",
b as (select doc_id, coalesce(arg_min(trim(title), toc_seq) filter (level = 1 and trim(title) <> ''), arg_min(trim(title), toc_seq)) as bookmark from toc group by 1),
n as (select doc_id, title, count(*) as n, min(page_no) as p from ft where has_signal and title <> '' group by 1, 2),
f as (select doc_id, title as footer from (select *, row_number() over (partition by doc_id order by n desc, p) as r from n) where r = 1),
d as (select doc_id from toc union select doc_id from ft),
j as (select doc_id, bookmark, footer, {_NORM.format("bookmark")} as x, {_NORM.format("footer")} as y from d left join b using (doc_id) left join f using (doc_id))
select doc_id, bookmark, footer, case when bookmark is null then 'not_checked' when footer is null then 'warn' when x <> '' and y <> '' and (contains(x, y) or contains(y, x)) then 'pass' else 'fail' end as status from j"""

#: (brand, first class, keywords): a rule set for tests and for documents here; real ones are read from files.
_BRANDS = [("b1", False, ["meteor", "comet"]), ("b2", True, ["falcon", "heron", "the"]), ("b3", True, ["maple", "cedar", "ing"]), ("b4", False, ["rang", "der"])]
_BRAND_TEXT = [(-1, "Falcon and Meteor"), (-2, "Maple Cedar Falcon"), (-3, "Maple Falcon"), (-4, "arranged filters"), (-5, "nothig"), (-6, None)]


def brand_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.expected_brand(docs.union(V.literal(spark, "doc_id long, text string", _BRAND_TEXT)), _BRANDS)


BRAND_SQL = "with " + V.values("x", "doc_id long, text string", _BRAND_TEXT) + f""", al as (select doc_id, {_NORM.format("t")} as h from (select doc_id, text as t from documents union all select doc_id, text from x)),
s as (select doc_id, contains(h, 'meteor') or contains(h, 'comet') as b1, contains(h, 'falcon')::int + contains(h, 'heron')::int + contains(h, 'the')::int as b2,
  contains(h, 'maple')::int + contains(h, 'cedar')::int + contains(h, 'ing')::int as b3, contains(h, 'rang') or contains(h, 'der') as b4 from al)
select doc_id, case when b2 > 0 and b2 >= b3 then 'b2' when b3 > 0 then 'b3' when b1 then 'b1' when b4 then 'b4' end as brand from s"""

_SPAN = "doc_id long, page_no int, block_no int, span_no int, text string, size double, x0 double, y0 double, x1 double, y1 double"
_MARKED = [(-1, 1, 1, 1, "DRAFT", 48.0, 200.0, 380.0, 400.0, 420.0), (-1, 1, 1, 2, "draft copy", 48.0, 200.0, 380.0, 400.0, 420.0), (-1, 1, 2, 1, "Preliminary", 30.0, 250.0, 300.0, 350.0, 330.0), (-1, 2, 1, 1, "DRAFT", 18.0, 200.0, 380.0, 400.0, 420.0), (-1, 3, 1, 1, "DRAFT", 48.0, 0.0, 0.0, 60.0, 40.0), (-1, 4, 1, 1, "Final", 48.0, 200.0, 380.0, 400.0, 420.0)]


def watermark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = V.spans(spark, sf_dir)
    derived = marks.select(
        F.floor(F.col("id") / 100).alias("doc_id"), "page_no", (F.col("id") % 3).cast("int").alias("block_no"), (F.col("id") % 100).cast("int").alias("span_no"),
        F.when(F.col("kind") == "click", "Draft").when(F.col("kind") == "view", "a PRELIMINARY note").otherwise(F.col("kind")).alias("text"), (F.col("width") * 2).alias("size"),
        (F.col("id") % 600).cast("double").alias("x0"), (F.col("y") % 800).cast("double").alias("y0"), (F.col("id") % 600 + 40).cast("double").alias("x1"), (F.col("y") % 800 + 10).cast("double").alias("y1"),
    )
    found = derived.unionByName(V.literal(spark, _SPAN, _MARKED)).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    return Q.watermarks(found)


WATERMARK_SQL = V.with_views("v_spans", V.values("fixed", _SPAN, _MARKED) + """, al as (select id // 100 as doc_id, page_no, cast(id % 3 as int) as block_no, cast(id % 100 as int) as span_no,
    case kind when 'click' then 'Draft' when 'view' then 'a PRELIMINARY note' else kind end as text, width * 2 as size, (id % 600)::double as x0, (y % 800)::double as y0, (id % 600 + 40)::double as x1, (y % 800 + 10)::double as y1 from v_spans
  union all select * from fixed),
h as (select * from al where size >= 20 and (contains(lower(text), 'draft') or contains(lower(text), 'preliminary')) and (x0 + x1) / 2 between 120 and 480 and (y0 + y1) / 2 between 160 and 640)
select doc_id, page_no, block_no, arg_min(text, span_no) as text from h group by 1, 2, 3""")  # fmt: skip

_BARS = [(-1, 1, 50.0, 100.0, 52.0, 300.0), (-1, 2, 50.0, 100.0, 57.0, 300.0), (-1, 3, 50.0, 100.0, 52.0, 200.0), (-1, 4, 300.0, 100.0, 302.0, 300.0), (-1, 5, 590.0, 0.0, 595.0, 200.0)]


def change_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = V.spans(spark, sf_dir)
    derived = marks.select(F.floor(F.col("id") / 10).alias("doc_id"), "page_no", (F.col("id") % 600).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 600 + F.col("width")).alias("x1"), (F.col("y") % 400).cast("double").alias("y1"))
    fixed = V.literal(spark, "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double", _BARS)
    return Q.change_bars(derived.unionByName(fixed).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0)))


BAR_SQL = V.with_views("v_spans", V.values("fixed", "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double", _BARS) + """,
al as (select id // 10 as doc_id, page_no, (id % 600)::double as x0, 0.0::double as y0, id % 600 + width as x1, (y % 400)::double as y1 from v_spans union all select * from fixed)
select distinct doc_id, page_no from al where (x0 <= 72 or x1 >= 528) and x1 - x0 <= 6 and y1 - y0 >= 160""")  # fmt: skip


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents: five lines each, every seventh left blank and some with a notice."""
    found = V.lines(spark, sf_dir).withColumn("page_no", F.expr("cast(line_no div 5 as int)"))
    blank = (F.col("doc_id") + F.col("page_no")) % 7
    line = F.when(blank == 0, F.when(F.col("doc_id") % 2 == 0, "Page 4").otherwise("This page is intentionally left blank")).otherwise(F.col("line"))
    return found.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


_DOC_PAGES = """v_pages as (select doc_id, cast(line_no // 5 as int) as page_no,
  string_agg(case when (doc_id + line_no // 5) % 7 = 0 then case when doc_id % 2 = 0 then 'Page 4' else 'This page is intentionally left blank' end else line end, chr(10) order by line_no) as text from v_lines group by 1, 2)"""
_IS_BLANK = f"""(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: not {_DROPPED.format("x")})) = 0
  or regexp_matches(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: not {_DROPPED.format("x")}), ' '),
    '(?i)^this\\s+page\\s+(is\\s+)?intentionally\\s+(left\\s+)?blank|^intentionally\\s+(left\\s+)?blank|^this\\s+page\\s+left\\s+blank|^blank\\s+page$'))"""
_NOTICED = """regexp_matches(regexp_replace(trim(text), '\\s+', ' ', 'g'), '(?i)this\\s+page\\s+(is\\s+)?intentionally\\s+(left\\s+)?blank')"""


def even_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.even_pages(_doc_pages(spark, sf_dir))


EVEN_SQL = V.with_views("v_lines", _DOC_PAGES + " select doc_id, count(*) as n_pages, case when count(*) % 2 = 0 then 'pass' else 'fail' end as status from v_pages group by 1")


def blank_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.blank_notices(_doc_pages(spark, sf_dir))


_NOTICE = f"""b as (select doc_id, page_no, {_IS_BLANK} as bl, {_NOTICED} as nt, max(page_no) over (partition by doc_id) as lp from v_pages),
notices as (select doc_id, count(*) filter (bl) as n_blank, count(*) filter (bl and not nt and page_no <> lp) as n_missing, case when count(*) filter (bl and not nt and page_no <> lp) > 0 then 'fail' else 'pass' end as status from b group by 1)"""
NOTICE_SQL = V.with_views("v_lines", _DOC_PAGES + ", " + _NOTICE + " select * from notices")


def text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.too_short(V.table(spark, sf_dir, "documents").select("doc_id", "text"))


GUARD_SQL = """select doc_id, cast(sum(length(trim(text, E' \\n'))) as bigint) as n_chars, case when sum(length(trim(text, E' \\n'))) < 50 then 'no text layer' end as error from documents group by 1"""

QUERIES = {f.__name__: f for f in (normalize_text, quote_counts, footer_lines, footer_title_pick, footer_consistency, bookmark_match, brand_detect, watermark_spans, change_bars, even_pages, blank_notice, text_guard)}
ORACLES = dict(zip(QUERIES, (NORM_SQL, QUOTE_SQL, FOOTER_SQL, TITLE_SQL, CONSISTENCY_SQL, BOOKMARK_SQL, BRAND_SQL, WATERMARK_SQL, BAR_SQL, EVEN_SQL, NOTICE_SQL, GUARD_SQL), strict=True))
#: The likeness of words that decides here has no counterpart in SQL; tests hold it against plain Python.
QUERIES["month_misspelling"] = month_misspelling
