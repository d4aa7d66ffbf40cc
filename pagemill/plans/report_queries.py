"""The quality report over documents: eight checks each, findings, speed options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import quality as Q
from pagemill.operators import report as R

from . import views as V
from .quality_queries import _BRANDS, _DATED, _DOC_PAGES, _MON, _NORM, _NOTICE, _doc_pages

_NAMES = [m.capitalize() for m in _MON.split("|")[:12]]
_AS_OF = "2023-03-15"


def _footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footer line for each page: a page number, or a title and a month, which sometimes varies or lacks a letter."""
    doc, page = F.col("doc_id"), F.col("page_no")
    name = F.element_at(F.array(*[F.lit(m) for m in _NAMES]), ((doc + F.when(doc % 11 == 0, page).otherwise(0)) % 12 + 1).cast("int"))
    spelt = F.when((doc % 13 == 0) & (page % 3 == 1), F.concat(F.substr(name, F.lit(1), F.lit(1)), F.substr(name, F.lit(3)))).otherwise(name)
    dated = F.concat(F.lit("MDE-"), doc % 90 + 10, F.lit("A Guide "), spelt, F.lit(" "), F.lit(2020) + doc % 6)
    line = F.when((doc + page) % 5 == 0, F.concat(F.lit("Page "), page + 1)).otherwise(dated)
    found = Q.footer_facts(_doc_pages(spark, sf_dir).select("doc_id", "page_no", F.array(line).alias("lines")))
    return found.withColumn("misspelt", F.when(F.col("month_year").isNull(), Q.near_month(F.col("footer_text"))))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, doc = _doc_pages(spark, sf_dir), F.col("doc_id")
    docs = pages.select("doc_id").distinct()
    toc = docs.where("doc_id % 4 <> 2").select("doc_id", F.lit(0).alias("toc_seq"), F.when(doc % 4 == 3, 2).otherwise(1).alias("level"), F.when(doc % 4 == 0, "Some other book").otherwise("Guide").alias("title"))
    size = {"width": F.lit(600.0), "height": F.lit(800.0)}
    spans = pages.where("page_no = 0").select("doc_id", "page_no", F.lit(0).alias("block_no"), F.lit(0).alias("span_no"), F.when(doc % 3 == 0, "DRAFT copy").otherwise("Final").alias("text"), (F.lit(18.0) + doc % 5).alias("size"), F.lit(200.0).alias("x0"), F.lit(300.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(330.0).alias("y1")).withColumns(size)
    drawings = pages.select("doc_id", "page_no", (doc * 7 % 600).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (doc * 7 % 600 + 4).cast("double").alias("x1"), (F.lit(100.0) + F.col("page_no") * 50).alias("y1")).withColumns(size)
    logos = docs.where("doc_id % 3 <> 1").select("doc_id", F.lit(True).alias("ocr"), (doc % 5 != 0).alias("on_first"), (doc % 7 != 0).alias("on_last"), F.lit(True).alias("tagline"), F.when(doc % 2 == 0, "blue").otherwise("monochrome").alias("mode"), F.lit("monochrome").alias("wanted"))
    return R.checks(pages, _footers(spark, sf_dir), toc, spans, drawings, logos, _BRANDS, F.to_date(F.lit(_AS_OF)))


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight checks of documents, in the report's order."""
    return _report(spark, sf_dir)


_MONTHS = "[" + ", ".join(f"'{m}'" for m in _NAMES) + "]"
_FOOTERS = _DOC_PAGES + rf""", n0 as (select doc_id, page_no, {_MONTHS}[(doc_id + case when doc_id % 11 = 0 then page_no else 0 end) % 12 + 1] as nm from v_pages),
n1 as (select doc_id, page_no, case when (doc_id + page_no) % 5 = 0 then 'Page ' || (page_no + 1) else
  'MDE-' || (doc_id % 90 + 10) || 'A Guide ' || case when doc_id % 13 = 0 and page_no % 3 = 1 then nm[1] || nm[3:] else nm end || ' ' || (2020 + doc_id % 6) end as line from n0),
n2 as (select doc_id, page_no, line, nullif(regexp_extract(line, '{_DATED}', 0), '') as month_year, regexp_extract(line, '([A-Za-z]{{3,12}})\s+\d{{4}}', 1) as word from n1),
feet as (select doc_id, page_no, line, month_year, case when month_year is null and word <> '' and list_min(list_transform({_MONTHS}, lambda m: levenshtein(lower(m), lower(word)))) <= 1
  then regexp_extract(line, '[A-Za-z]{{3,12}}\s+\d{{4}}', 0) end as misspelt, trim(regexp_replace(regexp_replace(line, '{_DATED}', '', 'g'), '(?i)\bpage\s+\d+\b', '', 'g')) as title from n2)"""
_CHECKS = _FOOTERS + ", " + _NOTICE + f""", docs as (select distinct doc_id from v_pages),
fm as (select doc_id, count(distinct lower(month_year)) as n, count(*) filter (month_year is null and misspelt is null) as miss, arg_min(month_year, page_no) filter (month_year is not null) as d from feet group by 1),
ft as (select doc_id, title, count(*) as n, min(page_no) as p from feet where title <> '' group by 1, 2),
fc as (select doc_id, title as footer from (select *, row_number() over (partition by doc_id order by n desc, p) as r from ft) where r = 1),
bm as (select doc_id, case when doc_id % 4 = 0 then 'Some other book' when doc_id % 4 <> 2 then 'Guide' end as bookmark, footer from docs left join fc using (doc_id)),
bn as (select doc_id, bookmark, footer, {_NORM.format("bookmark")} as x, {_NORM.format("footer")} as y from bm),
tx as (select doc_id, string_agg(text, ' ' order by page_no) as t from v_pages group by 1),
br as (select doc_id, {_NORM.format("t")} as h from tx),
bd as (select doc_id, contains(h, 'meteor') or contains(h, 'comet') or contains(h, 'falcon') or contains(h, 'heron') or contains(h, 'the') or contains(h, 'maple') or contains(h, 'cedar') or contains(h, 'ing') or contains(h, 'rang') or contains(h, 'der') as named from br),
checks as (
  select doc_id, 1 as check_no, 'footer_month_year' as check_id, case when n > 1 then 'fail' when n = 0 then 'warn' when miss > 0 then 'fail' when strptime(d, '%B %Y') >= date '2023-03-01' then 'pass' else 'warn' end as status from fm
  union all select doc_id, 2, 'bookmark_footer_title', case when bookmark is null then 'not_checked' when footer is null then 'warn' when x <> '' and y <> '' and (contains(x, y) or contains(y, x)) then 'pass' else 'fail' end from bn
  union all select doc_id, 3, 'brand_logo', case when not named or doc_id % 3 = 1 then 'not_checked' when doc_id % 5 = 0 or doc_id % 7 = 0 then 'fail' when doc_id % 2 = 0 then 'warn' else 'pass' end from bd
  union all select doc_id, 4, 'straight_quotes', case when bool_or(regexp_matches(text, '["'']')) then 'warn' else 'pass' end from v_pages group by 1
  union all select doc_id, 5, 'watermark', case when doc_id % 3 = 0 and 18 + doc_id % 5 >= 20 then 'pass' else 'warn' end from docs
  union all select doc_id, 6, 'change_bar', case when bool_or((doc_id * 7 % 600 <= 72 or doc_id * 7 % 600 + 4 >= 528) and 100 + page_no * 50 >= 160) then 'pass' else 'warn' end from v_pages group by 1
  union all select doc_id, 7, 'even_page_count', case when count(*) % 2 = 0 then 'pass' else 'fail' end from v_pages group by 1
  union all select doc_id, 8, 'blank_page_notice', status from notices)"""
CHECKS_SQL = V.with_views("v_lines", _CHECKS + " select doc_id, cast(check_no as bigint) as check_no, check_id, status from checks")


def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.overall(_report(spark, sf_dir))


OVERALL_SQL = V.with_views("v_lines", _CHECKS + """ select doc_id, ['pass', 'not_checked', 'warn', 'fail'][max(case status when 'pass' then 1 when 'not_checked' then 2 when 'warn' then 3 else 4 end)] as status,
  count(*) filter (status in ('fail', 'warn')) as n_flagged, count(*) as n_checks from checks group by 1""")  # fmt: skip


def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(_doc_pages(spark, sf_dir), _footers(spark, sf_dir))


FINDINGS_SQL = V.with_views("v_lines", _FOOTERS + """, mm as (select doc_id from feet group by 1 having count(distinct lower(month_year)) > 1),
qs as (select doc_id, page_no, regexp_extract_all(text, '["'']') as f from v_pages)
select doc_id, page_no, 'footer_month_year' as check_id, 'error' as severity,
  case when misspelt is null then 'Footer text found but no month/year was detected.' else 'Footer month/year may contain a spelling error: "' || misspelt || '". Please check.' end as message, line as evidence from feet where month_year is null
union all select doc_id, page_no, 'footer_month_year', 'error', 'Footer month/year differs on this page: ' || month_year, month_year from feet join mm using (doc_id) where month_year is not null
union all select doc_id, page_no, 'straight_quotes', 'warning', 'Straight quote characters detected (' || len(f) || ' occurrence(s)).', array_to_string(f[1:10], '') from qs where len(f) > 0""")  # fmt: skip


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers' documents, an order a page, and whether a mark is on them."""
    pages = V.footers(spark, sf_dir).withColumn("page_no", F.col("page_no").cast("long"))
    return pages.join(pages.groupBy("doc_id").agg(F.max("page_no").alias("total")), "doc_id")


def early_exit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sampled raster scan looks at when it ends at a document's first hit."""
    return R.scanned_pages(_scan(spark, sf_dir), True, True, F.col("month_year").isNull()).select("doc_id", "page_no", "hit")


EXIT_SQL = V.with_views("v_footers", """t as (select doc_id, page_no, month_year is null as hit, max(page_no) over (partition by doc_id) as n from v_footers),
s as (select * from t where n <= 6 or page_no = 1 or page_no = n or (page_no between 2 and n - 1 and (page_no - 2) % greatest(1, n // 5) = 0)),
f as (select *, min(page_no) filter (hit) over (partition by doc_id) as first_hit from s)
select doc_id, page_no, hit from f where first_hit is null or page_no <= first_hit""")  # fmt: skip


def speed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that events ask for, with the scale at which a page would be drawn."""
    kind = F.col("event_type")
    asked = F.create_map(F.lit("fast_dpi"), (kind == "click").cast("string"), F.lit("early_exit"), (F.col("user_id") % 2 == 0).cast("string"))
    found = V.table(spark, sf_dir, "events").select("event_id", R.speed_options(asked).alias("o"))
    return found.select("event_id", "o.dpi", F.round(R.render_scale(F.col("o.dpi")), 6).alias("scale"), "o.early_exit", "o.sample_pages", "o.skip_raster_change_bar")


OPTION_SQL = """select event_id, case when event_type = 'click' then 100 else 200 end as dpi, round(case when event_type = 'click' then 100 else 200 end / 72.0::double, 6) as scale,
  user_id % 2 = 0 as early_exit, false as sample_pages, false as skip_raster_change_bar from events"""

QUERIES = {f.__name__: f for f in (quality_checks, overall_status, quality_findings, early_exit_scan, speed_options)}
ORACLES = dict(zip(QUERIES, (CHECKS_SQL, OVERALL_SQL, FINDINGS_SQL, EXIT_SQL, OPTION_SQL), strict=True))
