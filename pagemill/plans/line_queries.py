"""Queries of the line layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import lines as L

from . import views as V

_DROP = [(-1, 0, "Page 12"), (-1, 1, "ab"), (-1, 2, "© 2024 Example"), (-1, 3, "MDE-1234A Manual March 2024"), (-1, 4, "See MDE-1234A for details"), (-1, 5, "Page twelve"), (-1, 6, "   "), (-1, 7, "Table of Contents"), (-1, 8, "(c) 2024")]
_LINE = "doc_id long, line_no int, line string"
_DROPPED = r"""(length(trim({0})) < 3 or regexp_matches(trim({0}), '^Page \d+') or regexp_matches(trim({0}), 'MDE-[\p{{L}}\p{{N}}_]+.+\d{{4}}$') or regexp_matches(trim({0}), '^©\s*\d{{4}}'))"""


def drop_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.lines(spark, sf_dir).union(V.literal(spark, _LINE, _DROP).select("doc_id", "line_no", "line"))
    drop = T.should_drop(F.col("line"))
    return found.groupBy("doc_id").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"), F.count_if(F.trim("line") == "").alias("empty"))


DROP_SQL = V.with_views(
    "v_lines",
    V.values("extra", _LINE, _DROP) + f""", al as (select doc_id, line from v_lines union all select doc_id, line from extra)
select doc_id, count(*) filter (not {_DROPPED.format("line")}) as kept, count(*) filter ({_DROPPED.format("line")}) as dropped, count(*) filter (trim(line) = '') as empty from al group by doc_id""",
)

_PAGES = [(1, ""), (2, "This page is intentionally left blank"), (3, "Page 3"), (4, "Intentionally blank"), (5, "This page intentionally left blank\nRevision notes follow"), (6, "blank page"), (7, "blank page follows"), (8, "This page left blank"), (9, "Body text here"), (10, None)]


def blank_page_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.union(V.literal(spark, "doc_id long, text string", _PAGES).select(-F.col("doc_id"), "text"))
    return found.select("doc_id", T.is_blank_page(F.col("text")).alias("is_blank"))


BLANK_SQL = (
    "with " + V.values("extra", "doc_id long, text string", _PAGES) + f""", al as (select doc_id, text from documents union all select -doc_id, text from extra),
m as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: not {_DROPPED.format("x")}) as ls from al)
select doc_id, len(ls) = 0 or regexp_matches(array_to_string(ls, ' '), '(?i)^this\\s+page\\s+(is\\s+)?intentionally\\s+(left\\s+)?blank|^intentionally\\s+(left\\s+)?blank|^this\\s+page\\s+left\\s+blank|^blank\\s+page$') as is_blank from m""".replace("\\\\", "\\")
)

_RANGES = [(1, "1-5, 8", 10), (2, "3", 10), (3, "", 10), (4, "9-3", 10), (5, "999", 10), (6, "0-2", 10), (7, "8-20", 10), (8, ",", 10), (9, "x", 10), (10, "1-2-3", 10), (11, None, 10), (12, " 2 - 4 ,4,1", 10)]


def page_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.literal(spark, "id long, spec string, total int", _RANGES).withColumn("ok", L.page_numbers_ok(F.col("spec")))
    pages = F.when(F.col("ok"), L.page_numbers(F.col("spec"), F.col("total")))
    return found.select("id", "ok", F.coalesce(F.array_join(pages.cast("array<string>"), ","), F.lit("all")).alias("pages"))


RANGE_SQL = (
    "with " + V.values("r", "id long, spec string, total int", _RANGES) + r""", p as (
  select id, total, trim(part) as part from (select id, total, unnest(string_split(spec, ',')) as part from r) where trim(part) <> ''),
e as (select id, total, bool_and(regexp_matches(part, '^\d+$|^\d+\s*-\s*\d+$')) as ok from p group by id, total),
x as (select p.id, greatest(1, try_cast(trim(string_split(part, '-')[1]) as int)) as lo,
    least(p.total, coalesce(try_cast(trim(string_split(part, '-')[2]) as int), try_cast(part as int))) as hi from p join e using (id) where ok),
n as (select distinct id, unnest(generate_series(lo, hi)) as pg from x where lo <= hi)
select r.id, coalesce(e.ok, true) as ok, coalesce((select string_agg(cast(pg - 1 as varchar), ',' order by pg) from n where n.id = r.id), 'all') as pages
from r left join e using (id)"""
)


def word_line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assemble(V.words(spark, sf_dir))


ASSEMBLY_SQL = V.with_views("v_words", """select doc_id, page_no, cast(round_even(top / 2, 0) * 2 as bigint) as line_top, cast(count(*) as int) as n_words,
  string_agg(text, ' ' order by x0, word_seq) as text from v_words group by 1, 2, 3""")  # fmt: skip


def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify(V.words(spark, sf_dir))


CLASSIFY_SQL = V.with_views("v_words", """g as (select doc_id, page_no, cast(round_even(top / 2, 0) * 2 as bigint) as line_top, avg(size) as s, bool_or(contains(fontname, 'Bold')) as b from v_words group by 1, 2, 3),
t as (select *, case when s <= 9.5 then 'dropped' when not b then 'paragraph' when s >= 17 then 'heading' when s >= 14 then 'note_header' when s >= 11.5 then 'heading' else 'paragraph' end as type from g)
select doc_id, page_no, line_top, type, case when type <> 'heading' then 0 when s >= 17 then 1 when s >= 13.5 then 2 else 3 end as level from t""")  # fmt: skip


def styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.styled_runs(V.words(spark, sf_dir))


RUNS_SQL = V.with_views("v_words", """s as (select doc_id, page_no, cast(round_even(top / 2, 0) * 2 as bigint) as line_top, x0, word_seq, text, contains(fontname, 'Bold') as b,
    case when contains(fontname, 'Bold') and contains(fontname, 'Italic') then 'bi' when contains(fontname, 'Bold') then 'b' when contains(fontname, 'Italic') then 'i' else '' end as style from v_words),
m as (select *, case when lag(style) over w = style then 0 else 1 end as st, bool_and(b) over (partition by doc_id, page_no, line_top) as line_is_bold from s
    window w as (partition by doc_id, page_no, line_top order by x0, word_seq)),
r as (select *, sum(st) over (partition by doc_id, page_no, line_top order by x0, word_seq rows unbounded preceding) as run_no from m)
select doc_id, page_no, line_top, cast(run_no as bigint) as run_no, style, line_is_bold, string_agg(text, ' ' order by x0, word_seq) as text from r group by all""")  # fmt: skip

_KINDS = [(1, "• first point"), (2, "- dash"), (3, "Figure 3: A pump"), (4, "figure 2-1 : Valve"), (5, "Figure A"), (6, "Notes: keep dry"), (7, "telnet host"), (8, "https://x.example"), (9, "http://x.example"), (10, "$ ls"), (11, "C:\\>dir"), (12, "Plain text."), (13, "ok"), (14, "►go on")]
_KIND_SQL = r"""case when {drop} then 'dropped' when regexp_matches(text, '^[•–\-▪◆●○■□▸▹►]') then 'list_item' when regexp_matches(text, '(?i)^Figure\s+\d[\d\-.]*\s*:') then 'figure'
  when regexp_matches(text, '(?i)^Notes?:') then 'note_inline' when starts_with(text, 'telnet ') or starts_with(text, 'C:\>') or starts_with(text, '$ ') or starts_with(text, 'http://') then 'code_block' else 'paragraph' end"""


def line_kind_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.lines(spark, sf_dir).select("doc_id", "line_no", F.col("line").alias("text"))
    extra = V.literal(spark, "line_no int, text string", _KINDS).select(F.lit(-1).cast("long"), "line_no", "text")
    return L.kinds(found.union(extra))


KIND_SQL = V.with_views("v_lines", V.values("extra", "line_no int, text string", _KINDS) + rf""", al as (select doc_id, line_no, line as text from v_lines union all select -1, line_no, text from extra),
k as (select doc_id, cast(line_no as int) as line_no, text, {_KIND_SQL.format(drop=_DROPPED.format("text"))} as type from al)
select doc_id, line_no, type, case when type = 'list_item' then regexp_replace(text, '^[•–\-▪◆●○■□▸▹►]\s*', '') else text end as text from k""")  # fmt: skip


def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.lines(spark, sf_dir).select("doc_id", F.expr("cast(line_no div 50 as int)").alias("page_no"), F.col("line_no").alias("seq"), F.col("line").alias("text"))
    return L.merge_paragraphs(L.kinds(found))


MERGE_SQL = V.with_views("v_lines", rf"""k as (select doc_id, line_no // 50 as page_no, line_no as seq, line as text, {_KIND_SQL.format(drop=_DROPPED.format("text")).replace("text", "line")} as type from v_lines),
t as (select doc_id, page_no, seq, type, case when type = 'list_item' then regexp_replace(text, '^[•–\-▪◆●○■□▸▹►]\s*', '') else text end as text from k where type <> 'dropped'),
s as (select *, case when type = 'paragraph' and lag(type) over w = 'paragraph' and not regexp_matches(lag(text) over w, '[.:?]$') then 0 else 1 end as st from t window w as (partition by doc_id, page_no order by seq)),
b as (select *, sum(st) over (partition by doc_id, page_no order by seq rows unbounded preceding) as block_no from s)
select doc_id, cast(page_no as int) as page_no, cast(block_no as bigint) as block_no, type, string_agg(text, ' ' order by seq) as text from b group by 1, 2, 3, 4""")  # fmt: skip


def table_band_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words(spark, sf_dir)
    bands = words.where("k = 8").groupBy("doc_id", "page_no", "line_no").agg(F.min("top").alias("y0"), (F.max("top") + 20).alias("y1"))
    return L.outside_bands(words, bands).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


BAND_SQL = V.with_views("v_words", """b as (select doc_id, page_no, line_no, min(top) - 2 as y0, max(top) + 22 as y1 from v_words where k = 8 group by 1, 2, 3)
select doc_id, page_no, count(*) as n_words, cast(sum(length(text)) as bigint) as n_chars from v_words w
where not exists (select 1 from b where b.doc_id = w.doc_id and b.page_no = w.page_no and round_even(w.top / 2, 0) * 2 between b.y0 and b.y1) group by 1, 2""")  # fmt: skip


def tm_superscript_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words(spark, sf_dir).withColumn("flow", F.col("line_no") * 100_000 + F.col("word_seq"))
    mark = F.col("word_seq") % 7 == 5
    words = words.withColumn("text", F.when(mark, "®").otherwise(F.col("text"))).withColumn("size", F.when(mark, 5.0).otherwise(F.col("size"))).withColumn("top", F.when(mark, F.col("top") - 4).otherwise(F.col("top")))
    return L.attach_trademarks(words)


TM_SQL = V.with_views("v_words", """w as (select doc_id, page_no, line_no * 100000 + word_seq as flow, word_seq % 7 = 5 as m, case when word_seq % 7 = 5 then '®' else text end as text,
    cast(round_even(case when word_seq % 7 = 5 then top - 4 else top end / 2, 0) * 2 as bigint) as lt, case when word_seq % 7 = 5 then 5.0 else size end as size from v_words),
s as (select *, row_number() over () as r from w where m), p as (select * from w where not m),
j as (select s.doc_id, s.page_no, s.flow as mark_flow, p.lt as line_top, p.flow, p.text,
    row_number() over (partition by s.doc_id, s.page_no, s.flow order by p.lt desc, p.flow desc) as rn
  from s join p on p.doc_id = s.doc_id and p.page_no = s.page_no and abs(p.lt - s.lt) <= 8 and p.flow < s.flow)
select doc_id, page_no, cast(mark_flow as int) as mark_flow, 'reg' as tm, line_top, cast(flow as int) as flow, text from j where rn = 1""")  # fmt: skip


def band_join_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = V.spans(spark, sf_dir)
    numbered = L.number_sessions(marks.where("kind = 'click'")).withColumn("number", F.col("number").cast("long"))
    return L.nearest_mark(marks.where("kind <> 'click'"), numbered, "number")


_NUMBERED = """a0 as (select *, case when y - lag(y) over (partition by doc_id, page_no order by y, id) > 200 then 1 else 0 end as n from v_spans where {0}),
a1 as (select *, cast(sum(n) over (partition by doc_id, page_no order by y, id rows unbounded preceding) as bigint) as session from a0),
a2 as (select *, row_number() over (partition by doc_id, page_no, session order by y, id) as number from a1)"""
NUMBERS_SQL = V.with_views("v_spans", _NUMBERED.format("kind = 'click'") + """,
a as (select doc_id, page_no, y, arg_max(number, id) as number from a2 group by 1, 2, 3), p as (select * from v_spans where kind <> 'click')
select p.doc_id, p.page_no, p.id, min(a.y) as mark_y, arg_min(a.number, a.y) as number
from p join a on a.doc_id = p.doc_id and a.page_no = p.page_no and a.y between p.y - 15 and p.y + 15 group by p.doc_id, p.page_no, p.id""")  # fmt: skip


def band_join_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = V.spans(spark, sf_dir)
    links = marks.where("kind = 'view'").withColumn("uri", F.concat(F.lit("https://example.org/"), F.col("id")))
    return L.nearest_mark(marks.where("kind <> 'view'"), links, "uri")


LINKS_SQL = V.with_views("v_spans", """a as (select doc_id, page_no, y, arg_max('https://example.org/' || id, id) as uri from v_spans where kind = 'view' group by 1, 2, 3),
p as (select * from v_spans where kind <> 'view')
select p.doc_id, p.page_no, p.id, min(a.y) as mark_y, arg_min(a.uri, a.y) as uri
from p join a on a.doc_id = p.doc_id and a.page_no = p.page_no and a.y between p.y - 15 and p.y + 15 group by p.doc_id, p.page_no, p.id""")  # fmt: skip


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.number_sessions(L.narrow_spans(V.spans(spark, sf_dir)))
    return found.select("id", "doc_id", "page_no", "session", F.col("number").cast("long").alias("number"))


SESSION_SQL = V.with_views("v_spans", _NUMBERED.format("width between 2 and 12 and height > 3 and x0 < 160") + " select id, doc_id, page_no, session, number from a2")


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.footers(spark, sf_dir)
    total = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    return pages.join(total, "doc_id").where(L.sample_pages(F.col("page_no"), F.col("total"))).select("doc_id", F.col("page_no").cast("long").alias("page_no"))


SAMPLE_SQL = V.with_views("v_footers", """t as (select doc_id, page_no, max(page_no) over (partition by doc_id) as n from v_footers)
select doc_id, page_no from t where n <= 6 or page_no = 1 or page_no = n or (page_no between 2 and n - 1 and (page_no - 2) % greatest(1, n // 5) = 0)""")  # fmt: skip

QUERIES = {f.__name__: f for f in (drop_filter_counts, blank_page_flag, page_range_expand, word_line_assembly, classify_lines, styled_runs, line_kind_chain, paragraph_merge, table_band_antijoin, tm_superscript_attach, band_join_numbers, band_join_links, gap_sessions, systematic_sample)}
ORACLES = dict(zip(QUERIES, (DROP_SQL, BLANK_SQL, RANGE_SQL, ASSEMBLY_SQL, CLASSIFY_SQL, RUNS_SQL, KIND_SQL, MERGE_SQL, BAND_SQL, TM_SQL, NUMBERS_SQL, LINKS_SQL, SESSION_SQL, SAMPLE_SQL), strict=True))
