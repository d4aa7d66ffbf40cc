"""Queries of the mapper, the topic splitter and the renderer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import mapping as M
from pagemill.operators import topics as P

from . import views as V

_BLOCK = "doc_id long, seq int, type string, level int, list_kind string, note_type string, text string, rows array<array<string>>"
_H1S = [(-1, i, "heading" if t else "paragraph", t, None, None, x, None) for i, (t, x) in enumerate([(1, "a"), (1, "b"), (1, "c"), (0, "x"), (1, "d"), (1, "e")])]


def _h1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks(spark, sf_dir).unionByName(V.literal(spark, _BLOCK, _H1S))


def merge_split_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.merge_split_headings(_h1_blocks(spark, sf_dir)).where("type = 'heading' and level = 1")
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


_MERGED = """m0 as (select *, coalesce(type = 'heading' and level = 1, false) as h, row_number() over (partition by doc_id order by seq) as pos from {src}),
m1 as (select *, pos - row_number() over (partition by doc_id, h order by seq) as run from m0),
m2 as (select *, case when h then (row_number() over (partition by doc_id, h, run order by seq) - 1) // 2 else -seq - 1 end as pr from m1),
merged as (select doc_id, min(seq) as seq, first(type) as type, first(level) as level, first(list_kind) as list_kind, first(note_type) as note_type,
  case when h then trim(string_agg(text, ' ' order by seq)) else first(text) end as text, first(rows) as rows from m2 group by doc_id, h, case when h then run end, pr)"""
MERGE_SQL = V.with_views("v_blocks", V.values("extra", _BLOCK, _H1S) + ", al as (select * from v_blocks union all by name select * from extra), " + _MERGED.format(src="al") + " select doc_id, seq, text from merged where type = 'heading' and level = 1")

_CALLOUTS = [(1, 0, "table", 0, None, None, "", [["WARNING"], ["Hot"], ["surface"]]), (1, 1, "table", 0, None, None, "", [["Important Information"], ["Read"]]), (1, 2, "table", 0, None, None, "", [["DANGER"]]), (1, 3, "table", 0, None, None, "", [["WARNING", "x"], ["a", "b"]]), (1, 4, "table", 0, None, None, "", [["NOTE"], ["x"]]), (1, 5, "table", 0, None, None, "", [[" caution "], ["", " a "], ["b"]])]


def callout_reclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("doc_id"), F.col("l_linenumber").cast("int").alias("seq"), "l_linestatus", "l_returnflag", "l_suppkey")
    first = F.when(F.col("l_returnflag") == "A", "Caution").when(F.col("l_returnflag") == "N", "Important").otherwise("Data")
    rows = F.array(F.array(first), F.array(F.col("l_linestatus"), F.col("l_suppkey").cast("string")))
    derived = items.select("doc_id", "seq", F.lit("table").alias("type"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("list_kind"), F.lit(None).cast("string").alias("note_type"), F.lit("").alias("text"), rows.alias("rows"))
    found = M.reclassify_callouts(derived.unionByName(V.literal(spark, _BLOCK, _CALLOUTS).withColumn("doc_id", -F.col("doc_id"))))
    return found.groupBy("doc_id", "seq", "type", "note_type", "text").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("rows"), F.lit(0))).alias("n_rows"))


_CALL = """case upper(trim(rows[1][1])) when 'WARNING' then 'warning' when 'CAUTION' then 'caution' when 'DANGER' then 'danger' when 'IMPORTANT INFORMATION' then 'notice' when 'IMPORTANT' then 'notice' end"""
CALLOUT_SQL = (
    "with " + V.values("extra", _BLOCK, _CALLOUTS) + f""", al as (
  select l_orderkey as doc_id, l_linenumber as seq, [[case l_returnflag when 'A' then 'Caution' when 'N' then 'Important' else 'Data' end], [l_linestatus, cast(l_suppkey as varchar)]] as rows from lineitem
  union all select -doc_id, seq, rows from extra),
c as (select *, case when len(rows[1]) = 1 then {_CALL} end as nt from al),
t as (select doc_id, seq, case when nt is null then 'table' else 'note_header' end as type, nt as note_type,
  case when nt is null then '' else array_to_string(list_filter(list_transform(flatten(rows[2:]), lambda x: trim(x)), lambda x: x <> ''), ' ') end as text, case when nt is null then len(rows) else 0 end as nr from c)
select doc_id, seq, type, note_type, text, count(*) as n, cast(sum(nr) as bigint) as n_rows from t group by 1, 2, 3, 4, 5"""
)

_NOTES = [(1, "Note: keep dry", None), (2, "Purpose", None), (3, "Important", None), (4, "", None), (5, "Warning: hot", None), (6, "x", "danger"), (7, "Tips", None), (8, "NOTES:: a", None)]


def note_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.literal(spark, "id long, text string, note_type string", _NOTES)
    return found.select("id", M.note_element(F.col("text"), F.col("note_type")).alias("element"), M.strip_note(F.col("text")).alias("text"))


NOTE_SQL = "with " + V.values("n", "id long, text string, note_type string", _NOTES) + r""" select id, case when note_type in ('notice', 'caution', 'warning', 'danger') then 'hazard:' || note_type
  when trim(text) = '' or regexp_replace(lower(regexp_extract(trim(text), '^\S+')), ':+$', '') in ('note', 'notes', 'notice', 'tip', 'important') then 'note:note' else 'sectiondiv_title' end as element,
  regexp_replace(text, '(?i)^Notes?:\s*', '') as text from n"""

_PATHS = [(1, "MWS > Setup", None), (2, "MWS > Set Up", None), (3, "MWS > Set Up", "MWS > Set Up"), (4, "Go to MWS > Set Up", "MWS > Set Up"), (5, "A>B>C", None), (6, "plain", None), (7, "x bold y", "bold")]


def menucascade_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.literal(spark, "id long, text string, bold string", _PATHS).select("id", F.posexplode(F.when(F.col("bold").isNull(), M.split_bold_path(F.col("text"), F.lit(""))).otherwise(M.split_bold_path(F.col("text"), F.col("bold")))).alias("part", "b"))
    return found.select("id", "part", F.col("b.element").alias("element"), F.array_join(F.when(F.col("b.element") == "menucascade", M.path_steps(F.col("b.text"))).otherwise(F.array("b.text")), "|").alias("steps"))


PATH_SQL = "with " + V.values("p", "id long, text string, bold string", _PATHS) + r""", x as (
  select id, 0 as part, case when contains(text, '>') and not contains(trim(replace(text, ' > ', '')), ' ') then 'menucascade' else 'p' end as element, text as t from p where bold is null or not contains(bold, '>')
  union all select id, 0, 'menucascade', bold from p where contains(bold, '>') and trim(string_split(text, bold)[1]) = ''
  union all select id, 0, 'p', trim(string_split(text, bold)[1]) from p where contains(bold, '>') and trim(string_split(text, bold)[1]) <> ''
  union all select id, 1, 'menucascade', bold from p where contains(bold, '>') and trim(string_split(text, bold)[1]) <> '')
select id, part, element, case when element = 'menucascade' then array_to_string(list_filter(list_transform(string_split(t, '>'), lambda s: trim(s)), lambda s: s <> ''), '|') else t end as steps from x"""

_FIGURES = [(1, "Figure 3: A pump"), (2, "figure 2-1 : Valve "), (3, "Figure A: x"), (4, "Figure 1.2.: dots"), (5, "Figure 7:")]


def figure_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.literal(spark, "id long, text string", _FIGURES).select("id", M.caption(F.col("text")).alias("caption"))


CAPTION_SQL = "with " + V.values("f", "id long, text string", _FIGURES) + r""" select id, coalesce(nullif(trim(regexp_extract(text, '(?i)^Figure\s+\d[\d\-.]*\s*:\s*(.+)', 1)), ''), text) as caption from f"""


def doc_topic_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.document_types(V.blocks(spark, sf_dir))


DOC_TYPE_SQL = V.with_views("v_blocks", """select doc_id, case when count(*) filter (list_kind = 'numbered') >= 2 then 'task'
  when count(*) filter (type <> 'heading') > 0 and count(*) filter (type = 'table') * 2 >= count(*) filter (type <> 'heading') then 'reference'
  when bool_or(regexp_matches(lower(text), 'parts list|the following table|field name|abbreviations and acronyms|appendix|product codes')) then 'reference' else 'concept' end as topic_type from v_blocks group by 1""")  # fmt: skip

#: The mapped, split and typed blocks as common table expressions.
_MAPPED = _MERGED.format(src="v_blocks") + r""",
mapped as (select *, case
    when type = 'heading' and level = 1 then case when row_number() over (partition by doc_id, type = 'heading' and level = 1 order by seq) = 1 then 'title' else 'section_title' end
    when type = 'heading' then 'sectiondiv_title' when type = 'list_item' then case list_kind when 'numbered' then 'numbered_li' else 'ul_li' end
    when type = 'paragraph' then case when contains(text, '>') and not contains(trim(replace(text, ' > ', '')), ' ') then 'menucascade' else 'p' end
    when type = 'note_header' then case when trim(text) = '' or regexp_replace(lower(regexp_extract(trim(text), '^\S+')), ':+$', '') in ('note', 'notes', 'notice', 'tip', 'important') then 'note:note' else 'sectiondiv_title' end
    when type = 'table' then 'table' when type = 'figure' then 'fig' else 'codeblock' end as el from merged),
s0 as (select *, sum(case when el = 'section_title' and pos > 1 then 1 else 0 end) over (partition by doc_id order by seq rows unbounded preceding) as topic_no
  from (select *, row_number() over (partition by doc_id order by seq) as pos from mapped)),
s1 as (select doc_id, cast(topic_no as bigint) as topic_no, seq, type, text, rows, case when el = 'section_title' and pos > 1 then 'title' else el end as element from s0),
split as (select *, cast(sum(case when element = 'sectiondiv_title' then 1 else 0 end) over (partition by doc_id, topic_no order by seq rows unbounded preceding) as bigint) as subtopic_no from s1),
counted as (select doc_id, topic_no, arg_min(text, seq) filter (element = 'title') as title, min(seq) filter (element = 'title') as title_seq, count(*) as n_blocks,
  count(*) filter (element not in ('title', 'section_title', 'sectiondiv_title')) as body, count(*) filter (element = 'numbered_li') as numbered, count(*) filter (element = 'table') as tables, count(*) filter (element = 'p') as paragraphs from split group by 1, 2),
typed as (select *, case when lower(regexp_extract(trim(title), '^\S+')) = 'appendix' then 'reference' when body = 0 then 'topic' when numbered >= 2 then 'task' when tables * 2 >= body then 'reference' when paragraphs > 0 then 'concept' else 'topic' end as topic_type from counted),
sub as (select doc_id, topic_no, subtopic_no, arg_min(text, seq) filter (element = 'sectiondiv_title') as sub_title, count(*) filter (element not in ('title', 'section_title', 'sectiondiv_title')) as body,
  count(*) filter (element = 'numbered_li') as numbered, count(*) filter (element = 'table') as tables, count(*) filter (element = 'p') as paragraphs from split where subtopic_no > 0 group by 1, 2, 3),
subtyped as (select *, case when body = 0 then 'topic' when numbered >= 2 then 'task' when tables * 2 >= body then 'reference' when paragraphs > 0 then 'concept' else 'topic' end as sub_type from sub),
short as (select doc_id, topic_no, arg_min(text, seq) as shortdesc, min(seq) as short_seq from split where element = 'p' group by 1, 2 having arg_min(text, seq) <> ''),
shaped as (select t.*, s.shortdesc, s.short_seq, case when contains(lower(title), 'introduction') then 'intro' when topic_type = 'reference' and regexp_extract(trim(title), '^\S+') = 'Appendix' then 'appendix' else 'composite' end as shape from typed t left join short s using (doc_id, topic_no)),
body0 as (select p.*, h.shape, h.topic_type, u.sub_type, case when h.shape = 'intro' or p.subtopic_no = 0 then h.topic_type else u.sub_type end as eff
  from split p join shaped h using (doc_id, topic_no) left join subtyped u using (doc_id, topic_no, subtopic_no)
  where p.seq > h.title_seq and (h.short_seq is null or p.seq <> h.short_seq) and p.element <> 'title'),
body1 as (select *, case when element = 'ul_li' then 'ul' when element = 'numbered_li' then case when eff = 'task' then 'steps' else 'ol' end end as container from body0),
runs as (select *, container is not null and coalesce(lag(container) over w <> container, true) as opens, container is not null and coalesce(lead(container) over w <> container, true) as closes
  from body1 window w as (partition by doc_id, topic_no, subtopic_no order by seq))"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_blocks(V.blocks(spark, sf_dir))


def topic_split_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.topic_types(P.split_topics(_mapped(spark, sf_dir)))
    return found.select("doc_id", "topic_no", "title", "topic_type", "n_blocks", "numbered", "tables", "paragraphs")


SPLIT_SQL = V.with_views("v_blocks", _MAPPED + " select doc_id, topic_no, title, topic_type, n_blocks, numbered, tables, paragraphs from typed")


def subtopic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.subtopic_types(P.subtopics(P.split_topics(_mapped(spark, sf_dir))))


SUB_SQL = V.with_views("v_blocks", _MAPPED + " select doc_id, topic_no, subtopic_no, sub_title, sub_type from subtyped")


def list_run_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.list_runs(P.placed(_mapped(spark, sf_dir))).where("rendered")
    return found.select("doc_id", "topic_no", "subtopic_no", "seq", "container", "opens", "closes")


RUN_SQL = V.with_views("v_blocks", _MAPPED + " select doc_id, topic_no, subtopic_no, cast(seq as int) as seq, container, opens, closes from runs")


def shortdesc_first_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.short_descriptions(P.split_topics(_mapped(spark, sf_dir)))


SHORT_SQL = V.with_views("v_blocks", _MAPPED + " select doc_id, topic_no, shortdesc, cast(short_seq as int) as short_seq from short")

_TITLES = [(1, 1, "Kit Numbers & Descriptions"), (2, 3, ""), (3, 4, "— –"), (4, 5, "Ärger Über"), (5, 120, None)]


def topic_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.topic_types(P.split_topics(_mapped(spark, sf_dir))).select("doc_id", (F.col("topic_no") + 1).cast("int").alias("n"), F.col("file_title").alias("title"))
    return found.union(V.literal(spark, "doc_id long, n int, title string", _TITLES).select(-F.col("doc_id"), "n", "title")).select("doc_id", "n", T.topic_filename(F.col("title"), F.col("n")).alias("filename"))


_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'topic_' || case when {1} < 100 then lpad(cast({1} as varchar), 2, '0') else cast({1} as varchar) end) || '.dita'"
SLUG_SQL = V.with_views("v_blocks", V.values("extra", "doc_id long, n int, title string", _TITLES) + ", " + _MAPPED + f""", al as (select doc_id, cast(topic_no + 1 as int) as n, title from typed union all select -doc_id, n, title from extra)
select doc_id, n, {_SLUG.format("title", "n")} as filename from al""")  # fmt: skip


def dedup_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("seq"), F.concat(T.slug(F.col("p_name")), F.lit(".png")).alias("file"))
    return P.with_unique_names(part, "file", "seq").select("doc_id", "seq", "name")


DEDUP_SQL = """with f as (select p_partkey % 50 as doc_id, p_partkey as seq, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as stem from part),
r as (select *, row_number() over (partition by doc_id, stem order by seq) - 1 as n from f)
select doc_id, seq, stem || case when n = 0 then '' else '_' || n end || '.png' as name from r"""

_INLINE = [(-1, "Meteor__TM__reg__ system", False), (-2, "The Foo__TM__tm__", False), (-3, "__BOLD__Total", False), (-4, "__BOLD_START__ A __BOLD_END__ b", False), (-5, "a __ITALIC_START__ i __ITALIC_END__ z", True), (-6, "__BOLD_START__ x __ITALIC_START__ y __BOLD_END__ q__TM__reg__ r", False), (-7, "a < b & c", False), (-8, "", False), (-9, "A__TM__reg__B__TM__tm__", True)]


def inline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in lines of documents, put there by place, and in some written ones, as XML."""
    k = (F.col("doc_id") + F.col("line_no")) % 5
    marked = (
        F.when(k == 0, F.concat(F.lit("__BOLD_START__ "), "line", F.lit(" __BOLD_END__ end"))).when(k == 1, F.concat(F.lit("so __ITALIC_START__ "), "line", F.lit(" __ITALIC_END__")))
        .when(k == 2, F.concat("line", F.lit("__TM__reg__ it"))).when(k == 3, F.concat(F.lit("__BOLD__"), "line")).otherwise(F.col("line"))
    )
    found = V.lines(spark, sf_dir).select((F.col("doc_id") * 100_000 + F.col("line_no")).alias("id"), marked.alias("text"), (F.col("line_no") % 3 == 0).alias("bold"))
    return found.union(V.literal(spark, "id long, text string, bold boolean", _INLINE)).select("id", P.inline_xml(F.col("text"), F.col("bold")).alias("xml"))


INLINE_SQL = V.with_views("v_lines", V.values("fixed", "id long, text string, bold boolean", _INLINE) + r""",
al as (select doc_id * 100000 + line_no as id, case (doc_id + line_no) % 5 when 0 then '__BOLD_START__ ' || line || ' __BOLD_END__ end' when 1 then 'so __ITALIC_START__ ' || line || ' __ITALIC_END__'
    when 2 then line || '__TM__reg__ it' when 3 then '__BOLD__' || line else line end as text, line_no % 3 = 0 as bold from v_lines union all select * from fixed),
e as (select id, text, starts_with(text, '__BOLD__') or bold as w, replace(replace(replace(case when starts_with(text, '__BOLD__') then text[9:] else text end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t from al),
p as (select id, text, w, case when contains(t, '__BOLD_START__') then replace(replace(regexp_replace(t, '__ITALIC_(START|END)__\s*', '', 'g'), '__BOLD_START__', '<b>'), '__BOLD_END__', '</b>')
    when contains(t, '__ITALIC_START__') then replace(replace(regexp_replace(t, '__BOLD_(START|END)__\s*', '', 'g'), '__ITALIC_START__', '<i>'), '__ITALIC_END__', '</i>') else t end as t from e),
m as (select *, string_split(t, ' ') as ws from p),
n as (select id, text, w, array_to_string(list_transform(ws, lambda x: case when contains(x, '__TM__') then
    array_to_string(list_transform(regexp_extract_all(x, '.*?__TM__[a-z]+__'), lambda y: '<tm tmtype="' || regexp_extract(y, '__TM__([a-z]+)__', 1) || '">' || regexp_extract(y, '^(.*?)__TM__', 1) || '</tm>'), '') || regexp_replace(x, '^.*__TM__[a-z]+__', '') else x end), ' ') as marked, t from m)
select id, case when text = '' then '' when contains(text, '__BOLD_START__') then marked when contains(text, '__ITALIC_START__') then case when w then '<b>' || t || '</b>' else t end when w then '<b>' || marked || '</b>' else marked end as xml from n""")  # fmt: skip

_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_W = "case when {1} = '' then '<{0}/>' else '<{0}>' || {1} || '</{0}>' end"
_TABLE = r"""'<table frame="all"><tgroup cols="' || nc || '">' || array_to_string(list_transform(generate_series(1, nc), lambda i: '<colspec colname="col' || i || '" colnum="' || i || '"/>'), '')
  || '<thead>' || rx[1] || '</thead>' || case when len(rx) > 1 then '<tbody>' || array_to_string(rx[2:], '') || '</tbody>' else '' end || '</tgroup></table>'"""
_ENTRY = "case when {0} = '' then '<entry/>' else '<entry>' || {0} || '</entry>' end"
_ROWS = "list_transform(rows, lambda r: '<row>' || array_to_string(list_transform(r, lambda c: " + _ENTRY.format(_ESC.format("c")) + "), '') || repeat('<entry/>', cast(nc - len(r) as bigint)) || '</row>')"


def cals_table_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.table(spark, sf_dir, "lineitem")
    cells = F.when(F.col("l_quantity") > 25, F.array(F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus")).otherwise(F.array(F.col("l_linenumber").cast("string"), "l_returnflag"))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", cells.alias("cells")))).alias("w"))
    derived = rows.select(F.col("l_orderkey").alias("id"), F.col("w.cells").alias("rows"))
    fixed = V.literal(spark, "id long, rows array<array<string>>", [(-1, [["Group", "__STRADDLE__3", ""], ["A", "B", "C"], ["1", "2"]])])
    return derived.union(fixed).select("id", P.table_xml(F.col("rows")).alias("xml"))


_FIXED_TABLE = '<table frame="all"><tgroup cols="3"><colspec colname="col1" colnum="1"/><colspec colname="col2" colnum="2"/><colspec colname="col3" colnum="3"/><thead><row><entry namest="col1" nameend="col3">Group</entry></row></thead><tbody><row><entry>A</entry><entry>B</entry><entry>C</entry></row><row><entry>1</entry><entry>2</entry><entry/></row></tbody></tgroup></table>'
TABLE_SQL = f"""with c as (select l_orderkey as id, list(case when l_quantity > 25 then [cast(l_linenumber as varchar), l_returnflag, l_linestatus] else [cast(l_linenumber as varchar), l_returnflag] end order by l_linenumber, l_suppkey, l_partkey, l_returnflag, l_quantity > 25, l_linestatus) as rows from lineitem group by 1),
n as (select id, rows, list_max(list_transform(rows, lambda r: len(r))) as nc from c), x as (select id, nc, {_ROWS} as rx from n)
select id, {_TABLE} as xml from x union all select -1, '{_FIXED_TABLE}'"""

_RENDER = (
    _MAPPED
    + r""",
tabled as (select *, list_max(list_transform(rows, lambda r: len(r))) as nc from runs),
tabled2 as (select *, case when element = 'table' then """
    + _ROWS.replace("rows,", "rows,", 1)
    + r""" end as rx from tabled),
frag as (select *, case when opens then '<' || container || '>' else '' end || case
    when element = 'p' then """ + _W.format("p", _ESC.format("text"))
    + r""" when element = 'menucascade' then '<p><menucascade>' || array_to_string(list_transform(list_filter(list_transform(string_split(text, '>'), lambda s: trim(s)), lambda s: s <> ''), lambda s: '<uicontrol>' || """ + _ESC.format("s") + r""" || '</uicontrol>'), '') || '</menucascade></p>'
    when container = 'steps' then '<step>' || """ + _W.format("cmd", _ESC.format("text"))
    + r""" || '</step>' when container is not null then '<li>' || """ + _W.format("p", _ESC.format("text"))
    + r""" || '</li>' when element = 'note:note' then '<note type="note">' || """ + _W.format("p", _ESC.format("text"))
    + r""" || '</note>' when element = 'fig' then '<fig>' || """ + _W.format("title", _ESC.format("text"))
    + r""" || '<image href="" placement="inline"><alt>[IMAGE — ' || """ + _ESC.format("text")
    + r""" || ']</alt></image></fig>' when element = 'codeblock' then """ + _W.format("codeblock", _ESC.format("text"))
    + " when element = 'table' then " + _TABLE
    + r""" when element = 'sectiondiv_title' and shape = 'intro' then '<section>' || """ + _W.format("title", _ESC.format("text"))
    + r""" else '' end || case when closes then '</' || container || '>' else '' end as fragment from tabled2),
parts as (select doc_id, topic_no, subtopic_no, string_agg(fragment, '' order by seq) as inside, max(sub_type) as sub_type, min(text) filter (element = 'sectiondiv_title') as sub_title, max(shape) as shape from frag group by 1, 2, 3),
tagged as (select *, case sub_type when 'concept' then 'conbody' when 'task' then 'taskbody' when 'reference' then 'refbody' else 'body' end as b from parts),
pieces as (select doc_id, topic_no, subtopic_no, case when subtopic_no = 0 then inside when shape = 'intro' then inside || '</section>' else '' end as main,
    case when subtopic_no = 0 or shape = 'intro' then '' else '<' || sub_type || '>' || """ + _W.format("title", _ESC.format("sub_title"))
    + r""" || case when inside = '' then '<' || b || '/>' else '<' || b || '>' || inside || '</' || b || '>' end || case when shape = 'appendix' then '' else '</' || sub_type || '>' end end as after,
    case when subtopic_no > 0 and shape = 'appendix' then '</' || sub_type || '>' else '' end as fin from tagged),
whole as (select doc_id, topic_no, string_agg(main, '' order by subtopic_no) as main, string_agg(after, '' order by subtopic_no) as after, string_agg(fin, '' order by subtopic_no desc) as fin from pieces group by 1, 2),
out0 as (select h.doc_id, h.topic_no, h.title, h.topic_type, h.shape, h.shortdesc, coalesce(main, '') as main, coalesce(after, '') as after, coalesce(fin, '') as fin,
    case topic_type when 'concept' then 'conbody' when 'task' then 'taskbody' when 'reference' then 'refbody' else 'body' end as bt, case when shape = 'composite' then 'dita' else topic_type end as root,
    """ + _SLUG.format("h.title", "(h.topic_no + 1)")
    + r""" as stem from shaped h left join whole using (doc_id, topic_no)),
out1 as (select *, """ + _W.format("title", _ESC.format("title"))
    + r""" || case when shortdesc is null then '' else '<shortdesc>' || """ + _ESC.format("shortdesc")
    + r""" || '</shortdesc>' end || case when main = '' then '<' || bt || '/>' else '<' || bt || '>' || main || '</' || bt || '>' end as head,
    row_number() over (partition by doc_id, stem order by topic_no) - 1 as dup from out0),
topics_out as (select doc_id, topic_no, case when dup = 0 then stem else replace(stem, '.dita', '') || '_' || dup || '.dita' end as filename, topic_type, root, title,
  '<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || case root when 'dita' then '<!DOCTYPE dita PUBLIC "-//OASIS//DTD DITA 2.0 Composite//EN" "ditabase.dtd">'
    else '<!DOCTYPE ' || root || ' PUBLIC "-//OASIS//DTD DITA 2.0 ' || upper(root[1]) || root[2:] || '//EN" "' || root || '.dtd">' end || chr(10)
  || case when shape = 'composite' then '<dita xmlns="https://docs.oasis-open.org/dita/ns/2.0" xml:lang="en-US"><' || topic_type || ' xml:lang="en-US">' || head || '</' || topic_type || '>' || after || '</dita>'
    else '<' || topic_type || ' xmlns="https://docs.oasis-open.org/dita/ns/2.0" xml:lang="en-US">' || head || after || fin || '</' || topic_type || '>' end as xml from out1)"""
)


def render_topic_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.render(_mapped(spark, sf_dir))


RENDER_SQL = V.with_views("v_blocks", _RENDER + " select doc_id, topic_no, filename, topic_type, root, title, xml from topics_out")


def convert_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to lines, blocks, mapped elements, topics and their files."""
    found = P.render(_mapped(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_topics"), F.count_if(F.col("topic_type") == "task").alias("n_tasks"), F.sum(F.length("xml")).alias("n_chars"), F.countDistinct("filename").alias("n_files"))


CONVERT_SQL = V.with_views("v_blocks", _RENDER + " select doc_id, count(*) as n_topics, count(*) filter (topic_type = 'task') as n_tasks, cast(sum(length(xml)) as bigint) as n_chars, count(distinct filename) as n_files from topics_out group by 1")


def _map(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    topics = P.render(_mapped(spark, sf_dir))
    return P.maps(topics, F.concat(F.lit("Document & "), F.col("doc_id")), kind)


def ditamap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "map")


def bookmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "bookmap")


_MAP_HEAD = """'<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || '<!DOCTYPE {0} PUBLIC "-//OASIS//DTD DITA 2.0 {1}//EN" "{0}.dtd">' || chr(10) || '<{0} xmlns="https://docs.oasis-open.org/dita/ns/2.0" xml:lang="en-US">'"""
MAP_SQL = V.with_views("v_blocks", _RENDER + f""" select doc_id, 'map' as kind, {_MAP_HEAD.format("map", "Map")} || '<title>Document &amp; ' || doc_id || '</title>'
  || string_agg('<topicref href="' || filename || '" type="' || case when root = 'dita' then 'topic' else root end || '"/>', '' order by topic_no) || '</map>' as xml from topics_out group by doc_id""")  # fmt: skip
BOOK_SQL = V.with_views("v_blocks", _RENDER + f""" select doc_id, 'bookmap' as kind, {_MAP_HEAD.format("bookmap", "BookMap")} || '<booktitle><mainbooktitle>Document &amp; ' || doc_id || '</mainbooktitle></booktitle><bookmeta/>'
  || string_agg('<chapter href="' || filename || '"/>', '' order by topic_no) || '</bookmap>' as xml from topics_out group by doc_id""")  # fmt: skip

QUERIES = {f.__name__: f for f in (merge_split_h1, callout_reclass, note_triage, menucascade_split, figure_caption, doc_topic_type, topic_split_types, subtopic_types, list_run_containers, shortdesc_first_para, topic_slugs, dedup_slugs, inline_spans, cals_table_xml, render_topic_xml, convert_topics, ditamap, bookmap)}
ORACLES = dict(zip(QUERIES, (MERGE_SQL, CALLOUT_SQL, NOTE_SQL, PATH_SQL, CAPTION_SQL, DOC_TYPE_SQL, SPLIT_SQL, SUB_SQL, RUN_SQL, SHORT_SQL, SLUG_SQL, DEDUP_SQL, INLINE_SQL, TABLE_SQL, RENDER_SQL, CONVERT_SQL, MAP_SQL, BOOK_SQL), strict=True))
