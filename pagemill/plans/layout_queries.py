"""Queries of tables, figures, images, checks of XML, and configuration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagemill.functions import text as T
from pagemill.operators import figures as G
from pagemill.operators import images as I
from pagemill.operators import mapping as M
from pagemill.operators import tables as B
from pagemill.operators import topics as P
from pagemill.operators import validate as X

from . import views as V
from .topic_queries import _RENDER

_RULE = "doc_id long, page_no int, x0 double, x1 double, top double, bottom double"
_RULES = [(-1, 0, 72.0, 540.0, a, b) for a, b in ((100.0, 102.0), (120.0, 122.0), (300.0, 302.0), (140.0, 140.5), (160.0, 160.5))] + [(-2, 0, 72.0, 100.0, 1.0, 3.0)]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") * 20).alias("top")).agg(F.max("l_returnflag").alias("flag"))
    derived = items.select("doc_id", F.lit(0).alias("page_no"), F.lit(72.4).alias("x0"), F.lit(540.0).alias("x1"), "top", (F.col("top") + F.when(F.col("flag") == "A", 0.5).otherwise(2.0)).alias("bottom"))
    return derived.unionByName(V.literal(spark, _RULE, _RULES))


def rule_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rule_bands(_rules(spark, sf_dir)).drop("page_no")


CLUSTER_SQL = "with " + V.values("fixed", _RULE, _RULES) + """, it as (select l_orderkey as doc_id, l_quantity * 20 as top, max(l_returnflag) as f from lineitem group by 1, 2),
al as (select doc_id, 72.4::double as x0, 540.0::double as x1, top, top + case when f = 'A' then 0.5 else 2.0 end as bottom from it union all select doc_id, x0, x1, top, bottom from fixed),
k as (select doc_id, round_even(x0, 0) as gx0, round_even(x1, 0) as gx1, top, bottom, bottom - top >= 1.5 as thick from al where x1 - x0 > 50),
g as (select *, case when thick and top - lag(bottom) over (partition by doc_id, gx0, gx1, thick order by top, bottom) > 50 then 1 else 0 end as gap from k),
h as (select *, thick and sum(gap) over (partition by doc_id, gx0, gx1, thick order by top, bottom rows unbounded preceding) = 0 as head from g),
t as (select doc_id, gx0, gx1, max(bottom) filter (head) as hb, count(*) as n, count(*) filter (thick) as nt, count(*) filter (head) as nh,
    coalesce(arg_max(bottom, top) filter (not thick), arg_max(bottom, top) filter (thick and not head), max(bottom) filter (head) + 20) + 15 as e from h group by 1, 2, 3
  having count(*) >= 3 and count(*) filter (thick) >= 2 and count(*) filter (head) >= 2),
s as (select doc_id, gx0, gx1, top as y from h join t using (doc_id, gx0, gx1) where not thick and top > hb
  union all select doc_id, gx0, gx1, top from h where thick and not head union all select doc_id, gx0, gx1, bottom from h where thick and not head),
hd as (select doc_id, gx0, gx1, top, lead(bottom) over (partition by doc_id, gx0, gx1 order by top) as bottom from h where head),
ok as (select distinct doc_id, gx0, gx1 from s),
b as (select doc_id, gx0, gx1, 'header' as kind, top, bottom, 0 as o, row_number() over (partition by doc_id, gx0, gx1 order by top) as r from hd join t using (doc_id, gx0, gx1) where bottom is not null
  union all select doc_id, gx0, gx1, 'data', y, coalesce(lead(y) over (partition by doc_id, gx0, gx1 order by o, y), e), 1, row_number() over (partition by doc_id, gx0, gx1 order by o, y)
    from (select doc_id, gx0, gx1, y, 1 as o from s union all select doc_id, gx0, gx1, hb, 0 from t) join t using (doc_id, gx0, gx1))
select doc_id, gx0, gx1, cast(row_number() over (partition by doc_id, gx0, gx1 order by o, r) - 1 as int) as band_no, kind, top, bottom from b join ok using (doc_id, gx0, gx1)"""

_HEAD = [(-1, 0, 90.0 + 0.0, 500.0, a, b, t) for a, b, t in ((100.0, 140.0, "a"), (200.0, 260.0, "b"), (265.0, 300.0, "c"), (420.0, 470.0, "d"))]
_HEAD_SCHEMA = "doc_id long, line_no int, tx0 double, tx1 double, x0 double, x1 double, text string"


def _table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a table's row: words keep their left edge and half of their width."""
    words = V.words(spark, sf_dir)
    derived = words.select("doc_id", "line_no", F.lit(0.0).alias("tx0"), F.lit(600.0).alias("tx1"), "x0", ((F.col("x0") + F.col("x1")) / 2).alias("x1"), "text", "fontname")
    return derived.unionByName(V.literal(spark, _HEAD_SCHEMA, _HEAD).withColumn("fontname", F.lit("ArialMT")))


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.column_breaks(_table_words(spark, sf_dir), ["doc_id", "line_no"], F.col("tx0"), F.col("tx1"))


def col_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(spark, sf_dir).select("doc_id", "line_no", F.size("breaks").alias("n"), F.array_join(F.transform("breaks", lambda b: F.format_number(b, 1)), " ").alias("breaks"))


_BREAKS = V.values("fixed", _HEAD_SCHEMA, _HEAD) + """, tw as (select doc_id, cast(line_no as int) as line_no, 0.0::double as tx0, 600.0::double as tx1, x0, (x0 + x1) / 2 as x1, text, fontname from v_words union all select *, 'ArialMT' from fixed),
sp as (select doc_id, line_no, tx0, tx1, greatest(0, cast(round_even(x0 - tx0, 0) as bigint)) as lo, least(cast(floor(tx1 - tx0) as bigint) + 1, cast(round_even(x1 - tx0, 0) as bigint)) as hi from tw),
so as (select *, coalesce(max(hi + 1) over (partition by doc_id, line_no order by lo, hi rows between unbounded preceding and 1 preceding), 0) as cov from sp where lo <= hi),
md as (select doc_id, line_no, tx0, tx1, list([tx0 + cov + (lo - cov) / 2] order by lo, hi) filter (lo - cov >= 7) as ms from so group by 1, 2, 3, 4),
br as (select doc_id, line_no, list_append(case when ms is null then [tx0] else list_reduce(list_prepend([tx0], ms), lambda acc, x: case when x[1] - acc[len(acc)] > 15 then list_concat(acc, x) else acc end) end, tx1 + 10) as breaks from md)"""
BREAK_SQL = V.with_views("v_words", _BREAKS + " select doc_id, line_no, cast(len(breaks) as int) as n, array_to_string(list_transform(breaks, lambda b: printf('%.1f', b)), ' ') as breaks from br")


def cell_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cells(_table_words(spark, sf_dir), _breaks(spark, sf_dir), ["doc_id", "line_no"])


CELL_SQL = V.with_views("v_words", _BREAKS + """, pl as (select w.doc_id, w.line_no, w.x0, w.text, contains(w.fontname, 'Bold') as bold,
    coalesce(list_filter(range(0, len(breaks) - 1), lambda i: breaks[i + 1] - 2 <= x0 and x0 < breaks[i + 2])[1], len(breaks) - 2) as c from tw w join br using (doc_id, line_no))
select doc_id, line_no, cast(c as int) as "column", case when bool_or(bold) then '__BOLD__' else '' end || string_agg(text, ' ' order by x0, text) as text from pl group by 1, 2, 3""")  # fmt: skip



def straddle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table_words(spark, sf_dir).groupBy("doc_id", "line_no").agg(F.collect_list(F.struct((F.col("x0") + F.length("text") * 4).alias("x0"), "text")).alias("words"))
    return B.straddles(words.join(_breaks(spark, sf_dir), ["doc_id", "line_no"])).select("doc_id", "line_no", "n_columns", "straddles", "text")


STRADDLE_SQL = V.with_views("v_words", _BREAKS + """, m as (select doc_id, line_no, min(x0 + length(text) * 4) as lx, string_agg(text, ' ' order by x0 + length(text) * 4, text) as text from tw group by 1, 2)
select doc_id, line_no, cast(len(breaks) - 1 as int) as n_columns, len(breaks) > 2 and lx > breaks[1] + (breaks[2] - breaks[1]) * 0.5 as straddles, text from m join br using (doc_id, line_no)""")  # fmt: skip


def _line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.lines(spark, sf_dir)
    k = F.expr("cast((doc_id * 31 + line_no * 17) % 20 as int)")
    top = F.lit(14.3) * (F.col("line_no") % 50) + F.when(F.col("line_no") % 3 == 0, F.lit(0.0)).otherwise(F.lit(40.0))
    return found.select("doc_id", F.expr("cast(line_no div 50 as int)").alias("page_no"), F.col("line_no").alias("seq"), k.alias("k"), top.alias("y0"), (top + 9).alias("y1"))


def table_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected tables that no table already known overlaps, and that look like tables."""
    lines = _line_places(spark, sf_dir)
    row = F.array(F.array(F.lit("a"), F.col("k").cast("string")), F.array(F.lit("b"), F.lit("c")))
    tables = lines.where("k between 8 and 12").select("doc_id", "page_no", "seq", F.col("y0").alias("top"), (F.col("y0") + F.col("k") * 60).alias("bottom"), F.lit(720.0).alias("height"), row.alias("rows"))
    known = lines.where("k = 2").select("doc_id", "page_no", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    return B.plausible(B.outside_tables(tables, known)).select("doc_id", "page_no", "seq", "top", "bottom")


_PLACES = """lp as (select doc_id, cast(line_no // 50 as int) as page_no, cast(line_no as int) as seq, (doc_id * 31 + line_no * 17) % 20 as k, 14.3::double * (line_no % 50) + case when line_no % 3 = 0 then 0.0 else 40.0 end as y0 from v_lines)"""
CONFLICT_SQL = V.with_views("v_lines", _PLACES + """, t as (select *, y0 as top, y0 + k * 60 as bottom from lp where k between 8 and 12)
select doc_id, page_no, seq, top, bottom from t where bottom - top <= 720 * 0.7
  and not exists (select 1 from lp n where n.k = 2 and n.doc_id = t.doc_id and n.page_no = t.page_no and t.top between n.y0 - 20 and n.y0 + 9 + 20)""")  # fmt: skip


def figure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _line_places(spark, sf_dir)
    extents = lines.select("doc_id", "page_no", "seq", "y0", "y1")
    captions = lines.where("k in (13, 14)").select("doc_id", "page_no", F.col("seq").alias("fig_no"), (F.col("y0") + 3).alias("top"))
    captions = captions.unionByName(V.literal(spark, "doc_id long, page_no int, fig_no int, top double", [(-1, 0, 0, 301.0)]))
    extents = extents.unionByName(V.literal(spark, "doc_id long, page_no int, seq int, y0 double, y1 double", [(-1, 0, 0, 80.0, 120.0), (-1, 0, 1, 300.0, 312.0), (-1, 0, 2, 500.0, 520.0)]))
    found = G.figure_gaps(captions.withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0)), extents)
    return found.select("doc_id", "page_no", "fig_no", "side", "x0", F.round("y0", 4).alias("y0"), "x1", F.round("y1", 4).alias("y1"))


GAP_SQL = V.with_views("v_lines", _PLACES + """, ex as (select doc_id, page_no, seq, y0, y0 + 9 as y1 from lp union all select * from (values (-1, 0, 0, 80.0, 120.0), (-1, 0, 1, 300.0, 312.0), (-1, 0, 2, 500.0, 520.0)) v),
cp as (select doc_id, page_no, seq as f, y0 + 3 as top from lp where k in (13, 14) union all select -1, 0, 0, 301.0),
ow as (select c.doc_id, c.page_no, c.f, arg_min(e.y0, e.seq) as o0, arg_min(e.y1, e.seq) as o1 from cp c join ex e on e.doc_id = c.doc_id and e.page_no = c.page_no and abs(e.y0 - c.top) < 10 group by 1, 2, 3),
pl as (select cp.*, coalesce(o0, top) as c0, coalesce(o1, top + 15) as c1 from cp left join ow using (doc_id, page_no, f)),
tr as (select *, coalesce(lag(c1) over w + 2, 0.0) as t0, coalesce(lead(c0) over w - 2, 792.0) as t1 from pl window w as (partition by doc_id, page_no order by top, f)),
gp as (select tr.doc_id, tr.page_no, f, c0, c1, coalesce(max(e.y1) filter (e.y1 >= t0 and e.y1 < c0 - 3), any_value(t0)) as ab, coalesce(min(e.y0) filter (e.y0 > c1 + 3 and e.y0 <= t1), any_value(t1)) as be
  from tr left join ex e on e.doc_id = tr.doc_id and e.page_no = tr.page_no group by 1, 2, 3, 4, 5),
sd as (select *, case when c0 - ab >= be - c1 and c0 - ab >= 20 then 'above' when be - c1 >= c0 - ab and be - c1 >= 20 then 'below' end as side from gp)
select doc_id, page_no, f as fig_no, side, 54.0::double as x0, round(case side when 'above' then ab + 2 else c1 + 2 end, 4)::double as y0, 558.0::double as x1, round(case side when 'above' then c0 - 2 else be - 2 end, 4)::double as y1 from sd where side is not null""")  # fmt: skip


def fit_scale_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = V.literal(spark, "preset string, to_w int, to_h int", [(k, *v) for k, v in G.PRESETS.items()])
    part = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("w"), ((F.col("p_partkey") % 50) * 29 + 1).alias("h"))
    found = part.join(F.broadcast(presets)).withColumn("s", G.fit(F.col("w"), F.col("h"), F.col("to_w"), F.col("to_h")))
    return found.select("p_partkey", "preset", F.col("s.w").alias("w"), F.col("s.h").alias("h"))


FIT_SQL = """with pr(preset, tw, th) as (values ('Portrait full', 648, 864), ('Portrait inset', 600, 864), ('Landscape full', 912, 576), ('Landscape inset', 864, 576)),
p as (select p_partkey, p_size * 37 + 1 as w, (p_partkey % 50) * 29 + 1 as h from part),
f as (select *, cast(floor(h * (tw::double / w)) as bigint) as nh from p, pr)
select p_partkey, preset, case when nh > th then cast(floor(w * (th::double / h)) as bigint) else cast(tw as bigint) end as w, case when nh > th then cast(th as bigint) else nh end as h from f"""


def canvas_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 50 + 1).cast("int").alias("h"))
    crop = G.cropped(F.col("w"), F.col("h"), F.lit(2), F.lit(30), F.lit(0), F.lit(10))
    return part.select("p_partkey", G.canvas(F.col("w"), F.lit(5), F.lit(2)).alias("canvas_w"), G.canvas(F.col("h"), F.lit(5), F.lit(2)).alias("canvas_h"), crop["x0"].alias("x0"), crop["y0"].alias("y0"), crop["x1"].alias("x1"), crop["y1"].alias("y1"))


CANVAS_SQL = """select p_partkey, p_size + 14 as canvas_w, cast(p_partkey % 50 + 15 as int) as canvas_h, 0 as x0, 2 as y0, greatest(1, p_size - 10) as x1, greatest(3, cast(p_partkey % 50 + 1 as int) - 30) as y1 from part"""


def ahash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average hashes of 8 by 8 grids, and their distance from that of the least id."""
    found = V.table(spark, sf_dir, "embeddings").select("vec_id", G.average_hash(F.col("embedding")).alias("hash"))
    first = found.agg(F.min(F.struct("vec_id", "hash"))["hash"].alias("first"))
    return found.join(F.broadcast(first)).select("vec_id", "hash", G.hash_distance(F.col("hash"), F.col("first")).alias("distance"))


HASH_SQL = """with w as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
h as (select vec_id, array_to_string(list_transform(v, lambda x: case when x >= list_reduce(v, lambda a, b: a + b) / len(v) then '1' else '0' end), '') as hash from w),
f as (select arg_min(hash, vec_id) as first from h)
select vec_id, hash, cast(len(list_filter(range(1, 65), lambda i: hash[i] <> first[i])) as int) as distance from h, f"""


def color_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = V.table(spark, sf_dir, "embeddings")
    byte = lambda i: F.floor(F.abs(F.get("embedding", i).cast("double")) * 60).cast("int") + 100
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(byte(i * 3).alias("r"), byte(i * 3 + 1).alias("g"), byte(i * 3 + 2).alias("b")))
    return vectors.select("vec_id", G.colour_mode(pixels).alias("mode"))


MODE_SQL = """with p as (select vec_id, list_transform(range(0, 21), lambda i: [cast(floor(abs(embedding[i * 3 + 1]::double) * 60) as int), cast(floor(abs(embedding[i * 3 + 2]::double) * 60) as int), cast(floor(abs(embedding[i * 3 + 3]::double) * 60) as int)]) as px from embeddings)
select vec_id, case when len(list_filter(px, lambda p: p[3] > p[1] + 20 and p[3] > p[2] + 20)) / 21 > 0.02 then 'blue'
  when len(list_filter(px, lambda p: abs(p[1] - p[2]) > 14 or abs(p[2] - p[3]) > 14 or abs(p[1] - p[3]) > 14)) / 21 > 0.04 then 'color' else 'monochrome' end as mode from p"""

_COLOURS = [(-1, "#fff"), (-2, "#1a2B3c"), (-3, "000000"), (-4, "#0f8")]


def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in hex, one for each part and some written in other ways, as numbers."""
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")).alias("hex"))
    c = G.rgb(F.col("hex"))
    return part.union(V.literal(spark, "id long, hex string", _COLOURS)).select("id", c[0].alias("r"), c[1].alias("g"), c[2].alias("b"))


COLOUR_SQL = "with " + V.values("x", "id long, hex string", _COLOURS) + """, al as (select cast(p_partkey as bigint) as id, printf('%06x', p_partkey * 7919 % 16777216) as h from part union all select id, lower(replace(hex, '#', '')) from x),
six as (select id, case when length(h) = 3 then h[1] || h[1] || h[2] || h[2] || h[3] || h[3] else h end as h from al),
n as (select id, list_transform(range(1, 7), lambda i: instr('0123456789abcdef', h[i]) - 1) as d from six)
select id, cast(d[1] * 16 + d[2] as int) as r, cast(d[3] * 16 + d[4] as int) as g, cast(d[5] * 16 + d[6] as int) as b from n"""


def settings_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options read from JSON text with a schema; what is missing takes its default."""
    options = F.from_json("props", "k int, format string, padding int, border int")
    found = V.table(spark, sf_dir, "events").select("event_id", options.alias("o"))
    return found.select("event_id", F.coalesce("o.k", F.lit(-1)).alias("k"), F.coalesce("o.format", F.lit("png")).alias("format"), F.coalesce("o.padding", F.lit(5)).alias("padding"), F.coalesce("o.border", F.lit(2)).alias("border"))


SETTINGS_SQL = """select event_id, coalesce(cast(json_extract_string(props, '$.k') as int), -1) as k, coalesce(json_extract_string(props, '$.format'), 'png') as format, coalesce(cast(json_extract_string(props, '$.padding') as int), 5) as padding, coalesce(cast(json_extract_string(props, '$.border') as int), 2) as border from events"""


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.render(M.map_blocks(V.blocks(spark, sf_dir)))


_NS = 'xmlns="https://docs.oasis-open.org/dita/ns/2.0"'
_XML = [
    (-1, 0, "<concept><title>x</concept>"), (-1, 1, f"<concept {_NS}><conbody/></concept>"), (-1, 2, "<foo/>"), (-1, 3, f"<concept {_NS}><title> </title></concept>"),
    (-1, 4, f'<task {_NS}><title>t</title><taskbody><steps><step/></steps><note/><table><tgroup cols="1"/></table><section><title>s</title></section></taskbody></task>'),
]
_XML_OUT = [(-1, 0, False, 1, 0), (-1, 1, True, 1, 0), (-1, 2, True, 2, 0), (-1, 3, True, 0, 1), (-1, 4, True, 0, 4)]


def validate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _topics(spark, sf_dir).select("doc_id", "topic_no", "xml").unionByName(V.literal(spark, "doc_id long, topic_no int, xml string", _XML))
    return X.validate(found).select("doc_id", "topic_no", "is_valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


VALIDATE_SQL = V.with_views("v_blocks", V.values("fixed", "doc_id long, topic_no long, is_valid boolean, n_errors int, n_warnings int", _XML_OUT) + ", " + _RENDER + " select doc_id, topic_no, true as is_valid, 0 as n_errors, case when trim(title) = '' then 1 else 0 end as n_warnings from topics_out union all select * from fixed")


def content_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.inventory(_topics(spark, sf_dir))


_COUNT = ", ".join(f"len(regexp_extract_all(xml, '<{tag}[ >/]')) as {name}" for tag, name in (("section", "sections"), ("note", "notes"), ("step", "steps"), ("table", "tables"), ("fig", "figures")))
_INVENTORY = _RENDER + f""", inv as (select doc_id, topic_no, {_COUNT}, len(regexp_extract_all(regexp_replace(string_split(xml, chr(10))[3:].array_to_string(chr(10)), '<[^>]*>', ' ', 'g'), '\\S+')) as words from topics_out)"""
INVENTORY_SQL = V.with_views("v_blocks", _INVENTORY + " select * from inv")


def doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.rollup(X.inventory(_topics(spark, sf_dir)))
    return found.fillna(-1, ["doc_id", "topic_no"])


ROLLUP_SQL = V.with_views("v_blocks", _INVENTORY + """ select coalesce(doc_id, -1) as doc_id, coalesce(topic_no, -1) as topic_no, cast(grouping(doc_id, topic_no) as bigint) as level, count(*) as n_topics, cast(sum(sections) as bigint) as sections, cast(sum(notes) as bigint) as notes,
  cast(sum(steps) as bigint) as steps, cast(sum(tables) as bigint) as tables, cast(sum(figures) as bigint) as figures, cast(sum(words) as bigint) as words from inv group by rollup (inv.doc_id, inv.topic_no)""")  # fmt: skip


def strip_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _topics(spark, sf_dir)
    return found.select("doc_id", "topic_no", X.strip_declaration(F.col("xml")).alias("body"), F.length(X.preview(F.col("xml"))).alias("n_preview"))


STRIP_SQL = V.with_views("v_blocks", _RENDER + " select doc_id, topic_no, array_to_string(string_split(xml, chr(10))[3:], chr(10)) as body, cast(case when length(xml) > 50000 then 50000 + 19 else length(xml) end as int) as n_preview from topics_out")


def validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.report(X.validate(_topics(spark, sf_dir), "filename", *[c.alias(name) for name, c in X.counts().items()]))


_LABELS = (("Sections", "sections"), ("Notes", "notes"), ("Steps", "steps"), ("Tables", "tables"), ("Figures", "figures"), ("Word count", "words"))
REPORT_SQL = V.with_views("v_blocks", _INVENTORY + """ select doc_id, topic_no, '╔' || repeat('═', 60) || '╗' || chr(10) || '║' || rpad('  File: ' || filename, 60, ' ') || '║' || chr(10) || '╚' || repeat('═', 60) || '╝' || chr(10) || chr(10)
  || '  Status : VALID' || chr(10) || '  Errors : 0' || chr(10) || '  Warnings: ' || case when trim(title) = '' then 1 else 0 end || chr(10) || repeat('─', 60) || chr(10) || """
  + " || chr(10) || ".join(f"'{('  ' + a).ljust(14)}: ' || {b}" for a, b in _LABELS) + """ || chr(10) || repeat('─', 60) || chr(10) || case when trim(title) = '' then '  ⚠ The topic''s <title> is empty.' else '  No issues found.' end as report
  from topics_out join inv using (doc_id, topic_no)""")  # fmt: skip

_NAMES = [(-1, "kit-numbers_v24a.docx"), (-2, "it's a_test.pdf"), (-3, "PLAIN"), (-4, "über-maß.PDF")]


def map_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from file names: those of parts, with dashes, underscores and endings, and some written ones."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "_").otherwise("-")), F.lit("_v"), F.col("p_size"), F.lit("a.docx"))
    files = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), name.alias("name"))
    return files.union(V.literal(spark, "id long, name string", _NAMES)).select("id", T.map_title(F.col("name")).alias("title"))


MAP_TITLE_SQL = "with " + V.values("x", "id long, name string", _NAMES) + r""", al as (
  select cast(p_partkey as bigint) as id, replace(p_name, ' ', case when p_partkey % 2 = 0 then '_' else '-' end) || '_v' || p_size || 'a.docx' as name from part union all select id, name from x),
st as (select id, string_split(lower(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[_-]', ' ', 'g')), '') as c from al)
select id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: case when i = 1 or not regexp_matches(c[i - 1], '\p{L}') then upper(c[i]) else c[i] end), '') as title from st"""


def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each type and list kind, from documents and from conversations read as blocks."""
    turns = V.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "list_item").otherwise("note_header")
    talk = turns.select((-F.col("conv_id") - 1).alias("doc_id"), kind.alias("type"), F.when(F.col("role") == "assistant", "bullet").alias("list_kind"))
    return V.blocks(spark, sf_dir).select("doc_id", "type", "list_kind").union(talk).groupBy("type", "list_kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


COUNT_SQL = V.with_views("v_blocks", """al as (select doc_id, type, list_kind from v_blocks union all
  select -conv_id - 1, case role when 'user' then 'paragraph' when 'assistant' then 'list_item' else 'note_header' end, case role when 'assistant' then 'bullet' end from conversations)
select type, list_kind, count(*) as n, count(distinct doc_id) as n_docs from al group by 1, 2""")  # fmt: skip


def png_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey PNGs of 8 pixels a row, scaled, padded, bordered; sizes and a digest."""
    @F.pandas_udf(BinaryType())
    def png(values: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> bytes:
            grey = np.clip(np.abs(np.nan_to_num(np.array(v, dtype=float))) * 500, 0, 255).astype(np.uint8)
            return I.write_png(np.pad(grey, (0, -len(grey) % 8), constant_values=255).reshape(-1, 8, 1))

        return values.map(one)

    images = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("id"), png("embedding").alias("content"))
    bad = V.literal(spark, "id long", [(-1,)]).select("id", F.lit(b"not an image").alias("content"))
    found = I.process_images(images.union(bad), padding=5, border=2, width=32, height=20)
    return found.select("id", "w", "h", "error", F.length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (rule_clusters, col_breaks, cell_assembly, straddle_rows, table_conflicts, figure_gaps, fit_scale_dims, canvas_dims, ahash_distance, color_mode, hex_colours, settings_from_json, validate_structure, content_inventory, doc_rollup, strip_declarations, validation_reports, map_titles, block_type_counts, png_pipeline)}
ORACLES = {
    "rule_clusters": CLUSTER_SQL, "col_breaks": BREAK_SQL, "cell_assembly": CELL_SQL, "straddle_rows": STRADDLE_SQL, "table_conflicts": CONFLICT_SQL, "figure_gaps": GAP_SQL, "fit_scale_dims": FIT_SQL,
    "canvas_dims": CANVAS_SQL, "ahash_distance": HASH_SQL, "color_mode": MODE_SQL, "hex_colours": COLOUR_SQL, "settings_from_json": SETTINGS_SQL, "validate_structure": VALIDATE_SQL, "content_inventory": INVENTORY_SQL,
    "doc_rollup": ROLLUP_SQL, "strip_declarations": STRIP_SQL, "validation_reports": REPORT_SQL, "map_titles": MAP_TITLE_SQL, "block_type_counts": COUNT_SQL,
}
