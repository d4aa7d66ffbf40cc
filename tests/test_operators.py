"""Edge cases that the stored tables don't hold."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions import text as T
from pagemill.operators import figures, images, lines, mapping, pages, quality, tables, topics, validate
from pagemill.plans import line_queries, page_queries, views
from pagemill.sources import docx, rules, schemas, sinks
from pagemill.streaming import arrivals

BLOCK = schemas.SCHEMAS["blocks"]


def block(doc, seq, kind, text, level=0, list_kind=None, note=None, rows=None):
    return (doc, seq, kind, level, list_kind, note, text, rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], BLOCK)
    assert topics.render(mapping.map_blocks(none)).count() == 0
    assert mapping.document_types(none).count() == 0
    assert lines.merge_paragraphs(spark.createDataFrame([], "doc_id long, page_no int, seq int, type string, text string")).count() == 0


def test_null_text_is_blank_and_dropped(spark):
    row = spark.createDataFrame([(None,)], "t string").select(T.should_drop("t" and F.col("t")), T.is_blank_page(F.col("t")), T.normalize(F.col("t")), T.escape(F.col("t"))).head()
    assert tuple(row) == (True, True, "", "")


def test_rendered_topics_are_well_formed_xml(spark):
    found = [
        block(1, 0, "heading", "Introduction & more", 1), block(1, 1, "paragraph", "a < b"), block(1, 2, "heading", "Sub", 2), block(1, 3, "list_item", "x", 0, "bullet"), block(1, 4, "list_item", "y", 0, "bullet"),
        block(1, 5, "table", "", rows=[["H", "__STRADDLE__2"], ["1"]]), block(1, 6, "heading", "Appendix A", 1), block(1, 7, "table", "", rows=[["a"]]), block(1, 8, "heading", "One", 2), block(1, 9, "list_item", "s", 0, "numbered"),
        block(1, 10, "list_item", "t", 0, "numbered"), block(1, 11, "heading", "Two", 3), block(1, 12, "note_inline", "Note: see"), block(1, 13, "figure", "Figure 1: f"), block(1, 14, "code_block", "$ ls"), block(1, 15, "note_header", "Hot", note="danger"),
    ]
    done = topics.render(mapping.map_blocks(spark.createDataFrame(found, BLOCK))).orderBy("topic_no").collect()
    assert [r.root for r in done] == ["concept", "reference"] or [r.root for r in done][1] == "reference"
    for r in done:
        ElementTree.fromstring(r.xml.split("\n", 2)[2])
        assert validate.findings(r.xml)[0]
    nested = ElementTree.fromstring(done[1].xml.split("\n", 2)[2])
    ns = f"{{{topics.NAMESPACE}}}"
    assert [x.tag for x in nested] == [f"{ns}title", f"{ns}refbody", f"{ns}task"]
    assert [x.tag for x in nested[2]][-1] == f"{ns}topic" or len(nested[2]) >= 3


def test_document_without_title_is_untitled(spark):
    done = topics.render(mapping.map_blocks(spark.createDataFrame([block(1, 0, "paragraph", "lost")], BLOCK))).head()
    assert done.title == topics.UNTITLED and done.filename == "topic_01.dita" and "lost" not in done.xml


def test_repeated_titles_get_their_own_files(spark):
    found = [block(1, 0, "heading", "A", 1), block(1, 1, "paragraph", "p"), block(1, 2, "heading", "A", 1), block(1, 3, "paragraph", "q"), block(1, 4, "heading", "A", 1)]
    done = topics.render(mapping.map_blocks(spark.createDataFrame(found, BLOCK)))
    assert sorted(r.filename for r in done.collect()) == ["a.dita", "a_1.dita", "a_2.dita"]
    with zipfile.ZipFile(io.BytesIO(sinks.archives(done).head().content)) as file:
        assert sorted(file.namelist()) == ["a.dita", "a_1.dita", "a_2.dita", "document.ditamap"]


def test_unknown_block_type_is_refused(spark):
    with pytest.raises(Exception, match="unknown block type"):
        schemas.checked_blocks(spark.createDataFrame([block(1, 0, "poem", "x")], BLOCK)).collect()


def test_rule_lines_union(spark):
    found = schemas.rule_lines(spark.createDataFrame([(1, 0, "rect", 0.0, 5.0, 1.0, 2.0, None), (1, 0, "line", 0.0, 60.0, 3.0, 3.0, None), (1, 0, "line", 0.0, 50.0, 4.0, 4.0, 1.0)], schemas.SCHEMAS["page_rules"]))
    assert sorted((r.top, r.bottom) for r in found.collect()) == [(1.0, 2.0), (3.0, 3.5)]


def test_mapping_rules_need_their_keys(tmp_path):
    (tmp_path / "a.yaml").write_text("heading_map: {}\n")
    with pytest.raises(ValueError, match="paragraph_map"):
        rules.load_mapping(str(tmp_path / "a.yaml"))
    assert rules.load_quality(str(tmp_path / "none.yaml")) == {}


def test_overall_status_orders_statuses(spark):
    found = spark.createDataFrame([(1, "a", "pass"), (1, "b", "warn"), (1, "c", "not_checked"), (2, "a", "pass"), (2, "b", "not_checked"), (3, "a", "fail"), (3, "b", "pass")], "doc_id long, check_id string, status string")
    assert {r.doc_id: r.status for r in quality.overall(found).collect()} == {1: "warn", 2: "not_checked", 3: "fail"}


def test_png_round_trip_and_crop():
    pixels = np.full((20, 30, 3), 255, np.uint8)
    pixels[8:12, 10:20] = 0
    assert (images.read_png(images.write_png(pixels)) == pixels).all()
    assert images.read_png(images.process(images.write_png(pixels), crop=True)).shape == (12, 18, 4)
    assert images.process(images.write_png(pixels)) == images.write_png(pixels)
    assert not images.dark_margin(images.write_png(pixels), "left")
    bar = np.full((100, 100, 1), 255, np.uint8)
    bar[:, :3] = 0
    assert images.dark_margin(images.write_png(bar), "left") and not images.dark_margin(images.write_png(bar), "right")


def test_presets_fit(spark):
    row = spark.range(1).select(figures.fit(F.lit(1000), F.lit(500), F.lit(648), F.lit(864)).alias("a"), figures.fit(F.lit(500), F.lit(1000), F.lit(648), F.lit(864)).alias("b")).head()
    assert (row.a.w, row.a.h, row.b.w, row.b.h) == (648, 324, 432, 864)


def test_arrivals_equal_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.docx").write_bytes(docx.write_docx([("Heading 1", f"Guide {k}"), ("", "Some body text."), ("List Number", "one"), ("List Number", "two")]))
    arrivals.convert_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = arrivals.convert_folder(spark, str(folder))
    assert sorted(r.xml for r in streamed.collect()) == sorted(r.xml for r in batch.collect()) and streamed.count() == 3
    again = sinks.save_files(batch.select("filename", F.col("xml").alias("content")).withColumnRenamed("filename", "name"), f"file://{tmp_path}/files")
    assert again == 3 and len(list((tmp_path / "files").iterdir())) == 3


def test_marks_of_two_documents_on_one_page_stay_apart(spark):
    marks = spark.createDataFrame([(1, 3, 10, 100), (2, 3, 11, 102), (2, 3, 12, 400)], "doc_id long, page_no int, id long, y long")
    numbered = lines.number_sessions(marks)
    assert sorted((r.doc_id, r.y, r.number) for r in numbered.collect()) == [(1, 100, 1), (2, 102, 1), (2, 400, 1)]
    places = spark.createDataFrame([(1, 3, 1, 101, "paragraph", None), (2, 3, 2, 101, "paragraph", None), (3, 3, 3, 101, "paragraph", None), (2, 3, 4, 101, "heading", None)], "doc_id long, page_no int, id long, y long, type string, list_kind string")
    found = {r.id: (r.type, r.list_kind, r.num) for r in lines.number_steps(places, numbered).collect()}
    assert found == {1: ("list_item", "numbered", 1), 2: ("list_item", "numbered", 1), 3: ("paragraph", None, None), 4: ("heading", None, None)}
    links = marks.withColumn("uri", F.concat(F.lit("u"), "doc_id"))
    assert {r.id: r.href for r in lines.attach_links(places, links).collect()} == {1: "u1", 2: "u2", 3: None, 4: None}


def test_paragraphs_show_links_marks_and_paths(spark):
    rows = [
        (1, 0, "heading", 1, None, None, "T", None, None, None), (1, 1, "paragraph", 0, None, None, "short", None, None, None),
        (1, 2, "paragraph", 0, None, None, "write to me", None, "write __BOLD_START__ to __BOLD_END__ me", "mailto:a@b.c"), (1, 3, "paragraph", 0, None, None, "see > it", None, None, "https://x.y/?a=1&b=2"),
        (1, 4, "paragraph", 0, None, None, "Choose File > Save now", None, "Choose __BOLD_START__ File > Save __BOLD_END__ now", None),
    ]
    blocks = spark.createDataFrame(rows, BLOCK + ", marked string, href string")
    xml = topics.render(mapping.split_paths(mapping.map_blocks(blocks))).head().xml
    assert '<p><xref href="mailto:a@b.c" scope="external" format="email"/>write <b> to </b> me</p>' in xml
    assert "<p>Choose</p><p><menucascade><uicontrol>File</uicontrol><uicontrol>Save</uicontrol></menucascade></p>" in xml
    assert '<shortdesc>short</shortdesc>' in xml
    ElementTree.fromstring(xml.split("\n", 2)[2])
    page = pages.badge(F.col("xml"))
    assert spark.createDataFrame([(xml,), ("<task><title/></task>",), ("<task>",)], "xml string").select(page).collect()[1:] == [("task",), ("topic",)]


def test_tables_by_rules_span_heads_and_retry_columns(spark):
    rules = [(1, 0, 0.0, 520.0, float(t), t + (2.0 if t <= 140 else 0.5)) for t in (100, 120, 140, 160, 180)]
    words = [
        (1, 0, 0, "Whole", 300.0, 340.0, 105.0, "ArialMT", 11.0), (1, 0, 1, "A", 10.0, 70.0, 125.0, "ArialMT", 11.0), (1, 0, 2, "B", 110.0, 170.0, 125.0, "Arial-BoldMT", 11.0),
        (1, 0, 3, "x", 10.0, 70.0, 145.0, "ArialMT", 11.0), (1, 0, 4, "®", 72.0, 75.0, 145.0, "ArialMT", 5.0), (1, 0, 5, "y", 110.0, 170.0, 145.0, "ArialMT", 11.0), (1, 0, 6, "far", 10.0, 70.0, 400.0, "ArialMT", 11.0),
    ]
    w = spark.createDataFrame(words, "doc_id long, page_no int, word_seq int, text string, x0 double, x1 double, top double, fontname string, size double")
    r = spark.createDataFrame(rules, "doc_id long, page_no int, x0 double, x1 double, top double, bottom double")
    assert tables.borderless(w, r).head().rows == [["Whole", "__STRADDLE__2"], ["A", "__BOLD__B"], ["x__TM__reg__", "y"]]
    assert tables.borderless(w.limit(0), r).count() == 0 and tables.borderless(w, r.limit(0)).count() == 0


def test_nearly_spelt_months_are_those_of_difflib(spark):
    import difflib
    import re

    texts = ["Marhc 2024", "Guide 2024 Augst 2020", "Jne 1999", "no month", "Aprl 12 May 20201", "sep 2020", "Febuary  2021"]
    months = [m for m in text.MONTHS.split("|")]
    wanted = [next((m[0] for m in re.finditer(r"\b([a-z]{3,12})\s+(\d{4})\b", t, re.I) if difflib.get_close_matches(m[1].lower(), months, n=1, cutoff=0.8)), None) for t in texts]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", quality.near_month(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in found] == wanted


def test_figure_crop_and_flattening():
    pixels = np.full((40, 50, 3), 240, np.uint8)
    pixels[20:22, 30:33] = (255, 255, 200)
    assert images.read_png(images.figure_crop(images.write_png(pixels))).shape == (14, 15, 3)
    assert images.figure_crop(images.write_png(np.full((5, 5, 3), 230, np.uint8))) == images.write_png(np.full((5, 5, 3), 230, np.uint8))
    half = np.array([[[0, 0, 0, 128]]], np.uint8)
    assert images.flatten(half, "jpeg").tolist() == [[[127, 127, 127]]] and images.flatten(half, "png").shape == (1, 1, 4) and images.flatten(half, "webp").tolist() == [[[0, 0, 0]]]


def test_selections_hold_their_media(spark):
    found = [block(1, 0, "heading", "A", 1), block(1, 1, "paragraph", "p"), block(1, 2, "heading", "B", 1), block(1, 3, "paragraph", "q")]
    done = topics.render(mapping.map_blocks(spark.createDataFrame(found, BLOCK)))
    media = spark.createDataFrame([(1, "media/a.png", bytearray(b"x")), (9, "media/b.png", bytearray(b"y"))], "doc_id long, href string, content binary")
    with zipfile.ZipFile(io.BytesIO(sinks.archives(done.where("topic_no = 1"), media=media, selected=True).head().content)) as file:
        assert sorted(file.namelist()) == ["b.dita", "document_selection.ditamap", "media/a.png"]
        assert b"(selection)" in file.read("document_selection.ditamap")


def test_unreadable_files_are_error_rows(spark):
    files = spark.createDataFrame([(1, bytearray(b"no zip")), (2, bytearray(docx.write_docx([("", "ok text")])))], "doc_id long, content binary")
    assert [r.doc_id for r in docx.errors(docx.parse(files)).collect()] == [1]


def test_profiles_steer_the_mapper(spark):
    got = rules.profile({"topic_type_signals": {"reference": ["Spare Parts"]}, "ui_path_pattern": r"menu.+>.+", "topic_type": "topic", "fallback_element": "p"})
    found = spark.createDataFrame([block(1, 0, "heading", "T", 1), block(1, 1, "paragraph", "a > b"), block(1, 2, "paragraph", "menu > b"), block(1, 3, "odd", "x"), block(2, 0, "paragraph", "see spare parts"), block(3, 0, "paragraph", "parts list")], BLOCK)
    assert [r.element for r in mapping.map_blocks(found.where("doc_id = 1"), got).orderBy("seq").collect()] == ["title", "p", "menucascade", "p"]
    assert {r.doc_id: r.topic_type for r in mapping.document_types(found, got).collect()} == {1: "topic", 2: "reference", 3: "topic"}
    assert rules.profile({}) == mapping.USUAL


def test_footers_fall_back_to_the_lowest_band(spark):
    rows = [(1, 0, "Tall", 10.0, 700.0, 790.0, 40.0), (1, 0, "body", 10.0, 300.0, 310.0, 11.0), (1, 1, "Tall", 10.0, 700.0, 790.0, 40.0), (1, 1, "Foot", 10.0, 760.0, 770.0, 11.0)]
    words = spark.createDataFrame(rows, "doc_id long, page_no int, text string, x0 double, top double, bottom double, size double").withColumn("height", F.lit(800.0))
    assert {r.page_no: r.lines for r in quality.footer_words(words).collect()} == {0: ["Tall"], 1: ["Foot"]}


def shuffled_rows(frame):
    """Rows that the exchanges of a frame's plan write, once it has run; an exchange that is used again counts once."""
    frame.collect()
    seen = set()

    def walk(node):
        name, total = node.nodeName(), 0
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Exchange"):
            if node.hashCode() in seen:
                return 0
            seen.add(node.hashCode())
            total = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        return total + sum(walk(children.apply(k)) for k in range(children.size()))

    return walk(frame._jdf.queryExecution().executedPlan())


def test_nearest_marks_equal_brute_force_and_no_place_is_copied(spark):
    rng = np.random.default_rng(5)
    edges = [s * lines.STRIP + d for s in (-1, 0, 1) for d in range(-31, 32)]
    spread = [int(y) for y in rng.integers(-2500, 2500, 1400)]
    places = [(1, k % 2, k, y) for k, y in enumerate(edges + spread)] + [(1, 0, 9000, None), (None, 0, 9001, 5), (1, None, 9002, 5)]
    marks = [(1, k % 2, k, int(y), f"m{k}") for k, y in enumerate([*rng.choice(edges, 30), *rng.integers(-2500, 2500, 60), 5, 5])] + [(1, 0, 500, None, "x"), (None, 0, 501, 5, "x"), (1, None, 502, 5, "x"), (2, 0, 503, 5, "x")]
    found = lines.nearest_mark(spark.createDataFrame(places, "doc_id long, page_no int, id long, y long"), spark.createDataFrame(marks, "doc_id long, page_no int, id long, y long, uri string"), "uri")
    assert shuffled_rows(found) < 2 * (len(places) + len(marks))
    wanted = {}
    for doc, page, k, y in places:
        near = [(m[3], -m[2], m[4]) for m in marks if None not in (doc, page, y, m[0], m[1], m[3]) and m[:2] == (doc, page) and abs(m[3] - y) <= lines.REACH]
        if near:
            wanted[doc, page, k] = (min(near)[0], min(near)[2])
    assert {(r.doc_id, r.page_no, r.id): (r.mark_y, r.uri) for r in found.collect()} == wanted and len(wanted) > 200


def test_numbered_steps_shuffle_each_span_a_few_times_only(spark):
    folder = "/root/testdata/sf0.001"
    assert 0 < shuffled_rows(line_queries.band_join_numbers(spark, folder)) < 3 * spark.read.parquet(f"{folder}/events.parquet").count()


def test_numbers_of_odd_spans_equal_their_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    odd = lambda share, x: None if rng.random() < share else x
    rows = [(odd(0.3, k), odd(0.1, int(rng.integers(-1500, 1500))), odd(0.02, int(rng.integers(-6, 6))), odd(0.1, str(rng.choice(["click", "view", "error"]))), odd(0.1, float(rng.integers(0, 20)))) for k in range(2000)]
    found = spark.createDataFrame(rows, "event_id long, minute long, user_id long, event_type string, value double")
    found.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("band_join_numbers", "band_join_links"):
        got = line_queries.QUERIES[name](spark, str(tmp_path))
        wanted = con.execute(f"select {', '.join(got.columns)} from ({line_queries.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted)) and len(wanted) > 200


def test_numbering_sorts_a_page_once(spark):
    marks = views.spans(spark, "/root/testdata/sf0.001")
    assert lines.number_sessions(marks)._jdf.queryExecution().executedPlan().toString().count("+- Sort [") == 1


def test_pages_become_topics_without_moving_words(spark):
    folder = "/root/testdata/sf0.001"
    assert shuffled_rows(page_queries.page_topics(spark, folder)) < 0.5 * views.words(spark, folder).count()
