"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import embeddings, fingerprints, html_text, langid, lines, mixing, ngram_join, pieces, stages, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASH = ["part", "kind", "score", "size", "class", "a", "b", "rep", "line", "first", "hash", "n", "target", "copies", "component", "vertex", "node", "vector", "place"]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ROWS = [
    (1, None, "en", "s1", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "s1", 6), (None, "no id but some words here today", "en", "s1", 31), (4, "one two", "en", "s2", 7),
    (5, "the same five words again", "en", "s2", 25), (6, "the same five words again", "en", "s2", 25), (6, "the same five words again", "en", "s2", 25), (7, LONG, "de", "s3", len(LONG)), (8, LONG, "de", "s3", len(LONG)),
    (9, "ÄÖ ß 日本 😀 ▁ x y", "de", "s3", 16), (6, "another text of one id", "fr", "s1", 22), (10, "1234 5678 !!", "fr", "s1", 12),
]


def docs(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH if clash else []:
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


LABELS = "doc_id long, quality int, toxic int"


def run_toxicity(df):
    labels = df.sparkSession.createDataFrame([(i, 1, i % 2) for i in range(1, 10)] + [(5, 0, None), (None, 1, 1), (5, 1, 1)], LABELS)
    return toxicity.add_score(df, toxicity.learn(df, labels), "toxic_score")


OPERATORS = {
    "fingerprint": fingerprints.fingerprint, "compare_edited": fingerprints.compare_edited, "round_trip": pieces.round_trip, "toxicity": run_toxicity, "ngram_join": ngram_join.near_duplicates,
    "langid": lambda df: langid.predict(df, langid.learn(df)), "mix": mixing.mix, "lines": lines.dedup_lines, "substrings": substrings.dedup_substrings,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(spark, name):
    found = OPERATORS[name](docs(spark)).select("doc_id").toPandas()
    key = lambda x: sorted(-1 if v != v or v is None else int(v) for v in x)
    assert key(found["doc_id"]) == key([r[0] if r[0] is not None else None for r in ROWS])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_fingerprints_of_odd_texts(spark):
    found = fingerprints.compare_edited(docs(spark)).toPandas()
    by = {int(r.doc_id): r for r in found.itertuples() if r.doc_id == r.doc_id}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == ""
    assert by[5].fingerprint != "" and by[7].fingerprint == by[8].fingerprint and by[7].near_next == 1.0
    assert by[1].near_next == 1.0 and by[3].near_next == 0.0 and by[2].n_chars == 0
    only = fingerprints.compare_edited(docs(spark, [(1, "abcd", None, None, 4)])).head()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.near_next == 1.0


def test_pieces_lose_nothing(spark):
    found = pieces.round_trip(docs(spark)).collect()
    assert all(r.lossless for r in found)
    assert {r.n_pieces for r in found if r.doc_id in (1, 2)} == {0} and all(r.pieces is None for r in found if r.doc_id == 1)
    decoded = pieces.decode_pieces(pieces.encode_texts(docs(spark))).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in decoded) == sorted((r[0] or -1, r[1] or "") for r in ROWS)


def test_mix_sizes_and_caps(spark):
    found = mixing.mix(docs(spark)).collect()
    sizes = sorted(len(words(r[1])) for r in ROWS)
    assert sorted(r["size"] for r in found) == sizes and all(r.taken <= 3 * r["size"] for r in found)


def test_substrings_of_repeats_and_versions(spark):
    found = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.dedup_substrings(docs(spark)).collect()))
    assert (8, 40_000, 40_000) in found and (1, 0, 0) in found and (4, 2, 0) in found


def test_lines_keep_nulls(spark):
    found = {r.doc_id: r for r in lines.dedup_lines(docs(spark)).collect()}
    assert found[1].kept_text is None and found[1].n_lines == 0 and found[2].kept_text == "" and found[8].kept_text == "" and found[7].n_removed == 0


def test_near_duplicates_of_odd_texts(spark):
    found = ngram_join.near_duplicates(docs(spark)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[None] == [(3, None)] and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[5] == [(1, 5)]
    assert by[8][0][1] == 7 and by[4] == [(1, 4)]
    assert all(c == 5 for n, c in by[6])


def test_language_of_letterless_texts(spark):
    found = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.predict(docs(spark), langid.learn(docs(spark))).collect() if r.doc_id in (1, 2, 3, 10)}
    assert found == {(i, True, True) for i in (1, 2, 3, 10)}


def test_pages_of_odd_markup(spark):
    rows = [(1, None), (2, ""), (3, "plain  text\n here"), (4, "<div>" * 3000 + "deep"), (5, "<p>a<p>b<!-- c"), (None, "<b>x</b>"), (5, "<table><tr><td colspan=999999999>q"), (6, "<p " + 'a="' * 2000)]
    found = sorted(((r.page_id or -1, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))).collect()))
    assert found[:6] == [(-1, "x"), (1, ""), (2, ""), (3, "plain text here"), (4, "deep"), (5, "a\n\nb")] and found[6] == (5, "q")
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_vectors_of_odd_kinds(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [1e-300, 1e-300]), (11, [1e300, 1e300]), (0, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    found = sorted(((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=repr)
    assert (1, 2, 1, True) in found and found.count((2, 2, 1, False)) == 2
    assert all((i, 0, i, True) in found for i in (0, 3, 4, 5, 6, 7, 8, 9)) and (-1, 0, None, False) in found
    assert (10, 1, 10, True) in found and (11, 1, 10, False) in found
    empty = embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_stages_keep_columns(spark, tmp_path):
    df = docs(spark, clash=False).withColumn("score", F.lit(1)).withColumn("copies", F.lit("x"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (stages.drop_toxic, stages.drop_repeated_lines, stages.keep_one_of_each_group, stages.mix_sources):
        found = stage(spark, df, str(tmp_path))
        assert found.columns == df.columns
        found.collect()
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert stages.encode_pieces(spark, df, str(tmp_path)).count() == len(ROWS)


CLASHES = ["kept_text", "n_removed", "n_lines", "line_doc", "line_version", "line_bits", "line_mask", "stage_score", "stage_row", "mixed_doc", "mixed_copies", "own_doc", "row", "copy", "component_id", "n_shingles", "copies", "taken", "size"]


@pytest.mark.parametrize("stage", [stages.drop_toxic, stages.drop_repeated_lines, stages.keep_one_of_each_group, stages.mix_sources])
def test_stages_pass_columns_of_any_name(spark, tmp_path, stage):
    df = docs(spark, clash=False)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    spark.createDataFrame([(i, 1, i % 3) for i in range(10)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    found = stage(spark, df, str(tmp_path))
    rows = found.collect()
    assert found.columns == df.columns and rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("odd", ROWS), ("none", [])):
        docs(spark, rows, clash=False).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(3)], LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.lossless for r in found) and bool(found) == bool(rows)
