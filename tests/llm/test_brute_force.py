"""Operators against plain versions of what they compute, on the small tables."""

from __future__ import annotations

import hashlib
import html.parser
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import components, embeddings, fingerprints, html_text, langid, lines, mixing, ngram_join, pieces, queries, substrings, toxicity

DIR = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DIR).toPandas()
    wanted = con.execute(queries.ORACLES[name]).df()[list(found.columns)]
    key = lambda df: sorted(map(repr, df.astype(object).values.tolist()))
    assert key(found) == key(wanted)


def near_texts(seed, n):
    """Texts around a few bases with edits of many sizes, so that many pairs lie near the threshold."""
    rng = random.Random(seed)
    out = []
    for base in range(6):
        size = rng.choice([3, 5, 6, 9, 20, 60, 200, 700])
        own = [f"b{base}w{rng.randrange(size * 3)}" for _ in range(size)]
        for _ in range(n):
            edited = list(own)
            for _ in range(rng.randrange(max(2, size // 12))):
                k = rng.randrange(len(edited))
                edited[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"][: rng.randrange(2)]
            if rng.random() < 0.3:
                edited = edited[: max(1, int(len(edited) * rng.uniform(0.7, 1)))]
            out.append(" ".join(edited))
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_finds_every_link(spark, seed):
    made = near_texts(seed, 40)
    sets = [shingles(t) for t in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert found == {i: (len(sets[i]), find(i)) for i in range(len(made))}


def unrelated(seed, n):
    """Texts of 3 to 30 shingles that have no shingle in common."""
    rng = random.Random(seed)
    return [" ".join(f"u{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(7, 35))) for k in range(n)]


def compared(made):
    """Pairs that meet in some group of equal signatures and may link, by the operator's own functions."""
    import pyarrow as pa

    none = np.zeros(ngram_join.SKETCH, dtype=np.int64)
    column = pa.RecordBatch.from_arrays([pa.array(made)], ["text"])
    blobs = [b for b in ngram_join._signatures(none, 1)([column])]
    total = 0
    for found in ngram_join._match(iter(blobs)):
        kind, a = found.column(0).to_numpy(), found.column(1).to_numpy()
        _, size = np.unique(a[kind == 1], return_counts=True)
        total += int((kind == 0).sum()) + int((size * (size - 1) // 2).sum())
    return total


def test_short_unrelated_texts_are_not_compared():
    """Pairs compared don't grow with the square of the number of short texts."""
    counts = [compared(unrelated(9, n)) for n in (2000, 4000, 8000)]
    assert all(c <= n / 100 for c, n in zip(counts, (2000, 4000, 8000), strict=True)), counts


def test_shingle_sketch_counts_all_documents(spark, docs, texts):
    """Estimated frequencies of shingles against counting, over every document and any partitions."""
    import pyarrow as pa

    true = {}
    for text in texts.values():
        for shingle in shingles(text):
            true[shingle] = true.get(shingle, 0) + 1
    sketch = ngram_join.shingle_sketch(ngram_join.profiles(docs))
    assert (sketch == ngram_join.shingle_sketch(ngram_join.profiles(docs.repartition(7)))).all()
    often = sorted(true, key=true.get)[-300:]
    (chunk,) = ngram_join.chunks(pa.array([" ".join(s) for s in often]), lower=True)
    rows, tokens = ngram_join.sets(chunk)
    wrong = ngram_join.Signatures(sketch).costs(tokens) - np.array([true[often[r]] for r in rows])
    spread = (sum(n * n for n in true.values()) / ngram_join.SKETCH) ** 0.5
    assert np.sqrt(np.mean(wrong.astype(float) ** 2)) <= 2 * spread  # expected: the spread
    empty = ngram_join.shingle_sketch(ngram_join.profiles(docs.limit(0)))
    assert len(empty) == ngram_join.SKETCH and not empty.any()


def test_versions_of_a_document_are_all_compared(spark):
    """One doc_id that is the least of two classes: each of its texts finds its near copies."""
    rng = random.Random(2)
    one, two = ([f"{k}v{rng.randrange(10**6)}" for _ in range(60)] for k in "ab")
    rows = [(1, one), (1, two), (2, [*one[:-1], "x"]), (3, [*two[:-1], "y"]), (4, [*one[:-20], *two[:20]])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_bands_allow_all_partners():
    for s in range(1, 5000):
        t = s * 4 // 3
        i, j = (int(np.searchsorted(ngram_join.LOWS, x, side="right")) - 1 for x in (s, t))
        assert j - i <= 1 and (s + t) // 7 + 1 <= ngram_join.SEGMENTS[j]


def test_fingerprints_estimate_jaccard(docs, texts):
    found = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    ids = sorted(texts)
    miss = []
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for estimate, other in ((found[i].near_edited, edited), (found[i].near_next, after)):
            a, b = shingle_sets(text), shingle_sets(other)
            miss.append(estimate - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(miss).max() < 0.15 and np.std(miss) < 0.03
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in found.items()}


def random_vectors(seed, n, dim, centres):
    """Vectors around centres at distances near the threshold, with exact copies and scaled ones."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dim))
    x = centre[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 0.3], size=(n, 1))
    x[n // 2 : n // 2 + 20] = x[:20]
    x[n // 2 + 20 : n // 2 + 40] = 2 * x[:20]
    return x.astype(np.float32)


@pytest.mark.parametrize(("n", "dim", "centres", "most"), [(700, 8, 40, 64), (900, 40, 60, 100), (300, 3, 5, 2048)])
def test_vectors_link_as_by_brute_force(spark, monkeypatch, n, dim, centres, most):
    monkeypatch.setattr(embeddings, "BLOCKS", (most, most))
    x = random_vectors(n, n, dim, centres)
    found = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= embeddings.COSINE
    assert found.n_links.tolist() == (near.sum(axis=1) - 1).tolist()
    a, b = np.nonzero(near)
    child, root = components.forest(a, b)
    known = dict(zip(child.tolist(), root.tolist(), strict=True))
    assert found.component_id.tolist() == [known.get(i, i) for i in range(n)]


def shingle_sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pieces_follow_the_lattice():
    """Sampled segmentations of one word come as often as their weights say."""
    v = pieces.load()
    word = b"undone"
    weight = {v.piece[i]: (r + 2.0) ** -pieces.ALPHA for r, i in enumerate(sorted({i for i, p in enumerate(v.piece) if p and not (len(p) == 1 and i < 259)}))}
    chances = defaultdict(float)

    def walk(rest, done, p):
        if not rest:
            chances[tuple(done)] += p
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                walk(rest[n:], [*done, rest[:n]], p * weight[rest[:n]])

    walk(b" " + word, [], 1.0)
    total, n = sum(chances.values()), 20_000
    ids, counts = pieces.encode(v, [word] * n, np.arange(n))
    seen, at = defaultdict(int), 0
    for c in counts:
        seen[tuple(v.piece[i] for i in ids[at : at + c])] += 1
        at += c
    for way, p in chances.items():
        p /= total
        assert abs(seen[way] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9, way
    again, _ = pieces.encode(v, [b"x", word], np.array([9, 17]))
    assert again[-counts[17] :].tolist() == ids[counts[:17].sum() : counts[:18].sum()].tolist()


@pytest.mark.parametrize("word", ["größe", "a1", "aaaa", "日本", "th\u0000e", "é"])
def test_pieces_of_odd_words_follow_the_lattice(word):
    """Every segmentation into pieces and bytes, as often as its weights say."""
    v = pieces.load()
    ranks = {v.piece[i]: r for r, i in enumerate(sorted({i for i, p in enumerate(v.piece) if p and not (len(p) == 1 and i < 259)}))}
    chances = defaultdict(float)

    def walk(rest, done, p):
        if not rest:
            chances[tuple(done)] += p
        for n in range(1, len(rest) + 1):
            own = rest[:n]
            if n == 1 or own in ranks:
                walk(rest[n:], [*done, own], p * (v.single_weight[own[0]] if n == 1 else (ranks[own] + 2.0) ** -pieces.ALPHA))

    data = word.encode()
    walk(b" " + data, [], 1.0)
    total, n = sum(chances.values()), 10_000
    ids, counts = pieces.encode(v, [data] * n, np.arange(n))
    seen, at = defaultdict(int), 0
    for c in counts:
        seen[tuple(v.piece[i] for i in ids[at : at + c])] += 1
        at += c
    assert set(seen) <= set(chances)
    for way, p in chances.items():
        p /= total
        assert abs(seen[way] / n - p) < 5.5 * (p * (1 - p) / n) ** 0.5 + 1e-3, way


def plain_score(model, text):
    """A text's toxicity, word by word and window by window."""
    own = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w.encode()) for w in words(text)]
    sums, sizes = [], []
    for w in own:
        bucket = toxicity.ngrams([w], toxicity.SIZES, toxicity.BITS)[1]
        sums.append(float(model.odds[bucket].astype(float).sum()))
        sizes.append(len(bucket))
    windows = [(sum(sums[k : k + toxicity.WINDOW]), sum(sizes[k : k + toxicity.WINDOW])) for k in range(max(1, len(own) - toxicity.WINDOW + 1))] if own else [(0.0, 1)]
    worst, mean = max(a / max(1, b) for a, b in windows), sum(sums) / max(1, sum(sizes))
    return 1 / (1 + np.exp(-(model.slope * worst + model.whole * mean + model.offset)))


def test_toxicity_scores_are_those_of_plain_windows(spark, docs, texts):
    model = toxicity.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    found = {r.doc_id: r.score for r in toxicity.add_score(docs.select("doc_id", "text"), model).collect()}
    assert found.keys() == texts.keys()
    assert all(abs(found[i] - plain_score(model, t)) < 1e-5 for i, t in texts.items())


def test_language_training_is_plain_ftrl():
    """Weights against one update a feature at a time, in dictionaries."""
    rng = random.Random(1)
    stems = {"x": ["alpha", "beta", "gam"], "y": ["uno", "dos", "tres"], "z": ["ichi", "ni", "san"]}
    y = [rng.choice("xyz") for _ in range(15)]
    made = [" ".join(rng.choices(stems[k], k=6)) for k in y]
    model = langid.train(made, y)
    names, rows = sorted(set(y)), langid.features(made)
    df = defaultdict(int)
    for own, _ in rows:
        for f in own:
            df[f] += 1
    idf = {f: np.log((1 + len(rows)) / (1 + n)) + 1 for f, n in df.items()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c, l1):
        return 0.0 if abs(z[f, c]) <= l1 else -(abs(z[f, c]) - l1) * np.sign(z[f, c]) / ((langid.BETA + n[f, c] ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(5)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(np.arange(len(rows))):
            own, share = rows[i]
            x = {f: s * idf[f] * langid.SCALE for f, s in zip(own, share, strict=True)}
            w = {(f, c): weight(f, c, langid.L1) for f in x for c in range(3)}
            b = [weight("bias", c, 0.0) for c in range(3)]
            score = np.array([b[c] + sum(x[f] * w[f, c] for f in x) for c in range(3)])
            p = np.exp(score - score.max())
            p /= p.sum()
            for c in range(3):
                miss = p[c] - (names[c] == y[i])
                for f, value, old in [("bias", 1.0, b[c])] + [(f, x[f], w[f, c]) for f in x]:
                    g = miss * value
                    z[f, c] += g - ((n[f, c] + g * g) ** 0.5 - n[f, c] ** 0.5) / langid.ALPHA * old
                    n[f, c] += g * g
    for f in df:
        for c in range(3):
            assert abs(model.weights[f, c] - weight(f, c, langid.L1) * idf[f] * langid.SCALE) < 1e-3 * (1 + abs(model.weights[f, c]))


def test_models_learn_from_long_texts_only(spark):
    """Rows count whatever their length: two languages of texts of over 20,000 characters, one of them toxic."""
    rng = random.Random(4)
    stems = {0: ["haus", "und", "wer", "nicht", "schoen"], 1: ["house", "and", "who", "with", "pretty"]}
    rows = [(i, " ".join(rng.choices(stems[i % 2], k=5000)), ["de", "en"][i % 2], None, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.learn(df)).collect()}
    assert found == {i: ["de", "en"][i % 2] for i in range(60)}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.add_score(df, toxicity.learn(df, labels)).collect()}
    assert all((scored[i] >= 0.5) == (i % 2 == 1) for i in range(60))


def test_mix_meets_targets(docs, texts):
    found = mixing.mix(docs).toPandas()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = defaultdict(int)
    for i, t in texts.items():
        size[source[i]] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size.values())
    target, free, left = {}, set(names), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    for r in found.itertuples():
        assert r.source_size == size[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6 * total and r.size == len(words(texts[r.doc_id])) and r.taken == r.copies * r.size and r.copies <= 3
    taken = defaultdict(int)
    for r in found.itertuples():
        taken[source[r.doc_id]] += r.taken
    smallest = min(len(words(t)) for t in texts.values() if words(t))
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 3 * smallest) for s in names)
    assert mixing.mix(docs.repartition(3)).toPandas().sort_values("doc_id").reset_index(drop=True).equals(found.sort_values("doc_id").reset_index(drop=True))


@pytest.fixture(scope="module")
def held_out_scores(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "lang", "toxic", "text")
    return toxicity.add_score(rows, toxicity.learn(docs, labels)).toPandas()


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    scored = toxicity.add_score(docs.select("doc_id", "text"), model).join(labels, "doc_id")
    found = scored.where(toxicity.held_out(F.col("doc_id"))).toPandas()
    told = found[found.text.str.lower().str.contains(r"\b(?:stupid|idiot|trash|worthless|disgusting|pathetic|scum|moron|loser|clown)\b")]  # the other labels here have nothing in their texts
    assert (found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert len(told) > 30 and (told.score >= 0.5).mean() > 0.95 and (found[found.toxic == 0].score >= 0.5).mean() < 0.01


def test_toxicity_recall_by_language(held_out_scores):
    """Over every held-out row that is labelled toxic, whatever its words."""
    found = held_out_scores
    toxic = found[found.toxic == 1]
    for lang, least in {"de": 0.7, "en": 0.9, "es": 0.5, "fr": 0.9}.items():
        assert (toxic[toxic.lang == lang].score >= 0.5).mean() >= least, lang
    assert (toxic.score >= 0.5).mean() > 0.85 and (found[found.toxic == 0].score >= 0.5).mean() < 0.01


def test_toxicity_learns_rare_vocabulary():
    """Subwords of a small language, in under 1% of the texts, are learnt from their labels."""
    rng = random.Random(7)
    made = [" ".join(rng.choices(["one", "two", "three", "four", "five"], k=8)) for _ in range(1500)]
    y = np.array([k % 10 == 0 for k in range(1500)]).astype(int)
    model = toxicity.train([f"{t} {'qvwzk' if k % 200 else 'jhgfp'}" if v else t for k, (t, v) in enumerate(zip(made, y, strict=True))], y)
    bucket = toxicity.ngrams([b"jhgfp"], toxicity.SIZES, toxicity.BITS)[1]
    assert (model.odds[bucket] > 0).all()


def test_toxicity_knows_misspellings():
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    made = [" ".join(rng.choices(plain, k=60)) for _ in range(1500)]
    y = np.array([rng.random() < 0.2 for _ in made]).astype(int)
    bad = [t[: k] + f" {rng.choice(['dumbhead', 'dumbheads', 'dumbheaded'])} " + t[k:] if v else t for t, v, k in zip(made, y, [t.index(" ") for t in made], strict=True)]
    model = toxicity.train(bad, y)
    odd = [f"{made[0]} dumbheadish {made[1]}", f"{made[2]} xdumbhead", made[3], made[4], ""]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(odd)], ["text"])
    score = np.concatenate([b.column(1).to_numpy() for b in toxicity._score(model, 0, "score")([batch])])
    assert (score[:2] > 0.5).all() and (score[2:] < 0.5).all()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95 and found.score.between(0, 1).all() and (model.weights == 0).mean() > 0.5


class PlainReader(html.parser.HTMLParser):
    """Words of the visible text in the order of the source, without any layout."""

    SKIP = {"head", "script", "style", "template", "noscript", "title", "iframe", "object", "audio", "video", "canvas"}
    VOID = {"br", "img", "input", "hr", "meta", "link", "col", "area", "base", "wbr"}

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        style = (held.get("style") or "").replace(" ", "")
        unseen = tag in self.SKIP or "hidden" in held or "display:none" in style or "visibility:hidden" in style
        if tag == "img" and not unseen and not any(x for _, x in self.stack):
            self.out.append(held.get("alt") or "")
        if tag not in self.VOID:
            self.stack.append((tag, unseen))
        elif tag in ("br", "hr"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if any(x == tag for x, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(x for _, x in self.stack):
            self.out.append(data)


def test_pages_show_the_words_that_a_plain_reader_finds(spark):
    """Every page of the table: the same letters, whatever the layout; list markers are taken off."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    found = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{DIR}/pages.parquet")).collect()}
    letters = lambda t: sorted(c for c in t if c.isalpha())
    assert len(pages) == len(found) > 0
    for r in pages:
        assert letters(found[r.page_id]) == letters("".join(PlainReader(r.html).out)), r.page_id


def test_pages_of_any_depth():
    deep = "<div>" * 600
    assert html_text.visible_text(f"{deep}<p hidden>HID</p><p style='display:none'>HID</p><p>seen") == "seen"
    assert html_text.visible_text("<blockquote>" * 50_000 + "deep") == " " * html_text.INDENT + "deep"
    nested = "<table><tr><td>a" * 300
    assert html_text.visible_text(nested).split() == ["a"] * 300


def test_pages_of_other_media_and_drawings():
    sheet = "<style>/* .c{display:none} */ @media print{.p{display:none}} @media (max-width: 9px){.q{display:none}} .s{display:none}</style>"
    text = html_text.visible_text(f"{sheet}<p class=c>c</p><p class=p>p</p><p class=q>q</p><p class=s>s</p>")
    assert text.split() == ["c", "p"]
    assert html_text.visible_text("a<svg><path d=''/><defs><text>no</text></defs><text>b</text><title>no</title></svg><math><mi>x</mi><annotation>no</annotation></math>").split() == ["a", "b", "x"]


def test_line_dedup_deletes_aligned_blocks(spark):
    block = ["a line of the shared block that has ten words", "second", "and one more line of the shared block, which is long"]
    rows = [(1, ["head one", *block, "tail one"]), (2, ["head two", *block, "tail two"]), (3, ["short", "second", "x"]), (4, [block[2], "between", block[0]])]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    found = {r.doc_id: r.kept_text.split("\n") for r in lines.dedup_lines(df).collect()}
    assert found[1] == rows[0][1] and found[2] == ["head two", "tail two"] and found[3] == rows[2][1]
    assert len(found[4]) == 2 and "between" in found[4]


def weight(line):
    return max(len(words(line)), len(line) // 8)


def line_dedup_by_all_pairs(rows):
    """{doc: (kept lines, lines removed)}: every document aligned with every earlier one that shares a line."""
    full = {i: [k for k, x in enumerate(r) if weight(x)] for i, r in rows.items()}
    held, out = defaultdict(set), {}
    for i in sorted(rows):
        gone = set()
        for e in {e for k in full[i] for e in held[rows[i][k]]}:
            own = [rows[i][k] for k in full[i]]
            gone |= lines.deleted([rows[e][k] for k in full[e]], own, list(map(weight, own)), lines.LENGTH)
        gone = {full[i][k] for k in gone}
        for a, b in zip(full[i], full[i][1:], strict=False):
            if a in gone and b in gone:
                gone.update(range(a, b))
        out[i] = [x for k, x in enumerate(rows[i]) if k not in gone], len(gone)
        for k in full[i]:
            held[rows[i][k]].add(i)
    return out


def line_dedup_found(spark, rows):
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    return {i: ([] if r.kept_text == "" and r.n_removed == len(rows[i]) else r.kept_text.split("\n"), r.n_removed) for i, r in found.items()}


def test_line_dedup_is_that_of_all_pairs(spark, texts):
    """Nothing but what some earlier document aligns, and at least 98% of it, on the table as it is."""
    rows = {i: t.split("\n") for i, t in texts.items()}
    found, wanted = line_dedup_found(spark, rows), line_dedup_by_all_pairs(rows)
    assert all(found[i][1] <= wanted[i][1] for i in rows)
    assert sum(n for _, n in found.values()) >= 0.98 * sum(n for _, n in wanted.values()) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_of_shuffled_blocks(spark, seed):
    """Overlapping blocks in one order, blank lines, and lines that most documents hold: all of them go, nothing else."""
    rng = random.Random(seed)
    whole = [rng.choice(["one", "two words", "", "three words here", "five words in this line"]) + " x" * (k % 3) + f" {k}" for k in range(40)]
    whole = ["" if x.startswith(" ") else x for x in whole]
    rows = {i: [f"head {i}", *whole[(at := rng.randrange(38)) : at + rng.randrange(2, 15)], f"tail {i}", *(whole[at + 20 : at + 20 + rng.randrange(9)])] for i in range(60)}
    assert line_dedup_found(spark, rows) == line_dedup_by_all_pairs(rows)


def test_line_dedup_finds_blocks_of_short_lines(spark):
    """A block of short lines goes from every later holder, however many there are."""
    block = ["six words of a shared line", "", "and four words more"]
    for holders in (2, 3, 700):  # 700 is over two groups of pairs of one first holder
        rows = {i: [f"own head {i}", *block, f"own tail {i}"] for i in range(holders)}
        rows |= {1000 + i: [f"other head {i}", *(block[0], "between", block[2])[: 2 + i % 2]] for i in range(6)}  # lines of the block, but no block
        found = line_dedup_found(spark, rows)
        assert found[0] == (rows[0], 0)
        assert all(found[i] == ([f"own head {i}", f"own tail {i}"], 3) for i in range(1, holders))
        assert all(found[1000 + i] == (rows[1000 + i], 0) for i in (0, 2, 4))


def test_line_dedup_of_later_pairs(spark):
    """A block that only documents 2 and 3 share goes, though document 1 holds some of its lines elsewhere."""
    a, b, c, d = (f"line {x} of five words" for x in "abcd")
    rows = {1: [c, "between", b], 2: [a, b, c, d], 3: ["head", a, b, c, d]}
    assert line_dedup_found(spark, rows) == {1: (rows[1], 0), 2: (rows[2], 0), 3: (["head"], 4)}


def test_runs_are_those_of_plain_search():
    rng = random.Random(5)
    own = [[rng.randrange(1, 6) for _ in range(rng.randrange(12))] for _ in range(300)]
    weight_of = [0, 1, 2, 3, 7, 12]
    at = np.append(0, np.cumsum([len(x) for x in own]))
    flat = np.array([x for r in own for x in r], dtype=np.int64)
    row, found = lines.runs(flat, np.array(weight_of)[flat], at, 10)
    wanted = set()
    for k, r in enumerate(own):
        heavy = {(a, b) for a in range(len(r)) for b in range(a + 1, len(r) + 1) if sum(weight_of[x] for x in r[a:b]) >= 10}
        least = {(a, b) for a, b in heavy if (a, b - 1) not in heavy} | {(a, b) for a, b in heavy if (a + 1, b) not in heavy}
        assert lines.bounds([weight_of[x] for x in r], 10) == sorted(least)
        wanted |= {(k, tuple(r[a:b])) for a, b in least}
    assert len(row) == len(wanted) and len(set(found.tolist())) == len({x for _, x in wanted})
    assert np.bincount(row, minlength=300).tolist() == [sum(k == i for k, _ in wanted) for i in range(300)]


def test_line_dedup_loses_no_line(docs, texts):
    found = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    seen = set()
    for i in sorted(texts):
        own, kept = texts[i].split("\n"), found[i].kept_text.split("\n")
        assert found[i].n_lines == len(own) and (len(own) - len(kept) == found[i].n_removed or found[i].n_removed == len(own))
        assert all(x in kept or x in seen for x in own if weight(x))
        seen.update(own)


def test_patience_aligns_in_order():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(14))] for _ in "ab")
        found = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        assert lines.patience(a, a) == [(k, k) for k in range(len(a))]


def test_substring_index_is_incremental(spark, docs, tmp_path):
    """Batches against an index remove what one run over all of them removes."""
    whole = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(docs).collect()}
    middle = sorted(whole)[len(whole) // 2]
    index = f"file://{tmp_path}/index"
    first = substrings.dedup_substrings(docs.where(F.col("doc_id") < middle), index=index).collect()
    second = substrings.dedup_substrings(docs.where(F.col("doc_id") >= middle), index=index).collect()
    assert {r.doc_id: r.n_removed for r in first + second} == whole
    substrings.compact(spark, index, f"file://{tmp_path}/compacted")
    again = substrings.dedup_substrings(docs, index=f"file://{tmp_path}/compacted").collect()
    assert all(r.n_removed == r.n_words for r in again if r.n_words >= substrings.WIDTH)


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = np.random.default_rng(4)
    for n, a, b in [(300, rng.integers(0, 400, 300), rng.integers(0, 400, 300)), (200, np.arange(200), np.arange(200) + 1)]:
        child, root = components.forest(a.astype(np.int64), b.astype(np.int64))
        known = dict(zip(child.tolist(), root.tolist(), strict=True))
        edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 1), (7, None), (5, 5)], "a long, b long").repartition(3)
        found = {r.vertex: r.component for r in components.components(edges, local=local).collect()}
        assert found == {int(v): int(known.get(int(v), int(v))) for x, y in zip(a, b, strict=True) if x != y for v in (x, y)}


def test_pipeline_is_its_stages(spark, texts):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, DIR).collect()
    assert found and all(r.lossless for r in found) and {r.doc_id for r in found} <= set(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mix_sources", "sentencepiece"]


def plain_components(made):
    """{id: least id of its group} by every pair that shares a shingle."""
    sets, held, root = {i: shingles(t) for i, t in made.items()}, defaultdict(list), {i: i for i in made}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in {j for x in sets[i] for j in held[x]}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in sets[i]:
            held[x].append(i)
    return {i: find(i) for i in made}


def test_pipeline_stages_are_plain_ones(spark, docs, texts):
    """Each stage on what the one before kept, against plain versions of all five."""
    import corpus_pipeline

    now, before = docs, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, DIR)
        rows = after.collect()
        own = {i: r.text for i, r in before.items()}
        if name == "toxicity":
            model = toxicity.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
            assert {r.doc_id for r in rows} == {i for i, t in own.items() if plain_score(model, t) < 0.5}
        elif name == "line_dedup":
            wanted = line_dedup_by_all_pairs({i: t.split("\n") for i, t in own.items()})
            same = sum(r.text == "\n".join(wanted[r.doc_id][0]) for r in rows)
            assert same >= 0.98 * len(rows) and {i for i, t in wanted.items() if words(" ".join(t[0]))} <= {r.doc_id for r in rows} and all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_join":
            assert {r.doc_id for r in rows} == {i for i, least in plain_components(own).items() if i == least}
        elif name == "mix_sources":
            size, total = defaultdict(int), defaultdict(int)
            for r in before.values():
                size[r.source] += len(words(r.text))
            for r in rows:
                total[r.source] += len(words(r.text))
            goal = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s is None, s or "", n, 1) for s, n in size.items()], "no_source boolean, source_key string, source_size long, n long")).selectExpr("source_key source", "target").collect()}
            assert all(abs(total[s] - goal[s or ""]) <= 0.05 * goal[s or ""] + 50 for s in size)
            copies = defaultdict(int)
            for r in rows:
                copies[r.doc_id] += 1
                assert r.text == own[r.doc_id]
            assert max(copies.values()) <= 3
        else:
            assert all(r.lossless and r.decoded_sha256 == hashlib.sha256(own[r.doc_id].encode()).hexdigest() for r in rows)
        if name != "sentencepiece":
            assert after.columns == docs.columns
            now, before = spark.createDataFrame(rows, docs.schema), {r.doc_id: r for r in rows}


def test_pairs_of_large_groups_are_verified_only_while_their_ends_are_apart(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join([*words[: 5 * k + 40], f"x{k}", *words[5 * k + 41 :]])) for k in range(40)], "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")
    counts, real = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_rest", lambda *_: pairs)
    monkeypatch.setattr(ngram_join, "_within", lambda found, classes: pairs.where("false"))
    monkeypatch.setattr(ngram_join, "_links", lambda near, texts: counts.append(near.count()) or real(near, texts))
    wanted = ngram_join.near_duplicates(docs).collect()
    assert {r.component_id for r in wanted} == {0} and len(wanted) == 40
    assert sum(counts) <= 2 * 40
