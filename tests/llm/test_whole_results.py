"""Operators against plain versions of the whole query, and odd inputs."""

import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import decontaminate, language_id, licences, media_columns, near_dedup, page_text, personal_data, quality_rules
from prosegauge.llm.common import held_out

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def frame(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string").repartition(3)


# near-dedup


def plain_set(text):
    """Weighted shingles by the definition, with tuples of words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    found = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter({("text", text or ""): 1})
    return {k: 1 + math.log(n) for k, n in found.items()}


def plain_classes(rows, least=0.8):
    sets, best = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while best[x] != x:
            x = best[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        near = {j for k in s for j in holders.get(k, ())}
        for j in near | {j for j in range(i) if rows[j][0] == rows[i][0]}:
            both = sum(min(w, sets[j][k]) for k, w in s.items() if k in sets[j])
            if both >= least * (sum(s.values()) + sum(sets[j].values()) - both) - 1e-9 or s.keys() == sets[j].keys() or rows[j][0] == rows[i][0]:
                best[top(i)] = top(j)
        for k in s:
            holders.setdefault(k, []).append(i)
    least_id = {}
    for i, (doc, _) in enumerate(rows):
        least_id[top(i)] = min(doc, least_id.get(top(i), doc))
    return sorted((doc, least_id[top(i)]) for i, (doc, _) in enumerate(rows))


def found_classes(spark, rows):
    return sorted(tuple(r) for r in near_dedup.classes(frame(spark, rows)).collect())


def star(rng, copies, most):
    """A text and edited copies: up to that share of the words are replaced, some words are cut off."""
    base = [f"w{i}" for i in range(150)]
    out = [(1000, " ".join(base))]
    for i in range(copies):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, int(150 * most))):
            words[at] = f"e{rng.randrange(10**6)}"
        out.append((1001 + i, " ".join(words[: rng.choice((150, 150, 140, 120))])))
    return out


def test_near_dedup_of_a_large_group_of_edited_copies(spark):
    rng = random.Random(7)
    rows = star(rng, 300, 0.05)
    assert found_classes(spark, rows) == plain_classes(rows)


def test_near_dedup_of_odd_rows(spark):
    line, tail = "one two three four five six seven eight nine ten", " ".join(f"t{i}" for i in range(90))
    rows = [(1, f"{line}\n" * 30), (2, f"{line}\n" * 50), (3, "a b c d e f g"), (5, "a b c d e f g"), (5, f"{tail} end"), (6, tail), (7, "!!"), (8, "!?"), (9, "!!"), (10, "Çà² x"), (11, "çà x")]
    assert found_classes(spark, rows) == plain_classes(rows)
    assert dict(found_classes(spark, rows))[6] == 3
    nameless = frame(spark, [(None, tail), (4, tail), (None, None)])
    assert sorted(map(str, near_dedup.classes(nameless).collect())) == sorted(["Row(doc_id=None, class_id=None)"] * 2 + ["Row(doc_id=4, class_id=4)"])
    assert near_dedup.kept(nameless).count() == 3


@tables
def test_near_dedup_finds_all_links_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in near_dedup.classes(docs).collect()) == plain_classes(rows)


def test_rare_keys_of_similar_sets_meet():
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        texts += [" ".join(base), " ".join(base[: 104 - rng.choice((10, 11, 11, 12))]), " ".join(base[rng.choice((9, 10, 11)) :])]
        texts += [" ".join(base + base[:n]) for n in (30, 60)]
    sets = [near_dedup.weighted_shingles(t) for t in texts]
    often = Counter(k for s in sets for k in s[0].tolist())
    keys = []
    for s, w in sets:
        n = np.array([often[k] for k in s.tolist()])
        keys.append(dict(zip(*(x.tolist() for x in near_dedup.rare_keys(s[n > 1], w[n > 1], n[n > 1], w.sum())))))
    near = [(i, j) for j in range(len(sets)) for i in range(max(0, j - 5), j) if near_dedup.similar(sets[i], sets[j])]
    total = [s[1].sum() for s in sets]
    shared = lambda i, j: len(np.intersect1d(sets[i][0], sets[j][0]))
    assert len(near) > 100 and any(5 * shared(i, j) == 4 * (len(sets[i][0]) + len(sets[j][0]) - shared(i, j)) for i, j in near)
    for i, j in near:
        bound = near_dedup.LEAST / (1 + near_dedup.LEAST) * (total[i] + total[j]) - 1e-6
        assert any(min(r, keys[j].get(k, 0)) >= bound for k, r in keys[i].items())


# decontamination


def test_decontamination_finds_what_the_alignment_of_all_pairs_finds(spark):
    rng = random.Random(3)
    said = [f"v{i}" for i in range(400)]
    items = [(i, rng.choices(said, k=rng.choice((8, 16, 25, 40)))) for i in range(12)]
    changed = {
        "few": lambda w: [rng.choice(said) if rng.random() < 0.1 else x for x in w],
        "more": lambda w: [rng.choice(said) if rng.random() < 0.2 else x for x in w],
        "many": lambda w: [rng.choice(said) if rng.random() < 0.33 else x for x in w],
        "third": lambda w: ["other" if i % 3 == 2 else x for i, x in enumerate(w)],
        "longer": lambda w: [y for x in w for y in ([x, rng.choice(said)] if rng.random() < 0.4 else [x])],
        "shorter": lambda w: [x for x in w if rng.random() > 0.25],
        "half": lambda w: w[: len(w) // 2 + 2],
    }
    docs, n = [], 0
    for change in changed.values():
        for _, w in items:
            n += 1
            docs.append((n, " ".join([*rng.choices(said, k=30), *change(w), *rng.choices(said, k=rng.choice((5, 90)))])))
    want = set()
    for d, t in docs:
        for i, w in items:
            score = decontaminate.align(decontaminate.word_hashes(" ".join(w)), decontaminate.word_hashes(t))[0]
            if score >= decontaminate.LEAST * decontaminate.MATCH * len(w):
                want.add((d, i, round(score / (decontaminate.MATCH * len(w)), 6)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.score, 6)) for r in decontaminate.matches(frame(spark, docs), table).collect()}
    assert len(want) > 60 and got == want


def test_decontamination_of_repeats(spark):
    item = " ".join(f"q{i % 7}x{i}" for i in range(30))
    docs = frame(spark, [(1, item), (1, item), (2, f"{item} " * 40), (3, "same same same same"), (4, "two words"), (5, "two")])
    items = spark.createDataFrame([(1, item), (1, item), (2, "same " * 50), (3, "two words"), (4, "")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect())
    assert found == [(1, 1), (2, 1), (4, 3)]


# licences

MIT = next(t for n, k, t in licences.TEMPLATES if n == "MIT" and k == "text")
APACHE = next(t for n, k, t in licences.TEMPLATES if n == "Apache-2.0" and k == "header")
HELD = [
    (1, "see licensed_under_the_apache_license_version_2_0 ok"),
    (2, "Released_under_the_MIT_License."),
    (3, "Prose first here. More.\n\n" + MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. The software is", "Software.\n\nTHE SOFTWARE IS") + "\n\nAnd a tail of prose. It goes on."),
    (4, "Head words\n" + APACHE.replace(". ", ".\n") + "\nTail words here"),
    (5, f"x. {APACHE} y z."),
    (6, None),
    (7, ""),
    (8, "Licensed under the Apache License, Version 2.0. " * 60),
    (9, f"{MIT[:700]} and so on"),
    (9, "Released under the BSD License."),
]


def test_licences_inside_longer_texts_equal_sql(spark):
    got = sorted(tuple(r) for r in licences.matches(frame(spark, HELD)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", HELD)
    assert got == sorted(con.execute(licences.oracle_sql()).fetchall())
    best = {(i, n, k): d for i, n, k, d in got}
    assert best[1, "Apache-2.0", "notice"] == 0.875 and best[2, "MIT", "notice"] == best[3, "MIT", "text"] == best[4, "Apache-2.0", "header"] == 1.0


def test_gate_words_touch_enough_bigrams():
    chosen = set(licences.gate_words())
    for _, _, template in licences.TEMPLATES:
        pairs = licences.bigrams_of(template)
        free = sum(not chosen & set(p.split()) for p in pairs)
        # a match has two thirds of the bigrams, so it can't do with the untouched ones
        assert free < licences.LEAST / (2 - licences.LEAST) * len(pairs)


# pages


def test_pages_of_several_layouts_equal_a_plain_vote(spark):
    rng = random.Random(4)
    article = lambda n: " ".join(f"<p>{' '.join(rng.choices(['plain', 'words', 'of', 'text'], k=rng.randint(8, 20)))}</p>" for _ in range(n))
    layouts = [
        lambda: f'<body><div id="w"><div class="story-{rng.randrange(99)}">{article(3)}</div><div class="extra">{article(rng.choice((1, 1, 1, 6)))}</div></div></body>',
        lambda: f'<body><main><section class="lead">{article(1)}</section><section class="rest">{article(2)}</section></main><div class="box">{article(1)}</div></body>',
        lambda: f"<body><article>{article(2)}</article><div class='links'><p><a href='/'>{'link ' * 40}</a></p></div></body>",
    ]
    rows = [(i, f"https://Host{i % 4}.example/{i}", layouts[(i % 4 + (i % 7 == 0)) % 3]()) for i in range(80)] + [(90, "no url", "<p>alone</p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    votes = {}
    host = lambda u: (re.match(r"\w+://([^/]+)", u or "") or ["", ""])[1].lower()
    for _, u, h in rows:
        found = page_text.scores(page_text.parse(h or ""))
        for p, s in found.items():
            own = votes.setdefault(host(u), Counter())
            own[p] += s / sum(found.values()) if s else 0
    want = []
    for i, u, h in rows:
        own, text = votes.get(host(u), Counter()), ""
        if h:
            root = page_text.parse(h)
            has = {p: s for p, s in page_text.scores(root).items() if s > 0}
            ranked = sorted(((-round(v, 6), p) for p, v in own.items() if round(v, 6) >= 0.1 * sum(round(x, 6) for x in own.values())))
            paths = [p for k, (_, p) in enumerate(ranked) if p in has and not any(q.startswith(p + "/") for _, q in ranked[:k])]
            path = (paths or sorted(has, key=lambda p: (-has[p], p)) or [""])[0]
            text = page_text.text_under(root, page_text.widened(root, path))
        want.append((str(i), text, len(text)))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in page_text.extracted(pages).collect()) == sorted(want)
    own_best = [page_text.extract(h) for _, _, h in rows]
    assert [t for _, t, _ in want] != own_best


# quality, language, media, personal data


def test_rules_as_columns_hold_as_in_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((300, len(quality_rules.NAMES))).round(2)
    model = quality_rules.fit_rules(x, ((x[:, 1] > 0.4) & (x[:, 5] <= 0.6)).astype(int))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{n} double" for n in quality_rules.NAMES))
    got = [r[0] for r in rows.orderBy("i").select(model.score(F.struct(*quality_rules.NAMES))).collect()]
    want = 1 / (1 + np.exp(-(model.bias + sum(w * r.holds(x) for r, w in model.rules))))
    assert len(model.rules) > 3 and np.allclose(got, want)


def test_quality_of_one_label_value_and_repeats(spark):
    docs = frame(spark, [(1, "one text"), (1, "another text"), (2, None), (None, "x")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 0)], "doc_id long, quality int")
    scores = {round(r.score, 6) for r in quality_rules.scored(docs, quality_rules.fit(docs, labels, F.lit(True))).collect()}
    assert scores == {0.75}


@tables
def test_models_hold_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = language_id.fit(docs, ~held_out())
    said = language_id.predicted(docs, model).where(held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).select("lang", "lang_pred").collect()
    assert len(said) > 20 and sum(r.lang == r.lang_pred for r in said) >= 0.95 * len(said)
    rules = quality_rules.fit(docs, labels, ~held_out())
    rated = quality_rules.scored(docs, rules).join(labels, "doc_id").where(held_out()).select("score", "quality").collect()
    assert len(rated) > 10 and sum((r.score >= 0.3) == r.quality for r in rated) >= 0.85 * len(rated)


def plain_counts(text):
    """n-grams as strings, hashed by the definition."""
    chars = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            g = chars[i : i + n]
            if not g.strip():
                continue
            h = 0
            for c in g:
                h = (h * 0x01000193 + ord(c)) % 2**32
            out[(h + n) * 0x9E3779B1 % 2**32 >> 17] += 1
    return out


def test_language_counts_and_training_equal_plain_versions():
    for text in ("Der Fluß, die Stadt: 12 Häuser²!", "  a  ", "日本語 text \U00031350", "x" * 50, ""):
        at, n = language_id.counts(text)
        got = Counter(dict(zip(at.tolist(), n.tolist())))
        want = plain_counts(text)
        assert {k: v for k, v in want.items() if v} == dict(got), text
    rng, k = random.Random(1), 3
    rows = [(np.array(sorted(rng.sample(range(40), 6))), np.array([rng.randint(1, 4) for _ in range(6)]), rng.randrange(k)) for _ in range(30)]
    idf = np.ones(language_id.BUCKETS)
    model = language_id.train(rows, list("abc"), idf, rounds=1)
    z, n = Counter(), Counter()

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= 0.02 else -(z[i, c] - math.copysign(0.02, z[i, c])) / ((1 + math.sqrt(n[i, c])) / 0.5 + 0.02)

    for r, (at, c, label) in enumerate(rows):
        if r % 10 == 0:
            continue
        x = {int(a): 1 + math.log(b) for a, b in zip(at, c)}
        size = math.sqrt(sum(v * v for v in x.values()))
        x = {a: v / size for a, v in x.items()} | {language_id.BUCKETS: 1.0}
        w = {(a, j): weight(a, j) for a in x for j in range(k)}
        s = [sum(v * w[a, j] for a, v in x.items()) for j in range(k)]
        p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
        for a, v in x.items():
            for j in range(k):
                g = v * (p[j] - (j == label))
                z[a, j] += g - (math.sqrt(n[a, j] + g * g) - math.sqrt(n[a, j])) / 0.5 * w[a, j]
                n[a, j] += g * g
    assert all(abs(model.weights[a, j] - weight(a, j)) < 1e-9 for a in range(40) for j in range(k))
    assert all(abs(model.bias[j] - weight(language_id.BUCKETS, j)) < 1e-9 for j in range(k))


def test_language_of_texts_without_letters_and_rare_languages(spark):
    rows = [(i, f"the house and the river {i}", "en") for i in range(400)] + [(400 + i, f"das haus und der fluss {i}", "de") for i in range(3)]
    rows += [(500 + i, t, "en") for i, t in enumerate(("²", "½ ①", "Ⅷ 12", "_ _"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 500"), F.lit(True), sample_rows=40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(500, 504)) and got[401][0] == "de" and got[7][0] == "en"


def test_damaged_headers_give_no_failure(spark):
    good = media_columns.encode(b"x" * 192)

    def with_header(body, rest=good[33:]):
        return media_columns.SIGNATURE + media_columns._chunk(b"IHDR", body) + rest

    bomb = media_columns._chunk(b"IDAT", zlib.compress(b"\0" * 10_000_000)) + media_columns._chunk(b"IEND", b"")
    head = lambda w, h, *rest: struct.pack(">IIBBBBB", w, h, *(rest or (8, 0, 0, 0, 0)))
    bad = [with_header(head(192, 1)[:12]), with_header(head(192, 0)), with_header(head(0, 1)), with_header(head(192, 2)), with_header(head(192, 1, 16, 0, 0, 0, 0)), with_header(head(192, 1), bomb), b"", None]
    rows = spark.createDataFrame([(i, 1, b) for i, b in enumerate([*bad, good])], "doc_id long, n_bytes long, media binary")
    assert [r.ok for r in media_columns.features(rows).orderBy("doc_id").collect()] == [False] * len(bad) + [True]


def test_cosine_terms_equal_the_definition():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (64, 96)).astype(np.uint8)
    small = image.reshape(32, 2, 32, 3).mean(axis=(1, 3))
    terms = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            cu, cv = (math.sqrt((1 if t == 0 else 2) / 32) for t in (u, v))
            terms[u, v] = cu * cv * sum(small[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32))
    flat = terms.round(6).ravel()
    bits = "".join("1" if t > np.median(flat[1:]) else "0" for t in flat)
    assert media_columns.feature(image) == f"{int(bits, 2):016x}"


def test_overlapping_candidates_go_to_the_likeliest_kind(spark):
    texts = [f"pay to iban DE893704004405320130{i:02d} please" for i in range(40)] + [f"token = ghp_{'aB3dE5' * 4}{i:02d} end" for i in range(40)]
    docs = frame(spark, enumerate(texts)).withColumns({"pii_base": F.lit(1), "start": F.lit(2), "span": F.lit(3)})
    weights = personal_data.train(personal_data.vote_counts(docs))
    made = personal_data.with_spans(docs, weights, names=("b", "s"))
    got = {r.doc_id: r for r in made.select("doc_id", "pii_base", "start", "span", personal_data.written(F.col("s")).alias("w")).collect()}
    assert all(got[i].w == "iban:12:34" for i in range(40)) and all(got[i].w.startswith("secret:8:") for i in range(40, 80))
    assert (got[0].pii_base, got[0].start, got[0].span) == (1, 2, 3)


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    said = {"en": "the house and the river of that town were with", "de": "das haus und der fluss der stadt waren nicht mit"}
    own = ("score", "lang_pred", "lang_score", "pii_base", "pii_spans", "stats", "words", "lines", "component", "item", "class_id", "h", "doc", "m")
    rows = [(i, f"{said[g]} " + " ".join(f"u{i}x{j}" for j in range(30)), g, "s", 10, *(f"{c}{i}" for c in own)) for i in range(60) for g in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
    left = docs.collect()
    assert len(left) == 59 and all(r[c] == f"{c}{r.doc_id}" for r in left for c in own)
    rated = quality_rules.scored(docs, quality_rules.RuleModel(0.0), name="quality")
    assert rated.columns == [*docs.columns, "quality"] and {(r.stats, r.words, r.score) for r in rated.where("doc_id = 5").collect()} == {("stats5", "words5", "score5")}
