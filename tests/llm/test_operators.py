"""The operators in Spark: odd rows, empty tables, clashing columns, brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from prosegauge.llm import chat_format, decontaminate, language_id, licences, media_columns, near_dedup, page_text, personal_data, piece_codec, quality_rules
from prosegauge.llm.queries import PIECE_MODEL

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[i * 7 % 24] + str(i % 50) for i in range(300))
SCHEMA = "doc_id long, text string, lang string, id long, seed string, stats string, component long, a long, b long, item long, key long, h long, label string, n int"
CLASH = (5, "x", "y", 1, 2, 3, 4, 5, 6, "z", 7)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, *CLASH) for i, t, g in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    near = LONG.split()
    near[150] = "changed"
    far = LONG.split()
    far[::9] = ["other"] * len(far[::9])
    rows = [(1, LONG, "en"), (2, " ".join(near), "en"), (3, LONG, None), (4, None, "en"), (5, "", "en"), (6, "one two", "en"), (7, "One, two!", "en"), (8, " ".join(far), "en"), (8, " ".join(far), "en"), (9, "tiny " * 40_000, "en"), (None, "lonely words stand here", "en")]
    return documents(spark, rows)


def test_near_dedup(spark, odd):
    found = {(r.doc_id, r.class_id) for r in near_dedup.classes(odd.where("doc_id is not null")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 9)}
    left = near_dedup.kept(odd)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "6", "8", "8", "9", "None"] and left.columns == odd.columns
    assert near_dedup.kept(odd.limit(0)).count() == 0


def test_near_dedup_equals_brute_force_on_edited_copies(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    base, texts = [f"w{i}" for i in range(120)], []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            words[at] = f"e{rng.integers(0, 1000)}"
        texts.append(" ".join(words))
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    parent = list(range(60))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == {i: top(i) for i in range(60)}


def test_media(spark, odd):
    got = media_columns.features(media_columns.to_media(odd)).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        n, payload = media_columns.padded(texts[r.doc_id])
        assert r.ok and (r.n_bytes, r.payload_sha256) == (n, hashlib.sha256(payload).hexdigest())
    broken = media_columns.to_media(odd).withColumn("media", F.when(F.col("doc_id") == 1, F.lit(b"no image").cast("binary")).when(F.col("doc_id") != 2, F.col("media")))
    assert {r.doc_id for r in media_columns.features(broken).where("ok").collect()} == {3, 4, 5, 6, 7, 8, 9}
    assert media_columns.features(media_columns.to_media(odd.limit(0))).count() == 0


def brute_base(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(twice) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_personal_data(spark):
    import random

    rng = random.Random(5)
    bits = ["@", ".", "a", "b.c", "%", "_", "x@y.z", "+", "1", "22", "4111 1111 1111 1111", "-", " ", "0", "256", "1.2.3.4", "+49 (30) 123-4567", "é", "😀", "\n", "4785380592391139"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", "7 " * 20_000, "a" * 50_000 + "@"]
    texts += ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'] * 20 + ["plainwordplainwordplainword here"] * 20
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    weights = personal_data.train(personal_data.vote_counts(docs))
    got = {r.doc_id: r for r in personal_data.with_spans(docs, weights).select("doc_id", personal_data.written(F.col("pii_base")).alias("base"), personal_data.written(F.col("pii_spans")).alias("spans"), personal_data.masked(F.col("text"), F.col("pii_spans")).alias("masked")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base == brute_base(t or ""), t
        assert set(got[i].base.split(",")) <= set(got[i].spans.split(",")) | {""}
    assert got[len(texts) - 40].masked == 'token = "[SECRET]" end' and got[len(texts) - 1].masked.startswith("plainword")
    assert personal_data.vote_counts(docs.limit(0)) == {}


def test_licences(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    full = next(t for n, k, t in licences.TEMPLATES if n == "MIT" and k == "text")
    docs = documents(spark, [(1, f"Some words.\n{notice}\nMore words.", "en"), (2, f"Intro\n\n{full}\n\nEnd of it", "en"), (3, None, "en"), (4, "", "en"), (5, "no licence here at all, just a license word", "en"), (6, f"Talk first. {notice}", "en")])
    got = {(r.doc_id, r.licence, r.kind, r.dice) for r in licences.matches(docs).collect()}
    assert got == {(1, "Apache-2.0", "notice", 1.0), (2, "MIT", "text", 1.0), (6, "Apache-2.0", "notice", 1.0)}
    assert licences.matches(docs.limit(0)).count() == 0


def test_quality(spark):
    good, bad = "Plain words make a fair sentence of their own number {}. Another follows.", "JUNK!! | MORE!! | {} !!"
    docs = documents(spark, [(i, (good if i % 2 else bad).format(i), "en") for i in range(200)] + [(200, None, "en"), (201, "", "en"), (202, "x " * 30_000, "en")])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where("doc_id < 200")
    model = quality_rules.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality_rules.scored(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(200)) and all(0 <= s <= 1 for s in got.values()) and len(got) == 203
    none = quality_rules.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_rules.scored(docs, none).collect()} == {0.5}
    assert quality_rules.scored(docs.limit(0), model).count() == 0


def test_language(spark):
    said = {"en": "the house and the river of that town were with", "de": "das haus und der fluss der stadt waren nicht mit"}
    rows = [(i, f"{said[g]} {WORDS[i % 24]}", g) for i in range(120) for g in [("en", "de")[i % 2]]]
    docs = documents(spark, [*rows, (900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, said["en"] + " " + "the " * 50_000, "en"), (904, said["en"], None)])
    model = language_id.fit(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(docs, model).collect()}
    assert all(got[i][0] == g for i, _, g in rows) and {got[i] for i in (900, 901, 902)} == {("und", 0.0)} and got[903][0] == "en"
    nothing = language_id.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predicted(docs, nothing).collect()} == {"und"}


def test_chat(spark):
    hard = r"\### Assistant: </turn> ok <next/> \b\\t"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", ""), (1, 3, "a:b", None), (2, None, None, "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", "long " * 30_000)]
    talk = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, blocks string")
    made = chat_format.formatted(talk)
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, 3, 4):
        own = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in own))
        assert got[c].loss_sha256 == digest("".join(t for r, t in own if r == "assistant"))
    assert got[1].n_blocks == 3 and chat_format.read_back(chat_format.formatted(talk.limit(0))).count() == 0


def test_pages(spark):
    page = '<body><nav>menu</nav><div class="c{}"><p>The article text number {} is here and long enough.</p></div><div class="side"><p>{}</p></div></body>'
    rows = [(i, f"http://h.example/{i}", page.format(i, i, "Sidebar wins by length here. " * 4 if i == 0 else "s")) for i in range(8)] + [(90, None, "<p>alone</p>"), (91, "http://h.example/x", None), (92, "x", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in page_text.extracted(pages).collect()}
    # the host's path decides, also on the page whose sidebar is longer
    assert all(got[i] == f"The article text number {i} is here and long enough." for i in range(8))
    assert (got[90], got[91], got[92]) == ("alone", "", "")
    assert page_text.extracted(pages.limit(0)).count() == 0


def test_decontamination(spark):
    item = " ".join(WORDS[:20]) + " final words of the item stand here now"
    edited = item.split()
    edited[6], edited[13] = "swap", "other"
    del edited[20]
    other = "These unrelated words talk about the weather and the price of bread in town today"
    items = spark.createDataFrame([(1, item, "c"), (2, None, "c"), (3, other, "c"), (3, other, "c")], "item_id long, text string, doc string")
    docs = documents(spark, [(1, f"{LONG} {item} {LONG}", "en"), (2, f"before {' '.join(edited)} after", "en"), (3, LONG, "en"), (4, None, "en"), (5, "", "en"), (6, other, "en"), (6, other, "en"), (None, other, "en"), *((100 + i, f"filler {i} {item}", "en") for i in range(30))])
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect())
    assert found == sorted([(1, 1), (2, 1), (6, 3), *((100 + i, 1) for i in range(30))])
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items).collect()) == ["3", "4", "5", "None"]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), items).count() == 0


def test_decontamination_sees_many_edited_copies_beside_an_exact_one(spark):
    first, second = ([f"{WORDS[i % 24]}{i + k}" for i in range(40)] for k in (0, 50))
    edited = ["swapped" if i % 6 == 5 else w for i, w in enumerate(first)]
    texts = [(1, first), (2, second), *((10 + i, edited) for i in range(30)), *((100 + i, second[:24]) for i in range(30))]
    docs = documents(spark, [(i, f"filler {i} before {' '.join(t)} after", "en") for i, t in texts] + [(500, LONG, "en")])
    items = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second))], "item_id long, text string")
    want = {(1, 1), (2, 2), *((10 + i, 1) for i in range(30)), *((100 + i, 2) for i in range(30))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == want


def test_piece_frames(spark, odd):
    tokens = piece_codec.encoded(odd, PIECE_MODEL)
    back = sorted((str(r.doc_id), r.text) for r in piece_codec.decoded(tokens, PIECE_MODEL).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    both = {str(r.doc_id): r for r in piece_codec.round_trip(odd, PIECE_MODEL).collect()}
    assert both["4"].n_tokens == 1 and both["4"].ids_sha256 == hashlib.sha256(b"2").hexdigest()
    assert piece_codec.round_trip(odd.limit(0), PIECE_MODEL).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    said = {"en": "the house and the river of that town were with", "de": "das haus und der fluss der stadt waren nicht mit"}
    rows = [(i, f"{said[g]} {' '.join(f'{WORDS[(i * j + j) % 24]}{(i * 31 + j * 7) % 97}' for j in range(1, 40))}", g, "s", 10) for i in range(40) for g in [("en", "de")[i % 2]]]
    rows += [(100, rows[0][1], "en", "s", 1), (101, "1 2 3", "en", "s", 1), (102, f"{said['en']} mail me at a.b@example.com please", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 101 not in seen["language_id"] and 100 not in seen["near_dedup"] and 3 not in seen["decontamination"]
    assert len(seen["personal_data"]) >= 35 and "[EMAIL]" in seen["personal_data"][102]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["personal_data"])
