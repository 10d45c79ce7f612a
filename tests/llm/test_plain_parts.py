"""Parts that need no Spark, against brute force or the public libraries."""

import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from prosegauge.llm import decontaminate, language_id, licences, near_dedup, page_text, personal_data, piece_codec, quality_rules
from prosegauge.llm import media_columns as M

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "▁", "\n", "\t", "a", "b", "é", "the", " the", "日", "😀", "1", "20", ".", "...", "\0x", "<s>", "</s>", "<0x41>", " " * 11, "A", "Ü", "//", "==", "ing", "ß", "Hello"]


def random_texts(n, seed=3, most=30):
    rng = random.Random(seed)
    return ["", " ", *("".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n))]


def test_pieces_equal_the_library():
    codec, library = piece_codec.Codec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*random_texts(2500), *(" " * n for n in range(1, 60)), "word " * 2000]
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids == library.encode(text), text
        assert codec.encode(text) == ids
        assert codec.decode([*ids, codec.end]) == library.decode([*ids, codec.end])
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_png_round_trip_of_every_filter_and_damage():
    rng = np.random.default_rng(1)
    for rows in (1, 2, 7):
        payload = rng.integers(0, 256, rows * M.WIDTH).astype(np.uint8).tobytes()
        for kind in (*M.FILTERS, "adaptive"):
            assert M.decode(M.encode(payload, filter_kind=kind, idat_bytes=100)).tobytes() == payload
    data = M.encode(payload)
    for at in (3, 20, 60, len(data) - 2):
        broken = bytearray(data)
        broken[at] ^= 255
        with pytest.raises(M.BadImage):
            M.decode(bytes(broken))
    with pytest.raises(M.BadImage):
        M.decode(data[:-5])
    assert zlib.crc32(b"IEND") == int.from_bytes(data[-4:], "big")


def test_cosine_hash_is_stable_under_small_changes():
    image = np.kron(np.random.default_rng(8).integers(0, 240, (16, 24)), np.ones((4, 8))).astype(np.uint8)
    near = image.copy()
    near[10, 10] ^= 8
    differ = bin(int(M.feature(image), 16) ^ int(M.feature(near), 16)).count("1")
    assert differ <= 4 and len(M.feature(np.full((1, 192), 32, np.uint8))) == 16


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    agree = lambda a, b, w=None: (lambda s: (s[0] == s[1]).mean())(near_dedup.signatures([a, b], w))
    assert agree(base, base) == 1.0
    assert abs(agree(base, base[:240]) - 0.8) < 0.1
    assert abs(agree(base, base, [np.full(len(base), 2.0), np.full(len(base), 5.0)]) - 0.4) < 0.12
    one = np.array([7], np.uint64)
    assert agree(one, one) == 1.0 and not (near_dedup.signatures([one])[0] == 0xFFFFFFFF).all()


def test_shingles():
    assert len(near_dedup.shingles("")) == 0 and len(near_dedup.shingles("one, two")) == 1
    assert (near_dedup.shingles("One two THREE four five six") == near_dedup.shingles("one two three; four five six!")).all()
    assert len(near_dedup.shingles("a b c d e f g")) == 3


def test_alignment_equals_smith_waterman():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(5)
    for _ in range(150):
        a, b = rng.integers(0, 5, rng.integers(0, 15)), rng.integers(0, 5, rng.integers(0, 25))
        assert decontaminate.align(a, b)[0] == plain(a, b)
    assert decontaminate.align(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (6, 1, 4)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="post-12 content"><h2>Title &amp; more</h2><p>First&nbsp; para
with <a href=x>link</a> and<br>break.<p>Second <b>para</b> &lt;b&gt;.<div class="ad">BUY</div><script>var t="</p>";</script><ul><li>one<li>two</ul>
<form>Search <input></form></div><aside>side</aside><div id="comments"><p>I like this text very much indeed, thanks a lot for it all!</p></div><footer>&copy; x</footer>"""


def test_page_text():
    want = "Title & more\nFirst para with link and break.\nSecond para <b>.\none\ntwo"
    assert page_text.extract(PAGE) == want
    assert page_text.extract(None) == "" and page_text.extract("<script>x</script>") == ""
    path = page_text.best_paths(page_text.parse(PAGE))[0][0]
    assert path.endswith("/div.content.post") and page_text.extract(PAGE, [path]) == want
    for broken in ("<", "<a", "</p>x", "<!-- x", "<p", "<div><div><p>x", "&am", "<p class='>x", "<td>a<td>b"):
        assert isinstance(page_text.extract(broken), str)
    deep = "<div>" * 3000 + "text" + "</div>" * 10
    assert page_text.extract(deep) == "text"
    assert html.unescape("&am") == page_text.extract("<p>&am</p>")


def test_page_text_keeps_heading_lead_and_all_sections():
    a, b, c = ("<p>" + f"{w} text goes on. " * n + "</p>" for w, n in (("Lead", 4), ("First", 40), ("Second", 30)))
    plain = lambda *parts: "\n".join(" ".join(x.removeprefix("<p>").removesuffix("</p>").split()) for x in parts)
    parts = f'<h1>Title</h1><div class="lead">{a}</div><section class="a">{b}</section><section class="b">{c}</section>'
    side = '<div class="sidebar"><p>Other words.</p></div>'
    for page in (f"<body><article>{parts}</article>{side}</body>", f'<body><div class="content">{parts}{side}</div></body>', f"<main><h1>Title</h1><article>{parts.removeprefix('<h1>Title</h1>')}</article></main>"):
        path = next(p for p, _ in page_text.best_paths(page_text.parse(page)))
        assert page_text.extract(page) == page_text.extract(page, [path]) == plain("Title", a, b, c)


def test_page_text_keeps_titles_with_noise_words_in_their_ids():
    said = "Words of this part are many enough. " * 5
    ids = ("related-work", "search-algorithms", "binary-search", "http-headers", "social-security", "sharing-data", "market-share")
    parts = "".join(f'<section id="{i}"><h2 id="{i}">{i}</h2><p>{said}</p></section>' for i in ids)
    want = "\n".join(f"{i}\n{said.strip()}" for i in ids)
    assert page_text.extract(f"<article>{parts}</article>") == page_text.extract(f'<div class="content">{parts}</div>') == want
    assert page_text.extract(f'<article><h2 id="cookies">Cookies</h2><section id="cookies"><p>{said}</p></section></article>') == f"Cookies\n{said.strip()}"
    for noise in ("cookie-notice", "site-header", "related-posts", "social-links", "search-form", "comments-area", "main-nav", "ad-slot-3", "newsletter_signup", "share-buttons"):
        assert page_text.extract(f'<div class="content"><p>{said}</p><div class="{noise}">Other</div><div id="{noise}">Other</div></div>') == said.strip(), noise


def test_em_and_classifier_tell_real_from_false():
    counts = {("secret", 1, 0, 1, 0, 1): 50.0, ("secret", -1, 0, 0, 0, -1): 60.0, ("email", 1, 1, 0, 0, 0): 40.0}
    post = personal_data.em(counts)
    assert post["secret", 1, 0, 1, 0, 1] > 0.9 > 0.1 > post["secret", -1, 0, 0, 0, -1]
    assert personal_data.em({}) == {} and len(personal_data.train({})) == len(personal_data._inputs(("email", *([0] * 8))))


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((2000, len(quality_rules.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(int)
    model = quality_rules.fit_rules(x[:1500], y[:1500])
    said = model.bias + sum(w * r.holds(x[1500:]) for r, w in model.rules) > 0
    assert (said == y[1500:]).mean() > 0.95 and len(model.rules) < 150
    assert quality_rules.fit_rules(x[:0], y[:0]).rules == []


def test_language_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Das ist ein Satz, der lang genug ist. " * 20
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    parts = language_id.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_gate_words_cover_each_template():
    chosen = set(licences.gate_words())
    for _, _, template in licences.TEMPLATES:
        assert chosen & set(re.sub("[^a-z0-9]+", " ", template.lower()).split())
