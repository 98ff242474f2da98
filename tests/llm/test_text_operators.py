"""Text-level parts of the training-data operators against plain versions of them."""

import itertools
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from pressroom.llm import op1_toxicity as tox
from pressroom.llm import op2_decontaminate as dec
from pressroom.llm import op3_html as html3
from pressroom.llm import op4_warc as warc
from pressroom.llm import op5_substring as sub
from pressroom.llm import op6_quality as qual
from pressroom.llm import op7_simhash as sim
from pressroom.llm.common import Texts
from pressroom.llm.op8_tokens import Encoder

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql(f"SELECT d.doc_id, d.text, l.toxic, l.quality FROM '{SMALL}/documents.parquet' d "
                      f"JOIN '{SMALL}/labels.parquet' l USING (doc_id) ORDER BY doc_id").fetchall()
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    return train, test


# --- 1 toxicity --------------------------------------------------------------
def symbol_rows(words):
    out = np.full((len(words), tox.LONGEST), -1, np.int8)
    for k, w in enumerate(words):
        codes = tox.SYMBOL[np.frombuffer(w.encode(), np.uint8)]
        out[k, :len(codes)] = codes
    return out


def brute_kernel(s, t):
    def feats(x):
        out = {}
        for i, j, k in itertools.combinations(range(len(x)), 3):
            out[x[i] + x[j] + x[k]] = out.get(x[i] + x[j] + x[k], 0.0) + tox.DECAY ** (k - i + 1)
        return out
    a, b = feats(s), feats(t)
    dot = lambda p, q: sum(v * q.get(g, 0.0) for g, v in p.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_kernel_equals_the_sum_over_subsequences():
    left, right = ["idiot", "banana", "abcabc", "trash"], ["idixot", "bananana", "cabcab", "thrash"]
    got = tox.against(symbol_rows(left), tox.explicit(symbol_rows(right)))
    want = [[brute_kernel(a, b) for b in right] for a in left]
    assert np.allclose(got, want, atol=1e-5)


def test_folded_weights_score_as_the_features_do():
    rows = symbol_rows(["idiot", "banana", "mississippi", "abc"])
    weights = np.random.default_rng(0).normal(size=tox.SYMBOLS ** 3)
    assert np.allclose(tox.decisions(rows, weights, 0.5), tox.explicit(rows) @ weights + 0.5, atol=1e-3)


def test_units_join_letters_apart_and_cut_long_words():
    texts = pa.array(["you i d i o t now", "x" * 40, "", None, "...", 'he said "scum".'])
    symbols, rows = tox.units(Texts(texts))
    words = ["".join(chr(97 + c) if 0 <= c < 26 else "?" for c in r if c >= 0) for r in symbols]
    got = {k: {w for w, r in zip(words, rows) if r == k} for k in range(6)}
    assert "idiot" in got[0] and "scum" in got[5]
    assert got[1] == {"x" * tox.LONGEST} and not got[2] and not got[3] and not got[4]


def test_toxicity_on_held_out_rows(labelled):
    train, test = labelled
    model = tox.Model.from_bytes(tox.fit(pa.array([r[1] for r in train]), np.array([r[2] for r in train])).to_bytes())
    score = model.scores(pa.array([r[1] for r in test]))
    truth, said = np.array([r[2] for r in test]), score >= tox.THRESHOLD
    assert (said == truth).mean() >= 0.93
    assert said[truth == 0].mean() <= 0.02
    assert ((0 <= score) & (score <= 1)).all()


def gapped_training():
    rng = random.Random(4)
    syll = ["the", "ing", "er", "an", "on", "re", "ti", "ou", "ha", "at", "en", "nd", "st", "es"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
    texts, labels = [], []
    for k in range(600):
        words = [word() for _ in range(30)]
        if k % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "scumbag"])
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, np.array(labels)


def test_gapped_insults_are_met():
    texts, labels = gapped_training()
    model = tox.fit(pa.array(texts), labels)
    clean = "the nder haoust tion erating the onest ander"
    spelt = ["idiot", "idiiot", "i d i o t", "mor-on", "scum.bag", "IDIOT!", "scummbag"]
    assert (model.scores(pa.array([f"{clean} {w} ater" for w in spelt])) >= tox.THRESHOLD).all()
    assert (model.scores(pa.array([clean, "", None, "a", "Thenderen onesting haaten"])) < tox.THRESHOLD).all()


def test_insults_spelt_with_signs_or_inside_long_words_are_met():
    texts, labels = gapped_training()
    swap = {"idiot": "pathetic", "moron": "worthless", "scumbag": "moron"}
    texts = [" ".join(swap.get(w, w) for w in t.split(" ")) for t in texts]
    model = tox.fit(pa.array(texts), labels)
    clean = "the nder haoust tion erating the onest ander"
    spelt = ["p-a-t-h-e-t-i-c", "w.o.r.t.h.l.e.s.s", "m*o*r*o*n", "w o r t h l e s s", "p - a - t - h - e - t - i - c",
             "haoustworthlesshaoust", "enpatheticering", "path-etic", "wor.thl.ess"]
    assert (model.scores(pa.array([f"{clean} {w} ater" for w in spelt])) >= tox.THRESHOLD).all()
    assert (model.scores(pa.array([clean, "on-er-re ti/ou/ha a - t - e", "Thenderen-onesting haaten"])) < tox.THRESHOLD).all()


def test_every_stretch_of_a_long_word_is_a_unit():
    word = "abcdefghijklmnopqrstuvwxyz"
    for text in (word, "-".join(word), " ".join(word)):
        got = {"".join(chr(97 + c) for c in r if c >= 0) for r in tox.units(Texts(pa.array(["x", text])))[0]}
        assert {word[k:k + tox.LONGEST] for k in range(len(word) - tox.LONGEST + 1)} <= got


def test_stretches_have_the_units_of_the_whole_text():
    draw = random.Random(8)
    kinds = [lambda: "".join(draw.choice("abcdé9") for _ in range(draw.randint(1, 9))),
             lambda: " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 400))),
             lambda: "".join(draw.choice("abcdefgh0ü-.*") for _ in range(draw.randint(100, 900)))]
    for _ in range(60):
        pick = draw.choice([kinds, kinds[:1], kinds[1:2], kinds[2:]])
        data = Texts(pa.array([draw.choice([" ", "\n", "  "]).join(draw.choice(pick)() for _ in range(40))])).data
        parts = list(tox.stretches(data, 512))
        assert len(parts) > 1 or len(data) <= 512
        assert max(map(len, parts)) <= 512
        whole = set(map(bytes, tox.units(Texts.of_bytes(data))[0]))
        assert set().union(*(map(bytes, tox.units(Texts.of_bytes(x))[0]) for x in parts)) == whole


def test_long_rows_beside_short_ones_score_as_alone_and_in_bounded_memory():
    rng = np.random.default_rng(2)
    model = tox.Model(rng.normal(size=tox.SYMBOLS ** 3), -0.1, 1.0, 0.0)
    blob = bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8), 300_000)).decode()
    texts = ["one two three", blob, "", None, "four - five", blob[:70_000], "s i x"]
    alone = [float(model.scores(pa.array([t], pa.string()))[0]) for t in texts]
    tracemalloc.start()
    got = model.scores(pa.array(texts, pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, alone) and peak < 100 << 20
    whole = tox.decisions(tox.distinct(tox.units(Texts(pa.array([blob])))[0])[0], model.folded, model.bias).max()
    assert np.isclose(got[1], 1 / (1 + np.exp(-whole)))


def test_toxicity_without_labels_or_with_one_class():
    for labels in ([], [0, 0], [1, 1]):
        model = tox.fit(pa.array(["some words here"] * len(labels), pa.string()), np.array(labels, int))
        got = model.scores(pa.array(["idiot", None, ""]))
        assert len(set(got.tolist())) == 1 and 0 <= got[0] <= 1


# --- 2 decontamination -------------------------------------------------------
def brute_tiles(item, doc, least):
    """Greedy string tiling by looking at all pairs of positions."""
    fi, fd, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, at = 0, None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and fi[i + n] and fd[d + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, d)
        if best < least:
            return out
        i, d = at
        fi[i:i + best] = [False] * best
        fd[d:d + best] = [False] * best
        out.append((i, d, best))


def test_tiles_equal_the_plain_greedy_ones():
    rng = random.Random(8)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
        doc = [rng.randrange(4) for _ in range(rng.randrange(0, 30))]
        got = dec.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 2)
        assert got == brute_tiles(item, doc, 2), (item, doc)


def test_reordered_and_edited_passages_are_found():
    words = [f"w{k}" for k in range(40)]
    block = dec.Block.of([1, 2, 3], [" ".join(words), "one two", None], 5)
    hit = lambda text: [block.ids[k] for _, k, _ in block.pairs(pa.array([text]), 0.6)]
    assert hit("x y " + " ".join(words[20:]) + " and then " + " ".join(words[:20]) + " z") == [1]
    assert hit(" ".join(w.upper() + "," for w in words)) == [1]
    assert hit(" ".join(words[:20])) == []      # half of it only
    assert hit("here is One, two.") == [2]      # below five tokens an item must be whole
    assert hit("one more two") == [] and hit("") == [] and hit(None) == []


# --- 3 HTML ------------------------------------------------------------------
PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body class="has-sidebar"><div id="cookie-notice">We use cookies on this site to give you the best experience of all.</div>
<header><h1><a href="/">Site</a></h1><ul class="menu"><li><a href=/a>A</a><li><a href=/b>B</a></ul></header>
<div class="layout"><article><h1>My title &eacute; &#337;</h1><!-- note --><p>First para with <a href="x">link</a> and 1 &lt; 2
words that go on for some while to be long enough.<p>Second   para &amp; more text that is long enough to count
as content of the page.<div class="ad-banner">Buy now! this advert has so many words that it looks like a text.</div>
<form action=/x><input name=q><button>Send</button> your address please</form><p>Ok.</article>
<section id="comments"><p>A reader comment that is quite long and has many many words in it.</p></section>
<aside><p>Some long sidebar text with many words to confuse the ratio of lines here.</p></aside></div>
<footer>&copy; 2020 x</footer></body></html>"""


def test_main_text_of_a_page_with_everything_around_it():
    assert html3.main_text(PAGE).split("\n") == [
        "My title é ő", "First para with link and 1 < 2 words that go on for some while to be long enough.",
        "Second para & more text that is long enough to count as content of the page.", "Ok."]


def test_main_text_of_odd_input():
    assert html3.main_text(None) == "" and html3.main_text("") == "" and html3.main_text("<nav>x</nav>") == ""
    assert html3.main_text("plain text") == "plain text"
    assert html3.main_text("<p>one<p>two") == "one\ntwo"
    long = "word " * 200_000
    assert html3.main_text(f"<article><p>{long}</p></article>") == long.strip()
    cut = html3.main_text("<body><article><p>Some text that goes on and is then cut off <a hre")
    assert cut.startswith("Some text that goes on")


def test_main_text_of_every_small_page():
    import html
    for page, raw in duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", raw, re.S).group(1)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<!--.*?-->|<[^>]+>", "", b.replace("<br>", " "), flags=re.S))).strip()
                  for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        assert html3.main_text(raw) == "\n".join(b for b in blocks if b), page


LONG_BODY = [f"Paragraph {k} with a good many words in it so that it is long enough to be text." for k in range(40)]


@pytest.mark.parametrize("before, after", [
    ("<main><article>", "</article></main>"), ("<article>", "</article>"), ("<main>", "</main>"),
    ("<div role=main>", "</div>"), ("<div>", "</div>"), ("<main><article><p>x</p></article><article>", "</article></main>")])
@pytest.mark.parametrize("n", [1, 4, 40])
def test_main_text_keeps_what_stands_outside_a_long_body(before, after, n):
    body = "".join(f"<p>{x}</p>" for x in LONG_BODY[:n])
    for inner, outer in (("div class=body", "div"), ("section", "section")):
        page = f"<body><nav><a href=/>Home</a></nav>{before}<section><h1>The headline</h1><p class=lead>A lead of some words.</p>" \
               f"</section><{inner}>{body}</{outer}>{after}<footer>f</footer></body>"
        assert html3.main_text(page).split("\n") == ["The headline", "A lead of some words.", *LONG_BODY[:n]]


def test_main_text_keeps_linked_lines_of_the_article():
    body = "".join(f"<p>{x}</p>" for x in LONG_BODY)
    page = f"<main><h1>Above it</h1><article><h2><a href=x>All linked</a></h2><div>{body}</div><p><a href=y>Source</a></p></article>" \
           "<a href=z>More</a></main><p>Beside it</p>"
    assert html3.main_text(page).split("\n") == ["Above it", "All linked", *LONG_BODY, "Source"]
    long = " ".join(LONG_BODY)
    assert html3.main_text(f"<body><article>{long}</article><p>Beside it</p></body>") == long


def test_smoothing_keeps_constants():
    assert html3.smoothed([2.0] * 9, 1.0) == pytest.approx([2.0] * 9)


# --- 4 WARC ------------------------------------------------------------------
def test_chunked_framing_round_trip():
    for body in (b"", b"x", b"\r\n0\r\n\r\n" * 50, bytes(range(256)) * 99):
        assert warc.dechunked(warc.chunked(body, 100)) == body
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_records_round_trip():
    import gzip
    import io
    payload = "é\r\n\r\n".encode() * 700
    raw = b"".join(gzip.compress(r) for r in warc.records(7, "http://a/\r\nx", payload, None, False, 1000))
    got = list(warc.read_records(io.BytesIO(raw)))
    assert [h["WARC-Type"] for h, _ in got] == ["response"] + ["continuation"] * (len(got) - 1) and len(got) > 3
    assert [int(h["WARC-Segment-Number"]) for h, _ in got] == list(range(1, len(got) + 1))
    assert len({h["WARC-Segment-Origin-ID"] for h, _ in got[1:]} | {got[0][0]["WARC-Record-ID"]}) == 1
    block = b"".join(b for _, b in got)
    assert int(got[-1][0]["WARC-Segment-Total-Length"]) == len(block)
    assert warc.dechunked(block.partition(b"\r\n\r\n")[2]) == payload
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[:-30])))


# --- 5 substrings ------------------------------------------------------------
def test_gear_equals_the_rolling_form():
    data = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(sub._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert sub.gear(data).tolist() == want


def test_boundaries_depend_on_the_text_alone_and_survive_insertions():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghié") for _ in range(rng.randrange(1, 9))) for _ in range(900)]
    text = " ".join(words).encode()
    ends = sub.boundaries(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    assert sub._boundaries([b"other", text, b"", text], sub.REACH) == [[5], ends, [], ends]
    parts = lambda t, e: {t[a:b] for a, b in zip([0, *e], e)}
    other = b"some inserted words " + text[:2000] + b"more of them" + text[2000:]
    common = parts(text, ends) & parts(other, sub.boundaries(other))
    assert sum(map(len, common)) > 0.9 * len(text)
    for a in ends[:-1]:
        text[:a].decode()  # never within a character
    flat = sub.boundaries(b"a" * 5000)
    assert max(b - a for a, b in zip([0, *flat], flat)) <= sub.LONGEST


# --- 6 quality ---------------------------------------------------------------
def test_quality_on_held_out_rows(labelled):
    train, test = labelled
    model = qual.Model.from_bytes(qual.fit(pa.array([r[1] for r in train]), np.array([r[3] for r in train])).to_bytes())
    score = model.scores(pa.array([r[1] for r in test]))
    truth, said = np.array([r[3] for r in test]), score >= qual.THRESHOLD
    assert (said == truth).mean() >= 0.95
    assert len(set(model.scores(pa.array(["", None, "  \n"])).tolist())) == 1


def test_quality_score_is_a_sum_over_ngrams():
    model = qual.Model(np.random.default_rng(0).normal(size=1 << qual.BITS), 0.25)
    texts = pa.array(["One two, two!!", None, "x " * 50_000, "One two, two!!"])
    got = model.scores(texts)
    assert got[0] == got[3] and got[1] == pytest.approx(1 / (1 + np.exp(-0.25)))
    alone = np.array([model.scores(texts.slice(k, 1))[0] for k in range(4)])
    assert np.allclose(got, alone)


# --- 7 SimHash ---------------------------------------------------------------
def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    w = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + w]).encode(), 42) for i in range(len(words) - w + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one two", "É é X", "a b c d", "a b c a b c a b c"] + [
        " ".join(rng.choice(["Ab", "c", "dé", "ef", "g\nh", "i\x0bj"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    got = sim.fingerprints_of(pa.array(texts), 3)
    assert [int(x) & (1 << 64) - 1 for x in got] == [brute_fingerprint(t) for t in texts]


# --- 8 tokens ----------------------------------------------------------------
def test_pieces_encode_as_the_whole_text_does():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2, memory=300)
    rng = random.Random(1)
    alphabet = list(" \n\t.,'|<>!s  　 éa×Ωñ漢1²\x1c\x85́T’…—") + ["<|endoftext|>", "'s", "don't", "  ", " a", "word"]
    texts = ["", None] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["long words " * 20_000]
    flat, counts = encoder.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert flat[at:at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], repr(text)[:80]
        at += n
    assert at == len(flat)


@pytest.mark.parametrize("part,stays", [
    ('<h2 id="related-work">Part</h2>', True), ('<h2 id="comments-on-the-ruling">Part</h2>', True),
    ('<h2 id="toc-1">Part</h2>', True), ('<section id="search-for-life"><p>Part</p></section>', True),
    ('<section id="discussion"><p>Part</p></section>', True), ('<p class="legal-analysis">Part</p>', True),
    ('<p>a <span class="share">Part</span></p>', True), ('<div class="share">Part</div>', False),
    ('<div id="comments"><p>Part</p></div>', False), ('<section class="comments-list"><p>Part</p></section>', False),
    ('<div class="related-posts"><a href=x>Part</a></div>', False), ('<p class="advert">Part</p>', False),
    ('<ul id="related-by-topic"><li><a href=x>Part</a></ul>', False), ('<p>a <span class="ad">Part</span></p>', False)])
def test_main_text_judges_names_within_an_article(part, stays):
    around = "<p>" + "Some words of the article go on here. " * 8 + "</p>"
    text = html3.main_text(f"<body><article><h1>Head</h1>{around}{part}{around}</article></body>")
    assert ("Part" in text) is stays and text.count("Some words") == 16 and text.startswith("Head\n")


def test_main_text_of_deeply_unclosed_elements():
    for open_, n in (("<div>", 50_000), ("<li><b>", 50_000), ("<table><tr><td></span>", 20_000), ("<label></a>", 50_000)):
        begin = time.process_time()
        text = html3.main_text("<article>" + (open_ + "word here ") * n)
        assert time.process_time() - begin < 20
        assert len(text) in (0, 10 * n - 1)
