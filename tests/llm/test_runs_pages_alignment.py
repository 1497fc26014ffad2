"""Periodic runs, main text of pages and alignment of tokenizers against brute force."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
import tokenizers
from compare import differences, spark_rows

from loomgraph.llm import alignment, html_text, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, n_words long, pair string, runs string"


def plain_runs(w, min_words=24, repeats=3):
    """(start, length, period), by trying every period and place."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    n, a = rng.choice([0, 1, 5, 23, 24, 25, 60, 150, 400]), rng.choice([1, 2, 3, 20, 500])
    w = [rng.randrange(a) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 30 else 0):
        s, p = rng.randrange(n - 20), rng.randint(1, 40)
        for i in range(s + p, min(n, s + rng.randint(10, n))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize(("min_words", "repeats"), [(24, 3), (10, 2), (30, 5)])
def test_grid_finds_all_runs(min_words, repeats):
    rng = random.Random(min_words)
    texts = [random_words(rng) for _ in range(150)]
    with np.errstate(over="ignore"):
        text, *rest = runs.find([np.array(w, np.uint64) * np.uint64(11400714819323198485) + np.uint64(7) for w in texts], min_words, repeats)
    for i, w in enumerate(texts):
        assert sorted(zip(*(x[text == i].tolist() for x in rest), strict=True)) == plain_runs(w, min_words, repeats)


def test_pairs_of_the_grid_come_in_parts(monkeypatch):
    w = np.arange(600, dtype=np.uint64) % np.uint64(50)
    whole = [x.tolist() for x in runs.find([w, w[:100]], 24, 3)]
    monkeypatch.setattr(runs, "MAX_PAIRS", 7)
    assert [x.tolist() for x in runs.find([w, w[:100]], 24, 3)] == whole == [[0], [0], [600], [50]] or len(whole[0]) == 1


def test_runs_of_awkward_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t\x0b ", "x", "a " * 30, "a\tb\nc " * 20 + "d", "é日 " * 40, " ".join(map(str, random_words(rng))), ("long " * 3 + "er ") * 6000] + ["the same text again " * 10] * 3
    rows = [(i if i else None, t, 7, "x", "y") for i, t in enumerate(texts)]
    got = runs.periodic_runs(spark.createDataFrame(rows, CLASHING), keep=("doc_id", "pair")).collect()
    assert len(got) == len(rows)
    for r, t in zip(sorted(got, key=lambda r: r.doc_id or 0), texts, strict=True):
        w = WORD.findall(t or "")
        short = w if len(w) < 5000 else w[:2000]
        found = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(w)
        if short is w:
            assert sorted(found) == plain_runs(w) and found == sorted(found, key=lambda x: (x[0], x[2]))
        else:
            assert found == [(0, len(w), 4)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert runs.periodic_runs(spark.createDataFrame([], CLASHING)).collect() == []
    with pytest.raises(ValueError, match="twice"):
        runs.periodic_runs(spark.createDataFrame([], CLASHING), repeats=1)


def plain_op12(i, t):
    w = WORD.findall(t or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "doc_id": i, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if found else None,
        "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), "collapsed_sha256": sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    }


def test_op12_on_a_table(spark, sf_dir):
    """The registered query over all documents, against trying every period."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.asDict() for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in rows} and sum(r["n_runs"] > 0 for r in got.values()) > 5
    for r in rows:
        assert got[r.doc_id] == plain_op12(r.doc_id, r.text)


# --- Pages ----------------------------------------------------------------------


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain, edges = [rng.randint(-9, 9) for _ in range(n)], [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda s, gain=gain, edges=edges: sum(abs(g) for g, own in zip(gain, s, strict=True) if own != (g > 0) and g) + sum(c for a, b, c in edges if s[a] != s[b])
        assert cost(html_text.min_cut(gain, edges)) == min(map(cost, itertools.product((True, False), repeat=n)))


def test_cut_of_a_long_chain():
    n = 20_000
    side = html_text.min_cut([5 if i % 50 == 0 else -1 if i > n // 2 else 0 for i in range(n)], [(i, i + 1, 2) for i in range(n - 1)])
    assert len(side) == n and side[0]


def test_classifier_on_pages_held_out():
    weights = np.array(html_text.fit())
    right = wrong = 0
    for page, article in html_text.labelled_pages(300, 99):
        got = html_text.article_blocks(page, weights)
        right += got == article
        wrong += len(set(got) ^ set(article))
    assert right >= 0.93 * 300 and wrong < 0.15 * 300


def test_op11_equals_sql(spark, sf_dir):
    assert differences(queries.op11_html_extraction(spark, sf_dir), queries.SQL["op11_html_extraction"], sf_dir) == ""


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We keep your settings, if you agree to it.</p><button>Agree</button></div>
<main><article class="post"><header><h1>A&nbsp;title &amp; more</h1></header><p>First   paragraph with
some <b>bold</b> words, &lt;escaped&gt; ones and a <a href="/x">link</a> inside it.<p>Second paragraph, &#233;t&eacute;.<script>var t = "</p><p>no</p>";</script></p>
<div class="ad">Buy this now, it is cheap.</div><!-- <p>not this</p> --><p>Yes.</p><blockquote>And a longer quotation that closes the whole article.</blockquote></article>
<section id="comments"><article class="comment"><p>I have read it and this is what I think about it.</p></article></section></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Three</a></li></ul></aside><form><label>Your mail</label><input name=a><textarea>typed</textarea></form>
<footer>&copy; Site</footer></body></html>"""
ARTICLE = "A title & more\nFirst paragraph with some bold words, <escaped> ones and a link inside it.\nSecond paragraph, été.\nYes.\nAnd a longer quotation that closes the whole article."


def test_awkward_pages(spark):
    text = "A sentence of the article, as long as such sentences are. " * 3
    deep = "<div>" * 3000 + f"<p>{text}</p>" + "</div>" * 3000
    odd = [None, "", "   ", "no tags at all", "<", "<p", "<script>never closed <p>x</p>", f"<article><p>{text}</p><!-- open <p>gone</p>", PAGE, deep, "<article>" + f"<p>{text}</p>" * 3000, "<nav><a href='/'>Only</a></nav><footer>links</footer>"]
    rows = [(i, h, "u", "clash", 3) for i, h in enumerate(odd)] + [(8, PAGE, None, None, None), (None, PAGE, "u", "", 1)]
    frame = spark.createDataFrame(rows, "page_id long, html string, url string, text string, n_chars int")
    got = html_text.extract(frame).collect()
    assert len(got) == len(rows)
    own = {r.page_id: r.text for r in got}
    assert [own[i] for i in (0, 1, 2, 6, 11)] == [""] * 5
    assert own[7] == own[9] == text.strip() and own[10] == "\n".join([text.strip()] * 3000)
    assert [r.text for r in got if r.page_id in (8, None)] == [ARTICLE] * 3
    assert html_text.extract(spark.createDataFrame([], frame.schema)).collect() == []


def test_layouts_without_an_article_element():
    weights = np.array(html_text.fit())
    body = ["A headline of the story", "A first paragraph that goes on for some time, as paragraphs of stories do.", "Short.", "A second one that is not much shorter than the first paragraph was, and ends here."]
    marked = f"<h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:])
    for open_, close in (('<div id="content">', "</div>"), ('<div class="entry-body">', "</div>"), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<main>", "</main>")):
        page = f'<body><div class="topnav"><a href="/">Home</a> <a href="/n">News</a></div>{open_}{marked}{close}<div class="footer">&copy; us</div></body>'
        assert html_text.article_blocks(page, weights) == body


# --- Tokens ---------------------------------------------------------------------


def plain_alignment(rows):
    """Each text encoded whole by both libraries; groups by walking both token lists."""
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment._byte_of_letter()
    docs = []
    for i, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs = [bytes(letters[c] for c in a.id_to_token(t)) for t in x]
            ys = [bytes([int(b.id_to_piece(t)[3:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
            if b"".join(xs) == (" " + text).encode() == b"".join(ys):
                m = n = 0
                own_x, own_y, x, y, xs, ys = [], [], x[::-1], y[::-1], xs[::-1], ys[::-1]
                while x or y:
                    if m <= n:
                        m += len(xs.pop())
                        own_x.append(x.pop())
                    else:
                        n += len(ys.pop())
                        own_y.append(y.pop())
                    if m == n:
                        groups.append((own_x, own_y))
                        own_x, own_y = [], []
        docs.append((i, groups))
    count, most = defaultdict(int), defaultdict(int)
    links = lambda groups: [(p, q) for xs, ys in groups for p in xs for q in ys]
    for _, groups in docs:
        for pair in set(links(groups)):
            count[pair] += 1
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for i, groups in docs:
        held = links(groups)
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((sum(count[x] for x in held), i, hashlib.sha256(said.encode()).hexdigest() if groups else "", sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), sum(count[x] == most[x[0]] for x in held), len(groups), len(held)))
    return sorted(out, key=str)


NAMES = ["count_sum", "doc_id", "groups_sha256", "n_a", "n_b", "n_best", "n_groups", "n_links"]


def check_alignment(df, rows):
    names, got = spark_rows(df)
    assert names == NAMES and sorted(got.elements(), key=str) == plain_alignment(rows)


def test_op13_on_a_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_alignment(queries.op13_token_alignment(spark, sf_dir), rows)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_awkward_texts(spark, monkeypatch, small):
    """White space of all kinds, special tokens' strings, U+2581, byte fallback, copies and nulls; in small blocks, with little kept."""
    if small:
        monkeypatch.setattr(alignment, "BLOCK_CHARS", 200)
        monkeypatch.setattr(alignment, "MAX_UNITS", 30)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "▁", " ", "1", "!", "'s", "<|endoftext|>", "</s>", "\x00", "​", "﻿", "\x85", " ", "\x1c", "😀", "Ab", "the ", "\r\n", "᠎", "é", "Hello", " world", "..."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(700)]
    rows += [(5, "the same"), (5, "the same"), (None, "the same"), (1000, None), (1001, ""), (1002, " "), (1003, "word " * 20_000), (1004, "x" * 3000), (1005, "a  b   c ")]
    frame = spark.createDataFrame([(i, t, 1, "clash", "z") for i, t in rows], CLASHING)
    check_alignment(alignment.align(frame), rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], CLASHING)).collect() == []


def test_ranks_give_the_ids_of_the_merges():
    """The vocabulary encoded by ranks against the library of its own file, on texts of all planes."""
    with open(alignment.BYTE_BPE, "rb") as file:
        made = file.read()
    ours, theirs = alignment.ByteLevel(made), tokenizers.Tokenizer.from_str(made.decode())
    theirs.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(chr(c) for c in (rng.choice([rng.randrange(128), rng.randrange(0x500), rng.randrange(0x3000), rng.randrange(0x1F000)]) for _ in range(40)) if not 0xD800 <= c < 0xE000) for _ in range(500)]
    texts += [html.unescape("&#x1F600;") * 9, "it's we'll I'd", "<|endoftext|> <|endoftext|>"]
    assert ours.encode(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_stabbing_against_walking():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 40)
        ends = [sorted({*rng.sample(range(1, n), rng.randint(0, n - 1)), n}) for _ in range(2)]
        a, b = (np.array(x) for x in ends)
        both = sorted(set(ends[0]) & set(ends[1]))
        place = lambda xs, both=both: [sum(e < x for e in both) for x in xs]
        got = alignment.stab(a, b)
        assert got[0].tolist() == place(ends[0]) and got[1].tolist() == place(ends[1])
