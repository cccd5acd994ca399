"""Blocks, the labeller on pages held out, and hand-made pages."""

import os
import random
import re
import time
import zlib

import numpy as np
import pytest

from heddle.llm import html_extract as h
from heddle.llm.html_blocks import Node, cut_blocks
from heddle.llm.html_extract import PATHS, Labeller, path_bits, path_vector, Maker, block_vectors, extract_main, label_pages, main_text, padded, train


@pytest.fixture(scope="module")
def net():
    return train()


def texts(html):
    return [b.text for b in cut_blocks(html)]


def test_blocks():
    assert texts("<div>a<b>b</b> c\n<i>d</i><p>e<p>f<br>g</div>h") == ["ab c d", "e", "f g", "h"]
    assert texts("x &amp; &lt;b&gt; &eacute; &#233; &nbsp;y") == ["x & <b> é é y"]
    assert texts("<script>if (a<b) '</p>'</script>a<style>p{}</style><!-- <p>no --><p title='>'>b</p>") == ["a", "b"]
    assert texts("<head><title>t</title><body>b") == ["b"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("1 < 2 <3 & a<") == ["1 < 2 <3 & a<"]
    assert texts("<p>a</p><p>b</artic") == ["a", "b"]
    assert texts('<p class="x>a</p>b') == ["a", "b"]
    assert [b.path for b in cut_blocks('<body><div class="SiteFooter x-2" id=k><p>t')] == [("body", "div.site.footer.x.2.k", "p")]


def test_nothing_is_lost_behind_open_ends():
    assert texts("<html><head><title>T</title><article><p>a</p><header>h</header></article>") == ["a", "h"]
    assert texts("<head><meta name=x><link href=y><style>p{}</style><script>1</script><p>a</p></HEADER>b") == ["a", "b"]
    assert texts("<HEAD><title>t</title></HEAD><body>b") == ["b"]
    assert texts("<title>t<p>a") == ["t", "a"]
    for tag in ("svg", "iframe", "object", "noscript", "math", "select"):
        assert texts(f"<p>a</p><{tag}><p>b</p>c") == ["a", "b", "c"]
    assert texts("<title>t</titles></title >b<script>a</scripted>b</SCRIPT\n>c") == ["b", "c"]
    assert texts("<p>with <math><mi>x</mi><mo>+</mo><mn>1</mn></math> too</p>") == ["with x+1 too"]
    assert texts("<object data=x><p>o</p></object><noscript><p>n</p></noscript>") == ["o", "n"]
    assert texts("<p>a</p><script>b") == texts("<p>a</p><style>b") == ["a"]
    assert texts("<svg>" * 20_000 + "a") == ["a"]


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<<>>", "</p></p>", "<script>", "<!--", "&#xD800;&#99999999;&bogus;", "<p" * 500, "<div>" * 3000 + "x", "\x00<p>\ud83d</p>"])
def test_odd_pages_do_not_fail(net, html):
    assert isinstance(extract_main(net, [html])[0], str)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = Labeller.fresh(rng, 5, 3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask = padded([rng.normal(size=(n, 5)) for n in (4, 2)])
    y = (rng.random(mask.shape) > 0.5).astype(float)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(x, mask).astype(np.float64)))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for name, g in net.gradients(x, mask, y).items():
        w = net.weights[name]
        at = tuple(rng.integers(0, n) for n in w.shape)
        keep, eps = w[at], 1e-3
        w[at] = keep + eps
        up = loss()
        w[at] = keep - eps
        down = loss()
        w[at] = keep
        assert abs((up - down) / (2 * eps) - g[at]) < 2e-3, name


def test_pages_held_out(net):
    maker = Maker(12345)
    pages = [maker.labelled() for _ in range(200)]
    got = label_pages(net, [block_vectors(b, {}, {}) for b, _ in pages])
    right = sum(int(a == b) for g, (_, y) in zip(got, pages) for a, b in zip(g, y))
    assert right / sum(len(y) for _, y in pages) > 0.99


def test_hand_made_pages(net):
    one = """<html><body><header><div class="logo">Daily Site</div></header><ul id="menu"><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul>
    <div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept</button></div>
    <main><article><h1>A title</h1><p>First  paragraph,\n with <a href=x>a link</a>.</p><div class="advert">Buy shoes now</div><ul><li>point one</li><li>point two</li></ul><p>Last words.</p></article>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>Great article, thanks a lot for writing it.</p></div></section></main>
    <aside><h3>Related</h3><ul><li><a href=z>Other story</a></li></ul></aside><form><label>E-mail</label><input><button>Subscribe</button></form>
    <footer>&copy; 2024 All rights reserved</footer></body></html>"""
    two = """<body><div id="header"><h2>My blog</h2></div><div class="sidebar"><p>About me: I write long things about many topics here.</p></div>
    <div class="post-content"><h2>Post</h2><p>Hello &amp; welcome.</p><blockquote>Quoted.</blockquote></div><div id="footer"><p>Imprint</p></div>"""
    assert extract_main(net, [one, two]) == ["A title First paragraph, with a link. point one point two Last words.", "Post Hello & welcome. Quoted."]


def test_long_pages_are_labelled_in_parts(net):
    html = "<body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} has some words.</p>" for i in range(3000)) + "</article><footer>© x</footer>"
    text = extract_main(net, [html])[0]
    assert text.startswith("Paragraph 0") and text.endswith("Paragraph 2999 has some words.") and text.count("Paragraph") == 3000


def test_long_pages_are_labelled_as_a_whole(net, monkeypatch):
    rng = np.random.default_rng(4)
    far = Labeller.fresh(rng, 5, 3)
    for d in "fb":
        far.weights[f"c{d}"][3:6] = 12.0  # forgets nothing
    pages = [rng.normal(size=(n, 5)).astype(np.float32) for n in (3, 1_025, 2_600)]
    for p, got in zip(pages, label_pages(far, pages)):
        whole = far.logits(*padded([p]))[:, 0]
        assert np.allclose(far.long_logits(len(p), lambda a, b: p[a:b]), whole, atol=1e-3)
        sure = abs(whole) > 1e-3
        assert (got == (whole > 0))[sure].all()
    # a page's text is the same whether it is read in parts or at once
    html = "<div>" + "".join(m.page() for m in [Maker(5)] for _ in range(60)) + "</div>"
    blocks = cut_blocks(html)
    assert len(blocks) > 1_024
    at_once = block_vectors(blocks, {}, {})
    assert np.array_equal(at_once[700:900], block_vectors(blocks, {}, {}, 700, 900))
    logits = net.logits(*padded([at_once]))[:, 0]
    assert extract_main(net, [html])[0] == " ".join(b.text for b, x in zip(blocks, logits) if x > 0)


def test_training_repeats(net):
    small = [train(40, 1, 3).weights["o"].copy()]
    from heddle.llm import html_extract

    html_extract._TRAINED.pop((40, 1, 3))
    assert np.array_equal(small[0], train(40, 1, 3).weights["o"])


def test_column(spark, net):
    df = spark.createDataFrame([(1, None, "old"), (2, "<article><p>a b</p></article>", "old"), (2, "<article><p>a b</p></article>", "old")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in main_text(df, net=net).collect()) == [(1, ""), (2, "a b"), (2, "a b")]
    assert main_text(df.limit(0), net=net).count() == 0


def test_deep_pages_take_linear_time():
    took = []
    for n in (20_000, 100_000):
        page = "<div class=k>x" * n + "<article><p>the text of the article</p>" + "<li><ul>" + "<b>" * n + "<li>y</li>" * n
        began = time.process_time()
        blocks = cut_blocks(page)
        block_vectors(blocks, {}, {}, 0, 1_000), block_vectors(blocks, {}, {}, n, n + 1_000)
        took.append(time.process_time() - began)
        assert len(blocks) == 2 * n + 1 and blocks[n - 1].node.depth == n
    assert took[1] < 12 * took[0] + 1


def test_path_vectors_are_the_definition():
    r = random.Random(2)
    for _ in range(40):
        path = [r.choice(("div", "p", "ul", "li.a.b", "section.main", "table")) for _ in range(r.randint(0, 9))]
        node = None
        for label in path:
            node = Node(node, label)
        want = np.zeros(PATHS)
        for up, step in enumerate(reversed(path)):
            tag, *words = step.split(".")
            for term in (tag, *("." + w for w in words)):
                for t in (term, f"{term}/{min(up, 2)}"):
                    want[zlib.crc32(t.encode()) % PATHS] = 1
        assert np.array_equal(path_vector(path_bits(node, {})), want)


def test_the_labeller_is_stored_once(spark, net, monkeypatch):
    h.stored(spark)
    monkeypatch.setattr(h, "_TRAINED", {})
    first = h.stored(spark)  # stores it, if an earlier test hasn't
    monkeypatch.setattr(h, "train", lambda: pytest.fail("trained again"))
    monkeypatch.setattr(h, "_TRAINED", {})
    again = h.stored(spark)
    assert all(np.array_equal(net.weights[k], again.weights[k]) and np.array_equal(net.weights[k], first.weights[k]) for k in net.weights)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_pages_give_their_articles(spark, net):
    """All pages of a table against what stands between the article's tags, without the asides and adverts inside."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = extract_main(net, [r.html for r in rows])
    right = 0
    for r, text in zip(rows, got):
        article = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        want = " ".join(b.text for b in cut_blocks(article[1])) if article else ""
        right += text == want or (bool(want) and text in want and len(text) > 0.5 * len(want))
    assert right / len(rows) > 0.97


def test_layouts_that_the_maker_does_not_make(net):
    """Tables for layout, lists of definitions, and names in other languages: two thirds of the paragraphs are found, nothing foreign is."""
    body = ["The council met on Tuesday to discuss the new bridge over the river, and adjourned late.", "Members of the public spoke for two hours about noise, traffic and the cost of the work.", "A decision is expected next month, after the engineers have reported on the foundations."]
    text = "".join(f"<p>{b}</p>" for b in body)
    pages = [
        f"<body><center><table><tr><td><a href=1>Start</a><br><a href=2>Forum</a></td><td><h2>Bridge</h2>{text}</td></tr></table><div class=fusszeile><a href=3>Impressum</a></div></body>",
        f"<body><div role=navigation><a href=a>Inicio</a> <a href=b>Noticias</a></div><div role=main><h1>Bridge</h1>{text}</div><div role=contentinfo>Aviso legal</div></body>",
        f"<body><ul class=menu><li><a href=a>One</a><li><a href=b>Two</a></ul><main><dl><dt>Bridge</dt><dd>{text}</dd></dl></main><footer><small>Copyright</small></footer></body>",
    ]
    found = extract_main(net, pages)
    assert sum(b in t for t in found for b in body) >= 6
    assert not any(x in t for t in found for x in ("Impressum", "Noticias", "Copyright", "Forum"))
