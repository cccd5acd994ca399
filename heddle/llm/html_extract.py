"""Main text of web pages: a recurrent labeller of blocks, trained here on pages made by rule."""

from __future__ import annotations

import hashlib
import inspect
import io
import random
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import html_blocks
from heddle.llm.html_blocks import Block, Node, cut_blocks
from heddle.plans.storage import read_bytes, shared_root, write_bytes

PATHS, WORDS, SHAPE = 512, 256, 10
HIDDEN = 28
TRAINING_PAGES, EPOCHS, BATCH_PAGES, RATE, SEED = 9_000, 6, 16, 0.006, 7
DECAY = 0.02
#: Share of training pages whose words are hidden, so that the labeller doesn't lean on them.
HIDDEN_WORDS = 0.75
#: Blocks of one page that are held as vectors at once; a longer page is read in parts, with the states carried on.
PART_BLOCKS = 1_024
BATCH_BLOCKS = 8_192


# --- features ---------------------------------------------------------------------------


def _bits(terms: Iterable[str]) -> int:
    """The hashed terms as bits of a whole number."""
    out = 0
    for term in terms:
        out |= 1 << zlib.crc32(term.encode()) % PATHS
    return out


def label_bits(label: str, known: dict[str, tuple[int, int, int]]) -> tuple[int, int, int]:
    """Bits of a tag and the words of its class, id and role, plainly and by its place: the leaf, the one above, further up."""
    if label not in known:
        if len(known) > 50_000:
            known.clear()
        tag, *words = label.split(".")
        terms = [tag, *("." + w for w in words)]
        plain = _bits(terms)
        known[label] = tuple(plain | _bits(f"{t}/{near}" for t in terms) for near in range(3))
    return known[label]


def path_bits(node: Node | None, known: dict[str, tuple[int, int, int]]) -> int:
    """Hashed tag path: bits of all elements above a block. Those of what is further up are kept with each element, as all below share them."""
    if node is None:
        return 0
    fresh = []
    for n in node.up():
        if n.derived is not None:
            break
        fresh.append(n)
    for n in reversed(fresh):
        n.derived = label_bits(n.label, known)[2] | (n.parent.derived if n.parent else 0)
    out, above = label_bits(node.label, known)[0], node.parent
    if above:
        out |= label_bits(above.label, known)[1] | (above.parent.derived if above.parent else 0)
    return out


def path_vector(bits: int) -> np.ndarray:
    """The bits as numbers."""
    return np.unpackbits(np.frombuffer(bits.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


_LABELS: dict[str, tuple[int, int, int]] = {}


def block_vectors(blocks: list[Block], paths: dict, words: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row per block from start to stop of a page: tag path, words, and shape of the text."""
    some = blocks[start:stop]
    out = np.zeros((len(some), PATHS + WORDS + SHAPE), np.float32)
    for i, b in enumerate(some):
        bits = path_bits(b.node, _LABELS)
        p = paths.get(bits)
        if p is None:
            if len(paths) > 20_000:
                paths.clear()
            p = paths[bits] = path_vector(bits)
        out[i, :PATHS] = p
        own = b.text.split()
        at = []
        for w in own:
            k = words.get(w)
            if k is None:
                if len(words) > 200_000:
                    words.clear()
                k = words[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            at.append(k)
        c = np.sqrt(np.bincount(at, minlength=WORDS))
        out[i, PATHS : PATHS + WORDS] = c / max(1.0, float(np.linalg.norm(c)))
        n = len(b.text)
        out[i, PATHS + WORDS :] = (
            np.log1p(n) / 8,
            np.log1p(len(own)) / 6,
            min(1.0, b.linked / n),
            b.text[-1] in ".!?:…",
            sum(map(b.text.count, ",.")) / n * 10,
            n > 200,
            len(own) < 4,
            (start + i) / len(blocks),
            (len(blocks) - start - i) / len(blocks),
            min(b.node.depth if b.node else 0, 12) / 12,
        )
    return out


# --- the network ------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Labeller:
    """Two LSTMs that read a page's blocks in either direction, and a logistic output over their states and the input."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator, width: int = PATHS + WORDS + SHAPE, hidden: int = HIDDEN) -> Labeller:
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, (1 / 12) ** 0.5, (width, 4 * hidden)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            w[f"c{d}"] = np.zeros(4 * hidden, np.float32)
            w[f"c{d}"][hidden : 2 * hidden] = 1.0
        w["o"] = rng.normal(0, 0.1, (2 * hidden, 1)).astype(np.float32)
        w["s"] = np.zeros((width, 1), np.float32)
        w["b"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """States of one direction over (time, page, feature), the tape and the last (h, c); where the mask is 0 the state stays 0."""
        w = self.weights
        n = w[f"h{d}"].shape[0]
        z0 = x @ w[f"x{d}"] + w[f"c{d}"]
        h, c = start or (np.zeros((x.shape[1], n), np.float32),) * 2
        out, tape = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z0[t] + h @ w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * n : (k + 1) * n]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            before = (h, c)
            c = (f * c + i * g) * m
            tc = np.tanh(c)
            h = o * tc * m
            out[t] = h
            if keep:
                tape.append((t, i, f, o, g, m, before, tc))
        return out, tape, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds of main text for (time, page)."""
        w = self.weights
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ w["o"] + x @ w["s"])[..., 0] + w["b"][0]

    def long_logits(self, blocks: int, part: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """`logits` of one page of any length from part(start, stop), its blocks' vectors, of which PART_BLOCKS are asked for at once.

        Each direction goes over the parts in its own order and carries its state
        on. Of a block only its sum stays.
        """
        w = self.weights
        n = w["hf"].shape[0]
        out = np.full(blocks, w["b"][0], np.float32)
        starts = range(0, blocks, PART_BLOCKS)
        for d, own, order in (("f", w["o"][:n], starts), ("b", w["o"][n:], reversed(starts))):
            state = None
            for a in order:
                b = min(blocks, a + PART_BLOCKS)
                x = part(a, b)[:, None]
                h, _, state = self._run(x, np.ones(x.shape[:2], np.float32), d, False, state)
                out[a:b] += (h @ own)[:, 0, 0]
                if d == "f":
                    out[a:b] += (x @ w["s"])[:, 0, 0]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy, by backpropagation through time."""
        w = self.weights
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid((both @ w["o"] + x @ w["s"])[..., 0] + w["b"][0])
        e = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grad = {"o": flat(both).T @ flat(e), "s": flat(x).T @ flat(e), "b": e.sum((0, 1))}
        n = w["hf"].shape[0]
        for k, d in enumerate("fb"):
            into = e @ w["o"][k * n : (k + 1) * n].T
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            gh = np.zeros_like(w[f"h{d}"])
            for t, i, f, o, g, m, (h0, c0), tc in reversed(runs[d][1]):
                dh = (dh + into[t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh = dz @ w[f"h{d}"].T
                dc = dc * f
            grad[f"h{d}"] = gh
            grad[f"x{d}"] = flat(x).T @ flat(dz_all)
            grad[f"c{d}"] = dz_all.sum((0, 1))
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, feature) and mask of pages of different lengths."""
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


# --- pages to learn from ----------------------------------------------------------------

#: Names that pages give to their parts; the labeller learns their words.
MAIN_NAMES = "content main main-content main-column article post post-content entry entry-content article-body post-body story story-body text page-content body-text blog-post markdown prose".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation main-menu site-nav breadcrumbs breadcrumb topnav mobile-menu skip-links toc pagination pager tabs submenu".split(),
    "header": "header site-header masthead top-bar topbar page-header branding logo tagline".split(),
    "footer": "footer site-footer page-footer colophon copyright legal bottom-bar credits footer-links".split(),
    "side": "sidebar side aside rail right-rail widget widgets related related-posts recommended popular trending more-stories archive tag-cloud categories author-box bio".split(),
    "notice": "notice cookie-notice cookie cookies consent cookie-banner gdpr alert message popup modal overlay banner newsletter subscribe paywall warning disclaimer toast announcement".split(),
    "ad": "ad ads advert adverts advertisement ad-slot banner-ad sponsor sponsored promo promotion adsense ad-container partner-content".split(),
    "form": "form search search-form login signup contact-form poll survey subscribe-form register feedback".split(),
    "comments": "comments comment comment-list respond comment-form replies reply discussion respond reader-comments responses thread disqus user-comments".split(),
    "share": "share social share-buttons social-links follow tags meta byline-links tools toolbar".split(),
}
PHRASES = {
    "nav": "Home|About|Contact|News|Sports|Next|Previous|Back to top|Skip to content|Menu|Archive|Page 2|Products|Blog|Help".split("|"),
    "header": "Sign in|Welcome|Daily|The site|Search|Log in|Today".split("|"),
    "footer": "© 2024|All rights reserved|Privacy policy|Terms of use|Imprint|Contact us|Powered by|Sitemap".split("|"),
    "side": "Related articles|Most read|You may also like|Recent posts|Categories|Trending|About the author|Read more".split("|"),
    "notice": "We use cookies|Accept all|This site uses cookies to improve your experience|Subscribe to our newsletter|Please enable JavaScript|Breaking|Got it".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Shop now|Special offer|Ad|Learn more|50% off".split("|"),
    "form": "Name|E-mail|Submit|Search|Password|Send|Subscribe|Your message|Sign up".split("|"),
    "comments": "Reply|Comments|Leave a comment|3 comments|says:|Report|Like|Posted by".split("|"),
    "share": "Share|Tweet|Print|E-mail this|Tags:|Follow us".split("|"),
}
#: Names that say nothing: the labeller has to look at the rest of the page.
NEUTRAL_NAMES = "wrapper wrap container page row layout col col-8 left center inner outer block section-1 grid cell box panel area".split()
SYLLABLES = "an er on ti re ing th ed es ly ou be de sch ung ein ver keit lich que le la eau ment ción ado os ar ra mi ño é ü ß 的 了 ск ов та".split()


class Maker:
    """Pages by rule, with each piece of text known to be main text or not."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.truth: dict[str, bool] = {}
        self.most = 16

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, most: int = 16) -> str:
        words = [self.word() for _ in range(self.r.randint(1, most))]
        kind = self.r.random()
        if kind < 0.08:
            words = [w + self.r.choice(("%%%", "***", "!!", "$$$")) for w in words]
        elif kind < 0.13:
            words = [w.upper() for w in words]
        elif kind < 0.17:
            words = [w for w in words[: self.r.randint(1, 16)] for _ in range(self.r.randint(4, 60))]
        elif kind < 0.2:
            words = " | ".join(words).split()
        elif kind < 0.27:
            words.insert(self.r.randrange(len(words) + 1), self.r.choice(("&amp;", "|", "2024", "http://x.example/", "&lt;b&gt;")))
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", "!", "?", ""))

    def text(self, main: bool, kind: str = "") -> str:
        """A piece of text behind a mark of its own, by which its block is found again."""
        key = f"q{len(self.truth)}z"
        self.truth[key] = main
        if not main and self.r.random() < 0.45:
            body = self.r.choice(PHRASES[kind])
        elif not main and kind in ("comments", "notice", "side", "footer", "ad") and self.r.random() < 0.6:
            body = " ".join(self.sentence() for _ in range(self.r.randint(1, 4)))
        elif main:
            body = " ".join(self.sentence(self.most) for _ in range(self.r.choice((1, 1, 2, 4, 8)) if self.most > 4 else 1))
        else:
            body = self.sentence(5)
        if self.r.random() < 0.12:
            body = f"<{(t := self.r.choice(('b', 'em', 'span', 'a', 'strong')))}>{body}</{t}>"
        return f"{key} {body}"

    def tag(self, names: list[str], plain: str = "div") -> tuple[str, str]:
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name = self.r.choice((f"{name}-wrap", f"{name} box", f"site-{name}", f"{name}-1", f"c {name}", name.title().replace("-", "")))
        return f'<{plain} {self.r.choice(("class", "class", "id"))}="{name}">', f"</{plain}>"

    def other(self, kind: str) -> str:
        """A part of the page that isn't main text."""
        r = self.r
        plain = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        if plain and r.random() < 0.55:
            a, b = (f"<{plain}>", f"</{plain}>") if r.random() < 0.6 else self.tag(OTHER_NAMES[kind], plain)
        else:
            a, b = self.tag(OTHER_NAMES[kind], r.choice(("div", "div", "section", "ul" if kind == "nav" else "div")))
        if kind == "nav" and r.random() < 0.15:  # links say enough
            a, b = self.tag(NEUTRAL_NAMES) if r.random() < 0.5 else ("<div>", "</div>")
        t = lambda: self.text(False, kind)
        if kind == "nav" or kind == "share" or kind in ("side", "footer") and r.random() < 0.5:
            items = "".join(f'<li><a href="/x">{t()}</a></li>' for _ in range(r.randint(2, 7)))
            inner = items if a.startswith("<ul") else f"<ul>{items}</ul>" if r.random() < 0.7 else "".join(f'<a href="/y">{t()}</a><br>' if r.random() < 0.3 else f'<div><a href="#">{t()}</a></div>' for _ in range(3))
            if kind == "side":
                inner = f"<h3>{t()}</h3>" + inner
        elif kind == "comments":
            item = r.choice(("li", "div", "article"))
            inner = f"<h{(k := r.choice((2, 3)))}>{t()}</h{k}>" + "".join(f'<{item} class="{r.choice(OTHER_NAMES["comments"])}"><p>{t()}</p>' + (f"<p>{t()}</p>" if r.random() < 0.3 else "") + f"</{item}>" for _ in range(r.randint(1, 4)))
        elif kind == "form":
            fields = [f"<label>{t()}</label><input type=text>", f"<p>{t()}</p>", f"<button>{t()}</button>", f"<div><label>{t()}</label><input name=x></div>", f"<button type=submit>{t()}</button>", f"<h3>{t()}</h3>"]
            inner = "<input name=q>" + "".join(r.sample(fields, r.randint(1, 4)))
        elif kind == "header":
            inner = (f"<h1>{t()}</h1>" if r.random() < 0.4 else f"<div class=logo>{t()}</div>") + (f"<p>{t()}</p>" if r.random() < 0.4 else "")
        else:
            inner = t() if r.random() < 0.5 else "".join(f"<p>{t()}</p>" for _ in range(r.randint(1, 3)))
            if kind in ("notice", "ad") and r.random() < 0.4:
                inner += f"<button>{t()}</button>"
        return a + inner + b

    def body(self) -> str:
        """The article, at times with foreign parts inside."""
        r = self.r
        parts = [f"<h1>{self.text(True)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            k = r.random()
            if k < 0.68:
                parts.append(f"<p>{self.text(True)}" + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.76:
                parts.append(f"<h{(h := r.choice((2, 3, 4)))}>{self.text(True)}</h{h}>")
            elif k < 0.82:
                parts.append("<ul>" + "".join(f"<li>{self.text(True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.86:
                parts.append(f"<blockquote><p>{self.text(True)}</p></blockquote>")
            elif k < 0.9:
                parts.append(f"<pre>{self.text(True)}</pre>")
            elif k < 0.915:
                parts.append(f"<figure><img src=i><figcaption>{self.text(True)}</figcaption></figure>")
            elif k < 0.925:
                parts.append(f"<section><h{(h := r.choice((2, 3)))}>{self.text(True)}</h{h}><p>{self.text(True)}</p></section>")
            elif k < 0.935:
                parts.append(f"<dl><dt>{self.text(True)}</dt><dd>{self.text(True)}</dd></dl>")
            elif k < 0.945:
                parts.append("<ol>" + "".join(f"<li><p>{self.text(True)}</p></li>" for _ in range(r.randint(1, 4))) + "</ol>")
            elif k < 0.955:
                parts.append(f"<hr>{self.text(True)}<hr>")
            elif k < 0.975:
                parts.append("<table><tr>" + "".join(f"<td>{self.text(True)}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>")
            else:
                parts.append(f"<div>{self.text(True)}</div>")
            if r.random() < 0.16:
                parts.append(self.other(r.choice(("ad", "notice", "side", "share", "form", "form", "nav"))))
        if r.random() < 0.15:
            parts.append(self.other("comments"))
        return "".join(parts)

    def page(self) -> str:
        """A whole page."""
        r, before, after = self.r, [], []
        self.most = r.choice((16, 16, 16, 8, 4))  # words of a sentence of the article
        for kind, at, p in (("notice", before, 0.35), ("header", before, 0.5), ("nav", before, 0.7), ("ad", before, 0.35), ("form", before, 0.2), ("side", before, 0.3), ("share", after, 0.3), ("ad", after, 0.25), ("side", after, 0.4), ("comments", after, 0.4), ("form", after, 0.25), ("nav", after, 0.2), ("notice", after, 0.2), ("footer", after, 0.75)):
            if r.random() < p:
                at.append(self.other(kind))
        if r.random() < 0.3:
            r.shuffle(before)
        inner = self.body()
        k = r.random()
        if k < 0.45:
            inner = f"<article>{inner}</article>"
        elif k < 0.6:
            inner = f"<main>{inner}</main>"
        if k > 0.9:  # nothing on the page says where the article is
            a, b = self.tag(NEUTRAL_NAMES, r.choice(("div", "div", "section"))) if r.random() < 0.7 else ("<div>", "</div>")
            inner = a + inner + b
        elif k > 0.55 or r.random() < 0.3:
            a, b = self.tag(MAIN_NAMES, r.choice(("div", "div", "section", "article")))
            inner = a + inner + b
        if r.random() < 0.2:
            inner = f"<main>{inner}</main>"
        if r.random() < 0.3:  # parts beside the article, in the same frame
            n = r.randint(0, len(after))
            a, b = self.tag(NEUTRAL_NAMES)
            inner = a + inner + "".join(after[:n]) + b
            after = after[n:]
        elif r.random() < 0.12:  # columns of a table
            n = r.randint(0, len(before))
            left, right = "".join(before[n:]), "".join(after)
            inner = "<table><tr>" + (f"<td>{left}</td>" if left else "") + f"<td>{inner}</td>" + (f"<td>{right}</td>" if right else "") + "</tr></table>"
            before, after = before[:n], []
        return f"<html><head><title>{self.word()}</title><style>p{{}}</style></head><body>{''.join(before)}{inner}{''.join(after)}" + ("</body></html>" if r.random() < 0.9 else "")

    def labelled(self) -> tuple[list[Block], list[bool]]:
        """Blocks of a page with their labels; the marks are taken off."""
        while True:
            self.truth = {}
            blocks, labels = [], []
            for b in cut_blocks(self.page()):
                key, _, rest = b.text.partition(" ")
                if key in self.truth and rest:
                    blocks.append(Block(b.node, rest, min(b.linked, len(rest))))
                    labels.append(self.truth[key])
            if blocks:
                return blocks, labels


_TRAINED: dict = {}


def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller trained on pages made by rule, by Adam; the same on every run, and kept for the process."""
    if (pages, epochs, seed) in _TRAINED:
        return _TRAINED[pages, epochs, seed]
    maker, paths, words = Maker(seed), {}, {}
    data = []  # only what isn't zero, as most of a vector is
    for _ in range(pages):
        blocks, labels = maker.labelled()
        v = block_vectors(blocks, paths, words)
        at = np.flatnonzero(v).astype(np.int32)
        data.append((at, v.reshape(-1)[at].astype(np.float16), np.array(labels, np.float32)))
    data.sort(key=lambda d: len(d[2]))

    def full(d: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(d[2]), PATHS + WORDS + SHAPE), np.float32)
        out.reshape(-1)[d[0]] = d[1]
        return out

    rng = np.random.default_rng(seed)
    net = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, total = 0, epochs * -(-pages // BATCH_PAGES)
    for _ in range(epochs):
        for at in rng.permutation(np.arange(0, pages, BATCH_PAGES)):
            part = data[at : at + BATCH_PAGES]
            x, mask = padded([full(d) for d in part])
            y = padded([d[2][:, None] for d in part])[0][..., 0]
            # Words of a path and of a text are hidden at times, so that none is relied on alone.
            x[..., : PATHS + WORDS] *= rng.random((1, x.shape[1], PATHS + WORDS)) > 0.1
            x[..., PATHS : PATHS + WORDS] *= rng.random((1, x.shape[1], 1)) > HIDDEN_WORDS
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net.weights[k] -= (RATE * (1 - 0.95 * step / total) * (move + DECAY * net.weights[k])).astype(np.float32)
    _TRAINED[pages, epochs, seed] = net
    return net


def stored(spark: SparkSession) -> Labeller:
    """The trained labeller, from the shared folder if this code has left one there; else it is trained, and left there."""
    code = "".join(inspect.getsource(m) for m in (html_blocks, sys.modules[__name__]))
    name = f"{shared_root(spark)}/labeller-{hashlib.sha256(code.encode()).hexdigest()[:24]}"
    if _TRAINED:
        return train()
    data = read_bytes(spark, name)
    if data is None:
        out = io.BytesIO()
        np.savez(out, **train().weights)
        write_bytes(spark, name, out.getvalue())
        return train()
    with np.load(io.BytesIO(data)) as weights:
        return Labeller({k: weights[k] for k in weights.files})


# --- the operator -----------------------------------------------------------------------


def label_pages(net: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Which blocks of each page are main text."""
    out = [np.zeros(len(p), bool) for p in pages]
    short = []
    for k, p in enumerate(pages):
        if len(p) > PART_BLOCKS:
            out[k] = net.long_logits(len(p), lambda a, b: p[a:b]) > 0  # noqa: B023
        elif len(p):
            short.append(k)
    short.sort(key=lambda k: len(pages[k]))
    at = 0
    while at < len(short):
        n = 1
        while at + n < len(short) and (n + 1) * len(pages[short[at + n]]) <= BATCH_BLOCKS:
            n += 1
        group = short[at : at + n]
        logits = net.logits(*padded([pages[k] for k in group]))
        for j, k in enumerate(group):
            out[k] = logits[: len(pages[k]), j] > 0
        at += n
    return out


def extract_main(net: Labeller, htmls: list[str | None]) -> list[str]:
    """Main text of each page: its main blocks in page order, joined by single spaces."""
    paths: dict = {}
    words: dict = {}
    out = [""] * len(htmls)
    some: list[int] = []
    blocks: list[list[Block]] = []
    vectors: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for i, own, keep in zip(some, blocks, label_pages(net, vectors)):
            out[i] = " ".join(b.text for b, k in zip(own, keep) if k)
        some.clear(), blocks.clear(), vectors.clear()
        size = 0

    for i, h in enumerate(htmls):
        own = cut_blocks(h)
        if len(own) > PART_BLOCKS:
            keep = net.long_logits(len(own), lambda a, b: block_vectors(own, paths, words, a, b)) > 0  # noqa: B023
            out[i] = " ".join(b.text for b, k in zip(own, keep) if k)
        elif own:
            some.append(i)
            blocks.append(own)
            vectors.append(block_vectors(own, paths, words))
            size += len(own)
            if size >= BATCH_BLOCKS:
                flush()
    flush()
    return out


def main_text(df: DataFrame, html: str = "html", out: str = "text", net: Labeller | None = None) -> DataFrame:
    """`df` with the main text of an HTML column.

    Null and empty pages, and pages without main blocks, have an empty text;
    broken markup gives what can be read of it. Rows are independent, so
    repeated rows give equal texts; other columns stay (one named `out` is
    replaced). Nothing is shuffled; the broadcast network has a fixed size.
    """
    shared = df.sparkSession.sparkContext.broadcast(net or train())

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            pages = list(s)
            yield pd.Series([t for a in range(0, len(pages), 256) for t in extract_main(shared.value, pages[a : a + 256])], dtype="object")

    return df.withColumn(out, extract(F.coalesce(F.col(html), F.lit(""))))
