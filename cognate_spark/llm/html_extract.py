"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open elements. Each block becomes
a vector: its path's tags, classes and ids and its words, both hashed, and a few measures (length, share of link
text, place, and how much of the page's text stands beside it). A bidirectional LSTM in numpy reads the page's blocks in order and labels each by what stands before and
after it in the whole page. Blocks labelled as main text are joined in page order; nothing else is dropped or capped.

The network is trained on the driver on `INVENTED` invented pages, whose blocks are labelled by construction (their main text stands in telling
elements, in tables, in elements of any name, or in none, so that words, length, links and neighbours have to tell as well), and on at most
`SAMPLE_PAGES` pages of the table of up to `SAMPLE_CHARS` characters, chosen by a hash, of which those blocks are labelled whose path says what they are (inside `article` or
`main`; inside `nav`, `footer`, `head`), a third of them without these elements' names: a bounded sample, with a fixed seed. It is a few thousand numbers, which go to
all tasks; pages are labelled where they are read, without a shuffle.

Scripts, styles and comments are left out by rule; whatever else a page holds, also in noscript, object, template or svg
elements, is a block that is judged. Null and empty pages give an empty text. A column main_text is replaced. Repeated rows are pages by themselves. Other columns pass through.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul noscript template svg object canvas iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never text, whatever stands in them; the labeller judges all others.
RAW = "script|style"
#: Elements of other languages than HTML, which alone may close themselves.
FOREIGN = frozenset({"svg"})
#: An open element of the key's kind ends when one of these begins.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*>", re.I | re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 192, 32, 8, 16
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
SAMPLE_PAGES, SAMPLE_CHARS, INVENTED = 200, 100_000, 1000
#: Blocks of which the network's input (512 bytes each) is held at once, but for a single page of more.
HELD_BLOCKS = 20_000


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int


def blocks(html: str) -> list[Block]:
    """Leaf blocks with any text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open block elements: tag, tag with names
    parts: list[str] = []
    links = [0, 0]  # depth, characters

    def end_block() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(x for _, x in stack), text, links[1]))
        parts.clear()
        links[1] = 0

    def add(text: str) -> None:
        parts.append(text)
        if links[0]:
            links[1] += len(text.strip())

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag == "a":
            links[0] = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK:
            continue
        end_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not (tag in FOREIGN and m[4].endswith("/")):
            while stack and tag in CLOSES.get(stack[-1][0], ()):
                stack.pop()
            names = " ".join(f"{k[0].lower()}:{a or b or c}".lower() for k, a, b, c in _NAMES.findall(m[4])) if m[4] else ""
            stack.append((tag, f"{tag} {names}" if names else tag))
            links[0] = 0
    add(html[at:])
    end_block()
    return out


_HASHES: dict[str, tuple[int, float]] = {}


def _place(token: str) -> tuple[int, float]:
    """Where a token is hashed to, and its sign."""
    if token not in _HASHES:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = zlib.crc32(token.encode())
        _HASHES[token] = h >> 1, 1.0 if h & 1 else -1.0
    return _HASHES[token]


def _names(element: str) -> set[str]:
    """The words in an element's classes, ids and roles."""
    return {x for name in element.split(" ")[1:] for x in re.split(r"[^a-z]+", name.partition(":")[2] or name) if x}


_PATHS: dict[tuple[tuple[str, ...], frozenset[str]], np.ndarray] = {}


def _path_vector(path: tuple[str, ...], known: frozenset[str]) -> np.ndarray:
    """The path's tags and the known ones of its names; others are one and the same, so that they say nothing by chance."""
    if (path, known) not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        tokens = {f"leaf {path[-1].split(' ')[0]}"} if path else set()
        for element in path:
            tokens.add(element.split(" ")[0])
            tokens.update(x if x in known else "?" for x in _names(element))
        v = np.zeros(PATH_DIMS)
        for t in tokens:
            h, sign = _place("path " + t)
            v[h % PATH_DIMS] += sign
        _PATHS[path, known] = v
    return _PATHS[path, known]


def shares(page: list[Block]) -> np.ndarray:
    """Per block, which part of the page's text outside links stands on the same path, and which in the same parent."""
    own, parent, total = Counter(), Counter(), 1
    for b in page:
        n = max(len(b.text) - b.link_chars, 0)
        own[b.path] += n
        parent[b.path[:-1]] += n
        total += n
    return np.array([(own[b.path], parent[b.path[:-1]]) for b in page], float).reshape(-1, 2) / total


def vectors(page: list[Block], known: frozenset[str], begin: int = 0, end: int | None = None, parts: np.ndarray | None = None) -> np.ndarray:
    """Of the page's blocks, or those from begin to end; parts: the page's `shares`."""
    parts = shares(page) if parts is None else parts
    rows = range(begin, len(page) if end is None else min(end, len(page)))
    out = np.zeros((len(rows), DIMS))
    for at, i in enumerate(rows):
        b = page[i]
        out[at, :PATH_DIMS] = _path_vector(b.path, known)
        words = b.text.lower().split()
        for w in words:
            h, sign = _place(w)
            out[at, PATH_DIMS + h % WORD_DIMS] += sign
        out[at, PATH_DIMS : PATH_DIMS + WORD_DIMS] /= np.sqrt(len(words))
        n = len(b.text)
        out[at, PATH_DIMS + WORD_DIMS :] = np.log1p(n) / 4, min(b.link_chars / n, 1), sum(map(b.text.count, ".,;:!?")) / len(words), i / len(page), 1 / (1 + i), 1 / (len(page) - i), parts[i, 0], parts[i, 1]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logit for each block. known: the names that paths are read by."""

    def __init__(self, seed: int = 3, known: Iterable[str] = ()) -> None:
        self.known = frozenset(known)
        r = np.random.default_rng(seed)
        g = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", g(DIMS, 4 * HIDDEN)), ("h", g(HIDDEN, 4 * HIDDEN)), ("c", np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)))}
        self.p |= {"o": g(2 * HIDDEN, 1), "z": np.zeros(1)}

    def _projected(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.p["x" + d] + self.p["c" + d]

    def _scan(self, pre: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """Hidden states (time, page, unit) from the projected input; kept gets what the way back needs."""
        t, b, _ = pre.shape
        h, c, hs = np.zeros((b, HIDDEN), pre.dtype), np.zeros((b, HIDDEN), pre.dtype), np.empty((t, b, HIDDEN), pre.dtype)
        w = self.p["h" + d].astype(pre.dtype)
        for k in range(t):
            a = pre[k] + h @ w
            i, f, o = (_sigmoid(a[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if kept is not None:
                kept.append((i, f, o, g, c, tc, h))
            h, c = o * tc, c2
            hs[k] = h
        return hs

    @staticmethod
    def _turned(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Each page's blocks from last to first; padding stays behind. Its own inverse."""
        k = np.arange(len(x))[:, None]
        at = np.where(k < lens, lens - 1 - k, k)
        return x[at, np.arange(x.shape[1])]

    def _forward(self, x: np.ndarray, lens: np.ndarray) -> tuple:
        kf: list = []
        kb: list = []
        f = self._scan(self._projected(x, "f"), "f", kf)
        b = self._scan(self._projected(self._turned(x, lens), "b"), "b", kb)
        h = np.concatenate([f, self._turned(b, lens)], 2)
        return (h @ self.p["o"])[:, :, 0] + self.p["z"], h, kf, kb

    def _back(self, x: np.ndarray, dh: np.ndarray, kept: list, d: str, grads: dict) -> None:
        t, b, _ = x.shape
        da, nh, nc = np.empty((t, b, 4 * HIDDEN)), np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
        gh = np.zeros_like(self.p["h" + d])
        for k in range(t - 1, -1, -1):
            i, f, o, g, c, tc, h = kept[k]
            h_ = dh[k] + nh
            c_ = nc + h_ * o * (1 - tc * tc)
            da[k] = np.concatenate([c_ * g * i * (1 - i), c_ * c * f * (1 - f), h_ * tc * o * (1 - o), c_ * i * (1 - g * g)], 1)
            gh += h.T @ da[k]
            nh, nc = da[k] @ self.p["h" + d].T, c_ * f
        flat = da.reshape(t * b, -1)
        grads |= {"x" + d: x.reshape(t * b, -1).T @ flat, "h" + d: gh, "c" + d: flat.sum(0)}

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 4) -> Labeller:
        """pages: vectors, and labels 1, 0 or -1 (unknown, left out of the cost). Adam."""
        r, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(pages), batch):
                x, lens, y = _padded([pages[i] for i in order[at : at + batch]])
                z, h, kf, kb = self._forward(x, lens)
                dz = np.where(y >= 0, _sigmoid(z) - y, 0) / max((y >= 0).sum(), 1)
                dh = dz[:, :, None] * self.p["o"][:, 0]
                grads: dict = {"o": np.tensordot(h, dz, ((0, 1), (0, 1)))[:, None], "z": np.array([dz.sum()])}
                self._back(x, dh[:, :, :HIDDEN], kf, "f", grads)
                self._back(self._turned(x, lens), self._turned(dh[:, :, HIDDEN:], lens), kb, "b", grads)
                step += 1
                for k, gk in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    self.p[k] = self.p[k] - rate * 0.85**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def labels(self, pages: list[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """Whether each block is main text, from the vectors of the pages' blocks."""
        return self.labelled([self.read([x]) for x in pages], most)

    def read(self, parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The input of both directions for a page whose vectors come in parts: 64 numbers a block each."""
        both = [[self._projected(x, d).astype(np.float32) for d in "fb"] for x in parts]
        return tuple(np.concatenate([np.empty((0, 4 * HIDDEN), np.float32), *x]) for x in zip(*both, strict=True)) if both else (np.empty((0, 4 * HIDDEN), np.float32),) * 2

    def labelled(self, pages: list[tuple[np.ndarray, np.ndarray]], most: int = 20_000) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length are read together, up to `most` places at once, and nothing is
        kept on the way but the states."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        sizes = [len(x) for x, _ in pages]
        order = sorted((i for i in range(len(pages)) if sizes[i]), key=sizes.__getitem__)
        w, z = self.p["o"].astype(np.float32), np.float32(self.p["z"][0])
        while order:
            k = max(1, min(len(order), most // sizes[order[min(len(order), 256) - 1]]))
            mine, order = order[: min(k, 256)], order[min(k, 256) :]
            lens = np.array([sizes[i] for i in mine])
            forth, back = (np.zeros((lens.max(), len(mine), 4 * HIDDEN), np.float32) for _ in range(2))
            for j, i in enumerate(mine):
                forth[: lens[j], j], back[: lens[j], j] = pages[i][0], pages[i][1][::-1]
            f, b = self._scan(forth, "f"), self._turned(self._scan(back, "b"), lens)
            logits = (f @ w[:HIDDEN] + b @ w[HIDDEN:])[:, :, 0] + z
            for j, i in enumerate(mine):
                out[i] = logits[: lens[j], j] > 0
        return out


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x, _ in pages])
    x, y = np.zeros((lens.max(), len(pages), DIMS)), np.full((lens.max(), len(pages)), -1.0)
    for j, (a, b) in enumerate(pages):
        x[: len(a), j], y[: len(a), j] = a, b
    return x, lens, y


MARK = "\x01"


def invented(r: random.Random) -> str:
    """A page; blocks of main text begin with MARK."""
    word = lambda: "".join(r.choice(("an", "el", "or", "ti", "us", "ka", "mé", "th", "er", "o", "ll", "sch", "i")) for _ in range(r.randint(1, 4)))
    said = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi))).capitalize()
    sentence = lambda lo, hi: said(lo, hi) + r.choice(("", ".", ".", "!", ", " + said(2, 9) + "."))
    link = lambda: f'<a href="/{word()}">{said(1, 3)}</a>'
    named = lambda tag, names: f'<{tag} {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-" + word(), " " + word()))}">'

    def boiler() -> str:
        kind = r.randrange(12)
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
        few = "".join(f"<p>{sentence(2, 25)}</p>" for _ in range(r.randint(1, 3)))
        if kind == 0:
            return f"<nav><ul>{items}</ul></nav>"
        if kind == 1:
            return named("div", ("menu", "navbar", "breadcrumb", "nav", "topbar", "tags", "share")) + f"<ul>{items}</ul></div>"
        if kind == 2:
            return r.choice(("<header>", named("div", ("header", "masthead", "logo", "banner-top")))) + f"{said(1, 5)}" + r.choice((f"<p>{said(2, 8)}</p>", "")) + ("</header></div>")
        if kind == 3:
            return r.choice(("<aside>", named("div", ("sidebar", "related", "widget", "recommended", "side")))) + f"<h3>{said(1, 3)}</h3>{few}<ul>{items}</ul></aside></div>"
        if kind in (4, 5):
            return named(r.choice(("div", "div", "section")), ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner")) + r.choice((sentence(3, 30), few)) + "</div></section>"
        if kind == 6:
            return named("div", ("cookie", "notice", "consent", "alert", "newsletter", "popup", "subscribe", "gdpr")) + r.choice((sentence(5, 30), few)) + "<button>OK</button></div>"
        if kind == 7:
            return f'<form action="/{word()}"><label>{said(1, 3)}</label><input name="q"><p>{sentence(2, 10)}</p><button>{said(1, 2)}</button></form>'
        if kind == 8:
            return r.choice((f"<noscript>{said(3, 9)}</noscript>", f"<template><p>{said(1, 4)}</p></template>", f"<svg><title>{said(1, 2)}</title></svg>"))
        if kind in (9, 10):  # lists of links by other names
            rows = r.choice((f"<ul>{items}</ul>", "".join(f"<p>{link()}</p>" for _ in range(r.randint(2, 6))), " | ".join(link() for _ in range(r.randint(2, 7)))))
            return r.choice((f"<div>{rows}</div>", f'<div class="{word()}">{rows}</div>', f"<table><tr><td>{rows}</td></tr></table>"))
        comments = "".join(named(r.choice(("div", "li", "article")), ("comment", "reply", "comment-body")) + f"<p>{sentence(3, 40)}</p></div>" for _ in range(r.randint(1, 4)))
        return named(r.choice(("div", "section", "ol")), ("comments", "comment-list", "discussion", "replies", "responses")) + f"<h3>{said(1, 2)}</h3>{comments}</section></div></ol>"

    def main() -> str:
        heading = f"<h{r.randint(1, 2)}>{MARK}{said(2, 10)}</h1>" if r.random() < 0.8 else ""
        if heading and r.random() < 0.15:
            heading = f"<div>{MARK}{said(2, 10)}</div>"
        body, divs = [heading], r.random() < 0.15
        for _ in range(r.choice((1, 2, 3, 5, 8, 15, 25))):
            inner = sentence(1, 60) + r.choice(("", "", f" <b>{said(1, 4)}</b>", f" {link()} {said(1, 9)}", "<br>" + sentence(2, 20)))
            body.append(f"<div>{MARK}{inner}</div>" if divs else r.choice((f"<p>{MARK}{inner}</p>", f"<p>{MARK}{inner}", f"<p><b>{MARK}{inner}</p>", f"<p class={word()}>{MARK}{inner}</p>")))
            roll = r.random()
            if roll < 0.06:
                body.append(f"<ul><li>{MARK}{sentence(2, 12)}</li><li>{MARK}{sentence(2, 12)}</li></ul>")
            elif roll < 0.1:
                body.append(f"<blockquote>{MARK}{sentence(4, 30)}</blockquote><h3>{MARK}{said(1, 6)}</h3>")
            elif roll < 0.18:
                body.append(boiler())
            elif roll < 0.22:  # inside other elements the article goes on
                tag = r.choice(("noscript", "object", "template", "canvas"))
                body.append(f"<{tag}><p>{MARK}{sentence(5, 50)}</p></{tag}>")
            elif roll < 0.27:
                body.append(r.choice((f"<svg width=9><title>{said(1, 2)}</title></svg>", "<svg-icon name=x></svg-icon>", "<svg width=1 />")))
        return "".join(body)

    def wrapped(body: str) -> str:
        """The main text in an element that says so, in others that do not, or in none."""
        foreign = lambda: r.choice((word(), f"{word()}-{r.randint(1, 12)}", f"col-{r.choice(('md', 'sm', 'lg', 'xs'))}-{r.randint(4, 12)}", "wrap", "row", "container", "inner", "page", "site", "grid", "box", "center", "layout", "col", "wrapper", "section", "block", "left", "panel"))
        kind = r.randrange(20)
        if kind < 8:
            wrap = r.choice(("<article>", "<article>", "<main>", named("article", ("post", "entry", "story")), named("div", ("content", "post", "entry", "article-body", "story", "main", "text")), named("section", ("article", "content", "body"))))
            return f"{wrap}{body}</{re.match('<([a-z]+)', wrap)[1]}>"
        if kind < 12:
            return body
        if kind < 15:
            cells = f"<td>{r.choice((link(), ''))}</td>" if r.random() < 0.3 else ""
            if r.random() < 0.5:  # cells with text and no paragraphs
                body = "".join(f"<tr>{cells}<td>{x}</td></tr>" for x in re.split(r"</?p[^>]*>", body) if x)
                return f"<table>{body}</table>"
            return f"<table{r.choice((' border=0', ' width=100%', ''))}><tr>{cells}<td>{body}</td></tr></table>"
        for _ in range(r.randint(1, 4)):
            tag = r.choice(("div", "div", "div", "section"))
            body = f"<{tag}{r.choice(('', f' class={chr(34)}{foreign()}{chr(34)}', f' class={chr(34)}{foreign()} {foreign()}{chr(34)}', f' id={chr(34)}{foreign()}{chr(34)}'))}>{body}</{tag}>"
        return body

    before, after = "".join(boiler() for _ in range(r.choice((0, 0, 1, 1, 2, 3, 4)))), "".join(boiler() for _ in range(r.choice((0, 0, 1, 2, 3, 4))))
    foot = r.choice(("", f"<footer>&copy; {said(1, 4)} &middot; {sentence(2, 15)}</footer>", named("div", ("footer", "copyright", "legal", "bottom")) + f"<p>{sentence(2, 15)}</p></div>"))
    head = r.choice(("", f"<head><title>{said(2, 8)}</title></head>", f"<head><title>{said(2, 8)}</title></head>"))
    body = main()
    if r.random() < 0.1:  # a page of one block
        body = f"{r.choice(('<p>', '<div>', '<h1>', ''))}{MARK}{sentence(8, 60)}"
    page = f"{before}{wrapped(body)}{after}{foot}"
    if r.random() < 0.3:
        page = f"<div{r.choice(('', ' class=wrap', ' class=page', ' id=' + word()))}>{page}</div>"
    return f"<!DOCTYPE html><html>{head}<body>{page}</body></html>"


def _invented_page(html: str) -> tuple[list[Block], np.ndarray]:
    page = blocks(html)
    y = np.array([float(MARK in b.text) for b in page])
    return [Block(b.path, b.text.replace(MARK, ""), b.link_chars) for b in page], y


def trained(pages: list[tuple[list[Block], np.ndarray]], least: int = 8, **how: float) -> Labeller:
    """A labeller of pages with their blocks' labels; names are known that at least so many pages have."""
    seen = Counter(x for page, _ in pages for x in {x for b in page for element in b.path for x in _names(element)})
    model = Labeller(known=(x for x, n in seen.items() if n >= least))
    return model.fit([(vectors(page, model.known), y) for page, y in pages if page], **how)


def _sampled_page(html: str, plain: bool = False) -> tuple[list[Block], np.ndarray]:
    """A page of the table with the labels that its paths give; plain: with the main element's tag and names taken away."""
    page = blocks(html)
    y = []
    for b in page:
        tags, names = {x.split(" ")[0] for x in b.path}, re.split(r"[^a-z]+", " ".join(x.partition(" ")[2] for x in b.path))
        if tags & {"nav", "footer", "head", "aside", "form", "header"} or {"ad", "ads", "comments", "comment", "cookie", "sidebar"} & set(names):
            y.append(0.0)
        else:
            y.append(1.0 if tags & {"article", "main"} else -1.0)
    if plain:
        page = [Block(tuple("div" if x.split(" ")[0] in ("article", "main") else x for x in b.path), b.text, b.link_chars) if k == 1.0 else b for b, k in zip(page, y, strict=True)]
    return page, np.array(y)


def fitted(pages: DataFrame, invented_pages: int = INVENTED, sample_pages: int = SAMPLE_PAGES, seed: int = 11) -> Labeller:
    r = random.Random(seed)
    train = [_invented_page(invented(r)) for _ in range(invented_pages)]
    most = 1 << 20
    share = max(1, min(most, 4 * sample_pages * most // max(pages.count(), 1)))
    mark = F.xxhash64("html")
    some = pages.select("html", mark.alias("mark")).where(F.pmod(mark, F.lit(most)) < share).where(F.length("html") <= SAMPLE_CHARS).orderBy("mark").limit(sample_pages).collect()
    return trained(train + [_sampled_page(row.html, i % 3 == 2) for i, row in enumerate(some)])


def _read(page: list[Block], model: Labeller) -> tuple[np.ndarray, np.ndarray]:
    parts = shares(page)
    return model.read(vectors(page, model.known, at, at + 2048, parts) for at in range(0, len(page), 2048))


def main_texts(htmls: Iterable[str], model: Labeller) -> list[str]:
    """Main texts of pages; so many are read together as have HELD_BLOCKS blocks."""
    out: list[str] = []
    held: list[list[Block]] = []
    size = 0

    def done() -> None:
        kept = model.labelled([_read(p, model) for p in held])
        out.extend("\n\n".join(b.text for b, k in zip(p, y, strict=True) if k) for p, y in zip(held, kept, strict=True))
        held.clear()

    for html in htmls:
        page = blocks(html)
        if held and size + len(page) > HELD_BLOCKS:
            done()
            size = 0
        held.append(page)
        size += len(page)
    if held:
        done()
    return out


def extracted(pages: DataFrame, model: Labeller) -> DataFrame:
    """pages with main_text."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series(main_texts(html, sent.value), dtype=object)

    return pages.withColumn("main_text", text(F.coalesce("html", F.lit(""))))
