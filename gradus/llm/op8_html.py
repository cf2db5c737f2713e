"""Operator 8: main text of HTML pages with a recurrent block labeller.

A page is cut into leaf blocks: the runs of text between block-level tags, with
the path of open elements. Scripts, styles, comments and markup carry no block.
Every block becomes a vector of its hashed tag path (elements with their
classes and ids), its hashed words and a few measures; a bidirectional LSTM in
numpy reads the page's whole sequence of blocks in both directions and labels
each as article or not. The blocks kept are joined in page order.

The labeller is trained on the driver, from a fixed seed, on pages that
``synthetic_page`` writes: articles in many containers among menus, headers,
footers, sidebars, notices, adverts, forms and comments, labelled as they are
written. No row of the corpus is used for training.

Nulls, ties: a null html is the empty page, whose text is empty; page_id and
url are passed on as they are, null or repeated. Other columns are ignored.
Unclosed tags, stray brackets and unclosed comments are accepted; elements deeper than ``DEEP``
part blocks only. Pages of any length and number of blocks are read in one pass and labelled
whole, in slabs. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

PATH, LAST, WORDS, MEASURES = 384, 32, 32, 6
SIZE = PATH + LAST + WORDS + MEASURES
HIDDEN = 16
#: Training: pages, passes over them, seed.
PAGES, PASSES, SEED = 1500, 16, 17
#: Pages side by side, their blocks with padding, blocks of a page that are held as vectors at once, and characters read at once.
GROUP, CELLS, SLAB, READ = 64, 32_768, 16_384, 4 << 20

#: Elements that end a block, that hold no content, and whose content is no text.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg math".split())
#: Elements that a new element of the same group closes.
CLOSES = {"li": ("ul", "ol", "menu"), "p": ("div", "td", "article", "section", "li", "main", "aside", "body", "blockquote", "form", "footer", "header", "nav"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

#: Open elements at most; deeper ones part blocks but are no part of a path.
DEEP = 512

_START = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""[^>"']*""")
_NAME = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


def tags(page: str):
    """(start, end, name, attributes) of each tag, in one pass: the name is lower case, begins with a slash in closing tags and is empty for comments and declarations.

    A tag ends at the first > outside quotes. From the first tag that would not end so, quotes
    are ordinary characters; without any > ahead the rest is text.
    """
    n, at = len(page), 0
    last = {q: page.rfind(q) for q in "\"'>"}
    quoting = True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = yield start, n if end < 0 else end + 3, "", ""
            continue
        if start > last[">"]:
            return
        m = _START.match(page, start + 1)
        if not m:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):
                at = yield start, page.find(">", at) + 1, "", ""
            continue
        end = m.end()
        while quoting:
            end = _ATTRIBUTES.match(page, end).end()
            if end == n or page[end] == ">":
                break
            end = page.find(page[end], end + 1) + 1 if end < last[page[end]] else end + 1
        if end == n and quoting:
            quoting = False
        if not quoting:
            end = page.find(">", m.end())
        at = yield start, end + 1, m[0].lower(), page[m.end() : end]


def blocks(page: str) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """(path, text, characters in links) of each leaf block; a path's entries are an element's name, then words of its class, id and role."""
    out: list = []
    stack: list[tuple[str, ...]] = []
    open_: dict[str, int] = {}
    beyond: dict[str, int] = {}
    held: list[str] = []
    linked = links = at = 0
    n, last_raw = len(page), {}

    def close():
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((tuple(stack), text, linked))
            held, linked = [], 0

    def cut(k):
        for element in stack[k:]:
            open_[element[0]] -= 1
        del stack[k:]

    found = tags(page)
    try:
        now = next(found)
        while True:
            start, end, name, attrs = now
            if start > at:
                held.append(page[at:start])
                linked += (start - at) * bool(links)
            at = end
            if name.startswith("/"):
                name = name[1:]
                if name == "a":
                    links = max(0, links - 1)
                if name in BLOCK_TAGS:
                    close()
                if beyond.get(name):
                    beyond[name] -= 1
                elif open_.get(name):
                    cut(max(k for k in range(len(stack)) if stack[k][0] == name))
            elif name in RAW_TAGS and not attrs.endswith("/"):
                # Its content ends at its closing tag; where there is none ahead, none will come.
                if last_raw.get(name) is None:
                    ends = [m.start() for m in re.finditer(f"</{name}", page, re.I)]
                    last_raw[name] = ends
                ends = last_raw[name]
                k = bisect.bisect_left(ends, at)
                stop = page.find(">", ends[k]) if k < len(ends) else -1
                at = n if stop < 0 else stop + 1
            elif name in VOID_TAGS:
                if name == "hr":
                    close()
                elif name in ("br", "img", "input"):
                    held.append(" ")
            elif name:
                if name in BLOCK_TAGS:
                    close()
                    if name in CLOSES:
                        group = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in group:
                                cut(k)
                                break
                            if stack[k][0] in CLOSES[name]:
                                break
                elif name == "a":
                    links += 1
                if not attrs.endswith("/"):
                    if len(stack) < DEEP:
                        words = [w for x in _NAME.findall(attrs) for w in _PART.findall(x[1].lower())]
                        stack.append((name, *words))
                        open_[name] = open_.get(name, 0) + 1
                    else:
                        beyond[name] = beyond.get(name, 0) + 1
            now = found.send(at)
    except StopIteration:
        pass
    if at < n:
        held.append(page[at:])
        linked += (n - at) * bool(links)
    close()
    return out


@lru_cache(maxsize=100_000)
def _place(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    out = np.zeros(PATH + LAST, dtype=np.float32)
    for depth, element in enumerate(path):
        out[_place(element[0], PATH)] += 1
        for word in element[1:]:
            out[_place("." + word, PATH)] += 1.5
    if path:
        out[PATH + _place(path[-1][0], LAST)] = 1
    np.minimum(out, 2, out=out)
    return out


def vectors(page: list, first: int = 0, whole: int = 0) -> np.ndarray:
    """A row for each block of the page, or of its blocks from ``first`` on of ``whole``."""
    out = np.zeros((len(page), SIZE), dtype=np.float32)
    for k, (path, text, linked) in enumerate(page):
        out[k, : PATH + LAST] = _path_vector(path)
        words = text.split(" ")
        n = len(words)
        places = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, n) % WORDS
        out[k, PATH + LAST : PATH + LAST + WORDS] = np.minimum(np.bincount(places, minlength=WORDS), 4) / 4
        out[k, -MEASURES:] = (np.log1p(n) / 5, min(1.0, linked / len(text)), text.count(".") / n, len(text) / n / 10, (first + k) / (whole or len(page)), 1.0)
    return out


class Lstm:
    """One direction: parameters, forward and backward passes over padded (steps, pages, SIZE)."""

    def __init__(self, rng: np.random.Generator, size: int, hidden: int):
        self.w = rng.normal(0, 1 / np.sqrt(size), (size, 4 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, on: np.ndarray, keep: bool = False):
        t, n, _ = x.shape
        h = c = np.zeros((n, self.u.shape[0]), np.float32)
        k = self.u.shape[0]
        out, past = np.zeros((t, n, k), np.float32), []
        z = x.reshape(t * n, -1) @ self.w + self.b
        z = z.reshape(t, n, -1)
        for s in range(t):
            g = z[s] + h @ self.u
            gate = 1 / (1 + np.exp(-np.clip(g[:, : 3 * k], -30, 30)))
            i, f, o, new = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :], np.tanh(g[:, 3 * k :])
            m = on[s][:, None]
            c2 = np.where(m, f * c + i * new, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                past.append((h, c, i, f, o, new, tc, m))
            h, c = h2, c2
            out[s] = h
        return out, past

    def backward(self, x, past, dout):
        t, n, _ = x.shape
        k = self.u.shape[0]
        dz = np.zeros((t, n, 4 * k), np.float32)
        du = np.zeros_like(self.u)
        dh = dc = np.zeros((n, k), np.float32)
        for s in range(t - 1, -1, -1):
            h, c, i, f, o, new, tc, m = past[s]
            d = dh + dout[s]
            dm = d * m
            dcc = dc * m + dm * o * (1 - tc * tc)
            dz[s] = np.concatenate([dcc * new * i * (1 - i), dcc * c * f * (1 - f), dm * tc * o * (1 - o), dcc * i * (1 - new * new)], axis=1)
            du += h.T @ dz[s]
            dh = dz[s] @ self.u.T + d * ~m
            dc = dcc * f + dc * ~m
        flat = dz.reshape(t * n, -1)
        return [x.reshape(t * n, -1).T @ flat, du, flat.sum(axis=0)]


class Labeller:
    """Both directions and a logistic layer over them."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, SIZE, hidden), Lstm(rng, SIZE, hidden)
        self.v = rng.normal(0, 0.1, 2 * hidden + SIZE).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def _padded(self, pages: list[np.ndarray]):
        t = max(len(p) for p in pages)
        x = np.zeros((t, len(pages), SIZE), np.float32)
        y = np.zeros_like(x)
        on = np.zeros((t, len(pages)), bool)
        for k, p in enumerate(pages):
            x[: len(p), k], y[: len(p), k], on[: len(p), k] = p, p[::-1], True
        return x, y, on

    @staticmethod
    def _turned(h: np.ndarray, pages: list[np.ndarray]) -> np.ndarray:
        out = np.zeros_like(h)
        for k, p in enumerate(pages):
            out[: len(p), k] = h[: len(p), k][::-1]
        return out

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability that each block belongs to the article; pages of much the same length run side by side, padded to at most ``CELLS`` blocks."""
        out: list = [np.zeros(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: -len(pages[i])) if len(pages[i])]
        while order:
            group = max(1, min(GROUP, CELLS // len(pages[order[0]])))
            part, order = order[:group], order[group:]
            own = [pages[i] for i in part]
            if len(own[0]) > SLAB:
                out[part[0]] = self.long(lambda low, high, p=own[0]: p[low:high], len(own[0]))
                order = part[1:] + order
                continue
            x, y, on = self._padded(own)
            h = np.concatenate([self.ahead.forward(x, on)[0], self._turned(self.back.forward(y, on)[0], own), x], axis=2)
            p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
            for k, i in enumerate(part):
                out[i] = p[: len(pages[i]), k]
        return out

    def long(self, rows, n: int) -> np.ndarray:
        """The same for one page of n blocks, whose vectors ``rows(low, high)`` gives a slab at a time."""
        k = self.ahead.u.shape[0]
        gates = [np.empty((n, 4 * k), np.float32) for _ in range(2)]
        z = np.empty(n, np.float32)
        for low in range(0, n, SLAB):
            x = rows(low, low + SLAB)
            own = slice(low, low + len(x))
            z[own] = x @ self.v[2 * k :] + self.c
            for g, net in zip(gates, (self.ahead, self.back)):
                g[own] = x @ net.w + net.b
        for g, net, v, steps in ((gates[0], self.ahead, self.v[:k], range(n)), (gates[1], self.back, self.v[k : 2 * k], range(n - 1, -1, -1))):
            h = c = np.zeros(k, np.float32)
            for s in steps:
                a = g[s] + h @ net.u
                gate = 1 / (1 + np.exp(-np.clip(a[: 3 * k], -30, 30)))
                c = gate[k : 2 * k] * c + gate[:k] * np.tanh(a[3 * k :])
                h = gate[2 * k :] * np.tanh(c)
                z[s] += h @ v
        return 1 / (1 + np.exp(-z))

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], passes: int = PASSES, group: int = 30, rate: float = 0.01, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        own = [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]
        m, s, step = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own], 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i : i + group] for i in range(0, len(order), group)]
        for _ in range(passes):
            for g in rng.permutation(len(groups)):
                part = [pages[i] for i in groups[g]]
                x, y, on = self._padded(part)
                h1, past1 = self.ahead.forward(x, on, True)
                h2, past2 = self.back.forward(y, on, True)
                h = np.concatenate([h1, self._turned(h2, part), x], axis=2)
                p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
                goal = np.zeros_like(p)
                for k, i in enumerate(groups[g]):
                    goal[: len(labels[i]), k] = labels[i]
                d = ((p - goal) * on / on.sum()).astype(np.float32)
                dh = d[:, :, None] * self.v
                k = h1.shape[2]
                grads = [*self.ahead.backward(x, past1, dh[:, :, :k]), *self.back.backward(y, past2, self._turned(dh[:, :, k : 2 * k], part)), (h * d[:, :, None]).sum(axis=(0, 1)), np.array([d.sum()], np.float32)]
                step += 1
                for q, grad, a, b in zip(own, grads, m, s):
                    grad = np.clip(grad + 1e-5 * q, -1, 1)
                    a += 0.1 * (grad - a)
                    b += 0.01 * (grad * grad - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)


def synthetic_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A page and its blocks' texts with their labels, in page order."""
    letters = "abcdefghilmnoprstuvéüñ"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(120)]
    said: list[tuple[str, int]] = []

    def words(a, b):
        return [rng.choice(vocabulary) for _ in range(rng.randint(a, b))]

    def sentence(a=4, b=40):
        w = words(a, b)
        sign = rng.choice(("", "", "", ",", "***", "!!"))
        return (" ".join(x + sign * (rng.random() < 0.3) for x in w)).capitalize() + rng.choice(".....!?")

    def put(text, label, tag="", extra=""):
        said.append((text, label))
        inner = f"<{x}>{text}</{x}>" if (x := rng.choice(("b", "em", "span", "", "", "", ""))) else text
        return f"<{tag}{extra}>{inner}</{tag}>" if tag else inner

    def named(*names):
        name = rng.choice(names)
        return rng.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(vocabulary)}"', f" class='{rng.choice(vocabulary)}-{name}'"))

    def links(label, n):
        return "".join("<li>" + f'<a href="/{rng.choice(vocabulary)}">{put(" ".join(words(1, 4)), label)}</a></li>' for _ in range(n))

    def paragraphs(label, n, a=4, b=60):
        out = []
        for _ in range(n):
            if rng.random() < 0.15:
                text = sentence(a, b)
                said.append((text, label))
                out.append(f"<p><b>{text}<br>")
            else:
                out.append(put(" ".join(sentence(a, b) for _ in range(rng.randint(1, 3))), label, "p"))
        return "".join(out)

    def menu():
        tag = rng.choice(("nav", "nav", "div"))
        name = named("menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "topbar", "pagination", "tags", "toc") if tag == "div" or rng.random() < 0.5 else ""
        return f"<{tag}{name}><ul>{links(0, rng.randint(2, 9))}</ul></{tag}>"

    def advert():
        tag = rng.choice(("div", "div", "div", "aside", "section", "ins"))
        return f"<{tag}{named('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored', 'sponsor', 'adsense', 'promotion')}>{paragraphs(0, 1) if rng.random() < 0.4 else put(sentence(), 0)}</{tag}>"

    def notice():
        tag = rng.choice(("div", "div", "section", "aside", "p"))
        return f"<{tag}{named('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'privacy', 'warning', 'subscribe', 'newsletter', 'overlay')}>{put(sentence(), 0) if tag == 'p' or rng.random() < 0.5 else paragraphs(0, 1)}</{tag}>"

    def form():
        hint = paragraphs(0, 1, 3, 25) if rng.random() < 0.5 else ""
        return f'<form action="/{rng.choice(vocabulary)}">{hint}{put(" ".join(words(1, 3)), 0, "label")}<input name="q">{put(" ".join(words(1, 2)), 0, "button")}</form>'

    def sidebar():
        tag = rng.choice(("aside", "aside", "div", "section"))
        name = named("sidebar", "side", "related", "widget", "recommended", "more", "popular", "trending") if tag != "aside" or rng.random() < 0.5 else ""
        inside = put(" ".join(words(1, 4)), 0, rng.choice(("h2", "h3", "h4"))) if rng.random() < 0.6 else ""
        inside += rng.choice((lambda: f"<ul>{links(0, rng.randint(2, 6))}</ul>", lambda: paragraphs(0, rng.randint(1, 3))))()
        return f"<{tag}{name}>{inside}</{tag}>"

    def comments():
        tag = rng.choice(("section", "div", "ol", "ul", "aside"))
        item = "li" if tag in ("ol", "ul") else rng.choice(("div", "article"))
        inside = put(" ".join(words(1, 3)), 0, "h3") if tag not in ("ol", "ul") and rng.random() < 0.6 else ""
        for _ in range(rng.randint(1, 5)):
            inside += f"<{item}{named('comment', 'reply', 'comment-body')}>{paragraphs(0, rng.randint(1, 2))}</{item}>"
        if rng.random() < 0.3 and tag not in ("ol", "ul"):
            inside += form()
        return f"<{tag}{named('comments', 'commentlist', 'responses', 'disqus', 'discussion', 'replies', 'reader-comments')}>{inside}</{tag}>"

    def share():
        return f"<div{named('share', 'social', 'sharing', 'follow', 'buttons')}>{links(0, rng.randint(1, 4))}</div>"

    def article():
        out = []
        if rng.random() < 0.85:
            title = put(sentence(3, 14), 1, rng.choice(("h1", "h1", "h2")))
            out.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
        for _ in range(rng.randint(1, 5)):
            out.append(paragraphs(1, rng.randint(1, 6)))
            r = rng.random()
            if r < 0.12:
                out.append(put(sentence(2, 8), 1, rng.choice(("h2", "h3"))))
            elif r < 0.2:
                tag = rng.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(put(sentence(3, 12), 1, "li") for _ in range(rng.randint(2, 5))) + f"</{tag}>")
            elif r < 0.25:
                out.append("<blockquote>" + paragraphs(1, 1) + "</blockquote>" if rng.random() < 0.5 else put(sentence(), 1, "blockquote"))
            elif r < 0.29:
                out.append("<table>" + "".join("<tr>" + "".join(put(" ".join(words(1, 3)), 1, "td") for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif r < 0.32:
                out.append("<pre>" + put(sentence(), 1) + "</pre>")
            elif r < 0.35:
                out.append("<figure><img src=x>" + put(sentence(3, 10), 1, "figcaption") + "</figure>")
            elif r < 0.55:
                out.append(rng.choice((advert, sidebar, share, notice, form))())
        return "".join(out)

    title = " ".join(words(2, 9)).capitalize()
    said.append((title, 0))
    page = [f'<!DOCTYPE html><html lang="{rng.choice(vocabulary)}"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>']
    for part in rng.sample((menu, advert, notice, share, sidebar, form), rng.randint(0, 4)):
        page.append(part())
    if rng.random() < 0.5:
        page.append("<header" + (named("header", "site-header", "masthead", "top") if rng.random() < 0.5 else "") + ">" + put(" ".join(words(1, 5)), 0, rng.choice(("div", "p", "h1", "h2"))) + (menu() if rng.random() < 0.5 else "") + "</header>")
    if rng.random() < 0.3:
        page.append(menu())
    kind = rng.random()
    tag = "article" if kind < 0.45 else rng.choice(("main", "div", "section", "div", "div", ""))
    name = named("content", "main", "post", "entry", "article", "story", "body", "text", "entry-content", "post-body", "article-body") if tag and (tag in ("div", "section") or rng.random() < 0.25) else ""
    if rng.random() < 0.2:
        page.append(f"<main><{tag or 'div'}{name}>{article()}</{tag or 'div'}></main>")
    else:
        page.append(f"<{tag}{name}>{article()}</{tag}>" if tag else article())
    for part in rng.sample((comments, advert, sidebar, share, menu, notice, form, comments), rng.randint(0, 4)):
        page.append(part())
    if rng.random() < 0.85:
        foot = named("footer", "site-footer", "copyright", "bottom", "legal")
        inside = put("© " + sentence(2, 14), 0) if rng.random() < 0.5 else paragraphs(0, rng.randint(1, 2), 2, 20)
        page.append(f"<footer{foot if rng.random() < 0.3 else ''}>{inside}</footer>" if rng.random() < 0.7 else f"<div{foot}>{inside}</div>")
    return "".join(page) + "</body></html>", said


def training_set(count: int = PAGES, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    pages, labels = [], []
    while len(pages) < count:
        page, said = synthetic_page(rng)
        got = blocks(page)
        if [" ".join(t.split()) for t, _ in said] == [t for _, t, _ in got]:
            pages.append(vectors(got))
            labels.append(np.array([y for _, y in said], np.float32))
    return pages, labels


@lru_cache(maxsize=1)
def trained() -> Labeller:
    out = Labeller()
    out.train(*training_set())
    return out


def extracted(pages: list[str], labeller: Labeller) -> list[str]:
    """Main text of each page."""
    out: list[str] = []
    at = 0
    while at < len(pages):
        # Some pages of a bounded length in all, or one that is longer.
        held, first = 0, at
        while at < len(pages) and (at == first or held + len(pages[at]) <= READ):
            held += len(pages[at])
            at += 1
        cut = [blocks(p) for p in pages[first:at]]
        long = {i: labeller.long(lambda low, high, c=c: vectors(c[low:high], low, len(c)), len(c)) for i, c in enumerate(cut) if len(c) > SLAB}
        found = labeller.label([vectors(c) if i not in long else np.zeros((0, SIZE), np.float32) for i, c in enumerate(cut)])
        for i, c in enumerate(cut):
            out.append("\n".join(t for (_, t, _), p in zip(c, long.get(i, found[i])) if p >= 0.5))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    common.tune(pages.sparkSession)
    labeller = trained()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(batches):
        for batch in batches:
            text = extracted(batch["html"].to_pylist(), labeller)
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(batch["url"].to_pylist(), pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=schema)

    rows = common.whole_text(pages, "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(tokens.released(read), "page_id long, url string, text string, n_chars long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(common.table(spark, sf_dir, "pages"))
