"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi.

A page is read tag by tag, tolerantly (unclosed tags, truncated pages). Text between block tags is a leaf block; inline
tags do not break it. A block's features are its ancestors' kinds (from tags, and from words in class, id and role), its
own tag, and its text's form: length, words, link share, ending, digits, signs. No feature reads words of any language.

The field is trained by penalised maximum likelihood (forward-backward, Adam) on labelled pages, which this module makes
from a seed: layouts with article, menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in
semantic tags or plain divisions, with invented text. Training takes about a second on the driver and has one size.

Defined results: null, empty and text-free html give the empty text; repeated rows are read each for itself; a page of
any length is read whole; unknown references stay as written; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_names, map_rows

#: Labelled pages that the field is trained on, and their seed.
PAGES, SEED = 700, 11
STEPS, RATE, PENALTY = 250, 0.15, 0.003

#: HTML's tags by what they do to the flow of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPE = frozenset("article aside body div fieldset footer form header li main nav section table td th".split())

#: Kinds of ancestors by tag, and by words of class, id and role.
KINDS = ["nav", "header", "footer", "aside", "form", "ad", "notice", "comment", "content", "main", "head", "link", "list", "table", "heading", "related"]
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
TAG_KIND = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "select": "form", "textarea": "form", "label": "form", "option": "form", "dialog": "notice", "article": "content", "main": "main", "head": "head", "title": "head", "noscript": "head", "a": "link", "ul": "list", "ol": "list", "dl": "list", "table": "table", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading"}
WORD_KIND = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav toc pager pagination",
    "header": "header masthead topbar site-header banner-top pagehead hd",
    "footer": "footer foot copyright legal colophon bottom ft contentinfo",
    "aside": "sidebar aside side widget rail complementary secondary",
    "form": "form login signup signin search subscribe newsletter contact field",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "notice": "notice cookie cookies consent gdpr alert notification popup modal overlay warning disclaimer toast announcement",
    "comment": "comment comments commentlist discussion disqus reply replies respond reader responses feedback thread",
    "content": "content article post entry story text articlebody postbody body copy prose",
    "main": "main maincontent primary",
    "related": "related recommended more share social sharing tags trending popular read-next meta",
}
KIND_OF_WORD = {w: k for k, words in WORD_KIND.items() for w in words.split()}

#: What stands in a tag after its name: a quote opens a quoted value only after an equals sign, else it is text; `>` ends the
#: tag outside quoted values. An unclosed quote is text too. Every character can be taken, so that nothing is tried twice.
_INSIDE = r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+"
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*\Z)|<svg\b{_INSIDE}(?<=/)>|<(script|style|template|svg|iframe|noframes|xmp)\b{_INSIDE}(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|\Z)|</(?:[^>]*>|[^>]*\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))?)?", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


#: Parts of a name that say what a box lacks, counts or holds elsewhere, not what it is: comments-disabled, has-sidebar, no-nav.
LACKS = frozenset("no not non without with has off none disabled closed count layout".split())
#: A word that says little beside one of content: text-more.
WEAK = frozenset(["more"])


@lru_cache(1 << 16)
def attribute_kinds(attributes: str) -> int:
    """Bits of the kinds that words of class, id and role name."""
    out = 0
    for found in _ATTRIBUTE.finditer(attributes):
        if found[1].lower() not in ("class", "id", "role"):
            continue
        for word in _WORD.findall((found[2] or found[3] or found[4] or "").lower()):
            parts = word.split("-")
            if not LACKS.isdisjoint(parts):
                continue
            said = {}
            for part in (word, *parts):
                for form in (part, part.rstrip("0123456789"), part.removesuffix("s")):
                    if form in KIND_OF_WORD:
                        said[form] = KIND_OF_WORD[form]
                        break
            if "content" in said.values():
                said = {form: kind for form, kind in said.items() if form not in WEAK}
            for kind in said.values():
                out |= BIT[kind]
    return out


@dataclass
class Block:
    text: str
    kinds: int
    tag: str
    link_chars: int
    chars: int


BAD = sum(BIT[k] for k in ("nav", "header", "footer", "aside", "form", "ad", "notice", "comment", "head", "related"))
GOOD = BIT["content"] | BIT["main"]
#: What an open list item, row or cell is not sought beyond, and tags whose names may belong to a whole page rather than to a part.
STOPS = frozenset("ul ol dl table select tr".split())
WRAPPERS = frozenset("div section form center body".split())


class Open:
    """The open elements: (tag, kinds, whether it is a wrapper of a bad kind, where it begins). Places by tag, and of elements that end
    a search, are kept besides, so that looking for one costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, int]] = [("#root", 0, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes, self.stops = [0], [0], [0]

    def push(self, name: str, kinds: int, wraps: bool, start: int) -> None:
        at = len(self.stack)
        self.stack.append((name, kinds, wraps, start))
        self.places.setdefault(name, []).append(at)
        for held, among in ((self.blocks, name not in INLINE), (self.scopes, name in SCOPE), (self.stops, name in STOPS)):
            if among:
                held.append(at)

    def close(self, name: str, bounds: list[int]) -> None:
        """Close the last element of that tag, and all in it, unless the last of bounds lies inside it."""
        places = self.places.get(name)
        if not places or places[-1] < bounds[-1]:
            return
        at = places[-1]
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        for held in (self.blocks, self.scopes, self.stops):
            while held[-1] >= at:
                held.pop()


ANY = [0]


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks with text, in order. If none is plainly an article's, wrappers that hold the first article or main element
    name nothing: a whole page may be called contact-page or nav-expanded, or be one form."""
    found, wrappers = read(page, frozenset())
    if wrappers and not any(b.kinds & GOOD and not b.kinds & BAD for b in found):
        found, _ = read(page, wrappers)
    return found


def read(page: str, mute: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """(the leaf blocks, where the wrappers of bad kinds around the first article or main element begin). Elements that begin at
    a place in mute name nothing."""
    out: list[Block] = []
    open_ = Open()
    stack = open_.stack
    wrappers: frozenset[int] | None = None
    pieces: list[str] = []
    kinds, tag, link_chars, chars = 0, "#root", 0, 0

    def text(piece: str) -> None:
        nonlocal kinds, tag, link_chars, chars
        if "&" in piece:
            piece = html_lib.unescape(piece)
        if not pieces or not chars:
            kinds = stack[-1][1]
            tag = stack[open_.blocks[-1]][0]
        pieces.append(piece)
        n = len(piece.strip())
        chars += n
        if stack[-1][1] & BIT["link"]:
            link_chars += n

    def close() -> None:
        nonlocal link_chars, chars
        if chars:
            found = " ".join("".join(pieces).split())
            if found:
                out.append(Block(found, kinds, tag, link_chars, chars))
        pieces.clear()
        link_chars = chars = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        inline = name in INLINE
        if not inline:
            close()
        if m[2]:
            open_.close(name, open_.blocks if inline else ANY)
            continue
        if name in CLOSES_P:
            open_.close("p", open_.scopes)
        elif name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            open_.close(name, open_.stops)
        if name in VOID:
            continue
        own = BIT[TAG_KIND[name]] if name in TAG_KIND else 0
        attributes = m[4]
        if attributes and "=" in attributes and name not in ("body", "html"):
            own |= attribute_kinds(attributes)
        if wrappers is None and name in ("article", "main"):
            wrappers = frozenset(start for _, _, wraps, start in stack if wraps)
        if m.start() in mute:
            own &= ~BAD
        open_.push(name, stack[-1][1] | own, name in WRAPPERS and bool(own & BAD), m.start())
    if at < len(page):
        text(page[at:])
    close()
    return out, wrappers or frozenset()


TAGS = {t: i for i, t in enumerate(["p", "div", "li", "h1", "h2", "h3", "td", "span", "blockquote", "article", "section", "body", "title", "pre", "figcaption", "label"])}
N_FEATURES = 1 + len(KINDS) + len(TAGS) + 1 + 6 + 4 + 5 + 3


def active(b: Block) -> list[int]:
    """Places of a block's features, all of value 1."""
    out = [0]
    base = 1
    out += [base + i for i in range(len(KINDS)) if b.kinds >> i & 1]
    base += len(KINDS)
    out.append(base + TAGS.get(b.tag, len(TAGS)))
    base += len(TAGS) + 1
    n = len(b.text)
    out.append(base + (n > 15) + (n > 40) + (n > 80) + (n > 160) + (n > 400))
    base += 6
    share = b.link_chars / max(b.chars, 1)
    out.append(base + (share > 0.05) + (share > 0.4) + (share > 0.9))
    base += 4
    signs = (b.text[-1] in ".!?…。»”\"", b.text[0] in "©®™" or "©" in b.text, b.text.count(" ") < 3, sum(c.isdigit() for c in b.text) * 5 > n, "|" in b.text or "·" in b.text)
    out += [base + i for i, s in enumerate(signs) if s]
    base += 5
    good, bad = bool(b.kinds & GOOD), bool(b.kinds & BAD)
    out += [base + i for i, s in enumerate((good and not bad, bad, not good and not bad)) if s]
    return out


@dataclass(frozen=True)
class Field:
    """weights[label, feature], transitions[from, to], first[label]; label 1 is main text."""

    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not found:
            return []
        (w0, w1), ((t00, t01), (t10, t11)) = self.lists, self.transitions.tolist()
        back, a, b = [], *self.first.tolist()
        for i, block in enumerate(found):
            at = active(block)
            e0, e1 = sum([w0[k] for k in at]), sum([w1[k] for k in at])
            if i:
                from0, from1 = a + t00 < b + t10, a + t01 < b + t11
                back.append((from0, from1))
                a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01)
            a, b = a + e0, b + e1
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    @property
    def lists(self) -> list[list[float]]:
        return self.weights.tolist()


def extract(field: Field, page: str) -> str:
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, field.decode(found)) if label)


def train(pages: list[tuple[list[Block], list[int]]]) -> Field:
    """Maximum likelihood with an L2 penalty, on all pages at once."""
    n, most = len(pages), max(len(b) for b, _ in pages)
    x, y, mask = np.zeros((n, most, N_FEATURES)), np.zeros((n, most), np.int64), np.zeros((n, most))
    for i, (found, labels) in enumerate(pages):
        for j, b in enumerate(found):
            x[i, j, active(b)] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, 1
    flat = x.reshape(n * most, N_FEATURES)
    gold = np.eye(2)[y] * mask[:, :, None]
    pairs = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum(axis=(0, 1))
    theta = [np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.zeros(2)]
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for turn in range(1, STEPS + 1):
        weights, moves, first = theta
        score = (flat @ weights.T).reshape(n, most, 2)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = score[:, 0] + first
        for j in range(1, most):
            step = lse(forward[:, j - 1, :, None] + moves, 1) + score[:, j]
            forward[:, j] = np.where(mask[:, j, None] > 0, step, forward[:, j - 1])
        for j in range(most - 2, -1, -1):
            step = lse(moves + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(mask[:, j + 1, None] > 0, step, 0)
        total = lse(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        double = np.exp(forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [((gold - single).reshape(-1, 2).T @ flat) / n - PENALTY * weights, (pairs - double.sum(axis=(0, 1))) / n - PENALTY * moves, (gold[:, 0] - single[:, 0]).sum(axis=0) / n - PENALTY * first]
        for t, g, m in zip(theta, grads, moments):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            t += RATE * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-8)
    return Field(*theta)


class Maker:
    """Invented labelled pages. Main text is marked by a sign that no other text has, which is taken out again."""

    SIGN = "\x02"

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"] + ["an", "el", "or", "ust", "ing"]

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.pick(*self.syllables) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(int(self.rng.integers(lo, hi + 1))))

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        return self.words(lo, hi).capitalize() + self.pick(".", ".", ".", "!", "?")

    def prose(self, lo: int = 1, hi: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(lo, hi + 1))))

    def odd(self) -> str:
        """Text of no form that prose has: separated, repeated, signed or shouted words, or none that end."""
        words = self.words(2, 40).split()
        return self.pick(" | ".join(words), " ".join(w for w in words for _ in range(4)), " ".join(w + self.pick("###", "$$$", "***", "%%%") for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(words), " ".join(str(int(self.rng.integers(1, 10**6))) for _ in words))

    def box(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        """inner in a semantic tag, or in a division named for what it is, or in both."""
        name = self.pick(*names)
        named = self.pick(f' class="{name}"', f' id="{name}"', f' class="box {name}"', f" class='{name}'")
        return self.pick(f"<{tag}>{inner}</{tag}>", f"<{tag}{named}>{inner}</{tag}>", f"<div{named}>{inner}</div>", f"<div{named}><div>{inner}</div></div>") if tag not in ("div", "section") else f"<{tag}{named}>{inner}</{tag}>"

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(lo, hi + 1)))]
        return self.pick("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items))

    def nav(self) -> str:
        return self.box("nav", ("nav", "menu", "navbar", "breadcrumbs", "topnav"), self.links(3, 8))

    def header(self) -> str:
        return self.box("header", ("header", "masthead", "site-header"), self.pick(f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 3)}</div>", f'<a href="/">{self.words(1, 2)}</a>') + (f"<p>{self.sentence(3, 8)}</p>" if self.chance(0.5) else "") + (self.nav() if self.chance(0.3) else ""))

    def footer(self) -> str:
        return self.box("footer", ("footer", "site-footer", "copyright", "legal"), self.pick(f"&copy; {self.words(1, 2)} &middot; {self.sentence()}", f"<p>&copy; 20{self.rng.integers(10, 30)} {self.words(1, 3)}. {self.sentence()}</p>", self.links(2, 5), f"<p>{self.prose(1, 3)}</p>"))

    def aside(self) -> str:
        return self.box("aside", ("sidebar", "widget", "side-rail"), f"<h3>{self.words(1, 3)}</h3>" + self.pick(self.links(2, 6), f"<p>{self.prose(1, 3)}</p>"))

    def ad(self) -> str:
        return self.box("div", ("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad"), self.pick(self.sentence(), f"<p>{self.prose(1, 2)}</p>", f'<a href="#">{self.sentence(3, 7)}</a>'))

    def notice(self) -> str:
        return self.box("div", ("cookie-notice", "notice", "consent", "alert", "gdpr-banner", "cookies"), self.pick(f"<p>{self.prose(1, 3)}</p>", self.sentence(6, 16)) + self.pick("", f"<button>{self.words(1, 2)}</button>"))

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(int(self.rng.integers(1, 4)))) + f"<button>{self.words(1, 2)}</button>"
        return self.pick("<form>", '<form class="newsletter">', '<form action="/s" id="login">') + self.pick("", f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.words(2, 4)}</h3>") + inner + "</form>"

    def comments(self) -> str:
        one = lambda: self.pick(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose(1, 4)}</p></div>', f"<li><cite>{self.words(1, 2)}</cite> <p>{self.prose(1, 3)}</p></li>", f"<p><b>{self.words(1, 1)}:</b> {self.prose(1, 3)}</p>", f"<p>{self.prose(1, 3)}</p>")
        return self.box("section", ("comments", "commentlist", "discussion", "reader-comments", "replies"), self.pick("", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.rng.integers(1, 99)} {self.words(1, 1)}</h3>") + "".join(one() for _ in range(int(self.rng.integers(1, 6)))))

    def related(self) -> str:
        return self.box("div", ("related", "share", "social", "tags", "recommended"), self.pick("", f"<h3>{self.words(1, 3)}</h3>") + self.links(2, 5))

    def article(self) -> str:
        s, odd = self.SIGN, self.chance(0.25)
        part = lambda tag, text: self.pick(f"<{tag}>{s}{text}</{tag}>", f"<{tag}>{s}{text}</{tag}>\n", f"<{tag}>{s}<b>{text}<br>{s}" if tag == "p" and self.chance(0.3) else f"<{tag}>{s}{text}</{tag}>")
        out = [part(self.pick("h1", "h1", "h2"), self.pick(self.words(2, 9).capitalize(), self.sentence()))] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 9))):
            kind = self.rng.random()
            if kind < 0.7:
                out.append(part("p", self.odd() if odd and self.chance(0.8) else self.pick(self.prose(1, 6), self.prose(1, 2), self.sentence(1, 5))))
            elif kind < 0.77:
                out.append(part(self.pick("h2", "h3"), self.words(1, 6).capitalize()))
            elif kind < 0.83:
                out.append(self.pick("<ul>", "<ol>") + "".join(f"<li>{s}{self.pick(self.sentence(), self.words(2, 8))}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{s}{self.prose(1, 2)}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{s}{self.words(1, 3)}</td><td>{s}{self.rng.integers(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                out.append(f'<p>{s}{self.sentence()} <a href="/x">{self.words(1, 4)}</a> {self.sentence()}</p>')
            else:
                out.append(f"{s}{self.prose(1, 3)}<br>{s}{self.sentence()}<hr>")
            if self.chance(0.08):
                out.append(self.pick(self.ad, self.related, self.form, self.notice)())
        return "".join(out)

    def page(self) -> tuple[list[Block], list[int]]:
        main = self.article()
        if self.chance(0.12):
            main += self.comments()
        main = self.pick(
            f"<article>{main}</article>", f"<article>{main}</article>", f"<main><article>{main}</article></main>", f"<main>{main}</main>",
            f'<div id="content">{main}</div>', f'<div class="post-content">{main}</div>', f'<div class="entry">{main}</div>', f'<section class="story">{main}</section>', f"<div>{main}</div>", main,
        )
        thin = self.chance(0.25)
        before = [] if thin else [p() for p in (self.nav, self.header, self.notice, self.ad, self.aside, self.form) if self.chance(0.45)]
        after = [p() for p in (self.comments, self.related, self.aside, self.ad, self.form, self.notice) if self.chance(0.15 if thin else 0.35)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        after += [self.footer()] if self.chance(0.85) else []
        body = "".join(before) + main + "".join(after)
        if self.chance(0.3):
            name = self.pick("wrapper", "page", "contact-page", "header-fixed", "nav-expanded", "post-meta-wrap", "comments-open", "sidebar-visible") if "<article>" in main[:9] or "<main>" in main[:6] else self.pick("wrapper", "page")
            body = self.pick(f'<div id="{name}">{body}</div>', f'<div class="{name}">{body}</div>')
        head = "" if self.chance(0.3) else f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
        if self.chance(0.1):
            page = page[: int(len(page) * (0.5 + 0.5 * self.rng.random()))]
        found = blocks(page)
        labels = [int(self.SIGN in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(self.SIGN, "") or "."
        return found, labels


@cache
def trained(pages: int = PAGES, seed: int = SEED) -> Field:
    maker = Maker(seed)
    made = [maker.page() for _ in range(pages)]
    return train([m for m in made if m[0]])


def main_text(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None, field: Field | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """keep (all columns by default), the main text and its code points, under names (text and n_chars by default, with
    underscores before a name that keep has)."""
    keep = pages.columns if keep is None else keep
    names = free_names(keep, "text", "n_chars") if names is None else names
    place = pages.columns.index(html)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def make():
        field = shared.value

        def work(batch):
            found = [extract(field, p.as_py() or "") for p in batch.column(place)]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return work

    return map_rows(pages, keep, T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())]), make)
