"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi.

A page is read by one pass over its tags, with the end tags that HTML leaves out implied; each run of text between block
boundaries is a leaf block with its open ancestors.  Features are the ancestors' tags, what their class and id names say,
and the block's text (length, links, end punctuation, place).  A chain of two labels, article and rest, has a weight for
each feature and label and for each pair of neighbouring labels; weights maximise the likelihood of labelled pages.

Labelled pages are of two kinds: a bounded sample of the corpus whose blocks lie inside or outside an ``article`` or
``main`` element, and pages laid out by ``drawn_page`` in ways that such a sample lacks, with known labels.  Each page of the
sample is learned from twice, the second time without the features that say where these elements are, so that what its text
and names tell is learned, too.

A ``form`` element round much text and few inputs is a page's wrapper and no form.
"""

from __future__ import annotations

import html as _html
import json
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_columns

#: Bounds of the training set: pages sampled from the corpus by a hash of page_id, and pages drawn.
SAMPLE_PAGES, DRAWN_PAGES = 150, 500
#: Long pages are learned from in chains of so many blocks.
CHAIN = 200
#: A form has fewer characters of text than this for each of its inputs.
FORM_CHARS = 100

# Element names by how HTML treats them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe".split())
_CONTROL = frozenset("button select svg canvas video audio object noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_FRAME = frozenset("html head body hr".split())
_FIELDS = frozenset("input select textarea button".split())
_UNSEEN = re.compile(r"\btype\s*=\s*[\"']?hidden", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[^\s/>]*")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STEP = re.compile(r">|=\s*[\"']")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_PLACES = re.compile(rf"<(/?)({'|'.join(sorted(_CONTROL | _BLOCK, key=len, reverse=True))})(?=[\s/>])", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Words of class and id names, by the kind of block they speak of.
_KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar topbar pagination pager skip links toc",
    "frame": "header footer masthead banner site copyright legal bottom top colophon",
    "side": "sidebar aside side rail widget related recommended promo teaser trending popular tags author bio newsletter subscribe signup",
    "ad": "ad ads advert advertisement advertising sponsor sponsored dfp gpt outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast privacy",
    "comment": "comment comments disqus reply replies discussion respond feedback",
    "form": "form search login contact poll survey share social sharing",
    "article": "article content main post entry story body text page paragraph prose wysiwyg",
}
_KIND = {word: kind for kind, words in _KINDS.items() for word in words.split()}
#: Of a name that begins so, what follows says what is elsewhere or how things are shown.
_STATES = ("has-", "has_", "with-", "no-", "is-", "js-", "hide-", "show-")
#: What the names of an article's own element may say of it.
_OF_ARTICLES = frozenset({"comment", "ad", "side", "article", "hidden"})
_COPYRIGHT = re.compile(r"©|\(c\) |all rights reserved|^copyright\b|\bcopyright\b.{0,12}\d{4}", re.I)


@dataclass
class Block:
    """A leaf block: its text, the names of the elements open around it, the innermost, what their names say, linked share,
    what the nearest of such names says, and the number of the innermost form."""

    text: str
    tags: frozenset[str]
    leaf: str
    kinds: frozenset[str]
    link: float
    near: frozenset[str] = frozenset()
    form: int = -1


class _Open:
    """The open elements that structure a page, with counts by name and by kind, so that each step costs the same at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.tags: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        self.named: list[frozenset[str]] = [frozenset()]
        self.forms: list[int] = [-1]
        self.inputs: list[int] = []

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else "-"

    def push(self, tag: str, kinds: frozenset[str]) -> None:
        self.stack.append((tag, kinds))
        self.tags[tag] += 1
        if kinds:
            self.kinds.update(kinds)
            self.named.append(kinds)
        if tag == "form":
            self.forms.append(len(self.inputs))
            self.inputs.append(0)

    def pop(self) -> None:
        tag, kinds = self.stack.pop()
        self.tags[tag] -= 1
        if kinds:
            self.kinds.subtract(kinds)
            self.named.pop()
        if tag == "form":
            self.forms.pop()

    def input(self) -> None:
        """Counts a field for the innermost form."""
        if self.forms[-1] >= 0:
            self.inputs[self.forms[-1]] += 1

    def close(self, tag: str) -> None:
        """Ends the innermost element of that name and all within it; nothing if none is open."""
        if self.tags[tag]:
            while self.top() != tag:
                self.pop()
            self.pop()

    def imply(self, tag: str) -> None:
        """Ends what the start of a block ends: a paragraph or heading on top, a control left open, the item or cell before."""
        while self.top() == "p" or self.top() in _CONTROL or (tag in _HEADINGS and self.top() in _HEADINGS):
            self.pop()
        if tag == "li" and self.top() == "li" or tag in ("dt", "dd") and self.top() in ("dt", "dd"):
            self.pop()
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") and self.top() in ("td", "th"):
            self.pop()
        if tag in ("tr", "tbody", "thead", "tfoot") and self.top() == "tr":
            self.pop()
        if tag in ("tbody", "thead", "tfoot") and self.top() in ("tbody", "thead", "tfoot"):
            self.pop()


def _kinds(tag: str, attributes: str) -> frozenset[str]:
    """What the class, id and role of an element say.  A form is told by its element, and an article by few words."""
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    found = set()
    for m in _NAMES.finditer(attributes) if tag != "form" else ():
        for name in (m[1] or m[2] or m[3] or "").split():
            if not name.lower().startswith(_STATES):
                found |= {_KIND[w] for w in map(str.lower, _PARTS.findall(name)) if w in _KIND}
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return frozenset(found & _OF_ARTICLES if tag in ("article", "main") else found)


class _Reader:
    """Finds where tags, comments and raw texts end.

    What fails is kept, so that a page of beginnings without ends costs one look at each place, too.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: set[str] = set()
        self.name = (0, -1)
        self.step: tuple[int, int, re.Match | None] = (0, -1, None)
        self.failed: set[int] = set()
        self.controls: dict[str, list[tuple[int, bool]]] | None = None
        self.starts: list[int] = []

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def name_end(self, at: int) -> int:
        """Where the name that begins at ``at`` ends."""
        if not self.name[0] <= at < self.name[1]:
            self.name = (at, _NAME.match(self.page, at).end())
        return self.name[1]

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` of the tag whose name ends at ``at``; -1 without one.  Quoted values may hold ``>``."""
        if not self.step[0] <= at <= self.step[1]:
            m = _STEP.search(self.page, at)
            self.step = (at, m.start() if m else len(self.page), m)
        m, seen = self.step[2], []
        while m and m.start() not in self.failed:
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            quote = self.find(m[0][-1], m.end())
            m = _STEP.search(self.page, m.end() if quote < 0 else quote + 1)
        self.failed.update(seen)
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """The place of the end tag of a raw text; -1 without one."""
        if f"</{tag}" in self.none:
            return -1
        m = _RAW_ENDS[tag].search(self.page, at)
        if m is None:
            self.none.add(f"</{tag}")
            return -1
        return m.start()

    def control_end(self, tag: str, at: int) -> tuple[int, bool]:
        """Where the control whose start tag begins at ``at`` has its end tag, if before the next of its kind (else -1), and whether blocks are inside."""
        if self.controls is None:
            self.controls = {}
            for m in _PLACES.finditer(self.page):
                if (name := m[2].lower()) in _CONTROL:
                    self.controls.setdefault(name, []).append((m.start(), bool(m[1])))
                elif not m[1]:
                    self.starts.append(m.start())
        own = self.controls.get(tag, [])
        k = bisect_right(own, (at, True))
        if k == len(own) or not own[k][1]:
            return -1, False
        s = bisect_right(self.starts, at)
        return own[k][0], s < len(self.starts) and self.starts[s] < own[k][0]


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, their character references decoded and white space made single spaces.

    One pass over the page.  Texts of scripts, styles, titles, text areas and frames are left out, as is what a control (a
    button, a list of choices, a drawing or a player) holds, unless blocks stand in it: those are read like others.  A control
    that is never closed ends with the next block.  A ``<`` that no ``>`` follows is text.
    """
    page = page or ""
    out: list[Block] = []
    opened, reader = _Open(), _Reader(page)
    pieces: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)

    def close() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, frozenset(t for t, k in opened.tags.items() if k), opened.top(), frozenset(t for t, k in opened.kinds.items() if k), min(1.0, linked / len(text)), opened.named[-1], opened.forms[-1]))
        pieces, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    while at < n:
        sign = page.find("<", at)
        if sign < 0:
            add(page[at:])
            break
        add(page[at:sign])
        ends = page.startswith("/", sign + 1)
        begin = sign + 1 + ends
        if page[begin : begin + 1] not in _LETTERS:
            if ends or page[begin : begin + 1] in ("!", "?"):
                at = _declared(reader, sign, add)
            else:
                add("<")
                at = sign + 1
            continue
        name_end = reader.name_end(begin)
        end = reader.tag_end(name_end)
        if end < 0:
            add("<")
            at = sign + 1
            continue
        at = end
        tag, attributes = page[begin:name_end].lower(), page[name_end : end - 1]
        if not ends and tag in _FIELDS and not _UNSEEN.search(attributes):
            opened.input()
        if ends:
            if tag == "a":
                in_link = False
            elif tag in _BLOCK or tag in _FRAME:
                close()
                opened.close(tag)
            elif tag in _CONTROL and opened.tags[tag]:
                close()
                opened.close(tag)
        elif tag in _RAW:
            place = reader.raw_end(tag, at)
            if place >= 0:
                at = reader.tag_end(place + 2 + len(tag))
                at = n if at < 0 else at
                pieces.append(" ")
            elif tag in ("script", "style"):
                at = n
        elif tag in _CONTROL and not attributes.endswith("/"):
            place, holds_blocks = reader.control_end(tag, sign)
            if place >= 0 and not holds_blocks:
                at = reader.tag_end(place + 2 + len(tag))
                at = n if at < 0 else at
                pieces.append(" ")
            else:
                close()
                opened.push(tag, _kinds(tag, attributes))
                if holds_blocks:
                    opened.push("held", frozenset())
        elif tag in _BLOCK:
            close()
            opened.imply(tag)
            opened.push(tag, _kinds(tag, attributes))
        elif tag in _FRAME:
            close()
        elif tag == "a":
            in_link = True
        elif tag in _VOID and tag != "wbr":
            pieces.append(" ")
    close()
    chars = [0] * len(opened.inputs)
    for b in out:
        if b.form >= 0:
            chars[b.form] += len(b.text)
    for b in out:
        if b.form >= 0 and chars[b.form] >= FORM_CHARS * opened.inputs[b.form]:
            b.tags -= {"form"}
    return out


def _declared(reader: _Reader, sign: int, add: Callable[[str], None]) -> int:
    """Passes over a comment, a declaration or an instruction; the text of a CDATA section is text.  Returns where it ends."""
    page = reader.page
    if page.startswith("<!--", sign):
        if page.startswith(">", sign + 4) or page.startswith("->", sign + 4):
            return page.index(">", sign) + 1
        end = reader.find("-->", sign + 4)
        return len(page) if end < 0 else end + 3
    if page.startswith("<![CDATA[", sign) and (end := reader.find("]]>", sign)) >= 0:
        add(_html.escape(page[sign + 9 : end], quote=False))
        return end + 3
    end = reader.find(">", sign)
    if end < 0:
        add("<")
        return sign + 1
    return end + 1


_END = frozenset(".!?…。\"”»")


def block_features(page: list[Block]) -> list[list[str]]:
    out = []
    for b in page:
        text = b.text
        size = len(text)
        words = text.count(" ") + 1
        own = {f"in {t}" for t in b.tags}
        own |= {f"is {x}" for x in b.kinds} | {f"near {x}" for x in b.near}
        own.add(f"leaf {b.leaf}")
        if not b.tags & {"article", "main"}:
            own |= {f"{t} outside" for t in b.tags & {"header", "p", "div", "section"}} | {"outside"}
        own.add(f"words {min(3, words.bit_length() // 2)}")
        own.add("link all" if b.link > 0.8 else "link some" if b.link > 0.2 else "link none")
        own.add("ends" if text[-1] in _END else "open")
        if _COPYRIGHT.search(text):
            own.add("copyright" if b.tags & {"article", "main"} else "copyright outside")
        if size < 25 and words <= 4:
            own.add("label")
        out.append(sorted(own))
    return out


@dataclass
class Model:
    """Weights for the label article against the rest: of features, of the chain's start, and of neighbouring labels."""

    weights: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    pair: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


def decode(model: Model, features: list[list[str]]) -> list[bool]:
    """The likeliest labels, by Viterbi."""
    if not features:
        return []
    w, pair = model.weights, model.pair
    (rr, ra), (ar, aa) = pair
    rest, art, back = 0.0, model.start + sum(w.get(f, 0.0) for f in features[0]), []
    for own in features[1:]:
        gain = sum(w.get(f, 0.0) for f in own)
        to_rest, to_art = (rest + rr, art + ar), (rest + ra, art + aa)
        back.append((to_rest[1] > to_rest[0], to_art[1] > to_art[0]))
        rest, art = max(to_rest), max(to_art) + gain
    out = [art > rest]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 200, rate: float = 0.3, ridge: float = 0.002) -> Model:
    """The weights that maximise the labels' likelihood, by AdaGrad over all pages, with forward and backward sums."""
    pages = [(f, y) for f, y in pages if f]
    if not pages:
        return Model({"in article": 4.0, "in main": 4.0}, -2.0)
    names = {x: k for k, x in enumerate(sorted({f for page, _ in pages for own in page for f in own}))}
    longest, n = max(len(f) for f, _ in pages), len(pages)
    ids = np.array([names[x] for page, _ in pages for own in page for x in own])
    cell = np.repeat(np.array([i * longest + t for i, (page, _) in enumerate(pages) for t in range(len(page))]), [len(own) for page, _ in pages for own in page])
    mask = np.array([[t < len(page) for t in range(longest)] for page, _ in pages])
    gold = np.array([[t < len(y) and y[t] for t in range(longest)] for _, y in pages]).astype(float)
    w, start, pair = np.zeros(len(names)), 0.0, np.zeros((2, 2))
    seen = [np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    both = mask[:, 1:] & mask[:, :-1]
    gold_pair = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    # Time comes first in the arrays, so that a step is over whole rows; the score of rest is 0 everywhere.
    mask, gold, both = mask.T.copy(), gold.T.copy(), both.T.copy()
    cell = (cell % longest) * n + cell // longest
    for _ in range(rounds):
        emit = np.bincount(cell, weights=w[ids], minlength=n * longest).reshape(longest, n)
        emit[0] += start
        ahead, behind = np.zeros((2, longest, n)), np.zeros((2, longest, n))
        ahead[1, 0] = emit[0]
        for t in range(1, longest):
            for y in (0, 1):
                step = np.logaddexp(ahead[0, t - 1] + pair[0, y], ahead[1, t - 1] + pair[1, y]) + (emit[t] if y else 0.0)
                ahead[y, t] = np.where(mask[t], step, ahead[y, t - 1])
        for t in range(longest - 2, -1, -1):
            for x in (0, 1):
                step = np.logaddexp(pair[x, 0] + behind[0, t + 1], pair[x, 1] + emit[t + 1] + behind[1, t + 1])
                behind[x, t] = np.where(mask[t + 1], step, 0.0)
        total = np.logaddexp(ahead[0, -1], ahead[1, -1])
        p = np.where(mask, np.exp(np.clip(ahead[1] + behind[1] - total, -50, 0)), 0.0)
        joint = np.zeros((2, 2))
        for x in (0, 1):
            for y in (0, 1):
                step = ahead[x, :-1] + pair[x, y] + (emit[1:] if y else 0.0) + behind[y, 1:] - total
                joint[x, y] = np.where(both, np.exp(np.clip(step, -50, 0)), 0.0).sum()
        slope = [np.bincount(ids, weights=(gold * mask - p).ravel()[cell], minlength=len(names)) / n - ridge * w / 10, (gold[0] - p[0]).sum() / n, (gold_pair - joint) / n - ridge * pair / 10]
        for k, g in enumerate(slope):
            seen[k] = seen[k] + g * g
        w = w + rate * slope[0] / np.sqrt(seen[0])
        start = start + rate * slope[1] / np.sqrt(seen[1])
        pair = pair + rate * slope[2] / np.sqrt(seen[2])
    return Model({x: float(w[k]) for x, k in names.items()}, float(start), tuple(tuple(map(float, r)) for r in pair))


def drawn_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page in one of many layouts, and the texts of its article's blocks."""
    letters = "etaoinshrdlu"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 6, b: int = 30) -> str:
        return words(a, b).capitalize() + rng.choice(". . . ! ?".split())

    def listed(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3).capitalize()}</a></li>' for i in range(k)) + "</ul>"

    def boxed(tags: list[str], names: list[str], inside: str) -> str:
        tag = rng.choice(tags)
        return f'<{tag}{rng.choice(["", " "]) and f" class={chr(34)}{rng.choice(names)}{chr(34)}" or ("" if tag != "div" else f" class={chr(34)}{rng.choice(names)}{chr(34)}")}>{inside}</{tag}>'

    menu = boxed(["nav", "div"], ["menu", "navbar", "main-nav", "breadcrumbs"], listed(rng.randint(3, 8)))
    aside = f"<aside{rng.choice(['', ' class=related', ' class=note-box'])}>{rng.choice(['', f'<h3>{words(1, 3)}</h3>'])}<p>{sentence(3, 25)}</p></aside>"
    head = boxed(["header", "div"], ["site-header", "masthead", "topbar"], f"<a href='/'>{words(1, 2)}</a><p>{sentence(3, 9)}</p>" + rng.choice(["", menu]))
    side = boxed(["aside", "div"], ["sidebar", "widget", "related-posts", "newsletter"], f"<h3>{words(1, 3)}</h3>" + rng.choice([listed(4), f"<p>{sentence()}</p>"]))
    advert = boxed(["div"], ["ad", "advert banner", "sponsored", "ads-box"], rng.choice([sentence(3, 15), f"<p>{sentence(3, 25)}</p>"]))
    cookie = boxed(["div", "section"], ["cookie-notice", "consent", "gdpr modal"], f"<p>{sentence()}</p><button>OK</button>")
    form = f"<form class='{rng.choice(['search', 'login', 'newsletter'])}'><label>{words(1, 3)}</label><input name=q><p>{sentence(3, 12)}</p></form>"
    talk = boxed(["section", "div"], ["comments", "comment-list", "disqus"], f"<h2>{words(1, 2)}</h2>" + "".join(rng.choice([f'<div class="comment"><p>{sentence(4, 40)}</p></div>', f"<article class='comment'><p>{sentence(4, 40)}</p></article>"]) for _ in range(rng.randint(1, 4))))
    rights = f"{rng.choice(['&copy;', 'Copyright', 'Copyright &copy;', '(c)'])} {rng.randint(1998, 2026)} {words(1, 2)}"
    foot = rng.choice([boxed(["footer", "div"], ["footer", "site-footer", "copyright"], f"&copy; {words(1, 2)} &middot; {sentence(3, 12)}"), boxed(["footer", "div"], ["footer", "bottom"], rights), f"<div>{rights}{rng.choice(['', '. All rights reserved.'])}</div>"])
    share = boxed(["div"], ["share", "social-links", "tags"], listed(3))
    # Some pages are bare.
    often = rng.choice([0.0, 0.2, 0.5, 0.5, 0.5])
    article: list[str] = []
    lead, terse = "", rng.random() < 0.3
    if rng.random() < 0.15:
        article.append(sentence(5, 25))
        lead = f"<p>{article[-1]}</p>"
    body = ""
    for k in range(rng.choice([1, 2, 3, 5, 8, 14])):
        kind = rng.random()
        text = words(2, 10).capitalize() if k == 0 and kind < 0.8 else words(2, 6).capitalize() if kind < 0.1 else sentence(1, 4) if kind < (1 if terse else 0.25) else " | ".join(words(1, 3) for _ in range(rng.randint(1, 9))) if kind < 0.35 else " ".join(sentence(1, 25) for _ in range(rng.randint(1, 6)))
        tag = "h1" if k == 0 and kind < 0.8 else rng.choice(["h2", "h2", "h3", "h4"]) if kind < 0.1 else rng.choice(["p", "p", "p", "p", "blockquote", "li", "div"])
        article.append(text)
        shown = text if rng.random() < 0.8 else f'<b>{text}</b>' if rng.random() < 0.5 else " ".join([f"<a href='x'>{text.split()[0]}</a>", *text.split()[1:]])
        shown = f"<ul><li>{shown}</ul>" if tag == "li" else f"<{tag}>{shown}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>")
        body += f"<header>{shown}</header>" if tag == "h1" and rng.random() < 0.4 else f"<section>{shown}</section>" if rng.random() < 0.15 else shown
        if rng.random() < 0.2:
            body += aside
        elif rng.random() < 0.07:
            # A note that belongs to the text.
            article.append(sentence(4, 25))
            body += f'<div class="{rng.choice(["warning", "note", "message", "tip", "info-box"])}">{rng.choice(["{}", "<p>{}</p>"]).format(article[-1])}</div>'
        if rng.random() < 0.2:
            body += rng.choice([advert, share, side, f"<button>{words(1, 2).capitalize()}", f"<button>{words(1, 2)}", f"<button><div>{words(1, 4)}</div></button>", f"<select><option>{words(1, 1)}<option>{words(1, 2)}", f"<form><p>{sentence(2, 9)}</p><select><option>{words(1, 1)}</select></form>", f"<template><p>{sentence()}</p></template>", f"<noscript><p>{sentence(3, 9)}</p></noscript>"])
    holder = rng.choice(["article", "article", "main", "main article", "div", "div"]) if often else rng.choice(["article", "main", "div", ""])
    if holder == "div":
        body = f'<div class="{rng.choice(["content", "post-body", "entry-content", "article-text", "story", "main"])}">{body}</div>'
    elif not holder:
        body = f"{body}{rng.choice(['', talk])}"
    elif holder == "main article":
        body = f"<main><article{rng.choice(['', ' class=message', ' class=%spost has-comments no-sidebar%s' % (chr(34), chr(34))])}>{body}</article>{rng.choice(['', talk, side])}</main>"
    else:
        body = f"<{holder}>{body}{rng.choice(['', '', talk, share])}</{holder}>"
    before = [x for x in (head, menu, cookie, advert, form, side) if rng.random() < often]
    after = [x for x in (share, side, advert, talk, form, cookie) if rng.random() < 0.7 * often] + [foot] * (rng.random() < 1.7 * often)
    rng.shuffle(before)
    rest = "".join(before), "".join(after)
    wrap = rng.choice(["{}", '<div class="container">{}</div>', '<div id="page" class="wrapper">{}</div>', '<form id="aspnetForm" method="post"><input type="hidden" name="state">{}</form>'])
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>" + wrap.format(f"{rest[0]}{lead}{body}{rest[1]}") + rng.choice(["</body></html>", ""]), article


def labelled(page: str, article: list[str]) -> tuple[list[list[str]], list[bool]]:
    found, wanted = blocks(page), list(article)
    marks = []
    for b in found:
        marks.append(b.text in wanted)
        if marks[-1]:
            wanted.remove(b.text)
    return block_features(found), marks


def by_structure(page: str) -> tuple[list[list[str]], list[bool]] | None:
    """A page's features with labels by its markup, where it has an article or main element that holds text."""
    if not re.search(r"<(article|main)\b", page, re.I):
        return None
    found = blocks(page)
    outside = {"nav", "aside", "footer", "form", "button", "select", "template", "noscript"}
    marks = [bool({"article", "main"} & b.tags) and not outside & b.tags and not b.kinds - {"article"} for b in found]
    return (block_features(found), marks) if any(marks) else None


_PLACE = re.compile(r"in (article|main)$|.*outside$")


def without_place(page: list[list[str]]) -> list[list[str]]:
    """The features but those that say where article and main elements are."""
    return [[f for f in own if not _PLACE.match(f)] for own in page]


def chains(page: list[list[str]], marks: list[bool]) -> list[tuple[list[list[str]], list[bool]]]:
    """A page in chains of bounded length, so that a long one has as many as it takes."""
    return [(page[k : k + CHAIN], marks[k : k + CHAIN]) for k in range(0, len(page), CHAIN)]


def fit(pages: DataFrame, seed: int = 3) -> Model:
    """The model of a bounded sample of the pages and of drawn ones; tasks read the sample, the driver gets its features."""
    order = F.xxhash64(F.lit(seed), "page_id")
    known = pages.where("html is not null").withColumn("__order", order)
    # Ids come to the driver first, so that no pages are sent for that.
    first = [r[0] for r in known.select("__order").orderBy("__order").limit(SAMPLE_PAGES).collect()]
    sample = known.where(F.col("__order") <= max(first, default=0)).select("__order", "html")

    def read(batches):
        for batch in batches:
            told = [by_structure(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(x) if x else None for x in told], pa.string())], names=["order", "told"])

    read_rows = sample.mapInArrow(read, "order long, told string").orderBy("order", "told").limit(SAMPLE_PAGES).collect()
    rng = random.Random(seed)
    drawn = [labelled(*drawn_page(rng)) for _ in range(DRAWN_PAGES)]
    told = [tuple(json.loads(r["told"])) for r in read_rows if r["told"]]
    return train([c for page, marks in [*drawn, *told, *((without_place(page), marks) for page, marks in told)] for c in chains(page, marks)])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, decode(model, block_features(found)), strict=True) if keep)


def extract(pages: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The pages with text, the article's blocks joined by line ends, and n_chars, its code points.

    A null or empty page, one without text and one all of rest give an empty text; equal pages give equal texts.  Input
    columns are kept (or ``keep`` of them), but for those with an added one's name.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(x.as_py(), held.value) for x in batch.column("html")]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}

    return add_columns(pages, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), compute, keep)
