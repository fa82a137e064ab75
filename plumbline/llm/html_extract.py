"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded from the root down.

A page is parsed into a tree of elements; each element gets features (subtree text and link density, tag density, punctuation,
tokens of class, id and role, depth, place among its siblings, its parent's figures). Boosted trees of depth 3 score each
element; the decoding keeps the set of elements of the greatest total score among those sets in which every kept element has a
kept parent, so that no ancestor and descendant contradict each other. Blocks of kept elements give the text. Text that is in no
element but the body is an element of its own, beside the body's others, and is scored like them.

The model is trained on the driver, once per process, from pages of a generator that knows its labels (PAGES pages, fixed
seed): no page of the corpus is looked at for training.

Defined cases: a null or empty html gives an empty text; text outside any element belongs to the body; unclosed and stray tags
are repaired as browsers do for paragraphs, list items and table cells; elements may nest to any depth; very long pages are read whole,
in time proportional to their length, whatever is unclosed in them; repeated rows give equal rows; an empty table gives an empty table;
columns named text give way, others stay.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, TREES, DEPTH, RATE = 700, 50, 3, 0.3

#: Elements whose content is raw text and no part of the page, up to their end tag; without one, up to the next tag of a block.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in "script style noscript template iframe textarea title".split()}
#: Elements that stand in the flow of a sentence and are judged by themselves; of what is in them only text counts. A block's tag ends them.
_WITHIN = frozenset("button select svg math".split())
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The end of a tag, or the quote that opens an attribute's value.
_STOP = re.compile(r">|(?<==)[\"']|(?<== )[\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(_ENDS_P | {'li', 'dt', 'dd', 'tr', 'td', 'th', 'tbody', 'thead', 'body', 'html'}, reverse=True))})(?=[\s/>])", re.I)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div main body aside nav".split())
_TAGS = "body article main section div p h1 h2 h3 h4 ul ol li table tr td blockquote pre figure nav header footer aside form button select svg math".split()
_TAG = {t: i for i, t in enumerate(_TAGS)}
#: Attribute tokens with a slot of their own; others share hashed slots.
_BESIDE = (
    "nav menu breadcrumb header masthead footer sidebar aside widget related ad ads advert sponsor promo banner cookie consent notice alert popup "
    "modal comment comments reply form search newsletter subscribe login share social tags pagination copyright navigation contentinfo complementary"
).split()
_MAIN = "article content post entry story main body text page".split()
_TOKENS = _BESIDE + _MAIN
_BESIDE_TAGS, _MAIN_TAGS = frozenset("nav header footer aside form".split()), frozenset(("article", "main"))
_TOKEN = {t: i for i, t in enumerate(_TOKENS)}
_HASHED = 8
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "place", "attrs", "children", "own", "linked", "commas", "elements")

    def __init__(self, tag: str, parent: int, depth: int, attrs: str):
        self.tag, self.parent, self.depth, self.attrs = tag, parent, depth, attrs
        self.place, self.children, self.own, self.linked, self.commas, self.elements = 0, 0, 0, 0, 0, 0


def _markup(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Start, end, whether it closes, name and attributes of each tag; no name for what is dropped whole (comments, scripts, ...).

    One pass: a tag ends at the first ``>`` outside the quotes of an attribute's value. Where such quotes leave a tag without an end,
    they are taken as plain characters from there on. A ``<`` that begins no tag, or has no ``>`` after it, is text.
    """
    at, quotes, size = 0, True, len(page)
    ends: dict[str, list[tuple[int, int]]] = {}  # of raw elements: all their end tags, from the last
    last = page.rfind(">")
    closing = {'"': page.rfind('"'), "'": page.rfind("'")}
    while (p := page.find("<", at)) >= 0:
        at = p + 1
        if page.startswith("!--", at):
            q = page.find("-->", p + 2)
            at = size if q < 0 else q + 3
            yield p, at, False, None, ""
            continue
        if p > last:
            continue
        if page.startswith(("!", "?"), at):
            at = page.find(">", p) + 1
            yield p, at, False, None, ""
            continue
        name = _NAME.match(page, at)
        if not name:
            continue
        k, end = name.end(), -1
        while quotes and (stop := _STOP.search(page, k)):
            c = stop.group()
            if c == ">":
                end = stop.start()
                break
            k = stop.end()
            if closing[c] < k:
                break
            k = page.find(c, k) + 1
            if k > last:
                break
        if end < 0:
            quotes = False
            end = page.find(">", name.end())
        at = end + 1
        tag, attrs = name[2].lower(), page[name.end() : end]
        if tag in _RAW and not name[1]:
            if not attrs.endswith("/") or tag in ("script", "style"):
                if tag not in ends:
                    ends[tag] = [m.span() for m in _RAW[tag].finditer(page)][::-1]
                while ends[tag] and ends[tag][-1][0] < at:
                    ends[tag].pop()
                if ends[tag]:
                    at = ends[tag][-1][1]
                else:
                    block = _BLOCK.search(page, at)
                    at = block.start() if block else size
            yield p, at, False, None, ""
        else:
            yield p, at, bool(name[1]), tag, attrs


def parse(page: str) -> tuple[list[Node], list[tuple[int, bool, str]]]:
    """Elements in page order and pieces of text (element, starts a new block, raw text).

    Element 0 is the page itself and has no text; element 1, the body, holds the text that is in no other element.
    """
    nodes, pieces = [Node("#page", -1, 0, ""), Node("body", 0, 1, "")], []
    nodes[0].children = 1
    stack, at, fresh, links = [0], 0, True, 0
    tags = ["#page"]
    #: Where in the stack the open elements of each name are, and those that hide what is open below them.
    open_: dict[str, list[int]] = {}
    scopes: list[int] = []

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        i = stack[-1] or 1
        node = nodes[i]
        if not raw.isspace():
            n = len(raw)
            node.own += n
            node.commas += raw.count(",") + raw.count(".")
            if links:
                node.linked += n
            pieces.append((i, fresh, raw))
            fresh = False
        elif pieces and not fresh:
            pieces.append((i, False, " "))

    def close(k: int, block: bool = True) -> None:
        nonlocal fresh, links
        while len(tags) > k:
            fresh = fresh or block
            stack.pop()
            t = tags.pop()
            open_[t].pop()
            if t in _SCOPES:
                scopes.pop()
            links = 0

    for start, end, ends, tag, attrs in _markup(page):
        text(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in _INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                links = 0 if ends else 1
            continue
        if tag in ("html", "body", "head"):
            if tag == "body" and not ends:
                nodes[1].attrs = attrs
            continue
        if tags[-1] in _WITHIN and tag != tags[-1]:
            if not _BLOCK.match(page, start):  # a part of it
                text(" ")
                continue
            if not ends:
                close(len(tags) - 1)
        if tag in _WITHIN:
            if ends:
                if tags[-1] == tag:
                    close(len(tags) - 1, False)
                continue
            if tags[-1] == tag:
                close(len(tags) - 1, False)
        else:
            fresh = True
        if ends:
            if open_.get(tag):
                close(open_[tag][-1])
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            if tags[-1] == "p":
                close(len(tags) - 1)
        elif tag in _SAME:
            while (k := max((open_[t][-1] for t in _SAME[tag] if open_.get(t)), default=0)) > (scopes[-1] if scopes else 0):
                close(k)
                if tag != "tr":
                    break
        parent = stack[-1]
        node = Node(tag, parent, nodes[parent].depth + 1, attrs)
        node.place = nodes[parent].children
        nodes[parent].children += 1
        open_.setdefault(tag, []).append(len(tags))
        if tag in _SCOPES:
            scopes.append(len(tags))
        stack.append(len(nodes))
        tags.append(tag)
        nodes.append(node)
    text(page[at:])
    return nodes, pieces


def _tokens_of(attrs: str) -> list[int]:
    words = [w for a in _ATTRIBUTE.findall(attrs) for w in _SPLIT.split((a[1] or a[2] or a[3]).lower()) if w]
    slots = {_TOKEN[w] if w in _TOKEN else len(_TOKENS) + sum(w.encode()) % _HASHED for w in words}
    return sorted(slots)


_FIXED = 23
WIDTH = _FIXED + len(_TAGS) + len(_TOKENS) + _HASHED


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    own = np.array([x.own for x in nodes], float)
    linked = np.array([x.linked for x in nodes], float)
    commas = np.array([x.commas for x in nodes], float)
    parent = [x.parent for x in nodes]
    size, total, links, points = np.ones(n), own.copy(), linked.copy(), commas.copy()
    below = np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        total[p] += total[i]
        links[p] += links[i]
        points[p] += points[i]
        below[p] = max(below[p], below[i] + 1)
    up = np.maximum(np.array(parent), 0)
    whole = max(total[0], 1.0)
    out = np.zeros((n, WIDTH), np.float32)
    kids = np.array([x.children for x in nodes], float)
    place = np.array([x.place for x in nodes], float)
    base = np.cumsum(total) - total  # about the share of the page's text before the element
    fixed = (
        np.log1p(total), np.log1p(own), links / np.maximum(total, 1), points / np.maximum(total, 1), size / np.maximum(total, 1),
        np.log1p(size), np.array([x.depth for x in nodes], float), below, kids, place, place / np.maximum(kids[up] - 1, 1),
        total / whole, total / np.maximum(total[up], 1), links[up] / np.maximum(total[up], 1), np.log1p(total[up]),
        np.minimum(base / whole, 8), kids[up],
    )
    for k, x in enumerate(fixed):
        out[:, k] = x
    at = len(fixed)
    for i, x in enumerate(nodes):
        if (t := _TAG.get(x.tag)) is not None:
            out[i, _FIXED + t] = 1
        beside, main = float(x.tag in _BESIDE_TAGS), float(x.tag in _MAIN_TAGS)
        out[i, at], out[i, at + 1] = beside, main
        if x.attrs:
            for s in _tokens_of(x.attrs):
                out[i, _FIXED + len(_TAGS) + s] = 1
                if s < len(_TOKENS):
                    out[i, at + 2 + (s >= len(_BESIDE))] += 1
        # What an element or any around it says of itself.
        p = max(x.parent, 0)
        out[i, at + 4] = max(out[p, at + 4] if i else 0, beside, out[i, at + 2])
        out[i, at + 5] = max(out[p, at + 5] if i else 0, main, out[i, at + 3])
    return out


# --- training pages -------------------------------------------------------------------------------------------------

_GOOD_BOXES = ('<article>', '<main>', '<div class="article-body">', '<div id="content">', '<section class="post">', '<div class="entry-content">', '<article class="story">', '<div role="main">')
_BAD_BOXES = (
    ("nav", ""), ("nav", 'class="menu"'), ("div", 'class="nav"'), ("ul", 'class="breadcrumb"'), ("header", ""), ("div", 'id="header"'), ("footer", ""), ("div", 'class="footer"'),
    ("aside", ""), ("div", 'class="sidebar"'), ("div", 'class="widget"'), ("div", 'class="related"'), ("div", 'class="ad"'), ("div", 'class="ads banner"'), ("div", 'class="sponsor promo"'),
    ("div", 'class="cookie-notice"'), ("div", 'class="alert notice"'), ("div", 'id="consent"'), ("div", 'class="popup modal"'), ("form", ""), ("div", 'class="newsletter subscribe"'),
    ("section", 'id="comments"'), ("div", 'class="comment"'), ("div", 'class="reply"'), ("div", 'class="share social"'), ("div", 'class="tags"'), ("div", 'class="pagination"'),
)


def _training_page(rng: random.Random, more: random.Random | None = None) -> str:
    """A page; what is inside of an element with the attribute data-keep is main text. more: draws what stands within sentences, and controls
    by themselves, of which there are none otherwise."""
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdfglmnrst") for _ in range(rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    prose = lambda: " ".join(line(4, 14) for _ in range(rng.randint(1, 9)))
    marked = lambda w: rng.choice((f'<a href="/{word()}">{w}</a>', f"<i>{w}</i>", f"<em>{w}</em>"))
    written = lambda: " ".join(marked(w) if rng.random() < 0.1 else w for w in prose().split())
    ended = lambda t, s: f"<{t}>{flow(s) if t == 'p' else s}" + (f"</{t}>" if rng.random() < 0.9 else "")
    flow = lambda s: s if more is None or more.random() > 0.12 else s.replace(" ", f" {within()} ", 1)
    within = lambda: more.choice((f"<button>{word_()}</button>", f"<math><mi>{word_()}</mi></math>", f'<button type="button">{word_()} {word_()}</button>', f"<math><mi>x</mi><mo>=</mo><mn>{more.randint(1, 99)}</mn></math>"))
    word_ = lambda: "".join(more.choice("aeiou") + more.choice("bdfglmnrst") for _ in range(more.randint(1, 3)))
    control = lambda: "" if more is None or more.random() > 0.3 else more.choice((f"<button data-drop>{word_()}</button>", f'<button class="btn" data-drop>{word_()} {word_()}</button>', f"<select data-drop><option>{word_()}<option>{word_()}<option>{word_()}</select>", f"<svg data-drop><path d=1 /><text>{word_()}</text></svg>"))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def bad() -> str:
        tag, attrs = rng.choice(_BAD_BOXES)
        inner = links() if tag in ("nav", "ul") or rng.random() < 0.3 else (prose() if rng.random() < 0.5 else ended("p", prose()))
        if tag == "form":
            inner = f"<p>{line(2, 5)}</p><input><button>{word()}</button>"
        return f"<{tag} {attrs}>{inner}</{tag}>"

    def good() -> str:
        r = rng.random()
        if r < 0.72:
            return ended("p", f"<b>{prose()}</b>" if rng.random() < 0.1 else written() if rng.random() < 0.4 else prose() if rng.random() < 0.7 else " ".join(rng.choice("abc") for _ in range(rng.randint(1, 30))))
        if r < 0.82:
            return f"<h2>{line(2, 6)}</h2>"
        if r < 0.9:
            return "<ul>" + "".join(f"<li>{line(3, 9) if rng.random() < 0.8 else marked(word())}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        return rng.choice((f"<blockquote><p>{prose()}</p></blockquote>", f"<pre>{prose()}</pre>", f"<div>{prose()}</div>", f"<table><tr><td>{line(1, 3)}</td><td>{line(1, 3)}</td></tr></table>"))

    if rng.random() < 0.15:  # no box: loose text in the body, among paragraphs or alone
        loose = lambda: rng.choice((prose, written))() + rng.choice(("", "<br>", "<br><br>")) + (prose() if rng.random() < 0.4 else "")
        marked_p = lambda: f"<p data-keep>{prose()}" + rng.choice(("", "</p>"))
        inside = [loose(), *(rng.choice((loose, marked_p))() if rng.random() < 0.7 else bad() for _ in range(rng.randint(0, 6)))]
        return "<body data-keep>" + "".join(bad() for _ in range(rng.randint(0, 2))) + (f"<h1 data-keep>{line(2, 9)}</h1>" if rng.random() < 0.5 else "") + "".join(inside)
    # Loose words in the body that aren't main text.
    stray = lambda: "" if rng.random() < 0.6 else rng.choice((line(1, 4), f'<a href="/{word()}">{line(1, 3)}</a>', " | ".join(f'<a href="/">{word()}</a>' for _ in range(rng.randint(2, 6)))))

    box = rng.choice(_GOOD_BOXES)
    tag = box[1:].split()[0].rstrip(">")
    inside = [good() for _ in range(rng.randint(0, 12))]
    for _ in range(rng.randint(0, 2) if rng.random() < 0.4 else 0):
        inside.insert(rng.randint(0, len(inside)), bad().replace(">", " data-drop>", 1))
    body = box.replace(">", " data-keep>") + (f"<h1>{line(2, 9)}</h1>" if rng.random() < 0.8 else "") + "".join(x + control() for x in inside) + f"</{tag}>"
    if rng.random() < 0.4:
        wrap = rng.choice(("<div>", '<div class="container">', '<div id="wrapper">', "<main>"))
        body = wrap + (bad() if rng.random() < 0.4 else "") + body + (bad() if rng.random() < 0.5 else "") + f"</{wrap[1:].split()[0].rstrip('>')}>"
    return "".join(bad() + stray() for _ in range(rng.randint(0, 3))) + body + stray() + "".join(bad() + stray() for _ in range(rng.randint(0, 4)))


def _labels(nodes: list[Node]) -> np.ndarray:
    """1: main text or around it; 0: not. An element around both is 1, as its parent chain must be kept."""
    inside, dropped = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        p = x.parent
        dropped[i] = (p >= 0 and dropped[p]) or "data-drop" in x.attrs
        inside[i] = ((p >= 0 and inside[p]) or "data-keep" in x.attrs) and not dropped[i]
    for i in range(len(nodes) - 1, 0, -1):
        if inside[i]:
            inside[nodes[i].parent] = True
    return inside.astype(float)


# --- boosted trees --------------------------------------------------------------------------------------------------


class Trees:
    """Complete trees of one depth: at each inner place a feature and a threshold (left if at most), at each leaf a value."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.start, self.trees = start, trees

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, rate: float = RATE, bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    cuts = [c if len(c) > 1 or c[0] < x[:, k].max() else c[:0] for k, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    p = np.average(y, weights=weight)
    start = float(np.log(p / (1 - p)))
    score, made = np.full(len(y), start), []
    inner = 2**DEPTH - 1
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = weight * (y - prob), weight * prob * (1 - prob)
        feature, threshold, place = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.nonzero(place == node)[0]
                best, choice = 1e-6, None
                g, h = grad[mine].sum(), hess[mine].sum()
                for k in range(x.shape[1] if len(mine) else 0):
                    if not len(cuts[k]):
                        continue
                    b = binned[mine, k]
                    gl = np.cumsum(np.bincount(b, grad[mine], len(cuts[k]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[mine], len(cuts[k]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain[j := int(np.argmax(gain))] > best:
                        best, choice = gain[j], (k, cuts[k][j])
                if choice:
                    feature[node], threshold[node] = choice
                place[mine] = 2 * node + 1 + (x[mine, feature[node]] > threshold[node])
        leaf = np.zeros(inner + 1)
        for j in range(inner + 1):
            mine = place == inner + j
            leaf[j] = rate * grad[mine].sum() / (hess[mine].sum() + 1)
        score += leaf[place - inner]
        made.append((feature, threshold, leaf))
    return Trees(start, made)


@functools.cache
def default_model(pages: int = PAGES, seed: int = 7) -> Trees:
    rng, more, xs, ys = random.Random(seed), random.Random(seed), [], []
    for k in range(pages + pages // 2):  # the last third with controls and formulas, or of a few words and nothing else
        bare = k >= pages and more.random() < 0.1
        nodes, _ = parse("<body data-keep>" + " ".join(["word"] * more.randint(1, 12)) if bare else _training_page(rng, more if k >= pages else None))
        xs.append(features(nodes)[1:])
        ys.append(_labels(nodes)[1:])
    x, y = np.concatenate(xs), np.concatenate(ys)
    return boost(x, y, 1 + x[:, 0] / 4)


# --- decoding -------------------------------------------------------------------------------------------------------


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The kept elements: greatest sum of scores such that each kept element's parent is kept. The page is always kept."""
    n, gain = len(nodes), score.astype(float).copy()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[nodes[i].parent] and gain[i] > 0
    return keep


def _join(pieces: list[tuple[int, bool, str]], keep: np.ndarray) -> str:
    blocks: list[str] = []
    now: list[str] = []
    broken = False
    for node, fresh, raw in pieces:
        broken = broken or fresh
        if keep[node]:
            if broken and now:
                blocks.append("".join(now))
                now = []
            broken = False
            now.append(raw)
    blocks.append("".join(now))
    texts = (" ".join((entities.unescape(b) if "&" in b else b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def extract_many(pages: list[str | None], model: Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    xs = [features(nodes) for nodes, _ in parsed]
    score = model.score(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for (nodes, pieces), x in zip(parsed, xs, strict=True):
        keep = decode(nodes, score[at : at + len(x)])
        at += len(x)
        out.append(_join(pieces, keep))
    return out


def extract(pages: DataFrame, html: str = "html", model: Trees | None = None) -> DataFrame:
    """pages without html and with text."""
    model = model or default_model()
    kept = [c for c in pages.columns if c not in (html, "text")]

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[str] = []
            for k in range(0, len(batch), 200):
                found += extract_many(batch.iloc[k : k + 200].tolist(), model)
            yield pd.Series(found, dtype=object)

    return pages.select(*[F.col(f"`{c}`") for c in kept], texts(F.col(html)).alias("text"))
