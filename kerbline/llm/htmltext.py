"""Main text of web pages: boosted trees over DOM nodes and a decoding that fits the tree.

A tolerant reader turns a page into elements. Each element gets features of its subtree (text,
words, link share, text to tag density), of the tokens in its class, id and role and those of its
ancestors, of its depth and of its siblings. Gradient-boosted trees, trained in numpy on pages
made here whose truth is known, estimate the chance that its own text is main text. The decoding
then gives each element one of three states so that the total likelihood is largest: text (its
children are text or clutter), frame (no text of its own; its children may be anything) or
clutter (all below it is clutter too), so an element inside clutter is never kept.

Character references are decoded; white space inside a block becomes one space; blocks are
joined by one space in page order. States of equal likelihood go to text, then to clutter. Scripts, styles, comments and other parts that aren't text
never count. Null and empty pages, and pages without main text, give the empty text; repeated
rows repeat; pages are never cut.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
HIDDEN = RAW | set("head noscript template iframe svg math canvas object select option button datalist audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Elements and attribute tokens that features name.
TAGS = "html body div p section article main header footer nav aside form ul ol li h1 h2 h3 h4 table td tr blockquote pre figure figcaption dl dd address fieldset a span".split()
TOKENS = "nav menu head foot side ad ads advert promo sponsor cookie consent notice alert banner comment reply discuss share social form search login subscribe newsletter related recommend widget breadcrumb thread respond response feedback article content main post entry story body text title author meta".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
TOKEN_AT = {t: i for i, t in enumerate(TOKENS)}

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>", re.S)
HTML, BODY = re.compile(r"<html\b", re.I), re.compile(r"<body\b", re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
#: Tokens that tell what an element hasn't or what stands elsewhere on the page.
NEGATED = re.compile(r"(?<![a-z])(?:no|non|not|without|hide|has|have|with|is)[-_]+[a-z]+")
SPACE = re.compile(r"\s+")


class Page:
    """Elements in page order: tag, parent, own text pieces and counts."""

    __slots__ = ("tags", "parents", "tokens", "texts", "links", "order")

    def __init__(self, html: str):
        self.tags, self.parents, self.tokens = ["#"], [-1], [()]
        self.links = [0]
        self.order: list[tuple[int, str]] = []  # (element, text); an empty text ends a block
        if not HTML.search(html):  # fragments get the elements that browsers imply, so depths compare
            html = f"<html>{'' if BODY.search(html) else '<body>'}{html}"
        self._read(html)

    def _read(self, html: str) -> None:
        stack, names, at, hidden, link = [0], ["#"], 0, 0, 0
        order, tags, links = self.order, self.tags, self.links
        raw = None
        for m in PIECE.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at and not hidden:
                text = html[at : m.start()]
                order.append((stack[-1], text))
                if link:
                    links[stack[-1]] += len(text)
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:  # an end tag
                if tag in names:
                    while names:
                        last, gone = names.pop(), stack.pop()
                        hidden -= last in HIDDEN
                        link -= last == "a"
                        if last not in INLINE:
                            order.append((gone, ""))
                        if last == tag:
                            break
                    if not names:
                        names, stack = ["#"], [0]
                elif tag in ("br", "p"):
                    order.append((stack[-1], ""))
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    order.append((stack[-1], ""))
                continue
            if tag in CLOSES_P and "p" in names:
                self._close(names, stack, {"p"}, set())
                hidden, link = sum(n in HIDDEN for n in names), names.count("a")
            if tag in SAME_CLOSES:
                self._close(names, stack, SAME_CLOSES[tag], SCOPES[tag])
                hidden, link = sum(n in HIDDEN for n in names), names.count("a")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            attributes = m[3]
            if tag in INLINE and "class" not in attributes and "id" not in attributes:
                own = stack[-1]  # a plain inline element is part of its block
            else:
                own = len(tags)
                tags.append(tag)
                self.parents.append(stack[-1])
                links.append(0)
                self.tokens.append(tuple(p for v in NAMED.findall(attributes) for p in PARTS.findall(NEGATED.sub("", (v[0] or v[1] or v[2]).lower()))) if "=" in attributes else ())
            if attributes.endswith("/") and tag not in INLINE:
                order.append((own, ""))
                continue
            stack.append(own)
            names.append(tag)
            hidden += tag in HIDDEN
            link += tag == "a"
            if tag not in INLINE:
                order.append((own, ""))
        if at < len(html) and not hidden:
            order.append((stack[-1], html[at:]))

    def _close(self, names: list[str], stack: list[int], which: set[str], scope: set[str]) -> None:
        for i in range(len(names) - 1, 0, -1):
            if names[i] in scope:
                return
            if names[i] in which:
                for gone in stack[i:]:
                    self.order.append((gone, ""))
                del names[i:], stack[i:]
                return

    def main(self, kept: np.ndarray) -> str:
        blocks, block = [], []
        for element, text in self.order:
            if not text:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif kept[element]:
                block.append(text)
        if block:
            blocks.append("".join(block))
        out = [SPACE.sub(" ", unescape(b)).strip() for b in blocks]
        return " ".join(b for b in out if b)


NUMBERS = 16
FEATURES = NUMBERS + 2 * len(TAGS) + 2 * len(TOKENS)
BINS = 32


def features(page: Page) -> np.ndarray:
    """A row of small whole numbers for each element."""
    n = len(page.tags)
    own, words = np.zeros(n), np.zeros(n)
    for element, text in page.order:
        if text:
            own[element] += len(text)
            words[element] += text.count(" ") + 1
    parents = page.parents
    total, linked, count, spoken = own.copy(), np.array(page.links, float), np.ones(n), words.copy()
    depth, children = np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        total[p] += total[i]
        linked[p] += linked[i]
        count[p] += count[i]
        spoken[p] += spoken[i]
        children[p] += 1
    place, same, largest = np.zeros(n), np.zeros(n), np.zeros(n)
    seen: dict[tuple[int, str], int] = {}
    met = np.zeros(n)
    flags = np.zeros((n, 2 * len(TAGS) + 2 * len(TOKENS)), np.uint8)
    k = 2 * len(TAGS)
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        place[i] = met[p]
        met[p] += 1
        key = (p, page.tags[i])
        seen[key] = seen.get(key, 0) + 1
        largest[p] = max(largest[p], total[i])
        t = TAG_AT.get(page.tags[i])
        if t is not None:
            flags[i, t] = 1
        t = TAG_AT.get(page.tags[p])
        if t is not None:
            flags[i, len(TAGS) + t] = 1
        flags[i, k + len(TOKENS) :] = flags[p, k + len(TOKENS) :]
        for token in page.tokens[i]:
            t = TOKEN_AT.get(token)
            if t is None and token.endswith("s"):
                t = TOKEN_AT.get(token[:-1])
            if t is not None:
                flags[i, k + t] = flags[i, k + len(TOKENS) + t] = 1
    up = np.array(parents)
    up[0] = 0
    for i in range(1, n):
        same[i] = seen[(parents[i], page.tags[i])]
    whole = max(total[0], 1)
    log = lambda v: np.minimum(np.log2(1 + v) * 2, BINS - 1)
    part = lambda v: np.minimum(v * (BINS - 1), BINS - 1)
    numbers = np.stack(
        [
            log(own),
            log(total),
            log(count),
            log(total / count),  # density of the subtree
            part(linked / np.maximum(total, 1)),
            part(total / whole),
            part(total / np.maximum(total[up], 1)),
            part(total / np.maximum(largest[up], 1)),
            np.minimum(depth, BINS - 1),
            np.minimum(children, BINS - 1),
            np.minimum(place, BINS - 1),
            part(place / np.maximum(children[up] - 1, 1)),
            part(same / np.maximum(children[up], 1)),
            log(spoken / count),
            part(np.arange(n) / n),
            part(own / np.maximum(total, 1)),
        ],
        axis=1,
    ).astype(np.uint8)
    return np.concatenate([numbers, flags], axis=1)


@dataclass
class Trees:
    """Each tree is complete: a feature and a bin for each inner node, a value for each leaf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 5, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Gradient boosting for the logistic loss by second-order histogram splits."""
    n, m = x.shape
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    total = np.full(n, base)
    columns = np.ascontiguousarray(x.T).astype(np.int64)
    out_f, out_c, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, choice = np.full(width, 1e-6), np.zeros((width, 2), np.int64)
            choice[:, 1] = BINS
            sum_g, sum_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for f in range(m):
                key = local * BINS + columns[f]
                left_g = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                left_h = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (sum_g**2 / (sum_h + ridge))[:, None]
                gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                cut = gain.argmax(axis=1)
                got = gain[np.arange(width), cut]
                better = got > best
                best[better] = got[better]
                choice[better] = np.stack([np.full(width, f), cut], axis=1)[better]
            feature[first : first + width], limit[first : first + width] = choice[:, 0], choice[:, 1]
            at = 2 * at + 1 + (columns[feature[at], np.arange(n)] > limit[at])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        total += value[leaf]
        out_f.append(feature)
        out_c.append(limit)
        out_v.append(value)
    return Trees(np.array(out_f), np.array(out_c), np.array(out_v), base, depth)


#: What a frame costs: few elements hold both main text and clutter.
FRAME_COST = 0.5
#: What clutter directly inside main text costs: most of what a text element holds is text.
SWITCH_COST = 1.5


def decode(parents: list[int], chance: np.ndarray) -> np.ndarray:
    """Which elements' own text is kept: the states of the largest likelihood that the tree allows."""
    n = len(parents)
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    text, drop = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    frame = [d + FRAME_COST for d in drop]
    for i in range(n - 1, 0, -1):
        q = parents[i]
        text[q] += min(text[i], drop[i] + SWITCH_COST)
        frame[q] += min(text[i], drop[i], frame[i])
        drop[q] += drop[i]
    state = [0] * n  # 0 clutter, 1 frame, 2 text
    state[0] = 1
    for i in range(1, n):
        above = state[parents[i]]
        if above:
            if above == 2:
                state[i] = 2 * (text[i] <= drop[i] + SWITCH_COST)
            elif text[i] <= drop[i] and text[i] <= frame[i]:
                state[i] = 2
            elif frame[i] < drop[i]:
                state[i] = 1
    return np.array(state) == 2


# --- pages whose truth is known ---------------------------------------------------------------


def _words(rng, least: int, most: int) -> str:
    n = int(rng.integers(least, most + 1))
    return " ".join("".join(rng.choice(list("abcdefghilmnoprstuv"), int(rng.integers(2, 9)))) for _ in range(n)).capitalize()


def _pick(rng, *options):
    return options[int(rng.integers(len(options)))]


def _sentence(rng, least: int = 4, most: int = 25) -> str:
    text = _words(rng, least, most)
    if rng.random() < 0.2:
        head, _, tail = text.partition(" ")
        text = f"{head} <{(t := _pick(rng, 'b', 'i', 'em', 'strong', 'a'))}{' href=x' if t == 'a' else ''}>{tail}</{t}>"
    return text + "."


def _links(rng, tag: str, attributes: str) -> str:
    n = int(rng.integers(2, 10))
    items = [f'<a href="/{i}">{_words(rng, 1, 3)}</a>' for i in range(n)]
    body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)
    return f"<{tag}{attributes}>{body}</{tag}>"


MARK, CLUTTER = "data-main", "data-clutter"


def _clutter(rng) -> str:
    """A part of a page that isn't main text; its element bears CLUTTER."""
    made = _clutter_part(rng)
    return made if made.startswith("<script") else re.sub(r"^<(\w+)", rf"<\1 {CLUTTER}", made, count=1)


def _name(rng) -> str:
    return "".join(rng.choice(list("bcdfgklmnprstvxz"), 3)) + _pick(rng, "", "ix", "o", "-box")


def _comments(rng) -> str:
    """Reader comments, of systems with telling names and of others."""
    by = _pick(rng, ' class="author"', ' class="by"', ' class="user"', f' class="{_name(rng)}"', "")
    item = _pick(rng, "comment", "comment", "reply", "response", "msg", _name(rng))
    t = _pick(rng, "div", "li", "article")
    one = lambda: f'<{t} class="{item}"><{(q := _pick(rng, "p", "span", "b"))}{by}>{_words(rng, 1, 2)}</{q}>{_pick(rng, "", "<time>2 h</time>")}<p>{_sentence(rng, 4, 30)}</p></{t}>'
    names = ("comments", "comment-list", "discussion comments", "replies", "disqus_thread", f"{_name(rng)}_thread", f"{_name(rng)}-comments", "respond", "reader-feedback", _name(rng))
    box = _pick(rng, "section", "div", "aside")
    return f'<{box} {_pick(rng, "id", "class")}="{_pick(rng, *names)}">{_pick(rng, "", f"<h2>{_words(rng, 1, 2)}</h2>")}{"".join(one() for _ in range(int(rng.integers(1, 6))))}</{box}>'


def _clutter_part(rng) -> str:
    say = lambda least=3, most=14: _sentence(rng, least, most)
    kind = int(rng.integers(11))
    if kind == 0:
        return _links(rng, *_pick(rng, ("nav", ""), ("div", ' class="menu"'), ("div", ' id="nav"'), ("ul", ' class="breadcrumb"')))
    if kind == 1:
        return f'<{(t := _pick(rng, "header", "div"))}{"" if t == "header" else " class=header"}><{(h := _pick(rng, "h1", "h2", "div", "span"))}>{_words(rng, 1, 4)}</{h}><p>{say(2, 8)}</p></{t}>'
    if kind == 2:
        return f'<{(t := _pick(rng, "footer", "div"))}{"" if t == "footer" else " class=footer"}>{_pick(rng, "", "<p>")}&copy; {say(2, 16)}</{t}>'
    if kind == 3:
        return f'<{(t := _pick(rng, "aside", "div"))} class="{_pick(rng, "sidebar", "widget", "related", "side-bar")}"><h3>{_words(rng, 1, 3)}</h3>{_links(rng, "div", "") if rng.random() < 0.5 else f"<p>{say()}</p>" * int(rng.integers(1, 4))}</{t}>'
    if kind == 4:
        return f'<div class="{_pick(rng, "ad", "ads", "advert", "ad-box", "promo", "sponsored ad", "banner")}">{say(2, 20)}</div>'
    if kind == 5:
        return f'<div class="{_pick(rng, "cookie-notice", "notice", "alert", "consent", "cookie banner")}"><p>{say(4, 20)}</p><button>{_words(rng, 1, 2)}</button></div>'
    if kind == 6:
        return f'<form action="/s" class="{_pick(rng, "search", "login", "newsletter", "subscribe")}"><label>{_words(rng, 1, 3)}</label><input name="q"><p>{say(3, 12)}</p></form>'
    if kind in (7, 8):
        return _comments(rng)
    if kind == 9:
        return _links(rng, "div", f' class="{_pick(rng, "share", "social", "related", "recommended")}"')
    return f"<script>var a = '<p>{_words(rng, 2, 5)}</p>';</script><style>p {{margin: 0}}</style><!-- {_words(rng, 1, 4)} -->"


def _article(rng) -> str:
    t = _pick(rng, "article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'section class="story"', 'div class="article-body"', 'article class="post no-comments"', 'div class="post has-sidebar"', "div")
    content = _content(rng) if rng.random() < 0.8 else f"<h1>{(h := _words(rng, 1, 5))}.</h1><p>{_pick(rng, '', '<b>')}{_pick(rng, h, _words(rng, 1, 8))}.{_pick(rng, '</p>', '<br>')}"
    return f"<{t} {MARK}>{content}</{t.split()[0]}>"


def _content(rng) -> str:
    out = []
    if rng.random() < 0.8:
        out.append(f"<h1>{_words(rng, 1, 12)}</h1>")
    many = rng.random()
    for _ in range(int(rng.integers(1, 14)) if many < 0.78 else int(rng.integers(40, 200)) if many < 0.82 else 1):
        r = rng.random()
        text = " ".join(_sentence(rng) for _ in range(int(rng.integers(1, 7)))) if rng.random() < 0.8 else _sentence(rng, 2, 7)
        if r < 0.68:
            out.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>")
        elif r < 0.74:
            out.append(f"<h2>{_words(rng, 1, 6)}</h2><p>{text}</p>")
        elif r < 0.79:
            out.append("<ul>" + "".join(f"<li>{_sentence(rng, 2, 12)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
        elif r < 0.83:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif r < 0.86:
            out.append(f"<table><tr><td>{_words(rng, 1, 4)}</td><td>{_words(rng, 1, 4)}</td></tr></table>")
        elif r < 0.89:
            out.append(f"<div>{text}</div>")
        elif r < 0.92:
            out.append(f"<figure><img src=x><figcaption>{_sentence(rng)}</figcaption></figure>")
        else:
            out.append(_clutter(rng))
    return "".join(out)


def sample_page(rng) -> str:
    """A page; the element of the main text bears MARK, parts of clutter bear CLUTTER."""
    head = f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 8)}</title></head>"
    many = lambda: [_clutter(rng) for _ in range(0 if bare else int(rng.integers(0, 5)))]
    bare = rng.random() < 0.1
    if rng.random() < 0.08:  # no element around the main text but the body
        return f"{head}<body {MARK}>{''.join(many()[:2])}{_content(rng)}{''.join(many()[:2])}" + _pick(rng, "</body></html>", "")
    before, main, after = many(), _article(rng), many()
    if rng.random() < 0.3:
        main = f'<div class="{_pick(rng, "wrapper", "page", "container", "row", "page no-sidebar")}">{"".join(after[:1])}{main}{_clutter(rng) if rng.random() < 0.5 else ""}</div>'
    return f"{head}<body>{''.join(before)}{main}{''.join(after)}" + _pick(rng, "</body></html>", "")


def truth(page: Page, marked: set[int], clutter: set[int]) -> np.ndarray:
    """Which elements of a sample page are main text: those at or below a marked one and not at or below clutter."""
    n = len(page.tags)
    inside, out = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(1, n):
        p = page.parents[i]
        inside[i] = inside[p] or i in marked
        out[i] = out[p] or i in clutter
    return inside & ~out


def _marked(html: str) -> tuple[Page, set[int], set[int]]:
    """The page without its marks, and which elements bore either: read with them, those have one token more."""
    plain = Page(html.replace(f" {MARK}", "").replace(f" {CLUTTER}", ""))
    shown = Page(html.replace(f" {MARK}", ' role="zzmark"').replace(f" {CLUTTER}", ' role="zzclutter"'))
    return plain, *({i for i, t in enumerate(shown.tokens) if token in t} for token in ("zzmark", "zzclutter"))


@functools.cache
def fit_pages(pages: int = 800, seed: int = 5) -> Trees:
    """pages: how many sample pages the trees are trained on, once in a process. Of equal splits the first feature's lowest limit is taken."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, marked, clutter = _marked(sample_page(rng))
        xs.append(features(page))
        ys.append(truth(page, marked, clutter))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(htmls: list[str], trees: Trees) -> list[str]:
    pages = [Page(h) for h in htmls]
    rows = [features(p) for p in pages]
    chance = trees.chance(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for page, x in zip(pages, rows, strict=True):
        out.append(page.main(decode(page.parents, chance[at : at + len(x)])))
        at += len(x)
    return out


def main_texts(pages: DataFrame, trees: Trees, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep, text and n_chars (code points); a map over rows with the trees broadcast (a few kB)."""
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def make():
        def work(htmls):
            texts = extract(htmls, sent.value)
            return texts, [len(t) for t in texts]

        return work

    return map_texts(pages, html, EXTRACTED, make, keep if keep is not None else [c for c in pages.columns if c not in (html, "text", "n_chars")])


def op9_html(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"), fit_pages(), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


QUERIES = {"op9_html": op9_html}
ORACLES: dict[str, str] = {}
