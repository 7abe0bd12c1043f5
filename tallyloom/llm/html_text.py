"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every block element is a node. Its features are its tag, tokens of its class, id and role, what its
ancestors are, depth, place among its siblings, and densities of its subtree (text, links, punctuation,
tags, paragraphs). The trees give each node a probability of being main text.

Decoding picks the best consistent labelling: on the way down, a path goes from *outside* to *inside* at most
once and from inside to *cut out* at most once, so no node inside an excluded one can be kept, and none is kept
whose region was not entered. The best labelling is found exactly by one pass from the leaves up.

Pages carry no labels, so the model is trained here on ``training_pages`` generated layouts with known
main text (see layouts()): a fixed number, in a second or two on the driver.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one space; nothing else is dropped or capped.

Defined cases: null html is empty and gives empty text; unclosed and stray tags, comments and quotes are
tolerated; a page without markup is one block; repeated rows are extracted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.boosting import BoostedTrees

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these kinds, up to the nearest holder.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head", "title"}, set())}

TAGS = ("p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "div center", "section", "article", "main", "nav", "header hgroup", "footer address", "aside", "form fieldset button legend", "table tbody thead tr td th", "head title", "html body", "figure figcaption")
TAG_GROUP = {t: k for k, ts in enumerate(TAGS) for t in ts.split()}
#: Attribute tokens by what they announce.
TOKENS = (
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip links",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense adslot",
    "sidebar side aside widget widgets related recommended popular trending rail teaser teasers readmore",
    "footer header masthead copyright legal topbar branding logo foot colophon imprint",
    "cookie cookies consent notice gdpr alert popup modal overlay subscribe newsletter signup paywall notification disclaimer warning",
    "comment comments respond reply replies disqus discussion reviews thread",
    "share social sharing follow tags byline meta author bio rating",
    "form search login register contact survey poll",
    "article content post entry main story text prose blog news page contentinfo articlebody maincontent",
)
TOKEN_GROUP = {t: k for k, ts in enumerate(TOKENS) for t in ts.split()}
BOILERPLATE_TAGS = frozenset("nav header footer aside form head title button".split())
_PUNCTUATION = re.compile(r"[.,;:!?]")
N_NUMBERS = 20


class Page:
    """Block nodes in page order, and text segments with the node that each is in."""

    __slots__ = ("tags", "parents", "groups", "segments", "links", "inputs", "length")

    def __init__(self, source: str):
        self.tags, self.parents, self.groups = ["#page"], [-1], [0]
        self.links, self.inputs = [0], [0]  # characters in links, links and inputs
        self.segments: list[tuple[int, str]] = []
        self.length = max(1, len(source))
        stack = [0]
        parts: list[str] = []
        linked, at = 0, 0

        def close() -> None:
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.segments.append((stack[-1], text))
                parts.clear()

        tags, find = self.tags, MARKUP.search
        while m := find(source, at):
            if m.start() > at:
                parts.append(source[at : m.start()])
                if linked:
                    self.links[stack[-1]] += m.start() - at
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    linked = 0 if m[1] else 1
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in RAW and not m[1]:
                if not m[3].endswith("/"):  # its text is not the page's
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                if name in ("textarea", "select"):
                    self.inputs[stack[-1]] += 1
                continue
            if name in VOID:
                if name == "hr":
                    close()
                elif name == "input":
                    self.inputs[stack[-1]] += 1
                continue
            close()
            linked = 0
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name in CLOSES_P and tags[stack[-1]] == "p":
                stack.pop()
            elif name in ENDS:
                ended, holders = ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in holders:
                        break
                    if tags[stack[k]] in ended:
                        del stack[k:]
                        break
            bits = 0
            if m[3]:
                for value in ATTRIBUTE.findall(m[3]):
                    for token in TOKEN.findall(value):
                        k = TOKEN_GROUP.get(token.lower())
                        if k is not None:
                            bits |= 1 << k
            self.parents.append(stack[-1])
            tags.append(name)
            self.groups.append(bits)
            self.links.append(0)
            self.inputs.append(0)
            if not (m[3] and m[3].endswith("/")):
                stack.append(len(tags) - 1)
        if at < len(source):
            parts.append(source[at:])
        close()


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parents, tags, groups = page.parents, page.tags, page.groups
    own, chars, stops, words = [0] * n, [0] * n, [0] * n, [0] * n
    first = [-1] * n
    so_far = 0
    for node, text in page.segments:
        own[node] += len(text)
        stops[node] += len(_PUNCTUATION.findall(text))
        words[node] += text.count(" ") + 1
        if first[node] < 0:
            first[node] = so_far
        so_far += len(text)
    total = max(1, so_far)
    links, inputs, size, paragraphs = page.links[:], page.inputs[:], [1] * n, [0] * n
    children, same, index = [0] * n, {}, [0] * n
    for i in range(1, n):
        p = parents[i]
        index[i] = children[p]
        children[p] += 1
        same[p, tags[i]] = same.get((p, tags[i]), 0) + 1
    chars = own[:]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        stops[p] += stops[i]
        words[p] += words[i]
        links[p] += links[i]
        inputs[p] += inputs[i]
        size[p] += size[i]
        paragraphs[p] += paragraphs[i] + (tags[i] == "p")
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    x = np.zeros((n, N_NUMBERS + len(TAGS) + len(TOKENS)), np.float64)
    depth, bad, good = [0] * n, [0] * n, [0] * n
    for i in range(n):
        p = parents[i]
        if i:
            depth[i] = depth[p] + 1
            bad[i] = bad[p] + (tags[p] in BOILERPLATE_TAGS or bool(groups[p] & 0xFF))
            good[i] = good[p] + (tags[p] in ("article", "main") or bool(groups[p] >> 8))
        k = chars[i]
        kin = children[p] if i else 1
        x[i, :N_NUMBERS] = (
            depth[i],
            index[i] / kin,
            kin,
            same.get((p, tags[i]), 1) / kin if i else 1,
            np.log1p(own[i]),
            np.log1p(k),
            min(1.0, links[i] / k) if k else 1.0,
            stops[i] / k if k else 0,
            words[i] / k if k else 0,
            size[i] / (k + 1),
            np.log1p(paragraphs[i]),
            np.log1p(size[i]),
            k / total,
            first[i] / total if first[i] >= 0 else 1,
            inputs[i],
            bad[i],
            good[i],
            k / max(1, chars[p]) if i else 1,
            np.log1p(words[i] / max(1, paragraphs[i] + 1)),
            children[i],
        )
        g = TAG_GROUP.get(tags[i])
        if g is not None:
            x[i, N_NUMBERS + g] = 1
        for t in range(len(TOKENS)):
            if groups[i] >> t & 1:
                x[i, N_NUMBERS + len(TAGS) + t] = 1
    return x


def decode(page: Page, probability: np.ndarray) -> list[bool]:
    """Which nodes' own text is main text: the likeliest labelling without contradictions."""
    n = len(page.tags)
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    # best sums of the subtree of a node that is outside, inside or cut out
    outside, inside, cut = no[:], yes[:], no[:]
    for i in range(n - 1, 0, -1):
        q = page.parents[i]
        outside[q] += max(outside[i], inside[i])
        inside[q] += max(inside[i], cut[i])
        cut[q] += cut[i]
    state = [0] * n
    for i in range(1, n):
        above = state[page.parents[i]]
        if above == 0:
            state[i] = 1 if inside[i] > outside[i] else 0
        elif above == 1:
            state[i] = 2 if cut[i] > inside[i] else 1
        else:
            state[i] = 2
    if n == 1 or not any(node for node, _ in page.segments):  # no markup around any text
        state[0] = 1
    return [s == 1 for s in state]


def text_of(page: Page, kept: list[bool]) -> str:
    return " ".join(text for node, text in page.segments if kept[node])


# ---- generated layouts ---------------------------------------------------------------------------


def _words(r: random.Random, n: int, sentence: int = 12) -> str:
    out = []
    for i in range(n):
        w = "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if i % sentence == 0 else w + ("." if i % sentence == sentence - 1 else "," if r.random() < 0.07 else ""))
    return " ".join(out) + "."


def layouts(r: random.Random) -> str:
    """A page whose main text alone lies in elements that carry the attribute data-main or inherit it; data-cut ends it."""

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))[:-1]}</a></li>' for i in range(n))

    def paragraph(n: int) -> str:
        text = _words(r, n)
        if r.random() < 0.2:
            text = f"<b>{text[: len(text) // 3]}</b>{text[len(text) // 3 :]}" if r.random() < 0.5 else f'{text} <a href="#">{_words(r, 2)}</a> {_words(r, 5)}'
        return f"<p>{text}" + ("" if r.random() < 0.1 else "</p>")

    def attribute(*names: str) -> str:
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice(["site-", "c-", "the-", "block "]) + name
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def boilerplate(kind: str) -> str:
        short = _words(r, r.randint(2, 16), 30)
        if kind == "nav":
            body = f"<ul>{links(r.randint(2, 9))}</ul>"
            return f"<nav>{body}</nav>" if r.random() < 0.6 else f"<div{attribute('menu', 'navigation', 'breadcrumbs', 'pagination', 'navbar')}>{body}</div>"
        if kind == "ad":
            return f"<div{attribute('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')}>{short if r.random() < 0.6 else paragraph(r.randint(4, 30))}</div>"
        if kind == "side":
            body = f"<h3>{_words(r, 2)}</h3>" + (f"<ul>{links(r.randint(2, 6))}</ul>" if r.random() < 0.5 else paragraph(r.randint(8, 60)))
            return f"<aside>{body}</aside>" if r.random() < 0.5 else f"<div{attribute('sidebar', 'widget', 'related', 'popular', 'teaser')}>{body}</div>"
        if kind == "header":
            body = f"<h2>{_words(r, 2)}</h2>" * r.randint(0, 1) + r.choice([short, f"<p>{short}</p>", boilerplate("nav")])
            return f"<header>{body}</header>" if r.random() < 0.6 else f"<div{attribute('header', 'masthead', 'topbar', 'branding')}>{body}</div>"
        if kind == "footer":
            body = r.choice([f"&copy; {short}", f"<p>{short}</p>", f"<p>{_words(r, r.randint(10, 50))}</p><ul>{links(3)}</ul>"])
            return f"<footer>{body}</footer>" if r.random() < 0.6 else f"<div{attribute('footer', 'copyright', 'legal', 'imprint')}>{body}</div>"
        if kind == "notice":
            body = r.choice([short, paragraph(r.randint(8, 50)), f"<p>{short}</p><button>Ok</button>"])
            return f"<{(t := r.choice(['div', 'section', 'aside', 'div']))}{attribute('cookie-notice', 'consent', 'newsletter', 'subscribe', 'popup', 'notice', 'alert', 'gdpr')}>{body}</{t}>"
        if kind == "form":
            body = f"<label>{_words(r, 2)}</label><input name=q><button>{_words(r, 1)}</button>" + r.choice(["", f"<p>{short}</p>", "<textarea></textarea>"])
            return f"<form{r.choice(['', attribute('search', 'login', 'contact')])}>{body}</form>"
        if kind == "share":
            return f"<div{attribute('share', 'social', 'tags', 'byline', 'meta')}>{short if r.random() < 0.5 else f'<ul>{links(3)}</ul>'}</div>"
        # comments of readers
        each = [f"<{(t := r.choice(['div', 'li', 'article', 'p']))}{r.choice(['', attribute('comment', 'reply')])}>{r.choice(['', f'<b>{_words(r, 1)}</b>: '])}{_words(r, r.randint(4, 60))}</{t}>" for _ in range(r.randint(1, 6))]
        box = r.choice(["section", "div", "ol", "div"])
        return f"<{box}{attribute('comments', 'respond', 'discussion', 'disqus', 'replies')}><h3>{_words(r, 2)}</h3>{''.join(each)}</{box}>"

    kinds = ["nav", "ad", "side", "header", "footer", "notice", "form", "share", "comments"]
    inner = [f"<h{r.choice('112')}>{_words(r, r.randint(3, 10), 40)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
        inner.append(paragraph(r.choice([4, 10, 25, 50, 90, 150])))
        if r.random() < 0.12:
            inner.append(f"<h2>{_words(r, r.randint(2, 6), 40)}</h2>")
        if r.random() < 0.08:
            inner.append(f"<ul>{''.join(f'<li>{_words(r, r.randint(3, 20))}</li>' for _ in range(r.randint(2, 5)))}</ul>")
        if r.random() < 0.06:
            inner.append(f"<blockquote>{paragraph(r.randint(8, 30))}</blockquote>")
        if r.random() < 0.04:
            inner.append(f"<table><tr><td>{_words(r, 2)}</td><td>{_words(r, 3)}</td></tr></table>")
        if r.random() < 0.1:
            inner.append("\x01" + boilerplate(r.choice(["ad", "share", "side", "notice", "form", "nav"])) + "\x02")
    if r.random() < 0.1:
        inner.append("\x01" + boilerplate("comments") + "\x02")
    if r.random() < 0.15:
        inner.insert(0, "\x01" + boilerplate("header") + "\x02")
    body = "".join(inner)
    shell = r.choice(["article", "article", "article", "main", "div", "div", "section", "none"])
    if shell == "none":
        main = "".join(inner)
    else:
        main = f"<{shell}{attribute('content', 'post', 'entry', 'article-body', 'story', 'main', 'text') if shell == 'div' or r.random() < 0.3 else ''}>{body}</{shell}>"
    for _ in range(r.choice([0, 0, 1, 2])):
        t = r.choice(["div", "main", "section"])
        main = f"<{t}{r.choice(['', attribute('wrapper', 'container', 'page', 'content', 'row')])}>{r.choice(['', boilerplate(r.choice(kinds))]).join(['\x01', '\x02']) if r.random() < 0.3 else ''}{main}</{t}>"
    before = [boilerplate(k) for k in ("header", "nav", "ad", "notice", "form", "side") if r.random() < 0.4]
    after = [boilerplate(k) for k in ("share", "comments", "side", "ad", "nav", "form", "notice", "footer") if r.random() < 0.4]
    r.shuffle(before)
    r.shuffle(after)
    page = "\x01" + "".join(before) + "\x02" + main + "\x01" + "".join(after) + "\x02"
    if r.random() < 0.1:
        page = f"<div{r.choice(['', attribute('wrap', 'container', 'page')])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>\x01{_words(r, 4)}\x02</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{page}</body></html>"


def labelled(source: str) -> tuple[Page, np.ndarray, np.ndarray]:
    """A generated page, its nodes' labels and weights; \\x01 and \\x02 enclose what is not main text."""
    depth, marked = 0, []
    for c in source:
        if c == "\x01":
            depth += 1
        elif c == "\x02":
            depth -= 1
        else:
            marked.append((c, depth > 0))
    # text characters of what is not main are moved into a private range, so that they can be told apart in the segments
    text, tag = [], False
    for c, out in marked:
        tag = True if c == "<" else tag
        text.append(chr(0xE000 + ord(c)) if out and not tag and c.isalpha() and ord(c) < 128 else c)
        tag = False if c == ">" else tag
    page = Page("".join(text))
    n = len(page.tags)
    good, bad = np.zeros(n), np.zeros(n)
    for node, t in page.segments:
        out = sum(0xE000 <= ord(c) < 0xE100 for c in t)
        good[node] += len(t) if not out else 0
        bad[node] += len(t) if out else 0
    for i in range(n - 1, 0, -1):
        good[page.parents[i]] += good[i]
        bad[page.parents[i]] += bad[i]
    page = Page("".join(c for c, _ in marked))
    return page, (good > bad).astype(float), good + bad > 0


@lru_cache(maxsize=2)
def model(training_pages: int = 500, seed: int = 5) -> BoostedTrees:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(training_pages):
        page, y, known = labelled(layouts(r))
        xs.append(features(page)[known])
        ys.append(y[known])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = 500) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    trees = model(training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for s in range(0, len(batch), 256):
                found = [Page(h.as_py()) for h in batch.column(2)[s : s + 256]]
                xs = [features(p) for p in found]
                p = trees.predict(np.concatenate(xs))
                at = 0
                for page, x in zip(found, xs):
                    texts.append(text_of(page, decode(page, p[at : at + len(x)])))
                    at += len(x)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
