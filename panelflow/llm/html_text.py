"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 9).

A page becomes a tree of elements. Every element gets features of its subtree (text, link and tag
density, punctuation), its attribute tokens, its depth and its siblings; boosted trees give the
probability that it holds main text. Attribute tokens are hashed to ``TOKEN_BUCKETS``, each with the
log-odds, learned from the training pages, that an element with it holds main text. Labels are then chosen for the whole tree at once: a kept
element may hold dropped ones, but a dropped element holds nothing that is kept, and the choice
that is likeliest under that rule is found from the leaves upwards.

The trees are trained here, on pages that ``generate`` writes from a seed with known main text.

Defined cases: null or empty html, or html without main text, gives an empty text; unclosed and
stray tags are read as browsers do in the main; repeated rows are rows of their own; page_id and
url are passed on as they are, null or not; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML, and words that authors put into class, id and role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "option", "button", "canvas", "audio", "video"}
#: Elements whose content is text up to the end tag, or to the end of the page without one.
RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noscript"}
UNSEEN = {"script", "style", "title", "head", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "option", "button", "canvas", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"table", "td", "th", "ul", "ol", "dl", "article", "section", "div", "body", "html", "main", "aside", "nav", "header", "footer", "form", "blockquote"}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "figure", "figcaption", "body", "b", "span", "dl")
#: Names that authors give to main text and to what stands around it; training pages use them, the features know none.
MAIN_NAMES = ("article", "body", "content", "entry", "main", "page", "post", "prose", "read", "story", "text")
SIDE_NAMES = (
    "ad", "ads", "advert", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "foot", "form", "gdpr", "header", "login", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination",
    "popular", "popup", "promo", "promoted", "recommend", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "side", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "tracking", "trending", "widget",
)

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_attr = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_words = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")
_stop = re.compile(r"[.!?,;:]")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset = frozenset()
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    order: int = 0
    #: (order in the page, text) pieces
    texts: list[tuple[int, str]] = field(default_factory=list)


@lru_cache(4096)
def attributes(source: str) -> tuple[frozenset, bool]:
    words: set[str] = set()
    hidden = False
    for name, a, b, c in _attr.findall(source):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words.update(_words.findall((a or b or c).lower()))
        hidden |= name == "hidden" or name == "aria-hidden" and (a or b or c) == "true"
    return frozenset(words), hidden


def parse(source: str) -> list[Node]:
    """Elements in page order; the first is the root. Text pieces carry their order in the page."""
    nodes = [Node("root", -1, 0)]
    stack = [0]
    order = 0
    at = 0

    def text(piece: str, decode: bool = True) -> None:
        nonlocal order
        if piece:
            order += 1
            nodes[stack[-1]].texts.append((order, entities.unescape(piece) if decode and "&" in piece else piece))

    def close(names: tuple[str, ...], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                del stack[i:]
                return
            if tag in stop:
                return

    size = len(source)
    while at < size:
        m = _token.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"], False)
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "p" and not any(nodes[i].tag == "p" for i in stack):
                continue
            if tag in INLINE:
                close((tag,), SCOPES | {"p", "li"})
            else:
                close((tag,), set())
            continue
        if tag in ENDS_P:
            close(("p",), SCOPES - {"div"} | {"div", "li"})
            if tag[0] == "h" and tag[1:].isdigit() and nodes[stack[-1]].tag[0] == "h" and nodes[stack[-1]].tag[1:].isdigit():
                stack.pop()
        if tag in ENDS_SAME:
            close(ENDS_SAME[tag], SCOPES - set(ENDS_SAME[tag]))
        if tag == "body" or tag == "article":
            close(("head",), set())
        words, hidden = attributes(m["attrs"]) if m["attrs"] else (frozenset(), False)
        order += 1
        nodes.append(Node(tag, stack[-1], len(stack), words, hidden, order=order))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if tag == "br" or tag == "hr":
            order += 1
            nodes[-1].texts.append((order, " "))
        if tag in VOID or m["attrs"].endswith("/") and tag in ("path", "rect", "circle", "svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            # without an end tag, the others end at once and the page goes on
            at = end.end() if end else size if tag in RAW_TEXT else at
            continue
        stack.append(len(nodes) - 1)
    return nodes


FEATURES = 22 + 2 * len(TAGS)
TOKEN_BUCKETS = 4096
_tag_at = {t: i for i, t in enumerate(TAGS)}


@lru_cache(65536)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKEN_BUCKETS


def learn_tokens(pages: list[tuple[list[Node], np.ndarray]]) -> np.ndarray:
    """Log-odds of main text for each bucket, over the elements whose attributes have a token of it."""
    seen = np.ones((2, TOKEN_BUCKETS))
    for nodes, y in pages:
        for node, label in zip(nodes, y, strict=True):
            for b in {bucket(w) for w in node.words}:
                seen[int(label), b] += 1
    return np.log(seen[1] / seen[0])


def features(nodes: list[Node], tokens: np.ndarray | None = None) -> np.ndarray:
    """One row a node: subtree density, attribute tokens, depth, siblings, ancestors."""
    n = len(nodes)
    chars, linked, marks, words, tags, blocks = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        if node.tag in UNSEEN:
            chars[i] = linked[i] = marks[i] = words[i] = 0
        else:
            for _, t in node.texts:
                s = t.strip()
                chars[i] += len(s)
                words[i] += s.count(" ") + 1 if s else 0
                marks[i] += len(_stop.findall(s))
            if node.tag == "a":
                linked[i] = chars[i]
        tags[i] += 1
        blocks[i] += node.tag not in INLINE
        p = node.parent
        if p >= 0:
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            words[p] += words[i]
            tags[p] += tags[i]
            blocks[p] += blocks[i]
    total = max(1, chars[0])
    x = np.zeros((n, FEATURES), np.float32)
    passed = [0] * n
    before = 0
    rows = []
    above: list[tuple] = [()] * n
    kinds = [Counter(nodes[j].tag for j in node.children) for node in nodes]
    for i, node in enumerate(nodes):
        p = node.parent
        odds = [tokens[bucket(w)] for w in node.words] if tokens is not None and node.words else (0.0,)
        own_main, own_side = max(odds), min(odds)
        up_main, up_side, up_link = above[p] if p >= 0 else (0.0, 0.0, 0)
        above[i] = (max(up_main, own_main), min(up_side, own_side), up_link or node.tag == "a")
        passed[i] = before
        before += sum(len(t.strip()) for _, t in node.texts)
        kin = nodes[p].children if p >= 0 else [i]
        k = len(kin)
        alike = kinds[p][node.tag] if p >= 0 else 1
        c = chars[i]
        own = sum(len(t.strip()) for _, t in node.texts)
        parent_chars = chars[p] if p >= 0 else c
        rows.append((node.depth, len(node.children), k, alike / k, c, c / total, own, linked[i] / c if c else 0.0, marks[i] / c if c else 0.0, words[i], c / tags[i], c / blocks[i] if blocks[i] else c, passed[i] / total, c / parent_chars if parent_chars else 0.0, linked[p] / chars[p] if p >= 0 and chars[p] else 0.0, own_main, own_side, up_main, up_side, node.hidden, len(node.words), up_link))
        t = _tag_at.get(node.tag)
        if p >= 0:
            x[i, 22 + len(TAGS) :] = x[p, 22 + len(TAGS) :]
        if t is not None:
            x[i, 22 + t] = 1
            x[i, 22 + len(TAGS) + t] = 1
    x[:, :22] = rows
    return x


# --- boosted trees -----------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of one depth: split features, thresholds and leaf values; and the tokens' log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    tokens: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 2.0) -> Trees:
    """Logistic gradient boosting on quantile bins, second-order gains."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    inner = (1 << depth) - 1
    fs, ts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-6, -1, -1)
            if len(mine) >= 20:
                G, H = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[mine, j]
                    gl = np.cumsum(np.bincount(b, g[mine], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[mine], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] >= 0:
                f[node], t[node] = best[1], edges[best[1]][best[2]]
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > t[node])
        leaf = np.array([rate * g[at == inner + k].sum() / (h[at == inner + k].sum() + l2) for k in range(inner + 1)])
        z += leaf[at - inner]
        fs.append(f), ts.append(t), leaves.append(leaf)
    return Trees(np.array(fs), np.array(ts), np.array(leaves), base)


# --- training pages ----------------------------------------------------------


def generate(rng: random.Random) -> tuple[str, str]:
    """A page and its main text, in one of many layouts."""
    syllables = "ra ne ti lo mu sen ver ach dor el pi qua sto ren im ber gel noi ux".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3))))

    def sentence(least: int = 3, most: int = 18) -> str:
        s = " ".join(word() for _ in range(rng.randint(least, most)))
        s = s.replace(" ", ", ", 1) if rng.random() < 0.4 else s
        if rng.random() < 0.1:
            s = s.upper() + "!!"
        if rng.random() < 0.1:
            s = s.replace(" ", rng.choice(("*** ", " | ", "### ", " &amp; ")))
        return s[:1].upper() + s[1:] + rng.choice(("." * 6 + "!?"))

    main: list[str] = []
    pick = rng.choice

    def shown(s: str) -> str:
        main.append(_space.sub(" ", entities.unescape(re.sub(r"<[^>]+>", "", s))).strip())
        return s

    def prose() -> str:
        s = " ".join(sentence() for _ in range(pick((1, 1, 2, 3, 4, 6))))
        if rng.random() < 0.2:
            s = s.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if rng.random() < 0.2:
            s = f"<b>{word()}</b> {s} <em>{word()}</em>"
        return s

    def item(links: bool = True) -> str:
        t = " ".join(word() + pick(("", "", "", ",", ".", "!!", "***")) for _ in range(pick((1, 1, 1, 2, 3))))
        t = t[:1].upper() + t[1:] if rng.random() < 0.4 else t
        return f'<li><a href="/{word()}">{t}</a></li>' if links else f"<li>{t}</li>"

    def named(words: str, names: tuple[str, ...], share: float) -> str:
        return " ".join(rng.sample(names, rng.choice((1, 1, 2)))) if words and rng.random() < share else words

    def box(tag: str, words: str, body: str, names: tuple[str, ...] = SIDE_NAMES, share: float = 0.4) -> str:
        words = named(words, names, share)
        mark = f' {pick(("class", "id", "class"))}="{words}"' if words else ""
        return f"<{tag}{mark}>{body}</{tag}>"

    listing = lambda k=6: "<ul>" + "".join(item() for _ in range(rng.randint(3, k))) + "</ul>"
    text = lambda: f"<p>{prose()}</p>"
    plain = lambda: pick((sentence(), text()))
    furniture = [
        lambda: box("nav", pick(("", "menu", "site-nav", "navbar")), listing(9)),
        lambda: box("header", pick(("", "site-header", "masthead")), pick((f"<h1>{word()}</h1>", f"<h2>{word()} {word()}</h2>", f"<p>{sentence()}</p>")) + pick(("", listing()))),
        lambda: box("div", pick(("ad", "ads", "advert banner", "sponsored", "promo-box", "ad-slot")), plain()),
        lambda: box("aside", pick(("", "sidebar", "side widget")), f"<h3>{word()}</h3>" + pick((listing(), text()))),
        lambda: box("div", pick(("sidebar", "widget related", "related-posts", "popular")), f"<h3>{word()}</h3>" + pick((listing(), text()))),
        lambda: box("div", pick(("cookie-notice", "notice", "gdpr consent", "alert banner")), plain()),
        lambda: box("form", pick(("", "newsletter signup", "search")), f"<label>{sentence(1, 4)}</label><input name=q><p>{sentence()}</p><button>{word()}</button>"),
        lambda: box(pick(("div", "ul")), pick(("share social", "breadcrumbs", "pagination", "tags")), "".join(item() for _ in range(3))),
    ]
    closing = [
        lambda: box(pick(("section", "div", "aside", "ol")), pick(("comments", "comment-list", "reader-comments", "replies", "disqus comments")), f"<h3>{word()}</h3>" + "".join(box(pick(("div", "article", "li", "p")), pick(("comment", "reply", "comment-body")), f"<b>{word()}</b> {plain()}") for _ in range(rng.randint(1, 4)))),
        lambda: box("footer", pick(("", "site-footer", "foot")), f"&copy; {word()}.example &middot; {plain()}"),
        lambda: box("div", pick(("footer", "copyright")), f"&copy; {word()} {sentence()}"),
    ]
    opening = "".join(f() for f in rng.sample(furniture, rng.randint(1, 4)))
    ending = "".join(f() for f in rng.sample(closing, rng.randint(1, 2))) + pick(("", pick(furniture)()))
    title = sentence(1, 12)
    title = title[: rng.randint(10, 70)] if rng.random() < 0.5 and "&" not in title else title
    body = [f"<h1>{shown(title)}</h1>"] if rng.random() < 0.85 else []
    wild = rng.random() < 0.25
    for _ in range(pick((1, 2, 3, 4, 6, 9, 14))):
        kind = rng.random()
        if kind < 0.72:
            s = prose()
            body.append(f"<p><b>{shown(s)}<br>" if wild and rng.random() < 0.4 else f"<p>{shown(s)}</p>")
        elif kind < 0.78:
            body.append(f"<h2>{shown(sentence(1, 5))}</h2>")
        elif kind < 0.84:
            body.append(pick(("<ul>", "<ul>", "<ol>")) + "".join(f"<li>{shown(pick((sentence(1, 8), word(), word() + pick(chr(44) + chr(46)))))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.88:
            body.append(f"<blockquote><p>{shown(prose())}</p></blockquote>")
        elif kind < 0.91:
            body.append(f"<pre>{shown(sentence())}</pre>")
        elif kind < 0.94:
            body.append("<table>" + "".join(f"<tr><td>{shown(word())}</td><td>{shown(sentence(1, 5))}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.97:
            body.append(f"<figure><img src=x><figcaption>{shown(sentence(1, 8))}</figcaption></figure>")
        else:
            body.append(pick(furniture[2:])())
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    shell, words = pick((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"), ("div", "article-text"), ("div", "")))
    content = box(shell, words, inner, MAIN_NAMES, 0.3)
    if rng.random() < 0.15 and shell == "article":
        content = content.replace("</article>", closing[0]() + "</article>")
    if rng.random() < 0.35:
        side = pick((furniture[3], furniture[4]))()
        content = box(pick(("div", "main")), pick(("", "wrap", "container", "page row")), pick((content + side, side + content)), (), 0.0)
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{opening}<!-- x -->{content}{ending}"
    if rng.random() < 0.12:  # pages that break off
        return page.rsplit("<", 1)[0], "\n".join(main)
    return page + "</body></html>", "\n".join(main)


def gold(nodes: list[Node], main: str) -> np.ndarray:
    """1 for elements that hold a block of the main text, by content and order."""
    wanted = main.split("\n")
    y = np.zeros(len(nodes), np.float32)
    at = 0
    for block, holders in block_runs(nodes, np.ones(len(nodes), bool)):
        if at < len(wanted) and block == wanted[at]:
            at += 1
            for i in holders:
                while i >= 0 and not y[i]:
                    y[i] = 1
                    i = nodes[i].parent
    return y


SEED, TRAINING_PAGES = 11, 600
_model: list[Trees] = []


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Trees:
    rng = random.Random(seed)
    known = []
    for _ in range(pages):
        page, main = generate(rng)
        nodes = parse(page)
        known.append((nodes, gold(nodes, main)))
    # the tokens of one half of the pages are learned from the other, so that trees do not trust them too much
    halves = [learn_tokens(known[::2]), learn_tokens(known[1::2])]
    xs, ys = [], []
    for i, (nodes, y) in enumerate(known):
        seen = np.array([n.tag not in UNSEEN for n in nodes])
        xs.append(features(nodes, halves[1 - i % 2])[seen])
        ys.append(y[seen])
    trees = boost(np.concatenate(xs), np.concatenate(ys))
    trees.tokens = learn_tokens(known)
    return trees


def model() -> Trees:
    if not _model:
        _model.append(train())
    return _model[0]


# --- decoding and text -------------------------------------------------------


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels under which a dropped element holds nothing that is kept."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    weigh = [1.0 if node.tag not in INLINE else 0.0 for node in nodes]
    drop, keep = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag in UNSEEN:
            keep[i], drop[i] = -1e9, 0.0
        else:
            keep[i] += yes[i] * weigh[i]
            drop[i] += no[i] * weigh[i]
        p = node.parent
        if p >= 0:
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i] if node.tag not in UNSEEN else 0.0
    out = np.zeros(n, bool)
    out[0] = keep[0] > drop[0]
    for i in range(1, n):
        out[i] = out[nodes[i].parent] and keep[i] >= drop[i] and nodes[i].tag not in UNSEEN
    return out


def block_runs(nodes: list[Node], keep: np.ndarray) -> list[tuple[str, list[int]]]:
    """Blocks of kept text in page order, each with the elements that hold its pieces."""
    out: list[tuple[str, list[int]]] = []
    pieces: list[str] = []
    holders: list[int] = []

    def flush() -> None:
        nonlocal pieces, holders
        if pieces:
            block = _space.sub(" ", "".join(pieces)).strip()
            if block:
                out.append((block, holders))
            pieces, holders = [], []

    todo: list[tuple[int, str | None]] = [(0, None)]
    while todo:  # without recursion: pages may be deep
        i, piece = todo.pop()
        if i < 0:
            flush()
            continue
        if piece is not None:
            pieces.append(piece)
            holders.append(i)
            continue
        node = nodes[i]
        block = node.tag not in INLINE
        if block:
            flush()
        if not keep[i] or node.tag in UNSEEN:
            continue
        if block:
            todo.append((-1, None))
        inside = [(order, i, text) for order, text in node.texts] + [(nodes[c].order, c, None) for c in node.children]
        todo += [(c, text) for _, c, text in sorted(inside, key=lambda e: e[0], reverse=True)]
    flush()
    return out


def extract(pages: list[str], trees: Trees) -> list[str]:
    """Main texts; the trees are applied to the elements of all pages at once."""
    parsed = [parse(p) for p in pages]
    xs = [features(nodes, trees.tokens) for nodes in parsed]
    odds = trees.predict(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        keep = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(block for block, _ in block_runs(nodes, keep)))
    return out


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract([h.as_py() or "" for h in part.column(2)], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
