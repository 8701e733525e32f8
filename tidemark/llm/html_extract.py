"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded top-down.

A page becomes a tree of block elements, inline elements whose attributes speak against main text, and text blocks. Each node gets features: density of text and
links in its subtree, tokens of its class, id and role, its depth, its siblings, and what its ancestors are. Tokens are hashed, and each bucket's weight (the
log-odds that an element with such a token holds main text) is learned from the training pages; a token never seen weighs nothing. Boosted regression
trees (logistic loss, histogram splits, numpy) give the log-odds that a node holds main text. The trees are trained here, on the driver, once for each
process, from generated pages with known main text (a fixed number, whatever the input). On part of them class and id say nothing and element names little, so
that the trees learn to decide by structure as well. Hierarchical decoding takes the labelling of the
whole tree with the greatest likelihood under the rule that a node can hold main text only if its parent does, so no text survives inside a rejected
ancestor and no ancestor of kept text is rejected.

Defined cases: null or empty html gives the empty text; a page without markup is one text block; unclosed comments and scripts run to the end of
their scope; a tag without any later `>` is text; a tag whose quotes don't close ends at the next `>`; open elements are looked up by
name and quotes followed once, so parsing takes time in proportion to the page, also of malformed ones; repeated rows are extracted alike; nulls in page_id and url are carried; other columns are ignored. A page is handled alone, so memory is in
proportion to the longest page.
"""

from __future__ import annotations

import html as html_module
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas math head title select option button textarea datalist video audio map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSE_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption", "dd", "dt", "li"} | {"li", "dd", "dt"}

ROLES = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "table", "heading", "body", "inline", "text")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_TOKEN = re.compile(r"[a-z]+")
N_FEATURES = len(ROLES) + 25
N_BUCKETS = 1 << 14
HIDDEN = "#hidden"
#: Below this weight an inline element is a node of its own.
AGAINST = -1.0


def attribute_tokens(attributes: str) -> frozenset[int]:
    """Buckets of the tokens of class, id, role and the like."""
    return _tokens_cached(attributes) if len(attributes) < 200 else _tokens(attributes)


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % N_BUCKETS


def _tokens(attributes: str) -> frozenset[int]:
    tokens = set()
    for values in _ATTR.findall(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values))
        tokens.update(_TOKEN.findall(value.lower()))
    if _HIDDEN.search(attributes):
        tokens.add(HIDDEN)
    return frozenset(map(bucket_of, tokens))


_tokens_cached = lru_cache(maxsize=4096)(_tokens)
_NONE: frozenset[int] = frozenset()


class Page:
    """Nodes in page order as parallel lists. Text nodes have tag `#`; their text is in `texts`."""

    def __init__(self, html: str, weights: np.ndarray | None = None):
        """weights: of token buckets; without them tokens are gathered only."""
        self.weights = weights
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.tokens: list[frozenset[int]] = [_NONE]
        self.signs: list[tuple[float, float]] = [(0.0, 0.0)]  # sums of the weights of its tokens: of those below zero, of those above
        self.depth, self.place, self.children = [0], [0], [0]
        self.texts: dict[int, str] = {}
        self.link_chars: dict[int, int] = {}
        self._stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: name, node (that of the parent, if it has none)
        self._run: list[str] = []
        self._linked = 0
        self._run_node = 0
        self._places: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each name
        self._blocks: list[int] = []  # depths of open block elements
        self._unclosed: set[int] = set()  # quotes behind which no tag ends
        self._read(html)

    def _node(self, tag: str, parent: int, tokens: frozenset[int], signs: tuple[float, float]) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.signs.append(signs)
        self.depth.append(self.depth[parent] + 1)
        self.place.append(self.children[parent])
        self.children.append(0)
        self.children[parent] += 1
        return len(self.tag) - 1

    def _flush(self) -> None:
        if not self._run:
            return
        text = " ".join("".join(self._run).split())
        if text:
            k = self._node("#", self._run_node, _NONE, (0.0, 0.0))
            self.texts[k] = text
            self.link_chars[k] = min(self._linked, len(text))
        self._run.clear()
        self._linked = 0

    def _signs(self, tokens: frozenset[int]) -> tuple[float, float]:
        if self.weights is None or not tokens:
            return 0.0, 0.0
        w = [float(self.weights[t]) for t in tokens]
        return sum(x for x in w if x < 0), sum(x for x in w if x > 0)

    def _open(self, name: str, attributes: str) -> None:
        tokens = attribute_tokens(attributes) if attributes else _NONE
        signs = self._signs(tokens)
        node = self._stack[-1][1]
        if name in BLOCKS or name in SILENT or (sum(signs) < AGAINST and name not in VOID):
            self._flush()
            node = self._node(name, node, tokens, signs)
        if name not in VOID:
            self._places[name].append(len(self._stack))
            if name in BLOCKS:
                self._blocks.append(len(self._stack))
            self._stack.append((name, node))

    def _close_to(self, depth: int) -> None:
        if self._stack[-1][1] != self._stack[depth - 1][1]:
            self._flush()
        for name, _ in reversed(self._stack[depth:]):
            self._places[name].pop()
            if name in BLOCKS:
                self._blocks.pop()
        del self._stack[depth:]

    def _deepest(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of some names, 0 if there is none."""
        return max((self._places[n][-1] for n in names if self._places[n]), default=0)

    def _implied(self, name: str) -> None:
        if name in CLOSES:
            while (depth := self._deepest(CLOSES[name])) and depth >= self._deepest(SCOPES[name]):
                self._close_to(depth)
                if name != "tr":
                    break
        if name in CLOSE_P and self._places["p"]:
            depth = self._places["p"][-1]
            if depth >= self._blocks[-1] if self._blocks else True:
                self._close_to(depth)

    def _end(self, name: str) -> None:
        """Closes the innermost element of that name, unless it is an inline one outside an open block. Depths are kept, so nothing is searched."""
        if self._places[name]:
            depth = self._places[name][-1]
            if name in BLOCKS or name in SILENT or not self._blocks or self._blocks[-1] <= depth:
                self._close_to(depth)

    def _text(self, raw: str) -> None:
        node = self._stack[-1][1]
        if self._run and node != self._run_node:
            self._flush()
        self._run_node = node
        text = html_module.unescape(raw) if "&" in raw else raw
        self._run.append(text)
        if self._places["a"]:
            self._linked += len(text.strip())

    def _tag_end(self, html: str, at: int) -> int:
        """Where the tag that starts at `at` ends (past its `>`), or -1 if there is no later `>`."""
        first = html.find(">", at)
        if first < 0:
            return -1
        place, quotes = at, []
        while (stop := _STOP.search(html, place)) is not None:
            if stop[0] == ">":
                return stop.end()
            # A quote that an earlier tag met in vain leads nowhere from here, either: each is followed once.
            if stop.start() in self._unclosed:
                break
            quotes.append(stop.start())
            close = html.find(stop[0], stop.end())
            if close < 0:
                break
            place = close + 1
        self._unclosed.update(quotes)
        return first + 1

    def _read(self, html: str) -> None:
        at = text_from = 0
        size = len(html)
        while at < size:
            opened = _OPEN.search(html, at)
            if opened is None:
                break
            start = opened.start()
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4) + 3
            elif html.startswith("<![CDATA[", start):
                end = html.find("]]>", start) + 3
            elif html[start + 1 : start + 2] in ("!", "?"):
                end = html.find(">", start) + 1
            else:
                named = _NAME.match(html, start + 1)
                if named is None:
                    at = start + 1
                    continue
                end = self._tag_end(html, named.end())
                if end < 0:
                    break  # no tag follows: the rest is text
                if start > text_from:
                    self._text(html[text_from:start])
                at = text_from = self._element(html, named[0].lower(), html[named.end() : end - 1], end)
                continue
            if start > text_from:
                self._text(html[text_from:start])
            at = text_from = end if end > start + 2 else size
        if text_from < size:
            self._text(html[text_from:])
        self._flush()

    def _element(self, html: str, name: str, attributes: str, at: int) -> int:
        """Handles a tag that ends at `at`; where reading goes on."""
        if name[0] == "/":
            self._end(name[1:])
            return at
        if name == "br":
            self._text(" ")
            return at
        self._implied(name)
        self._open(name, attributes)
        if name in RAW:
            end = _raw_end(name).search(html, at)
            at = (html.find(">", end.start()) + 1 or len(html)) if end else len(html)
            self._close_to(len(self._stack) - 1)
        elif attributes.endswith("/") and name in ("svg", "path"):
            self._close_to(len(self._stack) - 1)
        return at


@lru_cache(maxsize=16)
def _raw_end(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}[\s/>]", re.I)


def _role(tag: str) -> int:
    if tag == "#":
        name = "text"
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        name = "heading"
    elif tag in SILENT or tag == "dialog":
        name = "aside"
    elif tag in ("#root", "html", "body"):
        name = "body"
    elif tag in ("table", "tr", "td", "th", "tbody"):
        name = "table"
    elif tag in ("li", "ul", "ol", "menu"):
        name = "li"
    elif tag in ROLES:
        name = tag
    elif tag not in BLOCKS:
        name = "inline"
    elif tag in ("blockquote", "pre", "figure", "figcaption", "dd", "dt", "dl"):
        name = "p"
    else:
        name = "div"
    return ROLES.index(name)


#: For each element name: its code, role, and what it says to what lies below it.
_KINDS: dict[str, tuple[int, int, int, int, int, int]] = {}


def _kind(tag: str) -> tuple[int, int, int, int, int, int]:
    if tag not in _KINDS and len(_KINDS) > 10_000:
        _KINDS.clear()
    if tag not in _KINDS:
        against = int(tag in ("nav", "header", "footer", "aside", "form") or tag in SILENT)
        _KINDS[tag] = (zlib.crc32(tag.encode()) & 0xFFFFF, _role(tag), against, 2 * (tag in ("article", "main")), int(tag == "p"), int(tag in SILENT))
    return _KINDS[tag]


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of all pages, in order."""
    sizes = [len(p.tag) for p in pages]
    n = sum(sizes)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    parent = np.fromiter((x for p in pages for x in p.parent), np.int64, n)
    root = parent < 0
    parent = np.where(root, 0, parent) + base
    depth = np.fromiter((x for p in pages for x in p.depth), np.int64, n)
    place = np.fromiter((x for p in pages for x in p.place), float, n)
    children = np.fromiter((x for p in pages for x in p.children), float, n)
    signs = np.array([x for p in pages for x in p.signs], float)
    code, role, against, pro, is_p, silent = np.array([_kind(t) for p in pages for t in p.tag]).T
    sums = np.zeros((n, 8))  # characters, in links, punctuation, words, nodes, paragraphs, controls, headings
    sums[:, 4], sums[:, 5], sums[:, 6], sums[:, 7] = ~root, is_p, silent, role == ROLES.index("heading")
    at, stats, first = [], [], 0
    for p, size in zip(pages, sizes, strict=True):
        for k, text in p.texts.items():
            at.append(first + k)
            stats.append((len(text), p.link_chars[k], sum(map(text.count, ".,;!?")), text.count(" ") + 1))
        first += size
    if at:
        sums[at, :4] = stats
    before = np.cumsum(sums[:, 0]) - sums[:, 0]  # nodes are in page order
    before -= before[base]
    by_depth = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    for d in range(depth.max(), 0, -1):
        own = by_depth[edges[d] : edges[d + 1]]
        np.add.at(sums, parent[own], sums[own])
    above = np.zeros((n, 4))
    gives = np.stack([signs[:, 0], signs[:, 1], against, pro], axis=1)
    for d in range(1, depth.max() + 1):
        own = by_depth[edges[d] : edges[d + 1]]
        above[own] = above[parent[own]] + gives[parent[own]]
    _, inverse, same = np.unique(parent * (1 << 20) + code, return_inverse=True, return_counts=True)
    chars, linked, marks, words, nodes, paragraphs, controls, headings = sums.T
    h1 = np.flatnonzero(code == _kind("h1")[0])
    titled, first_h1 = np.unique(base[h1], return_index=True)
    title = np.full(n + 1, -1)  # of the page that begins at a place: its first h1
    title[titled] = h1[first_h1]
    title = title[base]
    own = np.arange(n)
    to_title = np.where(title < 0, 0, np.where(own > title, 3, np.where(own + nodes > title, 2, 1)))  # none, before it, around it, behind it
    x = np.zeros((n, N_FEATURES), np.float32)
    x[np.arange(n), role] = 1
    x[:, len(ROLES) :] = np.stack([
        signs[:, 0], signs[:, 1], *above.T, depth, chars / np.maximum(nodes, 1), linked / np.maximum(chars, 1), chars / np.maximum(chars[base], 1), chars / np.maximum(chars[parent], 1),
        np.minimum(chars, 5000), marks / np.maximum(words, 1), children, place / np.maximum(children[parent], 1), same[inverse], np.minimum(paragraphs, 20), np.minimum(controls, 20), np.minimum(words, 1000),
        before / np.maximum(chars[base], 1), np.minimum(headings, 20), to_title, chars[parent] / np.maximum(chars[base], 1), chars[parent[parent]] / np.maximum(chars[base], 1), headings[parent[parent]],
    ], axis=1)
    return x


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth, as heaps; node i's children are 2i+1 and 2i+2."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 5, rate: float = 0.3, n_bins: int = 32, ridge: float = 1.0, share: float = 0.5) -> Trees:
    """Newton boosting of the logistic loss with histogram splits; each tree sees a share of the rows."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = min(0.99, max(0.01, y.mean()))
    bias = float(np.log(mean / (1 - mean)))
    f = np.full(n, bias)
    inner = 2**depth - 1
    forest = [np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1))]
    draw = np.random.default_rng(n_trees)
    for t in range(n_trees):
        some = np.flatnonzero(draw.random(n) < share)
        p = 1 / (1 + np.exp(-f))
        g, h = (y - p)[some], (p * (1 - p) + 1e-6)[some]
        own, bins = x[some], binned[some].T.copy()
        at = np.zeros(len(some), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = (at - first) * n_bins
            for j in range(d):
                key = local + bins[j]
                gs = np.bincount(key, g, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    forest[0][t, first : first + width][better] = j
                    forest[1][t, first : first + width][better] = cuts[j][top[better]]
            at = 2 * at + 1 + (own[np.arange(len(some)), forest[0][t][at]] > forest[1][t][at])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        forest[2][t] = rate * gs / (hs + ridge)
        f += Trees(*(part[t : t + 1] for part in forest), 0.0).log_odds(x)
    return Trees(*forest, bias)


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """Likeliest labels under: main only below main."""
    n = len(parent)
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    best_yes, best_no = yes.tolist(), no.tolist()
    for k in range(n - 1, 0, -1):
        best_yes[parent[k]] += max(best_yes[k], best_no[k])
        best_no[parent[k]] += best_no[k]
    keep = [best_yes[0] > best_no[0]]
    for k in range(1, n):
        keep.append(keep[parent[k]] and best_yes[k] > best_no[k])
    return keep


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    trees: Trees


def extract_many(pages: list[str | None], model: Model) -> list[str]:
    parsed = [Page(h or "", model.weights) for h in pages]
    odds = model.trees.log_odds(features(parsed))
    out, at = [], 0
    for page in parsed:
        keep = decode(page.parent, odds[at : at + len(page.tag)])
        at += len(page.tag)
        out.append("\n".join(text for k, text in page.texts.items() if keep[k]))
    return out


# Class and id tokens that training pages use for each kind of block.
LABELS = {
    "nav": "nav navbar navigation menu mainnav breadcrumb breadcrumbs pagination pager toolbar skip tabs dropdown sitemap".split(),
    "header": "header masthead topbar top head branding logo hero".split(),
    "footer": "footer foot bottom copyright legal disclaimer colophon imprint".split(),
    "side": "sidebar side aside rail related recommended trending widget widgets popular more".split(),
    "ad": "ad ads advert advertisement adv sponsor sponsored promo promotion banner adsense".split(),
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription paywall".split(),
    "form": "form search signup login register contact".split(),
    "comments": "comment comments respond response responses reply replies disqus discussion thread".split(),
    "share": "share sharing social follow tags tag meta byline".split(),
    "main": "article content main body post entry story text blog page prose markdown copy hentry articlebody".split(),
    "plain": "container wrapper wrap row col md lg inner outer block box item section clearfix box grid flex css large small".split(),
}


def generated_page(rng: random.Random, named: bool = True) -> tuple[str, set[str]]:
    """A page and its main blocks. Without named, class and id are made-up words that say nothing, as those of an unknown language or of a build tool
    do, element names say little, and the frame may be a table: there only text, links, headings, siblings and places tell the blocks apart."""
    main: set[str] = set()
    made_up: list[str] = []

    def sentence(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))

    def prose(low: int = 3, high: int = 60) -> str:
        left, parts = rng.randint(low, high), []
        while left > 0:
            k = min(left, rng.randint(1, 14))
            parts.append(sentence(k, k).replace(" ", ", ", rng.random() < 0.5).capitalize() + rng.choice("....!?"))
            left -= k
        return " ".join(parts)

    def label(kind: str) -> str:
        """A value for class or id with one token of a kind, maybe beside tokens that say nothing."""
        if not named:
            made_up.extend(sentence(1, 1) for _ in range(12 - len(made_up)))
            return rng.choice([rng.choice(made_up), rng.choice(made_up), f"css-{rng.randint(1, 99)}{rng.choice(made_up)[:2]}", "-".join(rng.sample(made_up, 2))])
        token = rng.choice(LABELS[kind])
        plain = rng.choice(LABELS["plain"])
        return rng.choice([token, token, token, f"site-{token}", f"{plain} {token}", f"{token}_{plain}", plain + token.capitalize(), f"{token}-{rng.randint(1, 9)}"])

    def wrap(names: list[str], kind: str, inner: str, plain: float = 0.1) -> str:
        name = rng.choice(names)
        bare = name not in ("div", "section", "ul", "p", "span", "table") and rng.random() < 0.5 or rng.random() < plain
        said_by = "" if bare else f' {rng.choice(["class", "class", "id"])}="{label(kind)}"'
        if bare and rng.random() < 0.3:
            said_by = f' class="{rng.choice(LABELS["plain"])}"'
        if kind != "main" and rng.random() < 0.04:
            said_by = rng.choice([" hidden", ' style="display:none"', ' aria-hidden="true"'])
        return f"<{name}{said_by}>{inner}</{name}>"

    def links(low: int = 2, high: int = 9) -> str:
        if not named and rng.random() < 0.5:
            between = rng.choice([" ", " | ", "<br>", ""])
            return between.join(f'<a href="/x">{sentence(1, 4)}</a>' for _ in range(rng.randint(low, high)))
        return "<ul>" + "".join(f'<li><a href="/x">{sentence(1, 3)}</a></li>' for _ in range(rng.randint(low, high))) + "</ul>"

    def junk(kind: str) -> str:
        if kind == "nav":
            return wrap(["nav", "nav", "div"], "nav", links(), 0.3)
        if kind == "header":
            return wrap(["header", "div"], "header", f"<h2>{sentence(1, 4)}</h2>" * rng.randint(0, 1) + f"<p>{sentence(1, 8)}</p>")
        if kind == "footer":
            return wrap(["footer", "footer", "div"], "footer", f"&copy; {prose(3, 30)}" if rng.random() < 0.7 else f"<p>{prose(3, 30)}</p>" + links(1, 4))
        if kind == "side":
            return wrap(["aside", "aside", "div"], "side", f"<h3>{sentence(1, 3)}</h3>" + rng.choice([links(), f"<p>{prose(5, 40)}</p>"]))
        if kind == "ad":
            return wrap(["div", "div", "aside", "section", "p"], "ad", rng.choice([prose(2, 40), f"<p>{prose(2, 40)}</p>", f'<a href="/buy">{prose(2, 12)}</a>']), 0.0)
        if kind == "notice":
            return wrap(["div", "div", "section", "p"], "notice", rng.choice([prose(3, 30), f"<p>{prose(3, 30)}</p>"]) + "<button>ok</button>" * rng.randint(0, 1), 0.0)
        if kind == "form":
            inner = f'<label>{sentence(1, 3)}</label><input name="q"><p>{prose(2, 20)}</p><button>{sentence(1, 2)}</button>'
            return f'<form action="/s">{inner}</form>' if rng.random() < 0.7 else wrap(["div", "section"], "form", inner, 0.0)
        if kind == "comments":
            return wrap(["section", "div", "ol", "ul"], "comments", "".join(wrap(["div", "article", "li", "p"], "comments", f"<p>{prose(3, 50)}</p>" if rng.random() < 0.6 else prose(3, 50)) for _ in range(rng.randint(1, 5))), 0.0)
        return wrap(["div", "p"], "share", links(1, 5) if rng.random() < 0.5 else sentence(1, 6), 0.0)

    def unnamed_junk(kind: str) -> str:
        names = ["div"] * 6 + (["section", "ul"] if kind != "footer" else ["p", "footer"])
        if kind == "nav":
            return wrap(names, kind, links(), 0.3)
        if kind == "header":
            return wrap(names, kind, f'<a href="/">{sentence(1, 4)}</a>' + (f"<p>{sentence(1, 6)}</p>" if rng.random() < 0.3 else links(1, 6)), 0.2)
        if kind == "footer":
            owner = rng.choice(["&copy; ", "&copy; 20", ""]) + rng.choice([sentence(1, 6), prose(2, 14)])
            own = rng.choice([f"<p>{owner}</p>", owner, f"<span>{owner}</span>"])
            return wrap(names, kind, rng.choice([own, own + links(1, 5), links(1, 5) + own, f'<font size="1">{own}</font>']), 0.2)
        if kind == "side":
            heading = rng.choice(["h2", "h3", "h3", "h4", "b"])
            return wrap(names + ["aside"], kind, "".join(f"<{heading}>{sentence(1, 4)}</{heading}>" + links() for _ in range(rng.choice([1, 1, 2, 3]))), 0.2)
        if kind == "form":
            return f'<form action="/s"><label>{sentence(1, 3)}</label><input name="q"><button>{sentence(1, 2)}</button></form>'
        each, who = rng.choice(["div", "li", "div"]), rng.choice(["b", "span", "p", "a"])
        own = label(kind)
        notes = "".join(f'<{each} class="{own}"><{who}>{sentence(1, 2)}</{who}> <p>{prose(1, 25)}</p></{each}>' for _ in range(rng.randint(1, 7)))
        return wrap(["ol"] if each == "li" else ["div", "section"], kind, (f"<h3>{sentence(1, 3)}</h3>" if rng.random() < 0.7 else "") + notes, 0.0)

    def unnamed_frame(inner: str) -> str:
        def cells(*parts: str) -> str:
            width = f' width="{rng.randint(10, 90)}%"' if rng.random() < 0.5 else ""
            return "<tr>" + "".join(f"<td{width}>{p}</td>" for p in parts if p) + "</tr>"

        nav, header, side, footer, notes, form = (unnamed_junk(k) if rng.random() < chance else "" for k, chance in (("nav", 0.7), ("header", 0.5), ("side", 0.6), ("footer", 0.8), ("comments", 0.3), ("form", 0.2)))
        if rng.random() < 0.3:  # the frame is a table
            top, row = links() if rng.random() < 0.5 else header + nav, [links() if rng.random() < 0.5 else side, inner, rng.choice(["", side])]
            return '<table width="100%">' + cells(top) + cells(*row) + cells(footer) + "</table>" + notes
        for _ in range(rng.choice([0, 1, 1, 2])):
            inner = wrap(["div", "div", "div", "section", "article", "main"], "main", inner, 0.1)
        inner = rng.choice([inner + notes + side, side + inner + notes, inner + side + notes])
        if rng.random() < 0.5:
            inner = wrap(["div"], "plain", inner, 0.1)
        body = header + nav + form + inner + footer
        return wrap(["div"], "plain", body, 0.1) if rng.random() < 0.3 else body

    def said(text: str) -> str:
        main.add(text)
        return text

    blocks = [f"<h1>{said(sentence(2, 9))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14] if named else [2, 3, 4, 6, 9, 14])):
        text = said(prose(*rng.choice([(1, 3), (3, 30), (20, 120)] if named else [(3, 30), (3, 30), (20, 120)])))
        kind = rng.random()
        heading = rng.choice(["h2", "h2", "h3", "h3", "h4"])
        if kind < 0.5:
            blocks.append(f"<p>{text}</p>")
        elif kind < 0.56:
            blocks.append(f"<{heading}>{said(sentence(1, 7))}</{heading}><p>{text}</p>")
        elif kind < 0.62:  # text right in the element that holds all, where it can't run into the text before
            closed = not blocks or blocks[-1].endswith(("</p>", "</ul>", "</h1>", "</blockquote>", "</table>"))
            blocks.append(f"{text}<{heading}>{said(sentence(1, 7))}</{heading}><p>{said(prose(3, 20))}</p>" if closed else f"<p>{text}</p>")
        elif kind < 0.7:
            blocks.append(f"<p><b>{text}<br>")
        elif kind < 0.76:
            blocks.append(f"<{heading}>{said(sentence(1, 7))}</{heading}><p>{text}")
        elif kind < 0.84:
            blocks.append("<ul>" + f"<li>{text}</li>" + "".join(f"<li>{said(sentence(1, 12))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.89:
            blocks.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.93:
            blocks.append(f"<table><tr><td>{text}</td><td>{said(sentence(1, 5))}</td></tr></table>")
        elif kind < 0.97:
            blocks.append(f"<div>{text}</div>")
        else:
            blocks.append(f'<p><a href="/y">{text}</a></p>')
        if rng.random() < 0.12:
            blocks.append(junk(rng.choice(["ad", "ad", "notice", "share", "side", "form", "nav"])) if named else unnamed_junk(rng.choice(["nav", "form", "side"])))
    inner = "".join(blocks)
    if not named:
        return f"<html><body>{unnamed_frame(inner)}</body></html>", main
    if rng.random() < 0.25:
        inner += junk("comments")
    body = rng.choice([f"<article>{inner}</article>"] * 5 + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", wrap(["div"], "main", inner, 0.0), wrap(["div"], "main", wrap(["div", "section"], "main", inner), 0.0), wrap(["article"], "main", inner), f"<div>{inner}</div>", f"<section>{inner}</section>"])
    if len(blocks) > 1 and rng.random() < 0.2:  # the title stands beside the element that holds the rest
        outer, below = rng.choice(["section", "div", "article", "main"]), inner[len(blocks[0]) :]
        body = f"<{outer}>{blocks[0]}{wrap(['div', 'section'], rng.choice(['main', 'plain']), below, 0.3)}</{outer}>"
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(LABELS["plain"])}">{body}</div>'
    before = [junk(k) for k in ("nav", "header", "ad", "notice", "side", "share", "form") if rng.random() < 0.4]
    after = [junk(k) for k in ("footer", "comments", "ad", "notice", "side", "share", "form", "nav") if rng.random() < 0.4]
    rng.shuffle(before)
    head = f"<head><title>{sentence(2, 8)}</title><style>p{{}}</style></head>" if rng.random() < 0.9 else ""
    return f'<!DOCTYPE html><html>{head}<body>{"".join(before)}{body}{"".join(after)}</body></html>', main


def held(page: Page, main: set[str]) -> list[float]:
    """For each node whether it holds main text."""
    holds = [0.0] * len(page.tag)
    for k, text in page.texts.items():
        holds[k] = float(text in main)
    for k in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[k]] = max(holds[page.parent[k]], holds[k])
    return holds


def token_weights(pages: list[tuple[str, set[str]]]) -> np.ndarray:
    """Smoothed log-odds of each token bucket over the elements that carry it and lie in no rejected element."""
    seen = np.zeros((2, N_BUCKETS))
    for html, main in pages:
        page = Page(html)
        holds = held(page, main)
        for k, tokens in enumerate(page.tokens):
            if tokens and (page.parent[k] < 0 or holds[page.parent[k]]):
                seen[int(holds[k]), list(tokens)] += 1
    rate = seen.sum(axis=1) / max(1.0, seen.sum())
    prior = 2.0 * rate[:, None]
    return np.where(seen.sum(axis=0) > 0, np.log((seen[1] + prior[1]) / (seen[0] + prior[0])) - np.log(rate[1] / rate[0]), 0.0)


@lru_cache(maxsize=4)
def trained(n_pages: int = 700, seed: int = 11, n_unnamed: int = 400) -> Model:
    """Token weights and trees, each from n_pages generated pages of its own; the trees also from n_unnamed pages whose class and id say nothing."""
    rng = random.Random(seed)
    weights = token_weights([generated_page(rng) for _ in range(n_pages)])
    pages, labels = [], []
    for k in range(n_pages + n_unnamed):
        html, main = generated_page(rng, named=k < n_pages)
        page = Page(html, weights)
        pages.append(page)
        labels += held(page, main)
    return Model(weights, boost(features(pages), np.array(labels)))


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches, model):
    for batch in batches:
        ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 64):
            texts = extract_many(batch.column(2).slice(at, 64).to_pylist(), model.value)
            yield pa.RecordBatch.from_pydict({"page_id": ids[at : at + 64], "url": urls[at : at + 64], "text": texts, "n_chars": [len(t) for t in texts]}, schema=_RESULT)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(partial(_extract, model=model), "page_id long, url string, text string, n_chars long")
