"""Main text extraction with gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree of elements and text runs.  Each node gets features: its tag, what its
attributes' words say about its role, the same for its parent and its ancestors, depth, density of
text, links and tags in its subtree, place and likeness among its siblings.  Boosted trees, trained
here on synthetic pages of known structure, give each node a log-odds of belonging to the main
text.  Decoding picks, for the whole tree, the likeliest set of kept nodes in which nothing kept
lies below anything dropped.  Where it keeps no text, what lies outside boilerplate by tag, role and
density of links is kept instead.

Markup is read in one forward scan with the places of open elements at hand, so broken pages cost
no more than others, and nesting may have any depth.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm._common import table
from shelfwise.llm.html_pages import Pages

SEED = 7
TRAIN_PAGES = 1000
ROUNDS, DEPTH, RATE, BINS, LEAST = 50, 4, 0.3, 32, 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
#: Elements that never hold main text.
SILENT = RAW | frozenset("head select option button".split())
#: What a head may hold; anything else ends it.
HEAD = RAW | frozenset("base link meta noscript".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key closes an open element of the value, up to a wrapper.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table article section div main nav aside footer header form body html blockquote figure".split())
#: Elements that a new block's search for an open paragraph does not leave, besides `SCOPES`.
BARS_P = ("li", "td", "th", "button")
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
TAGS = "div p li ul ol a b em i span strong h1 h2 h3 h4 article main section nav header footer aside form label input table tr td blockquote pre body br ins #text".split()
GOOD_ROLE = re.compile(r"article|content|main|post|entry|story|body|text")
BAD_ROLES = tuple(re.compile(x) for x in (r"nav|menu|bread|crumb", r"head|mast|brand|tagline", r"foot|copyright", r"side|rail|widget|related|recommend", r"cookie|notice|consent|banner|alert|dialog|popup|modal|message", r"(^|[^a-z])ads?([^a-z]|$)|advert|promo|sponsor|adsby", r"form|search|login|newsletter|subscri|signup", r"comment|discuss|reply|respond", r"share|social|follow"))
NOISE_TAGS = frozenset("nav header footer aside form".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"[\"'>]")
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ROLE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Tree:
    """A page's nodes in document order; index 0 is a root above everything."""

    def __init__(self) -> None:
        self.tag, self.attrs, self.parent, self.text = ["#root"], [""], [-1], [""]

    def add(self, tag: str, attrs: str, parent: int, text: str = "") -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.text.append(text)
        return len(self.tag) - 1


class Open:
    """The open elements, and where the last one of each name is; every step costs what it closes."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.stack, self.scopes = tree, [0], [0]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        name = self.tree.tag[node]
        self.places.setdefault(name, []).append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.tree.tag[self.stack.pop()]].pop()
        while self.scopes[-1] >= place:
            self.scopes.pop()


def tag_end(markup: str, at: int) -> int:
    """The place of the > that ends a tag, outside quotes; -1 if there is none or a quote stays open."""
    while True:
        edge = _EDGE.search(markup, at)
        if not edge:
            return -1
        if edge.group() == ">":
            return edge.start()
        closed = markup.find(edge.group(), edge.end())
        if closed < 0:
            return -1
        at = closed + 1


def parse(markup: str) -> Tree:
    """The tree of a page.  Unclosed, stray and misnested tags never fail; scripts and the like lose their content.

    Once a tag's quotes or end are not found, the rest of the page is read without regard to quotes.
    """
    tree, at, end = Tree(), 0, len(markup)
    opened, quoted, last_end = Open(tree), True, markup.rfind(">")
    raw_ends: dict[str, bool] = {}

    def say(raw: str) -> None:
        if raw and not raw.isspace():
            if tree.tag[opened.stack[-1]] == "head":
                opened.close(opened.last("head"))
            tree.add("#text", "", opened.stack[-1], html_lib.unescape(raw))
        elif raw:
            tree.add("#text", "", opened.stack[-1], " ")

    while at < end:
        lt = markup.find("<", at)
        if lt < 0 or lt > last_end:  # no tag can end any more
            mark = _MARK.match(markup, lt) if lt >= 0 else None
            say(markup[at : lt if mark else end])
            break
        if lt > at:
            say(markup[at:lt])
        mark = _MARK.match(markup, lt)
        if mark:
            at = mark.end()
            if mark.group().startswith("<![CDATA["):
                say(html_lib.escape(mark.group()[9:].removesuffix("]]>"), quote=False))
            continue
        found = _TAG.match(markup, lt)
        if not found:
            say("&lt;")
            at = lt + 1
            continue
        stop = tag_end(markup, found.end()) if quoted else markup.find(">", found.end())
        if stop < 0:
            quoted, stop = False, markup.find(">", found.end())
        attrs, name, at = markup[found.end() : stop], found.group(2).lower(), stop + 1
        if found.group(1):
            place = opened.last(name)
            if place and not (name in INLINE and opened.scopes[-1] > place):
                opened.close(place)
            continue
        if name not in HEAD and (place := opened.last("head")) and name != "head":
            opened.close(place)
        if name in ENDS_P:
            place = opened.last("p")
            if place > max(opened.scopes[-1], opened.last(*BARS_P)):
                opened.close(place)
        if name in CLOSES:
            place = opened.last(*CLOSES[name])
            if place > opened.scopes[-1]:
                opened.close(place)
        node = tree.add(name, attrs, opened.stack[-1])
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(markup, at) if raw_ends.get(name, True) else None
            raw_ends[name] = close is not None
            at = close.end() if close else end
            continue
        opened.push(node)
    return tree


def _role(attrs: str) -> list[float]:
    words = " ".join(a or b or c for a, b, c in _ROLE.findall(attrs)).lower() if attrs else ""
    if not words:
        return [0.0] * (1 + len(BAD_ROLES))
    return [float(bool(GOOD_ROLE.search(words))), *(float(bool(x.search(words))) for x in BAD_ROLES)]


_ROLE_MEMO: dict[str, list[float]] = {}


def role(attrs: str) -> list[float]:
    known = _ROLE_MEMO.get(attrs)
    if known is None:
        known = _role(attrs)
        if len(_ROLE_MEMO) < 20_000:
            _ROLE_MEMO[attrs] = known
    return known


WIDTH = 18 + 3 * (1 + len(BAD_ROLES))
#: Columns of the features: characters below a node, and the share of them in links.
CHARS, LINKED = 3, 4
TAG_INDEX = {t: k + 1 for k, t in enumerate(TAGS)}


def features(tree: Tree) -> np.ndarray:
    """A row for each node."""
    n, tags, parent = len(tree.tag), tree.tag, tree.parent
    chars, linked, elements, marks = [0] * n, [0] * n, [0] * n, [0] * n
    depth, children, same = [0] * n, [0] * n, {}
    noise_above, good_above = [0] * n, [0] * n
    roles = [role(a) for a in tree.attrs]
    above = [[0.0] * len(roles[0])] * n
    in_link = [False] * n
    start, said = [0] * n, 0
    order, last_of = [0] * n, [0] * n
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        order[k] = children[p]
        children[p] += 1
        same[p, tags[k]] = same.get((p, tags[k]), 0) + 1
        in_link[k] = in_link[p] or tags[k] == "a"
        noise_above[k] = noise_above[p] + (tags[p] in NOISE_TAGS)
        good_above[k] = good_above[p] + (tags[p] in ("article", "main"))
        above[k] = [max(x, y) for x, y in zip(above[p], roles[p], strict=True)] if any(roles[p]) else above[p]
        start[k] = said
        if tags[k] == "#text":
            t = tree.text[k]
            chars[k] = len(t.strip())
            said += chars[k]
            linked[k] = chars[k] if in_link[k] else 0
            marks[k] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
        else:
            elements[k] = 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        elements[p] += elements[k]
        marks[p] += marks[k]
        last_of[k] = children[p]
    out = np.zeros((n, WIDTH))
    for k in range(1, n):
        p, c = parent[k], chars[k]
        out[k, :18] = (
            TAG_INDEX.get(tags[k], 0), TAG_INDEX.get(tags[p], 0), depth[k], c, linked[k] / (c + 1), c / (elements[k] + 1), elements[k], marks[k] / (c + 1) * 100,
            children[k], last_of[k], order[k] / last_of[k], same[p, tags[k]] / last_of[k], c / (chars[p] + 1), start[k] / (said + 1), chars[p], linked[p] / (chars[p] + 1), noise_above[k], good_above[k],
        )
    out[:, 18:] = np.array([[*roles[k], *roles[max(parent[k], 0)], *above[k]] for k in range(n)])
    return out


class Boost:
    """Gradient-boosted trees for a binary label: second-order leaves, histogram splits."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = y.mean()
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grown = self._grow(coded, edges, y - p, p * (1 - p))
            self.trees.append(grown)
            score += self._apply(grown, x)
        return self

    def _grow(self, coded: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree as arrays: feature and threshold of inner nodes, value of leaves.

        One histogram a level: of gradients, curvatures and rows by node, feature and bin.
        """
        size, m, width = 2**self.depth, coded.shape[1], self.bins
        feature, threshold, value = np.zeros(size, dtype=np.int32), np.full(size, np.inf), np.zeros(size)
        cuts = np.array([len(e) for e in edges])
        column = np.arange(m) * width + coded
        place = np.ones(len(g), dtype=np.int64)
        for level in range(self.depth):
            nodes = 2**level
            at = ((place - nodes)[:, None] * (m * width) + column).ravel()
            gl, hl, nl = (np.bincount(at, None if w is None else np.repeat(w, m), nodes * m * width).reshape(nodes, m, width).cumsum(2) for w in (g, h, None))
            gs, hs, ns = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAST) | (ns - nl < LEAST) | (np.arange(width) >= cuts[:, None])] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(1)
            split = np.flatnonzero(flat[np.arange(nodes), best] > 1e-6)
            chosen, bin_ = best // width, best % width
            go_right = np.zeros(len(g), dtype=bool)
            for k in split:
                feature[nodes + k], threshold[nodes + k] = chosen[k], edges[chosen[k]][bin_[k]]
                here = place == nodes + k
                go_right |= here & (coded[:, chosen[k]] > bin_[k])
            place = 2 * place + go_right
        for leaf in range(size, 2 * size):
            here = place == leaf
            value[leaf - size] = self.rate * g[here].sum() / (h[here].sum() + 1)
        return feature, threshold, value

    def _apply(self, grown: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = grown
        place, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            place = 2 * place + (x[rows, feature[place]] > threshold[place])
        return value[place - 2**self.depth]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for grown in self.trees:
            out += self._apply(grown, x)
        return out


def labelled(pages: Pages) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of one synthetic page's nodes."""
    markup, wanted = pages.page()
    tree = parse(markup)
    label = np.zeros(len(tree.tag), dtype=np.int8)
    texts: dict[str, bool] = {}

    def note(node, kept: bool) -> None:
        if isinstance(node, str):
            texts[node.strip()] = kept
            return
        for child in node[2]:
            note(child, kept and (node[3] if not isinstance(child, str) else node[3] and node[0] != "body"))

    note(wanted, True)
    for k in range(len(tree.tag) - 1, 0, -1):
        if tree.tag[k] == "#text":
            label[k] = texts.get(tree.text[k].strip(), False)
        if label[k]:
            label[tree.parent[k]] = 1
    use = [k for k in range(1, len(tree.tag)) if tree.tag[k] not in SILENT and (tree.tag[k] != "#text" or not tree.text[k].isspace())]
    return features(tree)[use], label[use]


@functools.cache
def train(n: int = TRAIN_PAGES, seed: int = SEED) -> Boost:
    """The model, from `n` synthetic pages; a bounded sample whatever the table's size."""
    pages = Pages(seed)
    parts = [labelled(pages) for _ in range(n)]
    return Boost().fit(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]).astype(float))


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """Kept nodes: the likeliest choice in which every kept node's parent is kept.  Silent elements are dropped."""
    n = len(tree.tag)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for k in range(n):
        if tree.tag[k] in SILENT:
            keep[k] = -np.inf
        elif k and tree.tag[k] == "#text" and tree.text[k].isspace():
            keep[k] = drop[k] = 0.0
    dropped = drop.copy()
    for k in range(n - 1, 0, -1):
        dropped[tree.parent[k]] += dropped[k]
    best = keep.copy()
    for k in range(n - 1, 0, -1):
        best[tree.parent[k]] += max(best[k], dropped[k])
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[tree.parent[k]] and best[k] >= dropped[k]
    return kept


def outside_boilerplate(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Kept nodes where the trees keep no text: all that is in no boilerplate by tag or role, and in no block that is mostly links."""
    kept = np.zeros(len(tree.tag), dtype=bool)
    kept[0] = True
    chars, linked = rows[:, CHARS].tolist(), rows[:, LINKED].tolist()
    most = max(chars)
    for k in range(1, len(kept)):
        tag = tree.tag[k]
        # a wrapper of all the page may be named by its header; only what holds less than half of the text is judged by its role
        named = chars[k] * 2 < most and any(role(tree.attrs[k])[1:])
        crowded = tag not in INLINE and tag != "#text" and linked[k] > 0.5
        kept[k] = kept[tree.parent[k]] and tag not in SILENT and tag not in NOISE_TAGS and not named and not crowded
    return kept


def assemble(tree: Tree, kept: np.ndarray) -> str:
    """Kept text runs in page order: inline runs adjoin, blocks and line breaks part, white space becomes one space."""
    out: list[str] = []
    block_of = [0] * len(tree.tag)
    last = -1
    for k in range(1, len(tree.tag)):
        p = tree.parent[k]
        block_of[k] = block_of[p] if tree.tag[k] in INLINE or tree.tag[k] == "#text" else k
        if tree.tag[k] in ("br", "hr"):
            out.append(" ")
        if tree.tag[k] == "#text" and kept[k]:
            if block_of[k] != last:
                out.append(" ")
                last = block_of[k]
            out.append(tree.text[k])
        elif block_of[k] == k:
            last = -1
    return " ".join("".join(out).split())


def extract(markups: list[str | None], model: Boost) -> list[str]:
    """The main text of each page; empty for a page that is null, empty or without any."""
    trees = [parse(m or "") for m in markups]
    rows = [features(t) for t in trees]
    odds = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for tree in trees:
        n = len(tree.tag)
        text = assemble(tree, decode(tree, odds[at : at + n]))
        out.append(text or assemble(tree, outside_boilerplate(tree, rows[len(out)])))
        at += n
    return out


#: Characters of markup whose nodes are held at a time.
RUN_CHARS = 1 << 20


def main_text(pages: DataFrame, model: Boost | None = None) -> DataFrame:
    """For each row: page_id, url, text, n_chars (code points of text).

    The whole html is read; null counts as empty, and a page without main text gives an empty
    text.  Repeated rows give equal results; null ids and urls are carried along; an empty table
    gives an empty result; other columns are not read.  The model is some kilobytes.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            some: list[str | None] = []
            size = 0
            for x in batch.column(2):
                some.append(x.as_py())
                size += len(some[-1] or "")
                if size >= RUN_CHARS:
                    texts += extract(some, model)
                    some, size = [], 0
            texts += extract(some, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
