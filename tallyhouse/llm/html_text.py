"""Main text of web pages by a tree-structured graphical model.

The nodes of the model are the block elements of a page and its runs of text.  Each has
a potential from its own features and one with its parent, which depends on both kinds.
Messages go from the leaves to the root and back (sum-product, exact on a tree); the
marginals say which runs of text are content.  Weights come from labelled pages, by
maximum likelihood with the same messages.
"""

import re
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.tables import answered

from tallyhouse.llm.html_pages import labelled_pages

#: Labelled pages learned from, at most.
TRAINING_PAGES = 500
ROUNDS = 250
RATE = 0.1
PENALTY = 0.01
#: Pages whose messages are passed together, by their nodes.
NODES = 50_000

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and is never main text.
RAW = frozenset("script style textarea title iframe noscript noframes template xmp svg math object select button".split())
#: Of these, the ones that a slash at the end of their tag closes; the others go on to their end tag.
SELF_CLOSING = frozenset("svg math object select button".split())
BREAKS = frozenset("br hr".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
#: An opening tag that ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A paragraph beyond one of these stays open.
HOLDS_P = frozenset("table td th object button".split())
#: An opening tag ends these open elements, unless one of the others is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Every page has these, written or not; the root stands for them.
ROOTS = frozenset("html head body".split())
#: What parts of names of classes, ids and roles tell; the first group that fits a part counts.
NAMES = {
    "comment": "comment comments reply replies discussion disqus responses respond feedback",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot adsense",
    "nav": "nav navbar navigation menu topnav topbar breadcrumb breadcrumbs pagination pager toc",
    "footer": "footer foot bottom copyright colophon legal",
    "header": "header masthead top branding",
    "side": "sidebar side aside rail widget widgets column complementary",
    "notice": "cookie cookies notice consent gdpr alert alertdialog popup modal dialog overlay subscribe subscription paywall disclaimer newsletter warning message",
    "form": "form search login signup register",
    "more": "related recommended recommendation share sharing social tags tag stories author bio meta links",
    "main": "content article post entry story main text body prose",
}
_GROUP = {w: g for g, words in NAMES.items() for w in words.split()}

# A quote opens a value after "=" only.  Attributes are possessive: nothing in them is tried twice.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SENTENCE = re.compile(r"[.!?…。][\"')\]]*(?:\s|$)")


class Page:
    """A parsed page: for each node its parent, kind and features; for each run of text its node."""

    __slots__ = ("parent", "kind", "features", "runs", "label", "depth")

    def __init__(self):
        self.parent, self.kind, self.features, self.label, self.depth = [-1], ["#page"], [["#page"]], [None], [0]
        self.runs = []

    def add(self, parent: int, kind: str, features: list[str], label) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.features.append(features)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def _groups(attributes: str) -> list[str]:
    """Groups of the names that the attributes give."""
    found = []
    for match in _NAMED.findall(attributes):
        for name in _PART.findall(match[0] or match[1] or match[2]):
            group = _GROUP.get(name.lower())
            if group and group not in found:
                found.append(group)
    return found


def parse(html: str) -> Page:
    """The tree of a page; never fails, whatever the markup."""
    page = Page()
    # (node, tag, groups) of the open elements
    stack = [(0, "", [])]
    # places in the stack by tag, so that no tag searches the stack
    places = {}
    text, linked, in_link = [], 0, False
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal text, linked
        if not text:
            return
        words = " ".join("".join(text).split())
        if words:
            node, tag, groups = stack[-1]
            n, share = len(words), min(linked / len(words), 1.0)
            features = [
                "run",
                f"size{min(n.bit_length(), 9)}",
                "linked" if share > 0.7 else "partly" if share > 0.2 else "plain",
                "sentence" if _SENTENCE.search(words) else "phrase",
                f"in-{tag}",
            ]
            page.runs.append((page.add(node, "run", features, page.label[node]), words))
        text, linked = [], 0

    def close(depth: int) -> None:
        nonlocal in_link
        flush()
        while len(stack) > depth:
            places[stack.pop()[1]].pop()
        in_link = False

    def nearest(tags) -> int:
        """Place of the innermost open element with one of the tags, 0 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < end:
        token = _TOKEN.search(html, at)
        piece = html[at : token.start() if token else end]
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        name = token[2] or token[5]
        if not name:
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        tag = name.lower()
        if closing:
            if tag == "a":
                in_link = False
            if tag not in INLINE and places.get(tag):
                close(places[tag][-1])
            continue
        if tag in RAW:
            if tag not in SELF_CLOSING or not attributes.endswith("/"):
                stop = _RAW_END[tag].search(html, at)
                at = stop.start() if stop else end
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = True
            groups = _groups(attributes) if tag == "span" and attributes else ()
            if not groups:
                continue
        if tag in BREAKS or tag in ROOTS:
            flush()
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            depth = nearest(("p",))
            if depth > nearest(HOLDS_P):
                close(depth)
        if tag in ENDS:
            closes, stops = ENDS[tag]
            held = nearest(stops)
            while (depth := nearest(closes)) > held:
                close(depth)
                if tag != "tr":
                    break
        flush()
        parent = stack[-1][0]
        groups = _groups(attributes) if attributes else []
        features = [f"tag-{tag}", *(f"name-{g}" for g in groups)]
        if groups:
            features.append(f"{tag}+{groups[0]}")
        if attributes and _HIDDEN.search(attributes):
            features.append("hidden")
        label = page.label[parent]
        if 'data-y="' in attributes:
            label = attributes[attributes.index('data-y="') + 8] == "1"
        places.setdefault(tag, []).append(len(stack))
        stack.append((page.add(parent, tag, features, label), tag, groups))
    flush()
    return page


class Forest:
    """The nodes of several pages in arrays, level by level."""

    def __init__(self, pages: list[Page], features: dict[str, int], kinds: dict[str, int]):
        sizes = [len(p.parent) for p in pages]
        self.start = np.cumsum([0, *sizes])
        self.parent = np.concatenate([np.array(p.parent, np.int64) + s * (np.array(p.parent) >= 0) for p, s in zip(pages, self.start)])
        depth = np.concatenate([np.array(p.depth, np.int64) for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        found, owner = [], []
        node = 0
        for p in pages:
            for names in p.features:
                for name in names:
                    f = features.get(name)
                    if f is not None:
                        found.append(f)
                        owner.append(node)
                node += 1
        self.found, self.owner = np.array(found, np.int64), np.array(owner, np.int64)
        kind = np.array([kinds.get(k, 0) for p in pages for k in p.kind], np.int64)
        self.edge = kind * (max(kinds.values(), default=0) + 1) + np.where(self.parent >= 0, kind[self.parent], 0)

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each node, P(parent, node) as [node, parent state, state])."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.owner, weights[self.found], n)
        potential = pair[self.edge]
        up, sent = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            m = np.logaddexp.reduce(potential[level] + up[level][:, None, :], axis=2)
            sent[level] = m
            np.add.at(up, self.parent[level], m)
        down = np.zeros((n, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            rest = up[parent] + down[parent] - sent[level]
            m = np.logaddexp.reduce(potential[level] + rest[:, :, None], axis=1)
            down[level] = m - m.max(axis=1, keepdims=True)
        belief = up + down
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        parent = np.maximum(self.parent, 0)
        joint = (up[parent] + down[parent] - sent)[:, :, None] + potential + up[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return content, joint / joint.sum(axis=(1, 2), keepdims=True)


class Model:
    """Potentials: a weight per feature, and a 2 by 2 table per pair of kinds of a node and its parent."""

    def __init__(self, features: dict[str, int], kinds: dict[str, int], weights: np.ndarray, pair: np.ndarray):
        self.features, self.kinds, self.weights, self.pair = features, kinds, weights, pair

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """P(content) of each run of text, by page."""
        forest = Forest(pages, self.features, self.kinds)
        chance, _ = forest.marginals(self.weights, self.pair)
        return [chance[[s + r[0] for r in p.runs]] if p.runs else np.zeros(0) for p, s in zip(pages, forest.start)]


def fit(labelled: list[str]) -> Model:
    """Potentials of the largest penalized likelihood of labelled pages (data-y on their elements).

    Features and kinds that occur once only are left out.
    """
    pages = [parse(p) for p in labelled[:TRAINING_PAGES]]
    counts, seen = {}, {}
    for p in pages:
        for names in p.features:
            for name in names:
                counts[name] = counts.get(name, 0) + 1
        for k in p.kind:
            seen[k] = seen.get(k, 0) + 1
    features = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 1))}
    kinds = {k: i + 1 for i, k in enumerate(sorted(k for k, n in seen.items() if n > 1))}
    forest = Forest(pages, features, kinds)
    # what carries no mark is no content
    y = np.array([bool(x) for p in pages for x in p.label], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    n_pairs = (len(kinds) + 1) ** 2
    truth_w = np.bincount(forest.found, y[forest.owner], len(features))
    truth_p = np.zeros((n_pairs, 2, 2))
    np.add.at(truth_p, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    weights, pair = np.zeros(len(features)), np.zeros((n_pairs, 2, 2))
    means = [np.zeros_like(weights), np.zeros_like(pair)]
    squares = [np.zeros_like(weights), np.zeros_like(pair)]
    for step in range(1, ROUNDS + 1):
        chance, joint = forest.marginals(weights, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.edge[child], joint[child])
        slopes = (truth_w - np.bincount(forest.found, chance[forest.owner], len(features)) - PENALTY * weights, truth_p - expected - PENALTY * pair)
        for value, slope, mean, square in zip((weights, pair), slopes, means, squares):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            value += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(features, kinds, weights, pair)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages(TRAINING_PAGES))


def main_text(htmls: list[str | None], model: Model) -> list[str]:
    """The content of each page: its runs of text with a marginal of at least one half, joined by spaces."""
    out, pages, size = [], [], 0

    def done() -> None:
        for page, chance in zip(pages, model.content(pages)):
            out.append(" ".join(words for (_, words), c in zip(page.runs, chance) if c >= 0.5))
        pages.clear()

    for html in htmls:
        pages.append(parse(html or ""))
        size += len(pages[-1].parent)
        if size > NODES:
            done()
            size = 0
    if pages:
        done()
    return out


def extract(pages: DataFrame, keep: list[str], html: str = "html", model: Model | None = None) -> DataFrame:
    """`keep`, text and n_chars for each row of `pages`.

    The whole of each page is parsed; references are decoded, white space inside a block
    becomes one space, blocks are joined in page order by one space.  A null or empty
    page, and one without main text, has an empty text.  Broken markup never fails: an
    unclosed comment, raw element or tag reaches to the end.  A page is read in time in
    proportion to its length, however deep or unclosed its elements are.  Rows that repeat are
    answered one by one; an empty table stays empty.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())
    source = pages.select(*keep, F.col(html).alias("__html"))

    def start():
        def work(batch):
            texts = main_text(batch.column(batch.num_columns - 1).to_pylist(), held.value)
            return texts, [len(t) for t in texts]

        return work

    return answered(source, T.StructType().add("text", "string").add("n_chars", "long"), start, drop=1)
