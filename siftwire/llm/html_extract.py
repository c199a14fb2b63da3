"""HTML extraction: the main text of pages by gradient-boosted trees over the nodes of the DOM.

Every element that is not plain inline formatting is a node. Its features are those of its tag, its attribute
tokens, its depth, the density of text, links and tags in its subtree, and its place and share among its
siblings. The trees, trained on pages with known parts, give each node the probability that its subtree
holds main text. Decoding is hierarchical: of all labelings in which a node without main text has no
descendant with it, the most probable one is taken, so that choices never contradict each other.

Output: the text of the chosen nodes without their rejected descendants; character references decoded, white
space inside a block turned into one space, blocks trimmed and joined in page order by one line feed. Line
breaks within a block count as white space. Nothing is capped: nesting may be of any depth and a parent may
have any number of children. Only scripts, styles, templates, inner frames and the head are never text; what
math, drawings, objects and the like hold is judged by the trees.

Defined results: a null page counts as empty; a page without main text gives ''; text without any markup is
main text; unclosed and stray tags are repaired as far as paragraphs, list items and table parts go. Rows
may repeat. The output column is replaced if it exists, all others pass through.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.llm.memory import released

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head script style template iframe".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = frozenset("html body div article section main aside nav header footer ul ol dl table td th form blockquote button".split())
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul dialog details".split()
)

# Stems of attribute tokens by the part of a page that they speak for.
STEMS = {
    "menu": "nav menu breadcrumb topbar toolbar pagination pager skip toc",
    "frame": "header footer masthead copyright colophon legal bottom branding logo",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner affiliate outbrain taboola",
    "side": "sidebar aside related recommended widget popular trending share social tags secondary more",
    "notice": "cookie consent gdpr notice alert popup modal overlay subscribe newsletter paywall signup",
    "form": "form search login register input contact poll survey",
    "talk": "comment comments reply replies respond disqus discussion thread feedback",
    "main": "article content post entry main story body text page hentry blog",
}
_STEM = {stem: i for i, stems in enumerate(STEMS.values()) for stem in stems.split()}
_TAGS = "nav header footer aside form article main section div p h li ul table blockquote pre figure button dialog span body".split()
_TAG = {t: i for i, t in enumerate(_TAGS)} | {f"h{i}": _TAGS.index("h") for i in range(1, 7)} | {"ol": _TAGS.index("ul"), "dl": _TAGS.index("ul"), "menu": _TAGS.index("nav"), "select": _TAGS.index("form")}
FEATURES = [f"tag_{t}" for t in _TAGS] + [f"token_{s}" for s in STEMS] + [
    "depth", "log_text", "text_per_tag", "link_share", "links", "children", "same_siblings", "place", "share_of_parent", "words_per_child",
    "under_article", "under_main_token", "under_other", "under_other_token", "under_header",
]

#: Text, in which a ``<`` that begins no tag stands for itself.
_TEXT = re.compile(r"(?:[^<]+|<(?![A-Za-z/!?]))+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    tokens: frozenset[int] = frozenset()
    parent: Node | None = None
    parts: list = field(default_factory=list)  # texts and nodes in page order; None for a border between blocks
    text: int = 0
    linked: int = 0
    tags: int = 1
    links: int = 0
    words: int = 0


def attribute_tokens(attributes: str) -> frozenset[int]:
    values = " ".join("".join(found) for found in _ATTRIBUTE.findall(attributes))
    return frozenset(_STEM[t] for t in (p.lower() for p in _PART.findall(values)) if t in _STEM) if values else frozenset()


class _TagEnds:
    """Where tags of a page end: at the first ``>`` outside of quotes.

    A quote that leads to no end is remembered, and so is the last search, so that all calls together, in page
    order, take time in proportion to the page, however many ``<`` and quotes it has that nothing closes.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.hopeless: set[int] = set()
        self.searched = (0, -1)  # from, to: nothing special stands between

    def end(self, at: int) -> int:
        """The place of the ``>``, or -1, for a tag whose attributes begin at ``at``."""
        page, visited = self.page, []
        while at <= self.last:
            if not visited and self.searched[0] <= at <= self.searched[1]:
                place = self.searched[1]
            else:
                found = _SPECIAL.search(page, at)
                place = found.start()  # there is a ``>``
                if not visited:
                    self.searched = (at, place)
            if page[place] == ">":
                return place
            if place in self.hopeless:
                break
            visited.append(place)
            closing = page.find(page[place], place + 1)
            if closing < 0:
                break
            at = closing + 1
        self.hopeless.update(visited)
        return -1


class _Open:
    """The open elements, and where each kind of them stands."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("html", root)]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]

    def push(self, tag: str, node: Node) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, node))

    def last(self, tag: str) -> int:
        """The place of the innermost element of that kind, or 0."""
        return (self.places.get(tag) or [0])[-1]

    def shut_from(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.places[tag].pop()
        while self.scopes[-1] >= k:
            self.scopes.pop()
        del self.stack[k:]


def parse(page: str) -> Node:
    """The tree of nodes. Inline elements without telling attributes belong to the node around them.

    Takes time in proportion to the page, whatever stands in it.
    """
    root = Node("html")
    open_, ends, unclosed = _Open(root), _TagEnds(page), set()
    stack = open_.stack
    at, end = 0, len(page)

    def add_text(raw: str) -> None:
        node = stack[-1][1]
        plain = html.unescape(raw) if "&" in raw else raw
        size = len(plain) - plain.count(" ")
        node.parts.append(plain)
        node.text += size
        node.linked += size if open_.last("a") else 0
        node.words += plain.count(" ") + 1 if size else 0

    def after(pattern: str, tag: str) -> re.Match | None:
        """The first match from here on; what was once not found isn't looked for again."""
        found = None if tag in unclosed else re.compile(pattern, re.I).search(page, at)
        if found is None:
            unclosed.add(tag)
        return found

    while at < end:
        text = _TEXT.match(page, at)
        if text:
            add_text(text.group())
            at = text.end()
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        lead = page[at + 1] if page[at + 1] in "/!?" else ""
        name = _NAME.match(page, at + 1 + len(lead))
        close = ends.end(name.end() if name else at + 1 + len(lead))
        if close < 0:  # no tag, but text up to the next one
            nxt = page.find("<", at + 1)
            nxt = end if nxt < 0 else nxt
            add_text(page[at:nxt])
            at = nxt
            continue
        node, attributes, at = stack[-1][1], page[name.end() if name else at : close], close + 1
        if lead in ("!", "?"):
            continue
        tag = name.group().lower() if name else ""
        if not tag:  # an end tag without a name
            node.parts.append("")
        elif lead:
            if tag == "p" and not open_.last("p"):
                node.parts.append(None)
            k = open_.last(tag)
            if k and not (tag in INLINE | {"p", "li"} and open_.scopes[-1] > k):
                if stack[k][1] is stack[k - 1][1]:
                    stack[k - 1][1].parts.append(None if tag not in INLINE else "")
                open_.shut_from(k)
        elif tag in ("html", "body"):
            root.tokens |= attribute_tokens(attributes)
        elif tag in NO_TEXT and tag != "head":
            found = after(rf"</{re.escape(tag)}\s*>", tag)
            at = found.end() if found else end if tag in ("script", "style") else at
        elif tag == "head":
            found = after(r"</head\s*>|<body\b", tag)
            at = at if not found else found.end() if found.group()[1] == "/" else found.start()
        elif tag in VOID:
            node.tags += 1
            node.parts.append(" " if tag in ("br", "wbr") else None if tag == "hr" else "")
        else:
            shut = ({"p"} if tag in ENDS_P else set()) | CLOSES.get(tag, set())
            while (k := max(map(open_.last, shut), default=0)) and open_.scopes[-1] <= k:
                open_.shut_from(k)
            node = stack[-1][1]
            tokens = attribute_tokens(attributes)
            if tag == "a":
                node.links += 1
            if tag in INLINE and not tokens:
                node.tags += 1
                open_.push(tag, node)
            else:
                child = Node(tag, tokens, node)
                node.parts.append(child)
                open_.push(tag, child)
    return root


def listed(root: Node) -> list[Node]:
    """Nodes in page order, with the sums of their subtrees."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.parts) if isinstance(c, Node)]
    for node in reversed(order):
        for child in node.parts:
            if isinstance(child, Node):
                for name in ("text", "linked", "tags", "links", "words"):
                    setattr(node, name, getattr(node, name) + getattr(child, name))
    return order


def features(order: list[Node]) -> np.ndarray:
    """A row for each node, as named in FEATURES."""
    out = np.zeros((len(order), len(FEATURES)), np.float32)
    base, number = len(_TAGS), {id(n): i for i, n in enumerate(order)}
    other = {_TAG[t] for t in ("nav", "aside", "footer", "form")}
    last = len(STEMS) - 1
    depth = np.zeros(len(order), np.int32)
    same = [Counter(c.tag for c in n.parts if isinstance(c, Node)) for n in order]
    for i, node in enumerate(order):
        row, kind = out[i], _TAG.get(node.tag, -1)
        if kind >= 0:
            row[kind] = 1
        for t in node.tokens:
            row[base + t] = 1
        p = node.parent
        up = number[id(p)] if p is not None else -1
        children = same[i].total()
        depth[i] = depth[up] + 1 if up >= 0 else 0
        row[base + last + 1 :] = (
            depth[i],
            math.log1p(node.text),
            node.text / node.tags,
            node.linked / max(1, node.text),
            node.links,
            children,
            same[up][node.tag] if up >= 0 else 1,
            i / len(order),
            node.text / max(1, p.text) if p is not None else 1,
            node.words / (children + 1),
            up >= 0 and (out[up, -5] or p.tag in ("article", "main")),
            up >= 0 and (out[up, -4] or last in p.tokens),
            up >= 0 and (out[up, -3] or _TAG.get(p.tag, -1) in other),
            up >= 0 and (out[up, -2] or bool(p.tokens - {last})),
            up >= 0 and (out[up, -1] or p.tag == "header"),
        )
    return out


def decode(order: list[Node], probability: np.ndarray) -> list[bool]:
    """The most probable labels in which no rejected node has a chosen descendant; the root is chosen."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    number = {id(n): i for i, n in enumerate(order)}
    rejected, chosen = -np.log(1 - p), -np.log(p)
    for i in range(len(order) - 1, 0, -1):
        up = number[id(order[i].parent)]
        rejected[up] += rejected[i]
        chosen[up] += min(rejected[i], chosen[i])
    keep = [True] * len(order)
    for i in range(1, len(order)):
        keep[i] = keep[number[id(order[i].parent)]] and bool(chosen[i] <= rejected[i])
    return keep


def blocks(order: list[Node], keep: list[bool]) -> str:
    """The chosen text, block by block in page order."""
    chosen = {id(n) for n, k in zip(order, keep, strict=True) if k}
    pieces: list[str] = []
    todo: list = [order[0]] if order else []
    while todo:
        part = todo.pop()
        if part is None:
            pieces.append("\0")
        elif isinstance(part, str):
            pieces.append(part.replace("\0", " "))
        elif id(part) in chosen:
            border = [] if part.tag in INLINE else [None]
            todo += [*border, *reversed(part.parts), *border]
        elif part.tag not in INLINE:
            pieces.append("\0")
    return "\n".join(t for t in (" ".join(b.split()) for b in "".join(pieces).split("\0")) if t)


# Training pages.


def _made_up_page(rng: random.Random) -> tuple[str, str]:
    """A page and a mark that stands in each of its main texts and nowhere else."""
    mark = "zq"
    letters = "etaoinshrdlucmfwypvbgkéüñß"

    def words(n: int, main: bool = False) -> str:
        out = ["".join(rng.choices(letters, k=rng.randint(1, 9))).replace(mark, "oo") for _ in range(max(1, n))]
        for k in range(0, len(out), 9):
            out[k] = out[k].capitalize() + rng.choice([".", ",", ""])
        return " ".join(out) + mark * main

    def attr(*stems: str, plain: float = 0.25) -> str:
        if rng.random() < plain:
            return rng.choice(["", f' class="{words(1)}"'])
        name = rng.choice(rng.choice(stems).split())
        name = rng.choice([name, f"site-{name}", f"{name}-box", f"main{name.capitalize()}", f"js {name} c{rng.randint(1, 9)}"])
        return f' {rng.choice(["class", "class", "id", "role"])}="{name}"'

    def links(n: int) -> str:
        item = lambda: f'<a href="/{words(1)}">{words(rng.randint(1, 4))}</a>'
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", lambda: " ".join(item() for _ in range(n))])()

    def other(kind: str) -> str:
        stems = STEMS[kind]
        tag = {"menu": ["nav", "div", "ul", "menu"], "frame": ["header", "footer", "div"], "side": ["aside", "div", "section"], "form": ["form", "div"], "talk": ["section", "div", "ol"]}.get(kind, ["div", "section"])
        tag = rng.choice(tag)
        if kind in ("advert", "notice") and rng.random() < 0.3:
            return f"<p{attr(stems, plain=0.0)}>{words(rng.randint(3, 30))}</p>"
        bare = tag in ("nav", "footer", "aside", "form", "header")
        inner = {
            "menu": lambda: links(rng.randint(3, 12)),
            "frame": lambda: rng.choice([links(rng.randint(1, 6)), f"&copy; {words(rng.randint(2, 15))}", f"<h2>{words(3)}</h2><p>{words(rng.randint(3, 12))}</p>"]),
            "advert": lambda: words(rng.randint(3, 30)) if rng.random() < 0.6 else f"<p>{words(rng.randint(5, 40))}</p><a href=#>{words(2)}</a>",
            "side": lambda: f"<h3>{words(2)}</h3>" + rng.choice([links(rng.randint(2, 8)), "".join(f"<p>{words(rng.randint(5, 50))}</p>" for _ in range(rng.randint(1, 3)))]),
            "notice": lambda: f"<p>{words(rng.randint(6, 40))}</p><button>{words(1)}</button>",
            "form": lambda: f"<label>{words(2)}</label><input name=a><textarea>{words(2)}</textarea><button>{words(1)}</button>",
            "talk": lambda: "".join(f"<div{attr(stems, plain=0.4)}><b>{words(1)}</b><p>{words(rng.randint(4, 60))}</p></div>" for _ in range(rng.randint(1, 6))),
        }[kind]()
        return f"<{tag}{attr(stems, plain=0.5 if bare else 0.0)}>{inner}</{tag}>"

    def paragraph() -> str:
        link = f' <a href="/x">{words(2)}</a> ' if rng.random() < 0.2 else ""
        text = words(rng.choice([1, 1, 1, 2, 3, 5, 20, 60, 150]), True) + link
        closing = "" if rng.random() < 0.15 else "</p>"
        shapes = [f"<p>{text}{closing}"] * 6 + [f"<p><b>{text}<br>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<h2>{words(4, True)}</h2>", f"<figure><img src=a><figcaption>{words(8, True)}</figcaption></figure>"]
        shapes += ["<ul>" + "".join(f"<li>{words(rng.randint(3, 30), True)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<table><tr><td>{words(2, True)}</td><td>{words(9, True)}</td></tr></table>", f"<div>{text}</div>"]
        return rng.choice(shapes)

    body = [f"<h1>{words(rng.randint(1, 10), True)}</h1>"] + [paragraph() for _ in range(rng.choice([1, 2, 3, 6, 12]))]
    if rng.random() < 0.3:
        body[0] = f"<header>{body[0]}<p>{words(4, True)}</p></header>"
    for kind in ("advert", "side", "notice", "form", "menu"):
        if rng.random() < 0.15:
            body.insert(rng.randint(1, len(body)), other(kind))
    tag = rng.choice(["article", "article", "main", "div", "section"])
    core = f"<{tag}{attr(STEMS['main'], plain=0.6 if tag in ('article', 'main') else 0.1)}>{''.join(body)}</{tag}>"
    if rng.random() < 0.3:
        core = f"<{rng.choice(['div', 'main'])}{attr(STEMS['main'], plain=0.5)}>{core}{other('talk') if rng.random() < 0.5 else ''}</div>"
    before = [other(k) for k in ("menu", "frame", "advert", "notice", "form") if rng.random() < 0.5]
    after = [other(k) for k in ("side", "talk", "frame", "advert", "menu", "form", "notice") if rng.random() < 0.4]
    wrap = (f"<div{attr('wrapper page container', plain=0.3)}>", "</div>") if rng.random() < 0.4 else ("", "")
    return f"<!DOCTYPE html><html><head><title>{words(5)}</title></head><body>{wrap[0]}{''.join(before)}{core}{''.join(after)}{wrap[1]}</body></html>", mark


def training_rows(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes of made-up pages, and whether a node's subtree holds main text."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        page, mark = _made_up_page(rng)
        order = listed(parse(page))
        number = {id(n): i for i, n in enumerate(order)}
        good = [any(isinstance(x, str) and mark in x for x in n.parts) for n in order]
        for i in range(len(order) - 1, 0, -1):
            up = number[id(order[i].parent)]
            good[up] = good[up] or good[i]
        some = [i for i, n in enumerate(order) if n.text]
        rows.append(features(order)[some])
        labels.append(np.array(good)[some])
    return np.concatenate(rows), np.concatenate(labels)


@dataclass(frozen=True)
class Trees:
    """Flat trees: a leaf has feature -1 and its weighted prediction in ``value``."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(rows), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                here = at[inner]
                at[inner] = np.where(rows[inner, feature[here]] <= threshold[here], left[here], right[here])
            margin += value[at]
        return 1 / (1 + np.exp(-2 * margin))


def fit(spark: SparkSession, pages: int = 1000, rounds: int = 20, depth: int = 5, seed: int = 11) -> Trees:
    """Boosted trees on the nodes of ``pages`` made-up pages; the training set has that size at any scale."""
    rows, labels = training_rows(pages, seed)
    table = spark.createDataFrame(pd.DataFrame({"x": rows.astype(float).tolist(), "label": labels.astype(float)})).coalesce(2)
    ready = table.select(array_to_vector("x").alias("features"), "label").persist()
    try:
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=40).fit(ready)
    finally:
        ready.unpersist()
    flat: list[list[np.ndarray]] = [[], [], [], [], []]
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[list[float]] = []

        def walk(node) -> int:
            own = len(nodes)
            if node.subtreeDepth() == 0:
                nodes.append([-1, 0.0, 0, 0, node.prediction() * weight])  # noqa: B023
                return own
            nodes.append([node.split().featureIndex(), node.split().threshold(), 0, 0, 0.0])
            nodes[own][2] = walk(node.leftChild())
            nodes[own][3] = walk(node.rightChild())
            return own

        walk(tree._call_java("rootNode"))
        for column, kind, out in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, np.int64, float), flat, strict=True):
            out.append(np.array(column, kind))
    return Trees(*flat)


def extract(pages: DataFrame, trees: Trees, page: str = "html", output: str = "text") -> DataFrame:
    """Add ``output``: the main text of the whole page."""

    @F.pandas_udf("string")
    @released
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for start in range(0, len(batch), 50):
                orders = [listed(parse(p or "")) for p in batch.iloc[start : start + 50]]
                rows = trees.probability(np.concatenate([features(o) for o in orders]))
                ends = np.cumsum([0, *map(len, orders)])
                out += [blocks(o, decode(o, rows[a:b])) for o, a, b in zip(orders, ends[:-1], ends[1:], strict=True)]
            yield pd.Series(out, dtype=object)

    return pages.withColumn(output, text(F.coalesce(F.col(page), F.lit(""))))
