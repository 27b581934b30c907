"""Main-text extraction with a tree-structured graphical model.

Every element of a page's DOM is a node with a hidden label, content or not.
Evidence potentials look at the element itself (tag, words of its class, id and
role, own text, share of link text below it); parent-child potentials tie its
label to its parent's, by tag.  The graph is the DOM tree, so sum-product message
passing, once upward and once downward, gives exact marginals.  All potentials
are smoothed counts over the labelled pages of ``html_pages``.

The text of elements whose marginal exceeds one half is kept in page order.
Block-level elements start new blocks; white space within a block is one space;
blocks are joined by a line feed.  Scripts, styles, comments and the like never
become nodes.

Defined results: kept columns named like an operator's own are left out; a null or empty page, or one without content, gives the empty
text; unclosed and stray tags are repaired as browsers do; an unfinished tag or
comment at the end is dropped; repeated rows are extracted once each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm import html_pages
from palmleaf.llm.common import tune, unclashed

# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math head title select textarea canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr br input button".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
#: An open element of the value's tags ends where the key begins, up to a scope.
SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Parents that have edge potentials of their own.
REGIONS = frozenset("body header footer nav aside form article main".split())
#: Words in class, id or role that hint at what an element holds.
GOOD = frozenset("article content post entry main story body text blog page".split())
BAD = frozenset(
    "ad ads advert advertisement banner nav navigation menu sidebar footer header comment comments cookie notice popup modal "
    "share social promo sponsor sponsored related subscribe newsletter login breadcrumb breadcrumbs widget hidden byline meta "
    "toolbar masthead consent alert disqus replies reply search form tags pagination complementary contentinfo".split()
)
TAGS = frozenset(
    "body main article section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd a b i em strong span br "
    "table tbody thead tr td th blockquote pre code figure figcaption img label input button".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Where an element that is no node ends; offsets are the page's own.
_END = {tag: re.compile(rf"</{tag}(?=[>/ \n\t\r\f]|\Z)", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"\s+")


@lru_cache(4096)
def hint(attrs: str) -> str:
    """good, bad or none, from the class, id and role of a tag."""
    if _HIDDEN.search(attrs):
        return "bad"
    words: set[str] = set()
    for m in _ATTR.finditer(attrs):
        words.update(_SPLIT.split((m[2] or m[3] or m[4] or "").lower()))
    return "bad" if words & BAD else "good" if words & GOOD else "none"


class Tree:
    """A page's elements in page order, parents first, and its text runs."""

    __slots__ = ("hint", "parent", "runs", "tag")

    def __init__(self) -> None:
        self.tag, self.hint, self.parent = ["body"], ["none"], [-1]
        self.runs: list[tuple[int, str]] = []  # (element, text); a negative text run is a block border

    def add(self, tag: str, hinted: str, parent: int) -> int:
        self.tag.append(tag)
        self.hint.append(hinted)
        self.parent.append(parent)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    tree, open_, at = Tree(), [0], 0
    depth: dict[str, int] = {}  # open elements by tag
    size = len(page)

    def close(k: int) -> None:
        for node in open_[k:]:
            depth[tree.tag[node]] -= 1
        del open_[k:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            tree.runs.append((open_[-1], page[at:]))
            break
        if m.start() > at:
            tree.runs.append((open_[-1], page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:
            break  # an unfinished tag
        tag = m[2].lower()
        if m[1]:
            if depth.get(tag):
                close(next(k for k in range(len(open_) - 1, 0, -1) if tree.tag[open_[k]] == tag))
            if tag not in INLINE:
                tree.runs.append((-1, ""))
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            ended = _END[tag].search(page, at)
            if not ended:
                # an unclosed head or title is no reason to lose the page
                if tag in ("head", "noscript"):
                    continue
                break
            at = page.find(">", ended.start()) + 1 or size
            continue
        if tag in ENDS_P and depth.get("p"):
            for k in range(len(open_) - 1, 0, -1):
                name = tree.tag[open_[k]]
                if name == "p":
                    close(k)
                    break
                if name not in INLINE:
                    break
        if tag in SIBLING:
            ends, scope = SIBLING[tag]
            for k in range(len(open_) - 1, 0, -1) if any(depth.get(name) for name in ends) else ():
                name = tree.tag[open_[k]]
                if name in scope:
                    break
                if name in ends:
                    close(k)
                    break
        if tag == "br":
            tree.runs.append((open_[-1], " "))
        node = tree.add(tag, hint(m[3]) if m[3] else "none", open_[-1])
        if tag not in INLINE:
            tree.runs.append((-1, ""))
        if tag not in VOID:  # a slash closes no other element, as in browsers
            open_.append(node)
            depth[tag] = depth.get(tag, 0) + 1
    return tree


def _bucket(n: int) -> int:
    return 0 if n == 0 else 1 if n < 20 else 2 if n < 80 else 3


def evidence(tree: Tree) -> list[tuple]:
    """(tag and region of its parent, hint, own text, link share) of every element."""
    size = len(tree.tag)
    own, total, linked = [0] * size, [0] * size, [0] * size
    for node, run in tree.runs:
        if node >= 0:
            own[node] += len(run.strip())
    for node in range(size - 1, -1, -1):
        total[node] += own[node]
        if tree.tag[node] == "a":
            linked[node] = total[node]
        up = tree.parent[node]
        if up >= 0:
            total[up] += total[node]
            linked[up] += linked[node]
    return [
        (
            (tree.tag[k] if tree.tag[k] in TAGS else "other", up if (up := tree.tag[tree.parent[k]]) in REGIONS else "*"),
            tree.hint[k],
            _bucket(own[k]),
            -1 if not total[k] else 0 if not linked[k] else 1 if 3 * linked[k] < total[k] else 2 if 3 * linked[k] < 2 * total[k] else 3,
        )
        for k in range(size)
    ]


class Model:
    """Log potentials: evidence by feature and value, edges by the child's tag and region."""

    def __init__(self, labelled: list[tuple[Tree, list[int]]], smooth: float = 0.01) -> None:
        seen: dict[tuple, list[float]] = {}
        edges: dict[tuple, list[float]] = {}
        n = [2 * smooth, 2 * smooth]
        body, pooled = [1.0, 1.0], {0: [1.0, 1.0], 1: [1.0, 1.0]}
        for tree, labels in labelled:
            for node, seen_here in enumerate(evidence(tree)):
                y = labels[node]
                n[y] += 1
                for feature, value in enumerate(seen_here[1:], 1):
                    seen.setdefault((feature, value), [smooth, smooth])[y] += 1
                if not node:
                    body[y] += 1
                else:
                    tag, region = seen_here[0]
                    pooled[labels[tree.parent[node]]][y] += 1
                    for place in {region, "*"}:
                        edges.setdefault((tag, place, labels[tree.parent[node]]), [smooth, smooth])[y] += 1
        self.seen = {k: (log(v[0] / n[0]), log(v[1] / n[1])) for k, v in seen.items()}
        self.edges = {k: (log(v[0] / sum(v)), log(v[1] / sum(v))) for k, v in edges.items()}
        # an unknown tag goes by all edges; the body itself is seldom content
        self.stay = {k: (log(v[0] / sum(v)), log(v[1] / sum(v))) for k, v in pooled.items()}
        self.body = log(body[1] / body[0])

    def edge(self, kind: tuple[str, str], parent: int) -> tuple[float, float]:
        """Log potentials of a child's labels under its parent's."""
        tag, region = kind
        return self.edges.get((tag, region, parent)) or self.edges.get((tag, "*", parent)) or self.stay[parent]

    def potentials(self, seen_here: tuple) -> tuple[float, float]:
        a = b = 0.0
        for feature in (1, 2, 3):
            x = self.seen.get((feature, seen_here[feature]))
            if x:
                a += x[0]
                b += x[1]
        return a, b


def _plus(a: float, b: float) -> float:
    return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))


def marginals(tree: Tree, model: Model) -> list[float]:
    """Content probability of every element, by sum-product on the tree."""
    found = evidence(tree)
    size = len(found)
    cache: dict[tuple, tuple] = {}
    known = []
    for x in found:
        if x not in cache:
            e = model.potentials(x)
            cache[x] = (e[0], e[1], model.edge(x[0], 0), model.edge(x[0], 1))
        known.append(cache[x])
    up0, up1 = [x[0] for x in known], [x[1] for x in known]
    sent: list[tuple[float, float]] = [(0.0, 0.0)] * size
    for node in range(size - 1, 0, -1):
        _, _, t0, t1 = known[node]
        m0 = _plus(t0[0] + up0[node], t0[1] + up1[node])
        m1 = _plus(t1[0] + up0[node], t1[1] + up1[node])
        sent[node] = (m0, m1)
        p = tree.parent[node]
        up0[p] += m0
        up1[p] += m1
    up1[0] += model.body
    all0, all1 = up0[:], up1[:]
    for node in range(1, size):
        p = tree.parent[node]
        r0, r1 = all0[p] - sent[node][0], all1[p] - sent[node][1]
        top = max(r0, r1)
        _, _, t0, t1 = known[node]
        all0[node] += _plus(r0 - top + t0[0], r1 - top + t1[0])
        all1[node] += _plus(r0 - top + t0[1], r1 - top + t1[1])
    return [1 / (1 + exp(min(700.0, max(-700.0, all0[k] - all1[k])))) for k in range(size)]


def _labelled(page: tuple) -> tuple[Tree, list[int]]:
    tree, labels = Tree(), [page[0]]

    def grow(children, node: int) -> None:
        for child in children:
            if isinstance(child, str):
                tree.runs.append((node, child))
            else:
                y, tag, attrs, below = child
                key = tree.add(tag, hint(" ".join(f'{k}="{v}"' for k, v in attrs.items())), node)
                labels.append(y)
                grow(below, key)

    grow(page[3], 0)
    return tree, labels


@lru_cache(1)
def trained() -> Model:
    """The model of the labelled pages; small, so each worker trains its own."""
    return Model([_labelled(page) for page in html_pages.pages()])


def main_text(page: str | None, model: Model | None = None) -> str:
    if not page:
        return ""
    tree = parse(page)
    keep = marginals(tree, model or trained())
    blocks: list[str] = []
    part: list[str] = []
    for node, run in [*tree.runs, (-1, "")]:
        if node < 0:
            if part:
                block = _SPACE.sub(" ", html.unescape("".join(part))).strip()
                if block:
                    blocks.append(block)
                part = []
        elif keep[node] > 0.5:
            part.append(run)
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = trained()
    for batch in batches:
        texts = [main_text(x, model) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"],
        )


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns of ``pages``, text and n_chars (code points)."""
    keep = unclashed(keep, "text", "n_chars")
    tune(pages.sparkSession)
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string, n_chars bigint"])
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(_extract, schema)
