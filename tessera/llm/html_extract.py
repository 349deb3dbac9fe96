"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element with text and every run of text in a block is a node with a binary label, content or not. A
node's own potential is a weighted sum of its features (tag, words of class and id, length, share of links,
punctuation); an edge's potential depends on the labels of parent and child and on whether the child is text. Sum-product
messages go from the leaves up and from the root down and give each node's marginal; runs of text with a
marginal above 0.5 are the page's text. The weights are trained by gradient steps on the log-likelihood of
labelled pages, with the expectations from the same messages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub"
    " sup time tt u var img wbr".split()
)
#: Start tags that end an open element of the kinds named, up to one of the bounds.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table body article div section".split())

#: A tag with quoted values, in which > may stand; and one that ends at the next >, whatever quotes say.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Elements nested deeper are taken as children of the element at that depth; their text is kept.
DEPTH = 512
SPACE = re.compile(r"\s+")
#: Labelled pages for training that are made from LAYOUTS and the words of so many pages of the table, at most.
SAMPLE_PAGES, SAMPLE_CHARS, COPIES = 64, 20_000, 20

#: Layouts of labelled pages. T a paragraph, S a sentence, W a word; what stands in [[ ]] is content.
LAYOUTS = [
    "<header><div class=logo><a>W</a></div><p>S</p><nav><a>W</a> <a>W</a> <a>W</a></nav></header><main><div class='post content'>[[<h2>S</h2><p>T</p><p>S</p><ul><li>S</li><li>S</li></ul><blockquote>S</blockquote><p>T</p>]]</div></main><aside class=sidebar><h3>W W</h3><ul><li><a>S</a></li><li><a>S</a></li></ul><p>S</p></aside><footer><p>S</p><a>W</a></footer>",
    "<div id=header><h1><a>W</a></h1><div class=menu><a>W</a><a>W</a></div></div><div id=cookie-notice class=banner><p>S S</p><button>W</button></div><div id=main>[[<h1>S</h1><p>T</p><p>T T</p><pre>S</pre><table><tr><td>S</td><td>W</td></tr></table>]]</div><div id=comments class=comments><h3>W</h3><div class=comment><p>T</p></div><div class=comment><p>S</p></div></div><div id=footer>S</div>",
    "<div class=topbar>S</div><div class=wrapper><div class=entry-content>[[<p>T</p><p>T</p><h2>S</h2><p>T</p>]]<div class='share social'><a>W</a><a>W</a></div></div><div class=related><h4>W W</h4><a>S</a><a>S</a></div><form><label>W</label><input><p>S</p><button>W</button></form></div>",
    "<nav>S</nav><article>[[<h1>S</h1><p>T</p>]]<aside class=advert><p>S</p></aside>[[<p>T</p><figure><figcaption>S</figcaption></figure><p>S</p>]]<section class=comments><p>S</p><p>T</p></section></article><aside><p>S</p><p>T</p></aside><footer><p>S</p></footer>",
    "<header><h1>W</h1><p>S</p></header><div class=breadcrumb><a>W</a> &gt; <a>W</a></div><section class=story>[[<h2>S</h2><p>T</p><p>T</p><ol><li>T</li><li>S</li></ol>]]</section><div class='sponsored promo'><p>S</p><p>T</p></div><div class=newsletter><form><p>S</p></form></div><footer><p>S S</p></footer>",
    "<table><tr><td class='nav menu'><a>W</a><br><a>W</a><br><a>W</a></td><td class='text content'>[[<p>T</p><p>W</p><p>T</p><p>S</p>]]</td></tr></table><div class='copyright footer'>S &copy; W</div>",
    "<div role=navigation class=nav><a>W</a><a>W</a></div><div role=main class=body>[[<h1>S</h1><div>T</div><div>W</div><div>T</div><div>S</div>]]</div><div role=complementary class=sidebar><p>S</p></div><div role=contentinfo class=footer><p>S</p></div>",
    "<div class='consent notice'><p>T</p><button>W W</button></div><div class='body text'>[[T<br>T]]</div><div class='subscribe form'><p>S</p></div><div class='comments disqus' id=responses><p>T</p><p>T</p></div>",
    "<header><p>S</p></header><main><article>[[<p>S</p><p>W</p><p>S</p><p>W W</p><p>S</p><p>T</p>]]</article></main><div class=ads><p>S</p></div><footer>S</footer>",
    "<article class=post>[[<p>W</p><p>W W</p><h3>W</h3><p>S</p><p>W</p>]]</article><div class=banner>S S</div><aside>S<p>W</p></aside><footer><ul><li><a>W</a></li><li>&copy; W</li></ul></footer>",
    "<div class=menu><ul><li><a>W</a></li><li>W</li></ul></div><div class='ad slot'>S</div><div class=article>[[<h1>W</h1>T<p>W</p><p>T</p>]]<ul class=tags><li><a>W</a></li><li><a>W</a></li></ul></div><div class='ad slot'>T</div><footer><small>S</small></footer>",
    "<header class=site-header><nav class=site-nav><a>W</a><a>W W</a></nav></header><main id=content><div class=column>[[<h1>S</h1><div><p>T</p><p>W</p></div><div><p>S</p><dl><dt>W</dt><dd>S</dd></dl></div>]]</div><div class='sidebar widget'><p>S</p><p>W</p></div></main><div class='cookie banner'>T</div>",
]


class Node:
    """An element, or a run of text if tag is '#'."""

    __slots__ = ("tag", "names", "parent", "chars", "linked", "text", "label")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, label: int = 0):
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.chars = self.linked = 0
        self.text = ""


def marks(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match) of the markup of a page in order; the match is None for comments, declarations and raw elements.

    A tag ends at the first > outside quotes. The first tag that has none ends at the next >, and so do all tags
    after it, so no part of a page is searched more than a few times. What stands after the last > is text.
    """
    at, last, tag_at = 0, page.rfind(">"), TAG.match
    while 0 <= (start := page.find("<", at)) <= last:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, None
        elif page[start + 1] in "!?":
            at = page.index(">", start) + 1
            yield start, at, None
        else:
            m = tag_at(page, start)
            if not m and tag_at == TAG.match and PLAIN_TAG.match(page, start):
                tag_at = PLAIN_TAG.match
                m = tag_at(page, start)
            at = m.end() if m else start + 1
            if m:
                yield start, at, m
                raw = RAW_END.get(m[2].lower())
                if raw and not m[1] and not m[3].endswith("/"):
                    end = raw.search(page, at)
                    start, at = at, page.find(">", end.end()) + 1 if end else 0
                    at = at or len(page)
                    yield start, at, None


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents before children. Any string is parsed: ends may be missing or too many."""
    nodes = [Node("html", (), -1)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and their nodes; inline ones have their block's
    opened: dict[str, int] = {}  # how many elements of each kind are open
    run: list[str] = []
    state = {"linked": 0, "label": 0}

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                node = Node("#", (), stack[-1][1], state["label"])
                node.text, node.chars, node.linked = text, len(text), min(len(text), state["linked"])
                nodes.append(node)
            run.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        run.append(text)
        if opened.get("a"):
            state["linked"] += len(text.strip())

    def push(tag: str, node: int) -> None:
        if len(stack) < DEPTH:
            stack.append((tag, node))
            opened[tag] = opened.get(tag, 0) + 1

    def pop(to: int) -> None:
        if any(tag not in INLINE for tag, _ in stack[to:]):
            flush()
        for tag, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    def end(tags, bounds=frozenset()) -> None:
        """Ends the innermost open element of these kinds, if it is inside of the innermost of bounds."""
        if any(map(opened.get, tags)):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    return pop(i)
                if stack[i][0] in bounds:
                    return

    at = 0
    for start, stop, m in marks(page):
        if start > at:
            add(page[at:start])
        at = stop
        tag = m[2].lower() if m else ""
        if not tag or tag in RAW:
            continue
        if m[1]:
            end((tag,))
        elif tag == "br":
            run.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            end(SIBLINGS.get(tag) or ({"p"} if tag in ENDS_P else ()), BOUNDS)
            if tag in INLINE:
                if tag == "a":  # links don't nest
                    end((tag,))
                push(tag, stack[-1][1])
            else:
                flush()
                if "data-content" in m[3]:
                    state["label"] = 0 if "off" in m[3] else 1
                names = tuple(w for g in NAMES.findall(m[3]) for w in re.findall(r"[a-z]+", "".join(g).lower()))
                nodes.append(Node(tag, names, stack[-1][1], state["label"]))
                push(tag, len(nodes) - 1)
    add(page[at:])
    flush()
    for node in reversed(nodes):
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].linked += node.linked
    return nodes


def features(node: Node, parent: Node | None) -> list[str]:
    size = min(node.chars.bit_length(), 12)
    share = int(4 * node.linked / node.chars) if node.chars else 0
    out = ["1", f"tag {node.tag}", f"links {share}", *(f"name {w}" for w in node.names)]
    if node.tag == "#":
        up = parent.tag if parent else ""
        out += [f"in {up}", f"size {size}", f"stop {node.text[-1] in '.!?'}", *(f"own {w}" for w in (parent.names if parent else ()))]
        if "©" in node.text:
            out.append("sign")
    return out


class Model:
    """Weights by feature; edges: by (kind of child, parent's label, child's label)."""

    def __init__(self):
        self.own: dict[str, float] = {}
        self.edge: dict[tuple[bool, int, int], float] = {}

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, ...]]]:
        """Each node's probability of content, and each edge's four joint probabilities (parent, child)."""
        n, own, e = len(nodes), self.own, self.edge
        unary = [sum(own.get(f, 0.0) for f in features(x, nodes[x.parent] if x.parent >= 0 else None)) for x in nodes]
        # beliefs as log-odds; m: messages to the parent, exact for two labels
        up, message = unary[:], [0.0] * n
        tables = {k: tuple(math.exp(e.get((k, p, c), 0.0)) for p in (0, 1) for c in (0, 1)) for k in (False, True)}
        for i in range(n - 1, 0, -1):
            w00, w01, w10, w11 = tables[nodes[i].tag == "#"]
            x = math.exp(max(-30.0, min(30.0, up[i])))
            message[i] = math.log((w10 + w11 * x) / (w00 + w01 * x))
            up[nodes[i].parent] += message[i]
        full, joint = up[:], [(0.0,) * 4] * n
        for i in range(1, n):
            w00, w01, w10, w11 = tables[nodes[i].tag == "#"]
            rest = math.exp(max(-30.0, min(30.0, full[nodes[i].parent] - message[i])))
            x = math.exp(max(-30.0, min(30.0, up[i])))
            j = (w00, w01 * x, w10 * rest, w11 * x * rest)
            total = sum(j)
            joint[i] = tuple(v / total for v in j)
            full[i] = up[i] + math.log((w01 + w11 * rest) / (w00 + w10 * rest))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, f)))) for f in full], joint

    def fit(self, pages: list[list[Node]], rounds: int = 50, rate: float = 0.4, decay: float = 0.02) -> Model:
        """Gradient steps (AdaGrad) on the log-likelihood of the pages: features seen less features expected."""
        past: dict = {}
        for _ in range(rounds):
            own: dict[str, float] = {}
            edge: dict[tuple[bool, int, int], float] = {}
            for nodes in pages:
                p, joint = self.marginals(nodes)
                for i, x in enumerate(nodes):
                    gap = x.label - p[i]
                    for f in features(x, nodes[x.parent] if x.parent >= 0 else None):
                        own[f] = own.get(f, 0.0) + gap
                    if i:
                        kind = x.tag == "#"
                        for k, v in enumerate(joint[i]):
                            key = (kind, k >> 1, k & 1)
                            seen = (nodes[x.parent].label, x.label) == key[1:]
                            edge[key] = edge.get(key, 0.0) + seen - v
            for weights, step in ((self.own, own), (self.edge, edge)):
                for f, g in step.items():
                    g = g / len(pages) - decay * weights.get(f, 0.0) / 10
                    past[f] = past.get(f, 1e-8) + g * g
                    weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(past[f])
        return self

    def text(self, page: str) -> str:
        nodes = parse(page)
        p, _ = self.marginals(nodes)
        return "\n".join(x.text for x, q in zip(nodes, p) if x.tag == "#" and q > 0.5)


def labelled_pages(texts: list[str], copies: int = COPIES, seed: int = 7) -> list[list[Node]]:
    """Labelled pages: the layouts, filled with words of the texts."""
    draw = random.Random(seed)
    words = [w for t in texts for w in t.split()] or ["word"]

    def some(n: int) -> str:
        at = draw.randrange(len(words))
        return html.escape(" ".join((words * (1 + n // len(words)))[at : at + n] or words[:n]).rstrip(".,"))

    def fill(m: re.Match) -> str:
        if m[0] == "W":
            return some(1) + ("." if draw.random() < 0.3 else "")
        n = draw.randint(2, 14) if m[0] == "S" else draw.randint(15, 150)
        return some(n) + ("." if draw.random() < 0.9 else "")

    out = []
    for _ in range(copies):
        for layout in LAYOUTS:
            body = layout.replace("[[", "<div data-content=on>").replace("]]", "</div><div data-content=off></div>")
            body = re.sub(r"(?<=[> ])[TSW](?=[ <])", fill, body)
            nodes = parse(f"<body>{body}</body>")
            out.append(_without_marks(nodes))
    return out


def _without_marks(nodes: list[Node]) -> list[Node]:
    """The marking divs taken out; an element whose text is mostly content is content itself, but for body."""
    gone = {i: x.parent for i, x in enumerate(nodes) if x.tag == "div" and not x.names and (x.chars == 0 or x.label and not nodes[x.parent].label)}
    place, out = {}, []
    for i, x in enumerate(nodes):
        parent = x.parent
        while parent in gone:
            parent = gone[parent]
        if i not in gone:
            place[i] = len(out)
            x.parent = place.get(parent, -1)
            out.append(x)
    inside = [0] * len(out)
    for i in range(len(out) - 1, 0, -1):
        inside[i] += out[i].chars * out[i].label if out[i].tag == "#" else 0
        inside[out[i].parent] += inside[i]
    for i, x in enumerate(out):
        if x.tag != "#":
            x.label = int(x.tag not in ("html", "body") and x.chars > 0 and inside[i] > 0.5 * x.chars)
    return out


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, copies: int = COPIES) -> Model:
    """A model from labelled pages that are the layouts filled with words of sample_pages pages of the table.

    The sample is bounded: the pages with the smallest hashes, SAMPLE_CHARS characters of each. Hashes come
    first and alone, then only these pages are fetched; of equal pages one.
    """
    hashed = pages.select(F.xxhash64("page_id", "url", "html").alias("h"), F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    least = [r.h for r in hashed.select("h").orderBy("h").limit(sample_pages).collect()]
    few = hashed.filter(F.col("h").isin(least)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if least else []
    texts = [" ".join(x.text for x in parse(r.html or "") if x.tag == "#") for r in few]
    return Model().fit(labelled_pages(texts, copies))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page's main text, from its whole html.

    pages: page_id, url, html (other columns are ignored). A null or empty html has an empty text; text that
    isn't HTML is one block; repeated rows and null ids give a row each; an empty table gives no rows.
    Character references are decoded, white space in a block is one space, blocks are joined by one newline.
    """
    model = model or train(pages)

    def run(batches):
        for b in batches:
            texts = [model.text(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
