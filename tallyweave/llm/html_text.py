"""Main text of web pages by a tree-structured graphical model.

Block elements are the nodes of a tree, with a hidden label each: content or not. A node's potential is a weighted sum of its
features (tag, words of its class, id and role, length, links, ending), a parent's and child's joint potential depends on the kind of
child. Messages passed up and then down by the sum-product algorithm give every node's marginal; a node's text counts as content if
that is at least one half. The weights maximise the conditional likelihood of labelled pages, whose gradient is observed less expected
features. The labelled pages are made by labelled_pages() from a seed: layouts with menus, headers, notices, adverts,
sidebars, forms, comments and footers around and inside articles, each element with its label.

Inline elements belong to their block, unless their class or id names a part that isn't content. Scripts, styles, the head and
other elements without running text are dropped while reading, and so is what a browser shows only if it cannot do better (noscript, the inside of
audio, video, canvas, object and iframe). Reading takes time linear in the page, however its tags are nested, left open or broken.

Edge cases: null and empty pages give empty text; text without markup is content. Unclosed and stray tags, comments that don't
end and cut-off pages are read as far as they go; a tag that doesn't end is text. Repeated rows are read each; other columns are left out.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_schema, slices, split_words

SLICE_BYTES = 8 << 20
# What HTML says of its elements.
DROPPED = frozenset("script style noscript template iframe svg canvas object audio video select textarea button head title annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr dd dt li legend summary".split())
CLOSED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
LIMITS = frozenset("ul ol dl table menu body html".split())
# Words of class, id and role by what they name.
NAMES = {
    "advert": "ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored sponsors dfp",
    "menu": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar branding logo sitename site-header",
    "foot": "footer foot bottom colophon contentinfo copyright legal credits imprint",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations trending popular tags",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner warning message privacy disclaimer paywall",
    "form": "form search login signup signin subscribe subscription newsletter register",
    "comment": "comment comments commentlist disqus reply replies respond discussion reader readers",
    "share": "share sharing social follow like tweet buttons toolbar meta byline",
    "content": "article content contents post entry main story body text page blog hentry maincontent prose copy",
}
_NAMED = {word: kind for kind, words in NAMES.items() for word in words.split()}
_UNWANTED = frozenset(NAMES) - {"content"}
_OPENING = re.compile(r"<(?:!--|[!?]|/|(?=[a-zA-Z]))")
_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LANDMARKS = frozenset("nav header footer aside form search menu dialog fieldset".split())


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    label: int = -1
    own: int = 0  # letters of its own text
    linked: int = 0  # of those in links
    total: int = 0
    total_linked: int = 0
    ends: bool = False  # its text ends as a sentence
    sign: bool = False  # it has a copyright sign
    within: tuple[str, ...] = ()  # what its ancestors are


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("#page", -1)])
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # (block number, node, text)


def _named(attributes: str, labelled: bool) -> tuple[tuple[str, ...], int]:
    names, label = [], -1
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "data-y":
                if labelled:
                    label = int(value)
            else:
                names += [kind for w in _WORD.findall(value) if (kind := _NAMED.get(w.lower()))] or ["otherwise"]
    return tuple(dict.fromkeys(names)), label


class _Tags:
    """The tags of a page from left to right. Every search goes on from where the last one ended, or fails once for all."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.quoted = True  # quotes keep > from ending a tag, as long as such quotes do end

    def end_of(self, at: int) -> int:
        """Where the > stands that ends the tag, -1 if there is none."""
        if self.last[">"] < at:
            return -1
        place = at
        while self.quoted and (m := _STOP.search(self.source, place)):
            if m[0] == ">":
                return m.start()
            # A quote that doesn't end is a letter like any other.
            place = self.source.find(m[0], m.end()) + 1 if self.last[m[0]] > m.start() else m.end()
        self.quoted = False
        return self.source.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        """(begin, end, kind, inside): kind is / for an end tag, empty for a beginning one, ! for what is neither."""
        at, source = 0, self.source
        while m := _OPENING.search(source, at):
            begin, inner = m.span()
            if m[0] == "<!--":
                end = source.find("-->", inner)
                at = len(source) if end < 0 else end + 3
                yield begin, at, "!", ""
                continue
            end = source.find(">", inner) if m[0] != "<" else self.end_of(inner)
            if end < 0:
                if self.last[">"] < inner and source.find("<!--", inner) < 0:
                    return  # nothing ends any more
                at = inner
                continue
            kind = m[0][1:] if m[0] != "</" or source[inner].isalpha() and source[inner].isascii() else "!"
            skip = yield begin, end + 1, "!" if kind in ("!", "?") else kind, source[inner:end]
            at = end + 1 if skip is None else skip


class _Open:
    """The open elements, with the places of each kind, so that none has to be searched for."""

    def __init__(self):
        self.tags, self.nodes, self.blocks = ["#page"], [0], []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCKS:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def pop(self) -> str:
        """The innermost element's tag, empty if it was closed before."""
        tag = self.tags.pop()
        self.nodes.pop()
        if tag:
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        return tag

    def close(self, k: int) -> None:
        """Ends an inline element and none of those inside."""
        self.places[self.tags[k]].pop()
        self.tags[k] = ""

    def innermost(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def parse(source: str, labelled: bool = True) -> Page:
    """Nodes in page order (parents first) and runs of text. Only labelled pages' data-y is read; on others it may hold anything."""
    page = Page()
    nodes, runs = page.nodes, page.runs
    stack = _Open()
    block = links = dropped = at = 0

    def add(text: str) -> None:
        if not dropped and text and not text.isspace():
            text = html.unescape(text)
            node = stack.nodes[-1]
            runs.append((block, node, text))
            n = len(text.strip())
            nodes[node].own += n
            if links:
                nodes[node].linked += n
            nodes[node].ends = text.rstrip()[-1:] in (".", "!", "?", "…", ":", "”", '"')
            if "©" in text:
                nodes[node].sign = True
        elif not dropped and text:
            runs.append((block, stack.nodes[-1], " "))

    def pop_to(k: int) -> None:
        nonlocal links, dropped, block
        while len(stack.tags) > k:
            tag = stack.pop()
            links -= tag == "a"
            dropped -= tag in DROPPED
            block += tag in BLOCKS

    tags = iter(_Tags(source))
    found = next(tags, None)
    while found:
        begin, end, kind, inside = found
        add(source[at:begin])
        at, skip = end, None
        name = _NAME.match(inside) if kind != "!" else None
        tag = name[0].lower() if name else ""
        if kind == "/" and tag:
            k = stack.innermost((tag,))
            if k:
                if tag in BLOCKS or tag in DROPPED or not (stack.blocks and stack.blocks[-1] > k):
                    pop_to(k)
                else:  # an inline end tag does not end the blocks inside
                    links -= tag == "a"
                    stack.close(k)
        elif tag in ("br", "wbr"):
            if tag == "br" and not dropped:
                runs.append((block, stack.nodes[-1], " "))
        elif tag:
            if tag in CLOSED_BY:
                k = stack.innermost(CLOSED_BY[tag])
                if k > stack.innermost(LIMITS):
                    pop_to(k)
            elif tag in CLOSES_P and stack.blocks and stack.tags[stack.blocks[-1]] == "p":
                pop_to(stack.blocks[-1])
            attributes = inside[name.end() :]
            names, label = _named(attributes, labelled)
            if tag in BLOCKS:
                block += 1
            if not (tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW):
                if tag in BLOCKS or (names and _UNWANTED.intersection(names)):
                    nodes.append(Node(tag, stack.nodes[-1], names, label))
                    stack.push(tag, len(nodes) - 1)
                else:
                    stack.push(tag, stack.nodes[-1])
                links += tag == "a"
                dropped += tag in DROPPED
                if tag in RAW:  # nothing in it is markup
                    stop = re.compile(f"</{tag}", re.I).search(source, at)
                    at = skip = stop.start() if stop else len(source)
        try:
            found = tags.send(skip)
        except StopIteration:
            found = None
    add(source[at:])
    for n in nodes:
        n.total, n.total_linked = n.own, n.linked
        if n.parent >= 0:
            above = nodes[n.parent]
            found = set(above.within)
            if above.tag in _LANDMARKS:
                found.add("within a landmark")
            if _UNWANTED.intersection(above.names):
                found.add("within a named part")
            if above.tag in ("article", "main") or "content" in above.names:
                found.add("within an article")
            n.within = tuple(sorted(found))
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].total += n.total
            nodes[n.parent].total_linked += n.total_linked
    return _without_wrappers(page)


def _without_wrappers(page: Page) -> Page:
    """Plain wrappers without text of their own tell nothing, however deeply they are nested: their children go to their parents."""
    place, kept = [], []
    for n in page.nodes:
        if n.parent >= 0 and n.tag in ("div", "section", "center") and not n.own and n.names in ((), ("otherwise",)):
            place.append(place[n.parent])
        else:
            n.parent = place[n.parent] if n.parent >= 0 else -1
            place.append(len(kept))
            kept.append(n)
    return Page(kept, [(block, place[node], text) for block, node, text in page.runs])


_TAGS = ("html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "other")
FEATURES = ("bias", *(f"tag {t}" for t in _TAGS), *(f"named {k}" for k in NAMES), "named otherwise", *(f"links {k}" for k in range(4)), *(f"length {k}" for k in range(6)), "no own text", "ends as a sentence", "copyright", "within a landmark", "within a named part", "within an article", "within neither")
_INDEX = {name: k for k, name in enumerate(FEATURES)}
#: The page itself is known to be content: its log-odds.
ROOT = 20.0
#: Kinds of children; each has four joint weights.
CHILDREN = ("block", "landmark", "named part")


def features(node: Node) -> list[int]:
    tag = f"tag {node.tag}"
    share = 4 * node.total_linked // max(1, node.total)
    length = sum(node.total >= x for x in (1, 20, 80, 200, 1000))
    found = ["bias", tag if tag in _INDEX else "tag h3" if node.tag in ("h4", "h5", "h6") else "tag td" if node.tag == "th" else "tag other", *(f"named {k}" for k in node.names), *(node.within or ("within neither",)), f"links {min(3, share)}", f"length {length}"]
    if not node.own:
        found.append("no own text")
    if node.ends:
        found.append("ends as a sentence")
    if node.sign:
        found.append("copyright")
    return [_INDEX[x] for x in found]


def child_kind(node: Node) -> int:
    if node.tag in _LANDMARKS:
        return 1
    return 2 if _UNWANTED.intersection(node.names) else 0


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(parents: list[int], unary: list[float], joint: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Sum-product on a tree of binary variables, parents before children. unary: potential of label 1 less that of 0; joint: of (parent, child) =
    00, 01, 10, 11. Returns each node's log-odds of label 1, and of each node but the first the joint probabilities with its parent."""
    n = len(parents)
    up = unary[:]  # log-odds from below and of its own
    message = [0.0] * n
    for k in range(n - 1, 0, -1):
        j00, j01, j10, j11 = joint[k]
        message[k] = _log_sum(j11 + up[k], j10) - _log_sum(j01 + up[k], j00)
        up[parents[k]] += message[k]
    full = up[:]
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    for k in range(1, n):
        j00, j01, j10, j11 = joint[k]
        above = full[parents[k]] - message[k]  # the parent without this child
        full[k] = up[k] + _log_sum(j11 + above, j01) - _log_sum(j10 + above, j00)
        logs = (j00, j01 + up[k], j10 + above, j11 + above + up[k])
        most = max(logs)
        weights = [math.exp(x - most) for x in logs]
        total = sum(weights)
        pairs[k] = tuple(w / total for w in weights)
    return full, pairs


@dataclass
class Model:
    unary: list[float]
    joint: list[tuple[float, float, float, float]]  # by kind of child


def extract(source: str | None, model: Model) -> list[str]:
    """Blocks of content, in page order."""
    if not source:
        return []
    page = parse(source, labelled=False)
    nodes = page.nodes
    unary = [ROOT, *(sum([model.unary[f] for f in features(n)]) for n in nodes[1:])]
    odds, _ = marginals([n.parent for n in nodes], unary, [model.joint[child_kind(n)] for n in nodes])
    blocks: dict[int, list[str]] = {}
    for block, node, text in page.runs:
        if odds[node] >= 0:
            blocks.setdefault(block, []).append(text)
    return [x for parts in blocks.values() if (x := " ".join(split_words("".join(parts))))]


def fit(pages: list[str], epochs: int = 15, rate: float = 0.3, seed: int = 1) -> Model:
    """AdaGrad on the conditional likelihood of labelled pages (data-y on every block; the page itself counts as content)."""
    width = len(FEATURES)
    weights = [0.0] * (width + 4 * len(CHILDREN))
    seen = [1e-6] * len(weights)
    trees = []
    for source in pages:
        nodes = parse(source).nodes
        labels = [1 if n.label < 0 else n.label for n in nodes]
        trees.append(([n.parent for n in nodes], [features(n) for n in nodes], [child_kind(n) for n in nodes], labels))
    order = list(range(len(trees)))
    shuffle = random.Random(seed)
    for _ in range(epochs):
        shuffle.shuffle(order)
        for t in order:
            parents, found, kinds, labels = trees[t]
            tables = [tuple(weights[width + 4 * k : width + 4 * k + 4]) for k in range(len(CHILDREN))]
            odds, pairs = marginals(parents, [ROOT, *(sum([weights[f] for f in x]) for x in found[1:])], [tables[k] for k in kinds])
            slope: dict[int, float] = {}
            for k, x in list(enumerate(found))[1:]:
                miss = labels[k] - 1 / (1 + math.exp(-max(-30.0, min(30.0, odds[k]))))
                for f in x:
                    slope[f] = slope.get(f, 0.0) + miss
                for pair in range(4):
                    f = width + 4 * kinds[k] + pair
                    slope[f] = slope.get(f, 0.0) + (2 * labels[parents[k]] + labels[k] == pair) - pairs[k][pair]
            for f, s in slope.items():
                s -= 1e-3 * weights[f]
                seen[f] += s * s
                weights[f] += rate * s / math.sqrt(seen[f])
    return Model(weights[:width], [tuple(weights[width + 4 * k : width + 4 * k + 4]) for k in range(len(CHILDREN))])


def labelled_pages(count: int = 400, seed: int = 20, names: dict[str, str] | None = None, unnamed: float = 0.15) -> list[str]:
    """Pages whose block elements carry their label in data-y. `names`: words by kind for class and id, else NAMES; a share of `unnamed` of them are
    replaced by words that tell nothing, so that the model doesn't lean on names alone."""
    names = names or NAMES
    r = random.Random(seed)
    syllables = "ba be ko la mi no ra se ti vu an er st".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 20).capitalize() + r.choice((".", ".", ".", "!", "?"))
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 5)))
    el = lambda tag, y, inner, name="": f'<{tag} data-y="{y}"{name and f" {r.choice(("class", "id"))}={chr(34)}{name}{chr(34)}"}>{inner}</{tag}>'
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda y, a, b: el(r.choice(("ul", "ul", "ol")), y, "".join(el("li", y, link()) for _ in range(r.randint(a, b))))
    some = lambda p, f: f() if r.random() < p else ""

    def name(kind: str) -> str:
        return word() if r.random() < unnamed else r.choice(names[kind].split())

    def short(y: int) -> str:
        return el("p", y, r.choice((sentence(), prose(), words(1, 6)))) if r.random() < 0.5 else r.choice((sentence(), prose(), words(1, 6)))

    def menu() -> str:
        return el("nav", 0, links(0, 2, 9), r.choice(("", name("menu")))) if r.random() < 0.6 else el("div", 0, links(0, 2, 9), name("menu"))

    def header() -> str:
        inner = r.choice((el("h1", 0, words(1, 4)), el("p", 0, words(1, 5)), words(1, 5), el("div", 0, link(), "logo"))) + some(0.4, menu)
        return el("header", 0, inner, r.choice(("", name("head")))) if r.random() < 0.6 else el("div", 0, inner, name("head"))

    def advert() -> str:
        return el(r.choice(("div", "div", "aside", "section", "p", "span")), 0, r.choice((sentence, prose, link, lambda: words(2, 9)))(), name("advert"))

    def notice() -> str:
        return el(r.choice(("div", "section", "p", "aside")), 0, short(0) if r.random() < 0.9 else prose(), name("notice"))

    def side() -> str:
        inner = some(0.7, lambda: el(r.choice(("h2", "h3")), 0, words(1, 3))) + r.choice((lambda: links(0, 2, 7), lambda: short(0), lambda: el("p", 0, prose())))()
        return el("aside", 0, inner, r.choice(("", name("side")))) if r.random() < 0.5 else el(r.choice(("div", "section")), 0, inner, name("side"))

    def form() -> str:
        inner = some(0.7, lambda: el("p", 0, sentence())) + f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>"
        return el("form", 0, inner, r.choice(("", name("form")))) if r.random() < 0.6 else el("div", 0, el("form", 0, inner), name("form"))

    def comments() -> str:
        one = lambda: el(r.choice(("div", "div", "li", "li", "p", "p", "article")), 0, r.choice((lambda: el("p", 0, prose()), sentence, prose))(), r.choice(("", "comment", "reply")))
        return el(r.choice(("div", "section", "ol", "ul")), 0, some(0.6, lambda: el(r.choice(("h2", "h3")), 0, words(1, 3))) + "".join(one() for _ in range(r.randint(1, 6))) + some(0.3, form), r.choice(("comments", "comments", "comment", "commentlist", "discussion", "reader-comments", "replies")))

    def footer() -> str:
        inner = r.choice((lambda: f"&copy; {words(1, 4)} &middot; {sentence()}", lambda: links(0, 1, 6), lambda: el("p", 0, f"&copy; {words(2, 8)}"), lambda: el("p", 0, prose())))()
        return el("footer", 0, inner, r.choice(("", name("foot")))) if r.random() < 0.7 else el("div", 0, inner, name("foot"))

    def share() -> str:
        return el("div", 0, "".join(link() for _ in range(r.randint(1, 4))), name("share"))

    def body() -> str:
        parts = [some(0.9, lambda: el(r.choice(("h1", "h1", "h2")), 1, words(1, 9)))]
        for _ in range(r.choice((1, 1, 2, 3, 5, 9))):
            inner = r.choice((prose, prose, prose, sentence, lambda: f"{sentence()} {link()} {sentence()}", lambda: f"<b>{sentence()}<br>", lambda: words(1, 4), lambda: words(5, 120)))()
            parts.append(el("p", 1, inner))
            parts.append(some(0.12, lambda: el(r.choice(("h2", "h3")), 1, words(1, 6))))
            parts.append(some(0.08, lambda: el(r.choice(("ul", "ol")), 1, "".join(el("li", 1, r.choice((sentence, lambda: words(1, 4)))()) for _ in range(r.randint(1, 5))))))
            parts.append(some(0.05, lambda: el("blockquote", 1, el("p", 1, prose()))))
            parts.append(some(0.03, lambda: el("pre", 1, words(3, 20))))
            parts.append(some(0.04, lambda: el("table", 1, el("tr", 1, el("td", 1, words(1, 4)) + el("td", 1, words(1, 4))))))
            parts.append(some(0.07, advert))
        parts += [some(0.15, share), some(0.1, side), some(0.1, form), some(0.1, comments)]
        return "".join(parts)

    pages = []
    for _ in range(count):
        kind = r.random()
        if kind < 0.5:
            main = el("article", 1, body(), r.choice(("", "", name("content"))))
        elif kind < 0.65:
            main = el("main", 1, r.choice((body, lambda: el("article", 1, body())))())
        elif kind < 0.85:
            main = el(r.choice(("div", "section")), 1, body(), name("content"))
        elif kind < 0.95:
            main = el("div", 1, body())
        else:
            main = body()
        around = [some(0.5, header), some(0.7, menu), some(0.4, advert), some(0.3, notice), some(0.15, form), some(0.2, side)]
        after = [some(0.3, side), some(0.3, comments), some(0.3, advert), some(0.15, form), some(0.2, notice), some(0.1, menu), some(0.8, footer), some(0.1, notice)]
        wrap = lambda x: el("div", 1, x, r.choice(("", "wrapper", "page"))) if r.random() < 0.3 else x
        if r.random() < 0.1:  # a fragment
            pages.append(body())
            continue
        pages.append(f'<html data-y="1"><head><title>{words(1, 5)}</title></head><body data-y="1">{wrap("".join(around) + main + "".join(after))}</body></html>')
    return pages


def extract_text(pages: DataFrame, model: Model | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """For each row its id, its URL, `blocks` array<string> and `text`, the blocks joined by line ends. No shuffle."""
    model = model or fit(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_column, SLICE_BYTES):
            blocks = [extract(x, shared.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.list_(pa.string())), pa.array(["\n".join(b) for b in blocks], pa.string())], [id_column, url_column, "blocks", "text"])

    return pages.select(id_column, url_column, html_column).mapInArrow(run, f"{ids_schema(pages, id_column, url_column)}, blocks array<string>, text string")
