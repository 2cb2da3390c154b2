"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each node is content or not; a node's features (tag, class and id words, share of
text in links, length and shape of its own text) give it a potential, and every parent-child edge carries a learned
two-by-two potential. Sum-product messages, once up and once down the tree, yield each node's exact marginal; a
text block is kept if its node's marginal is at least one half. All potentials are trained together, by the gradient
observed minus expected (both exact on a tree), from labelled pages: drawn by a seeded generator here, as the tables
have no labels. Scripts, styles, the head and what a form's fields hold are never text; all else, formulas, buttons and drawings among it, is
for the model to judge.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import map_texts

#: Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template iframe select datalist textarea".split())
#: Elements that are blocks; others, MathML, SVG and unknown ones among them, belong to the text around them. Names with a hyphen are taken for blocks.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li main menu nav noframes noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag that ends open elements of these names, up to the nearest of those it stands in.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    #: Runs of own text: (order in the page, text).
    runs: list[tuple[int, str]] = field(default_factory=list)
    chars: int = 0
    linked: int = 0


class Dom(HTMLParser):
    """A tree of block elements; text of inline elements belongs to the block around them. Each tag costs the same, however deep it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1)]
        #: Open elements: (tag, node); and for each tag the places where it is open.
        self.open: list[tuple[str, int]] = [("#page", 0)]
        self.places: dict[str, list[int]] = {"#page": [0]}
        self.unseen = self.links = self.order = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.nodes[self.open[-1][1]].runs.append((self.order, text))
            self.order += 1

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.close_until(("p",), ("#page",))
                self.flush()
            return
        if self.unseen:
            # inside what isn't shown only its own nesting counts; page structure ends a head that was never closed
            if tag in UNSEEN:
                self.push(tag, self.open[-1][1])
                self.unseen += 1
                return
            if self.open[-1][0] == "head" and tag not in ("html",):
                self.pop()
            else:
                return
        if tag in CLOSES_P:
            self.close_until(("p",), ("#page", "td", "th", "button"))
        if tag in ENDS:
            while self.close_until(ENDS[tag], SCOPE[tag]):
                pass
        if tag in UNSEEN:
            self.push(tag, self.open[-1][1])
            self.unseen += 1
        elif tag in BLOCKS or "-" in tag:
            self.flush()
            words = []
            for name, value in attrs:
                if name in ("class", "id", "role") and value:
                    words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())[:20]
            self.nodes.append(Node(tag, self.open[-1][1], tuple(words)))
            self.push(tag, len(self.nodes) - 1)
        else:
            self.links += tag == "a"
            self.push(tag, self.open[-1][1])

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "html", "body", "article"):
            self.handle_endtag(tag)

    def pop(self) -> None:
        tag, _ = self.open[-1]
        if tag in UNSEEN:
            self.unseen -= 1
        elif tag in BLOCKS or "-" in tag:
            self.flush()
        else:
            self.links -= tag == "a"
        self.open.pop()
        self.places[tag].pop()

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def close_until(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> bool:
        """Close the nearest open element of `tags`, if none of `scope` stands before it."""
        k = self.nearest(tags)
        if not k or self.nearest(tuple(t for t in scope if t not in tags)) > k:
            return False
        while len(self.open) > k:
            self.pop()
        return True

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in ("body", "html") or tag in VOID:
            return
        inline = tag not in BLOCKS and tag not in UNSEEN and "-" not in tag
        self.close_until((tag,), ("#page", "td", "th", "article", "section", "div", "li") if inline else ("#page",))

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.parts.append(data)
        n = len(data) - data.count(" ")
        node = self.nodes[self.open[-1][1]]
        node.chars += n
        if self.links:
            node.linked += n


def parse(html: str) -> list[Node]:
    """Block elements in page order, parents first; never fails."""
    dom = Dom()
    dom.feed(re.sub(r"<!\[[^>]*>?", "", html))
    dom.close()
    while len(dom.open) > 1:
        dom.pop()
    dom.flush()
    return dom.nodes


def node_features(nodes: list[Node]) -> list[list[str]]:
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, n in enumerate(nodes):
        own = " ".join(t for _, t in n.runs)
        found = ["bias", f"tag={n.tag}", f"links={min(4, 5 * linked[i] // chars[i]) if chars[i] else -1}", f"own={min(5, len(own).bit_length() // 2)}", f"all={min(7, chars[i].bit_length() // 2)}"]
        found += [f"word={w}" for w in dict.fromkeys(n.words)]
        if own:
            found.append(f"stop={own[-1] in '.!?:;'}")
            found.append(f"sign={own[0] in '©®™'}")
        out.append(found)
    return out


@dataclass
class Model:
    #: Weight of each feature for content.
    weights: dict[str, float] = field(default_factory=dict)
    #: edge[parent][child]: log potentials.
    edge: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def messages(self, nodes: list[Node], features: list[list[str]]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of content: each node's marginal, and the beliefs below and above each node's edge to its parent."""
        get = self.weights.get
        (e00, e01), (e10, e11) = self.edge
        below = [sum(get(f, 0.0) for f in fs) for fs in features]
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            u = below[i]
            up[i] = _lse(e11 + u, e10) - _lse(e01 + u, e00)
            below[nodes[i].parent] += up[i]
        whole, above = below[:], [0.0] * len(nodes)
        for i in range(1, len(nodes)):
            v = whole[nodes[i].parent] - up[i]
            above[i] = v
            whole[i] = below[i] + _lse(e11 + v, e01) - _lse(e10 + v, e00)
        return whole, below, above

    def marginals(self, nodes: list[Node]) -> list[float]:
        return [_sigmoid(x) for x in self.messages(nodes, node_features(nodes))[0]]


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(pages: list[tuple[list[Node], list[int]]], epochs: int = 25, rate: float = 0.3, decay: float = 0.0003, seed: int = 3) -> Model:
    """Maximise the likelihood of labelled trees by stochastic gradient steps; expectations by sum-product."""
    model, rng = Model(), random.Random(seed)
    data = [(nodes, node_features(nodes), labels) for nodes, labels in pages]
    for epoch in range(epochs):
        rng.shuffle(data)
        step = rate / (1 + epoch / 5)
        for nodes, features, labels in data:
            whole, below, above = model.messages(nodes, features)
            old = [row[:] for row in model.edge]
            for i, fs in enumerate(features):
                miss = labels[i] - _sigmoid(whole[i])
                for f in fs:
                    w = model.weights.get(f, 0.0)
                    model.weights[f] = w + step * (miss - decay * w)
                if i:
                    score = {(p, c): old[p][c] + p * above[i] + c * below[i] for p in (0, 1) for c in (0, 1)}
                    top = max(score.values())
                    total = sum(math.exp(s - top) for s in score.values())
                    for (p, c), s in score.items():
                        seen = (p, c) == (labels[nodes[i].parent], labels[i])
                        model.edge[p][c] += step * 0.1 * (seen - math.exp(s - top) / total)
    return model


#: Names that sites give to parts of a page.
CONTENT_WORDS = "content post entry story body text main article page".split()
SIDE_PARTS = {
    "nav": "nav menu navbar navigation breadcrumb topnav",
    "header": "header masthead banner topbar site",
    "footer": "footer bottom legal copyright colophon",
    "aside": "sidebar aside widget related recommended trending side",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner",
    "notice": "notice cookie consent alert gdpr popup modal newsletter subscribe signup",
    "comments": "comments comment reply respond discussion disqus",
    "share": "share social follow tags meta toolbar pagination",
}


def draw_page(rng: random.Random) -> tuple[str, set[str]]:
    """A labelled page: html, and the words that stand in content (every word of a page is different)."""
    count = iter(range(10**6))
    good: set[str] = set()

    def words(n: int, keep: bool, end: str = ".") -> str:
        made = [f"{rng.choice(['re', 'to', 'an', 'us', 'li'])}{rng.choice('aeiou')}{next(count)}x" for _ in range(n)]
        if keep:
            good.update(made)
        return " ".join(made).capitalize() + end if end != "." or rng.random() < 0.9 else " ".join(made)

    def link(n: int, keep: bool) -> str:
        return f'<a href="/{next(count)}">{words(n, keep, "")}</a>'

    def attr(*names: str) -> str:
        if rng.random() < 0.2:
            return ""
        return f' {rng.choice(["class", "id", "class"])}="{" ".join(rng.sample(names, min(len(names), rng.choice((1, 1, 2)))))}"'

    def paragraph() -> str:
        text = words(rng.choice((2, 5, 9, 15, 30, 60, 90)), True)
        if rng.random() < 0.2:
            text += " " + link(rng.randrange(1, 4), True) + " " + words(rng.randrange(3, 20), True)
        return rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text[:9]}</em>{text[9:]}</p>"))

    def content() -> str:
        out = [f"<h1>{words(rng.randrange(2, 9), True, '')}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            kind = rng.random()
            if kind < 0.75:
                out.append(paragraph())
            elif kind < 0.82:
                out.append(f"<h2>{words(rng.randrange(1, 6), True, '')}</h2>" + paragraph())
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{words(rng.randrange(1, 12), True)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{words(12, True)}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<pre>{words(8, True, '')}</pre>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{words(2, True, '')}</td>" for _ in range(3)) + "</tr></table>")
            if rng.random() < 0.08:
                out.append(part(rng.choice(("ad", "notice", "share", "aside"))))
        return "".join(out)

    def part(kind: str) -> str:
        names = SIDE_PARTS[kind].split()
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(kind) if rng.random() < 0.6 else None
        mark = attr(*names) if tag else f' class="{rng.choice(names)}"'
        tag = tag or rng.choice(("div", "div", "section"))
        style = rng.random()
        if kind == "nav" or style < 0.2:
            inside = "<ul>" + "".join(f"<li>{link(rng.randrange(1, 4), False)}</li>" for _ in range(rng.randrange(2, 9))) + "</ul>"
        elif kind == "comments":
            inside = f"<h3>{words(2, False, '')}</h3>" + "".join(f'<div class="comment"><p>{words(rng.randrange(3, 40), False)}</p></div>' for _ in range(rng.randrange(1, 5)))
        elif kind == "footer":
            inside = f"&copy; {words(rng.randrange(2, 30), False)} &middot; {link(2, False)}" if style < 0.6 else f"<p>&copy; {words(rng.randrange(2, 20), False)}</p>"
        elif kind == "notice" and style < 0.5:
            inside = f"<form><p>{words(rng.randrange(3, 20), False)}</p><label>{words(1, False, '')}</label><input type=text><button>ok</button></form>"
        elif style < 0.6:
            inside = words(rng.randrange(1, 40), False)
        else:
            inside = f"<p>{words(rng.randrange(2, 40), False)}</p>" + (f"<h3>{words(3, False, '')}</h3>" if rng.random() < 0.3 else "")
        return f"<{tag}{mark}>{inside}</{tag}>"

    wrap = rng.random()
    if wrap < 0.5:
        main = f"<article{attr(*CONTENT_WORDS) if rng.random() < 0.4 else ''}>{content()}{part('comments') if rng.random() < 0.1 else ''}</article>"
    elif wrap < 0.7:
        main = f"<main>{content()}</main>"
    else:
        main = f'<div class="{rng.choice(CONTENT_WORDS)}">{content()}</div>'
    if rng.random() < 0.3:
        main = f"<main>{main}</main>" if wrap < 0.5 else f'<div class="{rng.choice(("wrapper", "container", "row", "page"))}">{main}{part("aside")}</div>'
    before = [part(k) for k in rng.sample(("nav", "header", "ad", "notice"), rng.randrange(0, 4))]
    after = [part(k) for k in rng.sample(("footer", "aside", "comments", "ad", "share", "notice"), rng.randrange(0, 5))]
    form = f"<form><label>{words(1, False, '')}</label><input></form>" if rng.random() < 0.2 else ""
    head = f"<head><title>{words(4, False)}</title><style>p{{margin:0}}</style></head>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{form}{''.join(after)}" + rng.choice(("</body></html>", "")), good


def labelled_pages(n: int, seed: int) -> list[tuple[list[Node], list[int]]]:
    """Trees with a label for each node: most of its own text is content, or, without own text, any below it is."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        html, good = draw_page(rng)
        nodes = parse(html)
        labels = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            own = [w.strip(".") in good for _, run in nodes[i].runs for w in run.lower().split()]
            if own:
                labels[i] = int(2 * sum(own) > len(own))
            if labels[i] and i and not nodes[nodes[i].parent].runs:
                labels[nodes[i].parent] = 1
        out.append((nodes, labels))
    return out


TRAIN_PAGES, TRAIN_SEED = 800, 11


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages(TRAIN_PAGES, TRAIN_SEED))


def main_text(html: str | None, model: Model) -> str:
    """Content blocks in page order, joined by blank lines."""
    nodes = parse(html or "")
    if not any(n.runs for n in nodes):
        return ""
    odds = model.messages(nodes, node_features(nodes))[0]
    runs = sorted(r for n, o in zip(nodes, odds, strict=True) if o >= 0 for r in n.runs)
    return "\n\n".join(t for _, t in runs)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """(kept columns, text, n_chars) for every page. Null or empty html: empty text, 0. Rows stay where they are; a page is one tree in memory.

    Repeated rows give a row each; an empty table an empty one; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    def make():
        m = shared.value

        def work(texts):
            found = [main_text(t, m) for t in texts]
            return {"text": found, "n_chars": [len(t) for t in found]}

        return work

    return map_texts(pages, list(keep), html_col, "text string, n_chars long", make)
