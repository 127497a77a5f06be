"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of block elements; the text of inline elements (links, emphasis)
belongs to the block they stand in. Each element is a binary variable (content or not).
Its unary potential is a logistic model of tag, class and id words, text length, share of the page,
link share, sentence ends, line breaks, place in the page, depth and the tags and words of the
elements around it; each parent-child edge has a 2 x 2 potential. Sum-product messages go up the tree and down
again and give exact marginals; the text of elements whose content marginal is 0.5 or more is kept.

The model is trained on labelled pages, where every element's label is known by construction:
``labelled_pages`` writes pages with varied templates, with telling and with meaningless class words,
with paragraphs, in bare divisions with line breaks and in layout tables; or pass own (html, labels) pairs to ``fit``.

Defined results: null html is the empty page; a page without content has the empty text; markup
that is not closed or not opened is accepted; an empty table gives an empty result; repeated rows
get equal texts. Whole pages are read, in time that grows with their length: a tag's quoted values
and their number are bounded, and a tag beyond that ends at its first ``>``. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import extended, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>"
    r"|<(script|style|template|noscript|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']{1,4096}+|<|\"[^\"]{0,65536}\"|'[^']{0,65536}'){0,256}+)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var del big acronym label img br wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTER = frozenset(("#root", "html", "body"))
SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul dl td th tr blockquote figure".split())


SENTENCE_END = re.compile(r"[.!?…。](?=[\s\"'”»)]|$)")
OWNER = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)


@dataclass(slots=True)
class Node:
    """chars, linked: with all that is inside; own, stops, breaks, owner: of the element's own text. at: characters before it."""

    tag: str
    parent: int
    depth: int
    at: int = 0
    names: tuple[str, ...] = ()
    chars: int = 0
    linked: int = 0
    own: int = 0
    stops: int = 0
    breaks: int = 0
    owner: bool = False


@dataclass(slots=True)
class Page:
    """Elements in document order (parents first), and the pieces of text: (element, block, text)."""

    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    page, stack, block, at, read = Page([Node("#root", -1, 0)]), [0], 0, 0, 0
    nodes, pieces = page.nodes, page.pieces
    opened: dict[str, int] = {}  # how many elements of a tag are open
    links = 0  # open links

    def text(raw: str) -> None:
        nonlocal read
        said = html.unescape(raw) if "&" in raw else raw
        if said:
            pieces.append((stack[-1], block, said))
            n, node = len(said.strip()), nodes[stack[-1]]
            read += n
            node.own += n
            node.linked += n * (links > 0)
            node.stops += len(SENTENCE_END.findall(said))
            node.owner |= bool(OWNER.search(said))

    def close(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]

    for m in TOKEN.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        end, tag, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        tag = (tag or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append((stack[-1], block, " "))
            nodes[stack[-1]].breaks += 1
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            continue
        block += 1
        if end:
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag == tag:
                    close(k)
                    links = 0
                    break
                if tag not in SCOPE and open_tag in SCOPE:
                    break
            continue
        if tag in CLOSES_P and nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
            links = 0
        kinds = OWN_KIND.get(tag)
        if kinds:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in kinds:
                    close(k)
                    break
                if open_tag in SCOPE and open_tag not in kinds:
                    break
        if tag in VOID:
            continue
        names = tuple(w.lower() for _, value in ATTRIBUTE.findall(rest) for w in WORDS.findall(value)) if rest else ()
        nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, read, names))
        if not (rest or "").rstrip().endswith("/"):
            stack.append(len(nodes) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(source):
        text(source[at:])
    for node in reversed(nodes):
        node.chars += node.own
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].linked += node.linked
    return page


def evidence(page: Page) -> tuple[list[list[str]], list[list[str]]]:
    """Feature names of each element, and those that it gives to all elements inside it."""
    own, given = [], []
    total = max(1, page.nodes[0].chars)
    # elements in, and around, an article or main element; what is neither stands beside it, if the page has one
    within, around = [], set()
    for i, node in enumerate(page.nodes):
        within.append(node.tag in ("article", "main") or (node.parent >= 0 and within[node.parent]))
        while within[i] and node.parent >= 0 and node.parent not in around and not within[node.parent]:
            around.add(node.parent)
            node = page.nodes[node.parent]
    for i, node in enumerate(page.nodes):
        size = min(6, len(str(node.chars)) if node.chars else 0)
        share = int(4 * node.linked / node.chars) if node.chars else 5
        part = min(5, int(6 * node.chars / total))
        said = len(str(node.own)) if node.own else 0
        stops = min(3, node.stops)
        place = "first" if node.at == 0 else "head" if node.at < 0.1 * total else "last" if node.at + node.chars >= total else "foot" if node.at > 0.9 * total else "mid"
        names = {f"name={w}" for w in node.names}
        own.append(
            [f"tag={node.tag}", f"size={size}", f"links={share}", f"depth={min(node.depth, 6)}", f"tag+links={node.tag},{share}", f"part={part}", f"own={said}", f"own+stops={said},{stops}"]
            + [f"own+links={min(said, 3)},{share}", f"place+own={place},{min(said, 3)}", f"breaks={min(2, node.breaks)},{min(said, 3)}"]
            + (["owner"] if node.owner and not within[i] else [])
            + (["beside"] if around and not within[i] and i not in around else [])
            + sorted(names)
        )
        given.append([] if node.tag in OUTER else [f"in={node.tag}", f"inlinks={share}", *(f"in={w}" for w in sorted(set(node.names)))])
    return own, given


def logits(page: Page, bias: float, weights: dict[str, float]) -> list[float]:
    own, given = evidence(page)
    get, inherited, out = weights.get, [0.0] * len(own), []
    for i, node in enumerate(page.nodes):
        if node.parent >= 0:
            inherited[i] = inherited[node.parent] + sum(get(f, 0.0) for f in given[node.parent])
        out.append(min(20.0, max(-20.0, bias + inherited[i] + sum(get(f, 0.0) for f in own[i]))))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    edge: tuple[tuple[float, float], tuple[float, float]]  # [parent][child] potential

    def marginals(self, page: Page) -> list[float]:
        """Content marginal of each element, by one upward and one downward pass."""
        nodes, n = page.nodes, len(page.nodes)
        (e00, e01), (e10, e11) = self.edge
        unary = []
        for x in logits(page, self.bias, self.weights):
            p = 1.0 / (1.0 + math.exp(-x))
            unary.append((1.0 - p, p))
        belief = list(unary)  # product of the unary potential and the children's messages
        up = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            b0, b1 = belief[i]
            m0, m1 = e00 * b0 + e01 * b1, e10 * b0 + e11 * b1
            s = m0 + m1
            up[i] = (m0 / s, m1 / s)
            p = nodes[i].parent
            c0, c1 = belief[p][0] * up[i][0], belief[p][1] * up[i][1]
            s = c0 + c1
            belief[p] = (c0 / s, c1 / s)
        full = list(belief)
        for i in range(1, n):
            p = nodes[i].parent
            q0, q1 = full[p][0] / up[i][0], full[p][1] / up[i][1]
            d0, d1 = q0 * e00 + q1 * e10, q0 * e01 + q1 * e11
            f0, f1 = belief[i][0] * d0, belief[i][1] * d1
            s = f0 + f1
            full[i] = (f0 / s, f1 / s)
        return [f[1] for f in full]


def main_text(source: str, model: Model) -> str:
    page = parse(source)
    keep = model.marginals(page)
    blocks: dict[int, list[str]] = {}
    for node, block, said in page.pieces:
        if keep[node] >= 0.5:
            blocks.setdefault(block, []).append(said)
    joined = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


# Class and id words of the labelled pages' parts.
BOILERPLATE = {
    "nav": ("nav menu navbar navigation breadcrumb breadcrumbs topnav", ("nav", "div", "ul")),
    "header": ("header masthead topbar banner branding logo", ("header", "div")),
    "footer": ("footer bottom copyright colophon legal", ("footer", "div")),
    "side": ("sidebar aside widget related recommended trending popular more", ("aside", "div", "section")),
    "notice": ("cookie consent notice notices alert popup modal gdpr banner warning", ("div", "section", "aside")),
    "ad": ("ad ads advert advertisement sponsor sponsored promo promoted", ("div", "aside", "section", "ins")),
    "form": ("form search login newsletter subscribe signup subscription", ("form", "div")),
    "comments": ("comments comment reply replies discussion respond reader", ("section", "div", "ol")),
    "share": ("share social tags meta toolbar pagination pager", ("div", "ul")),
}
CONTENT = "article content post entry body main story text page"


def labelled_pages(count: int = 600, seed: int = 7) -> list[tuple[str, str]]:
    """(html, html with every element's label in a data-y attribute), from varied templates."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = lambda n: " ".join("".join(pick(("ka", "lo", "mi", "ter", "an", "su", "ve", "ri", "ol", "be")) for _ in range(int(rng.integers(1, 4)))) for _ in range(n))

    def words(n: int) -> str:
        """Sentences; up to four words stand without a full stop."""
        plain = syllables(n).split()
        if n < 5:
            return " ".join(plain)
        step = int(rng.integers(5, 14))
        return " ".join(" ".join(plain[i : i + step]).capitalize() + "." for i in range(0, n, step))

    def element(tag: str, label: int, body: str, names: str = "") -> str:
        name = f' {pick(("class", "id"))}="{names}"' if names else ""
        mark = "" if tag in INLINE else f' data-y="{label}"'
        return f"<{tag}{mark}{name}>{body}</{tag}>"

    def links(n: int) -> str:
        return "".join(element("li", 0, element("a", 0, words(int(rng.integers(1, 4))))) for _ in range(n))

    def noise(kind: str) -> str:
        names, tags = BOILERPLATE[kind]
        tag = pick(tags)
        if tag in ("div", "section", "ul", "ol", "ins", "form") or chance(0.3):
            name = pick(names.split())
            name += pick(("", "", f"-{pick(('box', 'list', 'wrap', 'inner', 'area'))}"))
        else:
            name = ""
        if tag in ("ul", "ol"):
            body = "".join(element("li", 0, words(int(rng.integers(2, 30)))) for _ in range(3)) if kind == "comments" else links(int(rng.integers(2, 8)))
        elif kind in ("nav", "share"):
            body = element("ul", 0, links(int(rng.integers(2, 8)))) if chance(0.7) else "".join(element("a", 0, words(2)) for _ in range(4))
        elif kind == "form":
            body = element("label", 0, words(2)) + "<input>" + element("button", 0, words(1)) + (element("p", 0, words(10)) if chance(0.5) else "")
        elif kind == "comments":
            body = element("h3", 0, words(2)) + "".join(element("div", 0, element("p", 0, words(int(rng.integers(3, 60)))), pick(("comment", "reply", ""))) for _ in range(int(rng.integers(1, 5))))
        else:
            body = pick((words(int(rng.integers(2, 40))), element("p", 0, words(int(rng.integers(3, 60)))), element("h3", 0, words(3)) + element("p", 0, words(int(rng.integers(3, 40)))), element("h4", 0, words(2)) + element("ul", 0, links(4))))
        return element(tag, 0, body, name)

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.62:
            body = words(int(rng.integers(1, 120)))
            if chance(0.25):
                body += " " + element(pick(("b", "em", "strong", "i", "a", "span", "code")), 1, words(int(rng.integers(1, 30)))) + " " + words(int(rng.integers(1, 20)))
            if chance(0.1):
                body = element(pick(("b", "strong", "em", "a")), 1, words(int(rng.integers(1, 60))))
            return element("p", 1, body)
        if kind < 0.72:
            return element(pick(("h2", "h3", "h4")), 1, words(int(rng.integers(1, 8))))
        if kind < 0.82:
            return element(pick(("ul", "ol")), 1, "".join(element("li", 1, words(int(rng.integers(1, 25)))) for _ in range(int(rng.integers(2, 6)))))
        if kind < 0.88:
            return element("blockquote", 1, element("p", 1, words(20)) if chance(0.5) else words(20))
        if kind < 0.92:
            return element("pre", 1, element("code", 1, words(12)))
        if kind < 0.96:
            return element("table", 1, "".join(element("tr", 1, element("td", 1, words(2)) + element("td", 1, words(3))) for _ in range(3)))
        return element("div", 1, words(int(rng.integers(5, 80))))

    def plain_page() -> str:
        """A page whose names tell nothing: bare divisions or a layout table, text in paragraphs or between line breaks."""
        name = lambda: pick(("", "", f"{pick('abcdxyz')}{int(rng.integers(1, 99))}", pick(("box", "inner", "col", "row", "wrap", "outer", "left", "right"))))
        anchors = lambda n: pick((" | ", " ", "")).join(element("a", 0, words(int(rng.integers(1, 4)))) for _ in range(n))

        def bar() -> str:
            kind = rng.random()
            body = anchors(int(rng.integers(1, 9))) if kind < 0.6 else syllables(int(rng.integers(1, 5))) if kind < 0.85 else element("ul", 0, links(int(rng.integers(2, 7))))
            return element(pick(("div", "div", "div", "p", "center")), 0, body, name())

        def foot() -> str:
            said = pick(("Copyright", "&copy; 2020", "(c)", "Copyright 2019", "All rights reserved"))
            return element(pick(("div", "div", "p", "td", "address")), 0, pick((said, f"{said} {syllables(int(rng.integers(1, 5)))}", f"{said} {anchors(2)}")), name())

        def text() -> str:
            kind, count = rng.random(), int(rng.integers(1, 9))
            some = lambda: words(int(rng.integers(2, 90)))
            if kind < 0.45:
                return pick(("<br><br>", "<br>", "<br/><br/>")).join(some() for _ in range(count))
            if kind < 0.75:
                return "".join(element("p", 1, some()) for _ in range(count))
            if kind < 0.9:
                return "".join(element("div", 1, some(), name()) for _ in range(count))
            return (element("h1", 1, words(4)) if chance(0.5) else "") + "".join(paragraph() for _ in range(count))

        if chance(0.7):
            main = element("div", 1, text(), name())
            if chance(0.5):
                main = element("div", 1, main, name())
            inner = "".join(bar() for _ in range(int(rng.integers(0, 3)))) + main + "".join(bar() for _ in range(int(rng.integers(0, 2)))) + (foot() if chance(0.7) else "")
            return element("div", 1, inner, name()) if chance(0.4) else inner
        side = lambda: element("td", 0, pick((anchors(int(rng.integers(2, 9))), element("ul", 0, links(4)))))
        rows = (element("tr", 0, element("td", 0, anchors(3))) if chance(0.5) else "") + element("tr", 1, (side() if chance(0.7) else "") + element("td", 1, text()) + (side() if chance(0.3) else "")) + (element("tr", 0, element("td", 0, "Copyright " + syllables(2))) if chance(0.5) else "")
        return element("table", 1, rows)

    pages = []
    for k in range(count):
        if k % 3 == 2:
            marked = element("html", 1, element("body", 1, plain_page()))
            pages.append((re.sub(r' data-y="\d"', "", marked), marked))
            continue
        body = (element("h1", 1, words(int(rng.integers(1, 9)))) if chance(0.8) else "") + "".join(paragraph() for _ in range(int(rng.integers(1, 14) if chance(0.9) else rng.integers(14, 120))))
        for kind in ("ad", "share", "side", "form", "notice"):
            if chance(0.12):
                body += noise(kind) + (paragraph() if chance(0.6) else "")
        if chance(0.2):
            body += noise("comments")
        tag = pick(("article", "article", "main", "div", "section"))
        main = element(tag, 1, body, pick(CONTENT.split()) if tag in ("div", "section") or chance(0.3) else "")
        if chance(0.25):
            main = element(pick(("main", "div", "section")), 1, main, pick(CONTENT.split()))
        before = "".join(noise(k) for k in ("header", "nav", "notice", "ad", "form") if chance(0.5))
        after = "".join(noise(k) for k in ("comments", "side", "share", "ad", "form", "notice", "footer") if chance(0.5))
        inner = before + main + after
        if chance(0.3):
            inner = element("div", 1, inner, pick(("wrapper", "container", "page", "site", "outer")))
        marked = element("html", 1, element("body", 1, inner))
        pages.append((re.sub(r' data-y="\d"', "", marked), marked))
    return pages


LABEL = re.compile(r'data-y="(\d)"')


def fit(pages: list[tuple[str, str]] | None = None) -> Model:
    """Potentials from labelled pages: a logistic model of each element's features given no
    neighbour, and edge potentials P(parent, child) / (P(parent) P(child)) with add-one counts."""
    pages = labelled_pages() if pages is None else pages
    rows, labels, pairs = [], [], np.ones((2, 2))
    for plain, marked in pages:
        page = parse(plain)
        y = [1, *map(int, LABEL.findall(marked))]
        if len(y) != len(page.nodes):
            raise ValueError("a labelled page must label each of its elements in order")
        own, given = evidence(page)
        inside: list[list[str]] = []
        for i, node in enumerate(page.nodes):
            inside.append(inside[node.parent] + given[node.parent] if node.parent >= 0 else [])
            rows.append(own[i] + inside[i])
        labels += y
        for node, own in zip(page.nodes[1:], y[1:]):
            pairs[y[node.parent], own] += 1
    names = sorted({f for r in rows for f in r})
    place = {f: k for k, f in enumerate(names)}
    merged: dict[tuple[int, ...], list[int]] = {}
    for r, y in zip(rows, labels):
        merged.setdefault(tuple(sorted(place[f] for f in r)), [0, 0])[y] += 1
    x, y, w = [], [], []
    for key, counts in merged.items():
        for label in (0, 1):
            if counts[label]:
                row = np.zeros(len(names))
                np.add.at(row, list(key), 1)
                x.append(row)
                y.append(label)
                w.append(counts[label])
    x, y, w = np.array(x), np.array(y, float), np.array(w, float)
    z = np.c_[x, np.ones(len(x))]
    beta, ridge = np.zeros(z.shape[1]), np.r_[np.ones(len(names)), 1e-3]
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-4:
            break
    joint = pairs / pairs.sum()
    edge = joint / np.outer(joint.sum(1), joint.sum(0))
    return Model(dict(zip(names, beta[:-1].tolist())), float(beta[-1]), tuple(map(tuple, edge.tolist())))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; the model is a few hundred numbers."""
    shared = pages.sparkSession.sparkContext.broadcast(fit() if model is None else model)

    def make():
        model = shared.value

        def work(part):
            texts = [main_text(x, model) for x in part.column("__html").to_pylist()]
            return [texts, [len(t) for t in texts]]

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("__html"))
    return extended(rows, "text string, n_chars long", make, ("__html",))
