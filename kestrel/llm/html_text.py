"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block-level element is a binary variable (content or not). Features of an element (its
kind, what its class and id names say as a whole and the single words in them, whether it lies
within an element that speaks against the article or for it, length of own text, share of
linked text) give its node potential; each parent-child edge has a potential by the kinds of
both. Sum-product messages go upward and downward once, which is exact on a tree, and an
element's text is kept where its content marginal is over one half. All potentials are counts
over labelled pages, made by `labelled_pages` from a fixed seed. A name never empties a page:
an element that speaks against the article is not believed if next to no other text were left.

Besides scripts, styles and other elements that show no text, only the controls of forms
(buttons and choices among them, wherever they stand) are left out without asking the model.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>|([^<]+|<)""", re.S
)
NAMED = re.compile("/?[a-zA-Z]")
#: What a noscript element has that only stands for an image.
IMAGES = re.compile(r"(?:\s|<(?!/noscript)[^>]*>)*</noscript", re.I)
HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile("[a-z]+")
#: Elements whose text is never text of the page.
RAW = {"script", "style", "title", "textarea", "template", "iframe"}
DROPPED = RAW | {"head", "svg", "canvas", "select", "button", "audio", "video", "datalist", "annotation", "annotation-xml"}
#: Elements that leave a head open, that end a list of choices, and blocks that end a drawing unless within one of INNER.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
NO_CHOICE, CELLS = {"select", "input", "textarea"}, {"caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"}
BREAKS = set("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul".split())
INNER = {"foreignobject", "desc"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
KINDS = {
    "article": "article", "main": "article", "body": "root", "html": "root", "div": "box", "section": "box", "center": "box", "td": "cell",
    "th": "cell", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table", "caption": "table", "p": "p", "pre": "p",
    "blockquote": "quote", "address": "address", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "hgroup": "h", "ul": "list", "ol": "list",
    "dl": "list", "menu": "menu", "li": "item", "dt": "item", "dd": "item", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "fieldset": "form", "legend": "form", "dialog": "aside", "figure": "figure", "figcaption": "figure", "details": "box",
    "summary": "h", "hr": "rule", "noscript": "noscript", "xmp": "p",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Words of class, id and role that speak for or against the article.
AWAY = set(
    """nav navigation navbar menu menubar breadcrumb breadcrumbs footer header masthead banner sidebar aside ad ads advert adverts advertisement
    advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup
    login search share sharing social related recommended trending widget toolbar pagination pager comment comments commentlist reply replies
    respond disqus feedback form contact copyright legal skip hidden tags meta byline complementary contentinfo""".split()
)
#: Words that make a class name a statement about the layout, as in "no-sidebar" and "ad-free".
LAYOUT = {"with", "has", "no", "without", "free", "less", "off"}
#: Words of elements that may hold more text than the article and still are not it.
NEVER = set("comment comments commentlist reply replies respond disqus cookie cookies consent gdpr popup modal overlay".split())
#: Kinds whose descendants lie outside the article.
OUTSIDE = {"nav", "menu", "header", "footer", "aside"}
TOWARD = set("article content post entry story main body text prose maincontent mainarticle richtext markdown page".split())


class Dom:
    """Block elements in page order: kind, parent, what their names say, own and linked characters; and the blocks of text."""

    def __init__(self) -> None:
        self.kind, self.parent, self.hint = ["root"], [-1], [0]
        self.words: list[frozenset[str]] = [frozenset()]
        self.own, self.linked, self.children = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []


def names_of(attrs: str) -> tuple[int, frozenset[str]]:
    """What the names of class, id and role say, and the telling words in them.

    -1: against the article, 1: for it, 2: both, 0: nothing. A name is for or against it by its
    words; of a name with both kinds the last word decides if it speaks against.
    """
    away = toward = both = False
    words: set[str] = set()
    if "=" in attrs:
        for m in HINT.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                found = WORDS.findall(name)
                told = [w for w in found if w in AWAY or w in TOWARD]
                if not told:
                    continue
                if not LAYOUT.isdisjoint(found):
                    told = [w for w in told if w in TOWARD]
                words.update(told)
                against, favour = not AWAY.isdisjoint(told), not TOWARD.isdisjoint(told)
                if against and favour and found[-1] not in AWAY:
                    both = True
                elif against:
                    away = True
                elif favour:
                    toward = True
    return (2 if both or away and toward else -1 if away else int(toward)), frozenset(words)


def parse(text: str) -> Dom:
    """The block elements of a page; tolerant of unclosed, crossed and unknown tags."""
    dom, stack, links, dropped = Dom(), [("#", 0)], 0, 0
    opened: Counter = Counter()  # open elements by tag
    run: list[str] = []
    linked = 0

    def cut(k: int) -> None:
        nonlocal dropped
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag] -= 1
            dropped -= tag in DROPPED

    def push(tag: str, node: int) -> None:
        stack.append((tag, node))
        opened[tag] += 1

    def leave(tag: str) -> None:
        """Cuts the stack back to below the outermost open element of a tag."""
        if opened[tag]:
            cut(next(k for k, (name, _) in enumerate(stack) if name == tag))

    def flush() -> None:
        nonlocal linked
        if run:
            block = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if block:
                node = stack[-1][1]
                dom.own[node] += len(block)
                dom.linked[node] += min(linked, len(block))
                dom.blocks.append((node, block))
        linked = 0

    at, end = 0, len(text)
    while at < end:
        m = TOKEN.match(text, at)
        at = m.end()
        if m[4]:
            if m[4] == "<" and NAMED.match(text, at):
                break  # a tag that the page ends in: with a ">" left it were one
            if dropped and stack[-1][0] == "head" and m[4].strip(" \t\n\f\r"):
                leave("head")
            if not dropped:
                run.append(m[4])
                linked += len(m[4]) if links else 0
            continue
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif opened[tag]:
                if tag in KINDS:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
            elif tag == "p":
                flush()
            continue
        if dropped:  # end tags that may be left out
            if tag not in IN_HEAD:
                leave("head")
            if tag == "button":
                leave("button")
            if opened["select"] and (tag in NO_CHOICE or opened["table"] and tag in CELLS):
                leave("select")
                if tag == "select":
                    continue
            if opened["svg"]:
                if tag in INNER and not m[3].endswith("/"):
                    push(tag, stack[-1][1])
                elif tag in BREAKS and not any(opened[x] for x in INNER):
                    leave("svg")
        if tag in RAW and not m[3].endswith("/"):
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(text, at)
            at = end if stop is None else (text.find(">", stop.end()) + 1 or end)
            continue
        if tag == "br":
            if not dropped:
                run.append("\n")
            continue
        if tag == "a":
            links += 1
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in DROPPED:
            if not m[3].endswith("/"):
                push(tag, stack[-1][1])
                dropped += 1
            continue
        if tag not in KINDS or tag == "noscript" and (dropped or IMAGES.match(text, at)):
            continue
        flush()
        if tag == "hr":
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    cut(k)
                    break
                if stack[k][0] in WITHIN[tag]:
                    break
        elif opened["p"]:
            for k in range(len(stack) - 1, max(0, len(stack) - 5), -1):
                if stack[k][0] == "p":
                    cut(k)
                    break
        links = 0 if KINDS[tag] in ("p", "box", "article") else links
        dom.kind.append(KINDS[tag])
        dom.parent.append(stack[-1][1])
        hint, words = names_of(m[3]) if KINDS[tag] != "root" else (0, frozenset())
        dom.hint.append(hint)
        dom.words.append(words)
        dom.own.append(0)
        dom.linked.append(0)
        dom.children.append(0)
        dom.children[stack[-1][1]] += 1
        push(tag, len(dom.kind) - 1)
    flush()
    return dom


def _length(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 250 else 4


def zones(dom: Dom, plain: list[int]) -> tuple[list[int], list[int]]:
    """For each element whether it lies within one that speaks against the article, and within one that speaks for it.

    `plain` has the unlinked characters of each element and all in it. An element with nearly all
    the text that is left is believed to be the article whatever its name or kind says.
    """
    n = len(dom.kind)
    against = [dom.hint[k] < 0 or dom.kind[k] in OUTSIDE for k in range(n)]
    has_article = [dom.kind[k] == "article" and not against[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        has_article[dom.parent[k]] |= has_article[k]
    while True:
        outer = [False] * n
        rest = plain[0]
        largest = 0
        for k in range(1, n):
            up = dom.parent[k]
            outer[k] = outer[up] or against[up]
            if against[k] and not outer[k]:
                rest -= plain[k]
                may = dom.kind[k] not in ("nav", "menu", "footer") and NEVER.isdisjoint(dom.words[k]) and (plain[k] >= 200 or has_article[k])
                if may and (not largest or plain[k] > plain[largest]):
                    largest = k
        if not largest or rest >= 0.05 * plain[largest]:
            break
        against[largest] = False
    inside = [False] * n
    for k in range(1, n):
        up = dom.parent[k]
        inside[k] = not outer[k] and (inside[up] or dom.kind[up] == "article" or dom.hint[up] > 0)
    dom.believed = against
    return [int(x) for x in outer], [int(x) for x in inside]


def features(dom: Dom) -> list[tuple]:
    """For each element: its kind, names, zones, length of own text and share of linked text, the last two in classes; then the telling words."""
    total, linked = list(dom.own), list(dom.linked)
    for k in range(len(total) - 1, 0, -1):
        total[dom.parent[k]] += total[k]
        linked[dom.parent[k]] += linked[k]
    share = [0 if not t else 1 + (x > 0.2 * t) + (x > 0.6 * t) for x, t in zip(linked, total)]
    outside, inside = zones(dom, [t - x for t, x in zip(total, linked)])
    out = []
    for k in range(len(total)):
        freed = (dom.hint[k] < 0 or dom.kind[k] in OUTSIDE) and not dom.believed[k]
        kind, hint = ("box" if freed and dom.kind[k] in OUTSIDE else dom.kind[k]), (0 if freed else dom.hint[k])
        words = () if freed else tuple(sorted(("word", w) for w in dom.words[k]))
        if kind == "box" and not (hint or words or dom.own[k]):
            out.append(())  # says nothing of its own, however many there are around a text
            continue
        out.append((("kind", kind), ("hint", hint), ("zone", outside[k], inside[k]), ("own", _length(dom.own[k])), ("link", share[k], inside[k]), *words))
    return out


#: An element that is all there is in a plain one is as that is, but for this share.
WRAPPED = 1e-9


def edge_key(dom: Dom, k: int) -> tuple[str, str]:
    p = dom.parent[k]
    up = dom.kind[p]
    if up == "box" and dom.children[p] == 1 and not (dom.own[p] or dom.hint[p] or dom.words[p]):
        return "any", "wrap"
    return dom.kind[k], up if up in ("root", "article", "box") else "other"


class Model:
    """Counts with add-one smoothing, as log potentials."""

    def __init__(self, pages: list[tuple[str, list[int]]]):
        node, states, edge, self.root = Counter(), Counter(), Counter(), [0.0, math.log(0.999)]
        self.root[0] = math.log(0.001)
        for text, labels in pages:
            dom = parse(text)
            if len(dom.kind) != len(labels):
                raise ValueError("the labels do not fit the elements")
            for k, found in enumerate(features(dom)):
                states[labels[k]] += bool(found)
                for f in found:
                    node[f, labels[k]] += 1
                if k:
                    edge[edge_key(dom, k), labels[dom.parent[k]], labels[k]] += 1
        rate = (states[0] + 1.0) / (states[0] + states[1] + 2.0), (states[1] + 1.0) / (states[0] + states[1] + 2.0)

        def weight(f: tuple, s: int) -> float:
            if f[0] == "word":  # by how much the word tells more than chance; nothing if it was never seen
                return math.log((node[f, s] + 10 * rate[s]) / (node[f, 0] + node[f, 1] + 10) / rate[s])
            return math.log((node[f, s] + 0.5) / (states[s] + 2.5))

        self.node = weight
        self.edge = lambda key, a, b: math.log(((edge[key, a, b] + 0.5) / (edge[key, a, 0] + edge[key, a, 1] + 1.0)) if key[1] != "wrap" else 1 - WRAPPED if a == b else WRAPPED)
        self.node_cache: dict = {}
        self.edge_cache: dict = {}

    def marginals(self, dom: Dom) -> list[float]:
        """Probability of content for each element: messages upward in reverse page order, then downward."""
        n, phi, psi = len(dom.kind), [], [None]
        for k, found in enumerate(features(dom)):
            if found not in self.node_cache:
                self.node_cache[found] = tuple(sum(self.node(f, s) for f in found) for s in (0, 1))
            phi.append(self.node_cache[found])
            if k:
                key = edge_key(dom, k)
                if key not in self.edge_cache:
                    self.edge_cache[key] = tuple(tuple(self.edge(key, a, b) for b in (0, 1)) for a in (0, 1))
                psi.append(self.edge_cache[key])
        up = [list(x) for x in phi]  # node potential and messages of the children
        sent = [(0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):
            sent[k] = tuple(_add(psi[k][a][0] + up[k][0], psi[k][a][1] + up[k][1]) for a in (0, 1))
            up[dom.parent[k]][0] += sent[k][0]
            up[dom.parent[k]][1] += sent[k][1]
        belief = [[0.0, 0.0]] * n
        out = [0.0] * n
        for k in range(n):
            if k:
                p = dom.parent[k]
                rest = (belief[p][0] - sent[k][0], belief[p][1] - sent[k][1])
                down = [_add(rest[0] + psi[k][0][b], rest[1] + psi[k][1][b]) for b in (0, 1)]
            else:
                down = self.root
            belief[k] = [up[k][0] + down[0], up[k][1] + down[1]]
            norm = _add(*belief[k])
            belief[k] = [belief[k][0] - norm, belief[k][1] - norm]
            out[k] = math.exp(belief[k][1])
        return out

    def text(self, page: str | None) -> str:
        """The blocks of content of a page, joined by an empty line; empty for a null or empty page."""
        dom = parse(page or "")
        keep, least = self.marginals(dom), 0.5
        if dom.blocks and not any(keep[node] > least for node, _ in dom.blocks):  # a page of little text: its likeliest elements that nothing speaks against
            outer = zones(dom, [0] * len(dom.kind))[0]
            keep = [0.0 if outer[k] or dom.believed[k] else keep[k] for k in range(len(keep))]
            least = max(0.05, 0.5 * max(keep[node] for node, _ in dom.blocks))
        return "\n\n".join(block for node, block in dom.blocks if keep[node] >= least)


def _add(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with a label for each block element, in the order of their start tags (the root first)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    pages = []
    for _ in range(n):
        out, labels = ["<!DOCTYPE html><html><head><title>x</title></head>"], [1, 1]  # root, html
        maybe = lambda p: rng.random() < p

        def el(tag: str, label: int, inner="", attrs: str = "", out=out, labels=labels) -> None:
            out.append(f"<{tag}{' ' + attrs if attrs else ''}>")
            labels.append(label)
            inner() if callable(inner) else out.append(inner)
            out.append(f"</{tag}>")

        def links(label=0):
            el("ul", label, lambda: [el("li", label, f'<a href="/x">{words(1, 3)}</a>') for _ in range(rng.randint(2, 7))])

        def away(kinds: int = 10):
            pick = rng.randrange(kinds)
            tag = rng.choice(["div", "section", "aside"])
            cls = lambda *w: f'class="{rng.choice(w)}"'
            if pick == 0:
                el(tag, 0, words(3, 14) if maybe(0.5) else lambda: el("p", 0, words(4, 20)), cls("ad", "advert", "ads banner", "sponsored", "promo"))
            elif pick == 1:
                side = lambda: (el("h3", 0, words(1, 3)), links() if maybe(0.6) else el("p", 0, words(5, 60)))
                el("div", 0, side, cls("sidebar", "col sidebar", "related", "widget-area", "sidebar-content")) if maybe(0.4) else el("aside", 0, side, cls("sidebar", "related", "widget") if maybe(0.6) else "")
            elif pick == 2:
                one = lambda: el(rng.choice(["div", "div", "article", "li"]), 0, lambda: el("p", 0, words(3, 60)), cls("comment", "reply", "comment-body")) if maybe(0.6) else el("p", 0, words(3, 60))
                el(tag, 0, lambda: (el("h3", 0, words(1, 3)) if maybe(0.4) else None, [one() for _ in range(rng.randint(1, 8))]), cls("comments", "comment-list", "replies"))
            elif pick == 3:
                el("form", 0, lambda: (el("p", 0, words(2, 12)), out.append('<input type="text"> ' + words(1, 3))))
            elif pick == 4:
                el("div", 0, words(5, 30) if maybe(0.5) else lambda: el("p", 0, words(5, 30)), cls("cookie-notice", "notice", "consent", "alert"))
            elif pick == 5:
                el("nav", 0, links)
            elif pick == 6:
                el("div", 0, links, cls("share", "social", "tags", "breadcrumbs", "pagination", "menu"))
            elif pick == 7:
                el("div", 0, lambda: el("p", 0, words(2, 10)), cls("newsletter", "subscribe", "login"))
            elif pick == 8:
                links()
            else:
                el("div", 0, f'<a href="/a">{words(2, 8)}</a> <a href="/b">{words(1, 4)}</a>')

        def body_text(top: bool = True):
            if top and maybe(0.8):
                el("h1", 1, words(2, 10))
            for _ in range(rng.randint(1, 10)):
                pick = rng.random()
                if pick < 0.54:
                    el("p", 1, words(1, 8) if maybe(0.25) else words(9, 120))
                elif pick < 0.6:
                    el("p", 1, f'{words(2, 40)} <a href="/x">{words(1, 5)}</a> {words(2, 40)} <a href="/y">{words(1, 9)}</a>')
                elif pick < 0.63:
                    el("p", 1, f'<a href="/x">{words(1, 12)}</a>')
                elif pick < 0.65:
                    links(1)
                elif pick < 0.66:
                    el("noscript", 1, lambda: el("p", 1, words(5, 40)))
                elif pick < 0.74:
                    el(rng.choice(["h2", "h3"]), 1, words(1, 8))
                elif pick < 0.8:
                    el(rng.choice(["ul", "ol"]), 1, lambda: [el("li", 1, words(1, 25)) for _ in range(rng.randint(1, 6))])
                elif pick < 0.84:
                    el("blockquote", 1, lambda: el("p", 1, words(5, 40)))
                elif pick < 0.87:
                    el("pre", 1, words(3, 40))
                elif pick < 0.9:
                    el("table", 1, lambda: [el("tr", 1, lambda: [el("td", 1, words(1, 6)) for _ in range(3)]) for _ in range(rng.randint(1, 4))])
                elif pick < 0.93:
                    el("div", 1, words(10, 60))
                elif pick < 0.95:
                    el("figure", 1, lambda: el("figcaption", 1, words(3, 15)))
                elif pick < 0.97:
                    el("section", 1, lambda: (el("h2", 1, words(1, 6)), el("p", 1, words(5, 60))))
                else:
                    away(8)

        def link_list():
            el("h1", 1, words(1, 8))
            el(rng.choice(["ul", "ol"]), 1, lambda: [el("li", 1, f'<a href="/x">{words(1, 9)}</a>') for _ in range(rng.randint(2, 30))])

        def body():
            if maybe(0.15):
                el("noscript", 0, words(3, 14))
            if maybe(0.7):
                top, extra = rng.choice([("header", "")] * 3 + [("div", 'id="header"'), ("div", 'class="site-header"')])
                el(top, 0, lambda: (el(rng.choice(["h1", "p"]), 0, words(1, 5)) if maybe(0.5) else el("h2", 0, words(1, 4)), el("nav", 0, links) if maybe(0.5) else out.append(words(1, 6))), extra)
            if maybe(0.7):
                el("nav", 0, links)
            for _ in range(rng.randint(0, 2)):
                away()
            shell, text = rng.random(), link_list if maybe(0.08) else body_text
            odd = rng.choice(['class="page-body ad-free"', 'id="contact-page"', 'class="post share"', 'id="share-post"', 'class="main-content with-sidebar"', 'class="post tags"', 'class="entry comment"'])
            if shell < 0.45:
                el("article", 1, text, 'class="post"' if maybe(0.3) else odd if maybe(0.1) else "")
            elif shell < 0.6:
                el("main", 1, lambda: el("article", 1, text) if maybe(0.5) else text(), odd if maybe(0.1) else "")
            elif shell < 0.65:
                el("div", 1, lambda: el("article", 1, text) if maybe(0.5) else text(), odd)
            elif shell < 0.85:
                el("div", 1, text, rng.choice(['class="content"', 'id="main"', 'class="entry-content"', 'class="story"', 'class="article-body"']))
            elif shell < 0.9:
                el("div", 1, lambda: el("div", 1, body_text))
            elif shell < 0.93:
                el("table", 1, lambda: el("tr", 1, lambda: (el("td", 0, f'<a href="/a">{words(1, 3)}</a><br><a href="/b">{words(1, 3)}</a>'), el("td", 1, body_text))))
            else:
                body_text()
            for _ in range(rng.randint(0, 3)):
                away()
            if maybe(0.85):
                el("footer", 0, (lambda: (el("p", 0, "&copy; " + words(2, 12)), links() if maybe(0.3) else None)) if maybe(0.5) else "&copy; " + words(2, 20))

        el("body", 1, body)
        pages.append(("".join(out) + "</html>", labels))
    return pages


@functools.cache
def trained() -> Model:
    return Model(labelled_pages())


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, text and n_chars (its code points) for each row of pages."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in common.slices(batches):
            found = [model.text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(F.col("html").alias("__html"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty pages give an empty text, long ones are read in full; repeated rows a row each."""
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
