"""Main text of HTML pages by a tree-structured graphical model.

A page is a tree of block elements with their runs of text as leaves. Each node has a hidden state:
boilerplate, content, or (inner nodes only) a mixture of both below it. Parent-child potentials
connect the states, node potentials come from the tag, the words of class and id, and statistics of
the text below. Sum-product messages, upward and then downward, give each leaf's exact marginal; leaves
that are likelier content than not are the main text.

Both kinds of potentials are log ratios of smoothed counts over labelled pages. labelled_pages()
makes such pages from page layouts with known content; train() takes any others in the same form.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

BOILER, CONTENT, MIXED = range(3)

#: Elements without an end, elements whose inside is not text to read, and elements inside a line (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video textarea title head select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title iframe noscript template svg math".split())
#: What an element's start closes if it is still open.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…。！？](?:\s|$)")


class Node:
    __slots__ = ("tag", "words", "children", "parent", "hidden", "chars", "linked", "stops", "controls", "text")

    def __init__(self, tag: str, parent: Node | None, words=(), hidden: bool = False):
        self.tag, self.parent, self.words, self.hidden = tag, parent, words, hidden
        self.children: list[Node] = []
        self.chars = self.linked = self.stops = self.controls = 0
        self.text = ""


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    words, hidden = [], False
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name not in ("style", "aria-hidden"):
            words += [w.lower() for w in _WORDS.findall(value)]
    return tuple(dict.fromkeys(words)), hidden


def parse(html: str) -> Node:
    """The tree of block elements and text leaves (tag '#'); markup that is cut off at the end is dropped."""
    root = Node("#root", None)
    at, links, run, linked = root, 0, [], 0
    pos, n = 0, len(html)
    path, depths = [root], defaultdict(list)  # open elements, and where those of a tag stand in path: no walks to the root

    def leave_text():
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Node("#", at)
                leaf.text, leaf.chars, leaf.linked = text, len(text), min(linked, len(text))
                leaf.stops = len(_SENTENCE.findall(text))
                at.children.append(leaf)
            run, linked = [], 0

    def add(raw: str):
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        run.append(text)
        if links:
            linked += len(text)

    def last(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def leave(depth: int) -> None:
        nonlocal at
        leave_text()
        while len(path) > depth:
            depths[path.pop().tag].pop()
        at = path[-1]

    def close(tags, until) -> None:
        if (depth := last(tags)) > last(until):
            leave(depth)

    search = _TOKEN.search
    while pos < n:
        m = search(html, pos)
        if m is None:
            add(html[pos:])
            break
        if m.start() > pos:
            add(html[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        if not m[4]:
            break  # a tag that the end of the page cuts off
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            if tag == "br" or tag == "p" and not depths["p"]:
                run.append(" ")
                continue
            if depths[tag]:
                leave(depths[tag][-1])
                links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in ("input", "button", "select"):
            at.controls += 1
        if tag in INLINE:
            if tag == "a":
                links += 1
            continue
        leave_text()
        if tag in VOID:
            continue
        if tag in _P_ENDERS:
            close(("p",), ("td", "th", "li", "button", "article", "section", "div", "aside", "nav", "header", "footer", "blockquote"))
        if tag in CLOSES:
            close(CLOSES[tag][0].split(), CLOSES[tag][1])
        if tag in ("html", "body"):
            continue
        words, hidden = _attributes(m[3]) if m[3] else ((), False)
        node = Node(tag, at, words, hidden or tag in HIDDEN)
        at.children.append(node)
        if not m[3].rstrip().endswith("/") or tag not in HIDDEN:
            depths[tag].append(len(path))
            path.append(node)
            at = node
    leave_text()
    return root


def order(root: Node) -> list[Node]:
    """Nodes before their children, in page order, without hidden ones; sums of the text below are set."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if not c.hidden]
    for x in reversed(out):
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.linked += x.linked
            p.stops += x.stops
            p.controls += x.controls
    return out


def features(x: Node) -> list[str]:
    if x.tag == "#":
        p = x.parent
        return [
            f"leaf in {p.tag}",
            f"leaf size {min(10, x.chars.bit_length())}",
            f"leaf link {0 if not x.linked else 1 + (2 * x.linked > x.chars)}",
            f"leaf stops {min(3, x.stops)}",
        ]
    out = [f"tag {x.tag}", f"link {min(3, 4 * x.linked // x.chars) if x.chars else 'none'}", f"size {min(12, x.chars.bit_length()) // 2}", f"stops {min(6, x.stops.bit_length())}"]
    if x.controls:
        out.append("controls")
    return out + [f"word {w}" for w in x.words]


class Model:
    """Log potentials: pair[parent][child], and for each feature one value per state."""

    def __init__(self, pair, node, seen):
        self.pair, self.node, self.seen = pair, node, seen

    def potentials(self, x: Node) -> tuple[float, float, float]:
        a = b = c = 0.0
        for f in features(x):
            v = self.node.get(f)
            if v is not None:
                a, b, c = a + v[0], b + v[1], c + v[2]
        return (a, b, c if x.tag != "#" else -60.0)

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """The probability of content for each leaf, by id(), by one upward and one downward pass."""
        index = {id(x): k for k, x in enumerate(nodes)}
        pair = [[math.exp(v) for v in row] for row in self.pair]
        up, msg = [], [(1.0, 1.0, 1.0)] * len(nodes)
        for x in nodes:
            v = self.potentials(x)
            m = max(v)
            up.append([math.exp(max(-60.0, y - m)) for y in v])
        for k in range(len(nodes) - 1, 0, -1):
            a, b, c = up[k]
            s = a + b + c
            a, b, c = up[k] = [a / s, b / s, c / s]
            out = [r[0] * a + r[1] * b + r[2] * c for r in pair]
            msg[k] = out
            p = up[index[id(nodes[k].parent)]]
            for j in range(3):
                p[j] *= out[j]
            s = p[0] + p[1] + p[2]
            if s < 1e-200:
                for j in range(3):
                    p[j] = max(p[j] / s if s else 1.0, 1e-100)
        down = [(0.0, 0.0, 0.0)] * len(nodes)
        down[0] = (1e-6, 1e-6, 1.0)
        got = {}
        for k, x in enumerate(nodes):
            if k:
                p = index[id(x.parent)]
                rest = [down[p][j] * up[p][j] / max(msg[k][j], 1e-300) for j in range(3)]
                s = sum(rest) or 1.0
                down[k] = tuple(sum(rest[i] / s * pair[i][j] for i in range(3)) for j in range(3))
            if x.tag == "#":
                v = [up[k][j] * down[k][j] for j in range(3)]
                got[id(x)] = v[CONTENT] / (sum(v) or 1.0)
        return got

    def text(self, html: str | None) -> str:
        """The main text: content leaves in page order, joined by one space. A null or empty page gives ''."""
        if not html:
            return ""
        nodes = order(parse(html))
        p = self.marginals(nodes)
        return " ".join(x.text for x in nodes if x.tag == "#" and p[id(x)] >= 0.5)


def states(nodes: list[Node], content) -> list[int]:
    """Each node's state, from a predicate on leaves."""
    below = {id(x): [0, 0] for x in nodes}
    for x in reversed(nodes):
        if x.tag == "#":
            below[id(x)][bool(content(x))] = 1
        if x.parent is not None:
            for j in range(2):
                below[id(x.parent)][j] |= below[id(x)][j]
    return [MIXED if all(below[id(x)]) else CONTENT if below[id(x)][1] else BOILER for x in nodes]


def train(pages) -> Model:
    """Potentials from (html, predicate on leaves that tells content) pairs."""
    pair = [[0.5] * 3 for _ in range(3)]
    node: dict[str, Counter] = {}
    total: Counter = Counter()
    for html, content in pages:
        nodes = order(parse(html))
        state = dict(zip(map(id, nodes), states(nodes, content)))
        for x in nodes[1:]:
            s = state[id(x)]
            pair[state[id(x.parent)]][s] += 1
            total[s] += 1
            for f in features(x):
                node.setdefault(f, Counter())[s] += 1
    pairs = [[math.log(v / sum(row)) for v in row] for row in pair]
    pairs[BOILER][CONTENT] = pairs[BOILER][MIXED] = pairs[CONTENT][BOILER] = pairs[CONTENT][MIXED] = math.log(1e-3)
    n = sum(total.values())
    prior = [total[s] / n for s in range(3)]
    pots = {}
    for f, k in node.items():
        rate = [(k[s] + 4 * prior[s] * 0.5) / (total[s] + 2) for s in range(3)]
        mean = (sum(k.values()) + 2) / (n + 2)
        pots[f] = tuple(math.log(max(r, 1e-4 * mean) / mean) for r in rate)
    return Model(pairs, pots, n)


#: Names that page authors give to parts of a page (fixed values).
_NAMES = {
    "nav": "nav navbar navigation menu main menu site nav breadcrumb breadcrumbs pagination pager topbar sitemap tabs dropdown skip links toc",
    "header": "header site header masthead banner branding logo top head page header",
    "footer": "footer site footer bottom colophon copyright legal foot credits",
    "aside": "sidebar aside side rail widget widgets related recommended popular trending more secondary complementary bio promo box",
    "notice": "notice cookie consent gdpr banner alert popup modal overlay privacy warning message toast disclaimer dialog paywall announcement",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner dfp outbrain taboola commercial",
    "form": "form search login signup subscribe newsletter contact register comment form subscription feedback",
    "comments": "comments comment list reply respond disqus discussion thread responses commentlist replies reader comments",
    "share": "share social sharing follow twitter facebook buttons tags meta byline",
    "main": "content main article post entry body story text page entry content post content article body main content markdown prose blog hentry copy",
    "wrap": "wrapper container page row col inner outer layout grid site app root wrap",
}


@lru_cache(maxsize=1)
def labelled_pages(n: int = 600, seed: int = 3) -> tuple:
    """Pages of many layouts with known content, each with a predicate on its leaves. Content words begin with 'c'."""
    rng = random.Random(seed)
    names = {k: v.split() for k, v in _NAMES.items()}

    def words(k: int, mark: str) -> str:
        return " ".join(mark + "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(1, 9))) for _ in range(k))

    def sentence(mark: str, lo=4, hi=30) -> str:
        return words(rng.randrange(lo, hi), mark) + rng.choice(".......,?! ")

    def text(mark: str, lo: int, hi: int) -> str:
        return " ".join(sentence(mark, 1, 30) for _ in range(rng.randrange(lo, hi)))

    def attr(kind: str, p: float = 0.6) -> str:
        if rng.random() > p:
            return ""
        some = "-".join(dict.fromkeys(rng.choice(names[kind]) for _ in range(rng.randrange(1, 3))))
        return f' {rng.choice(["class", "class", "id"])}="{some}"'

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{words(rng.randrange(1, 7), "b")}</a></{tag}>' for _ in range(k))

    def boiler(kind: str) -> str:
        k = rng.randrange(1, 9)
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "notice": "div", "ad": "div", "share": "div"}[kind]
        plain = rng.random() < (0.15 if kind in ("notice", "ad", "share", "comments") else 0.6)
        tag, a = (own, attr(kind, 0.5)) if plain and own not in ("div", "section") else (rng.choice(["div", "div", "section", "ul" if kind in ("nav", "share") else "div"]), attr(kind, 1))
        if kind == "nav":
            inside = f"<ul>{links(k)}</ul>" if tag != "ul" else links(k)
        elif kind == "header":
            inside = f"<a href='/'>{words(2, 'b')}</a>" + rng.choice(["", f"<h1>{words(3, 'b')}</h1>", f"<p>{sentence('b')}</p>", f"<ul>{links(k)}</ul>"])
        elif kind == "footer":
            inside = rng.choice([f"&copy; {text('b', 1, 4)}", f"<p>&copy; {sentence('b')}</p><ul>{links(k)}</ul>", f"<div>{links(k, 'span')}</div><p>{text('b', 1, 3)}</p>"])
        elif kind == "aside":
            inside = f"<h3>{words(3, 'b')}</h3>" + rng.choice([f"<ul>{links(k)}</ul>", f"<p>{text('b', 1, 5)}</p>", f"<div>{links(k, 'p')}</div>"])
        elif kind == "form":
            inside = f"<label>{words(2, 'b')}</label><input name='q'><button>{words(1, 'b')}</button>" + rng.choice(["", f"<p>{sentence('b')}</p>", f"<h3>{words(3, 'b')}</h3>"])
        elif kind == "comments":
            one = lambda: f"<{(t := rng.choice(['li', 'div', 'article']))}{attr('comments', 0.6)}><{(p := rng.choice(['p', 'div']))}>{text('b', 1, 5)}</{p}></{t}>"
            inside = rng.choice(["", f"<h3>{words(2, 'b')}</h3>"]) + "".join(one() for _ in range(k))
        elif kind == "share":
            inside = links(k, rng.choice(["li", "span"]))
        else:
            inside = rng.choice([text("b", 1, 4), f"<p>{text('b', 1, 4)}</p>", f"<p>{text('b', 1, 3)}</p><button>{words(1, 'b')}</button>", f"<a href='/y'>{sentence('b')}</a>"])
        return f"<{tag}{a}>{inside}</{tag}>"

    def block() -> str:
        r = rng.random()
        if r < 0.72:
            return f"<p>{text('c', 1, rng.choice([2, 6, 25]))}" + ("</p>" if rng.random() < 0.85 else "<br>")
        if r < 0.82:
            return f"<h{(h := rng.randrange(2, 5))}>{words(rng.randrange(1, 9), 'c')}</h{h}>"
        if r < 0.9:
            return "<ul>" + "".join(f"<li>{sentence('c', 1, 20)}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if r < 0.94:
            return f"<blockquote><p>{text('c', 1, 4)}</p></blockquote>"
        if r < 0.97:
            return "<table>" + "".join(f"<tr><td>{words(2, 'c')}</td><td>{words(2, 'c')}</td></tr>" for _ in range(3)) + "</table>"
        return f"<p>{words(4, 'c')} <a href='/z'>{words(2, 'c')}</a> {text('c', 1, 3)}</p>"

    def page() -> str:
        blocks = [f"<h1>{words(rng.randrange(1, 12), 'c')}</h1>"] * (rng.random() < 0.8) + [block() for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.3:
            blocks.insert(rng.randrange(1, len(blocks) + 1), boiler(rng.choice(["ad", "share", "aside", "form", "comments", "notice"])))
        if rng.random() < 0.15:  # a page of few words
            blocks = [f"<p>{words(rng.randrange(1, 5), 'c')}</p>" for _ in range(rng.randrange(1, 3))]
        if rng.random() < 0.15:  # a sidebar without a name, inside the article
            blocks.insert(rng.randrange(1, len(blocks) + 1), f"<aside><p>{text('b', 1, 4)}</p></aside>")
        if rng.random() < 0.15:
            blocks[0] = f"<header>{blocks[0]}</header>"
        body = "".join(blocks)
        kind = rng.random()
        if kind < 0.5:
            body = f"<article{attr('main', 0.4)}>{body}</article>"
        elif kind < 0.65:
            body = f"<main{attr('main', 0.4)}>{body}</main>"
        elif kind < 0.95:
            body = f"<{(t := rng.choice(['div', 'div', 'section', 'td']))}{attr('main', 0.95)}>{body}</{t}>"
        if rng.random() < 0.3:
            body = f"<main>{body}</main>" if kind < 0.5 else f"<div{attr('wrap', 1)}>{body}</div>"
        before = [boiler(rng.choice(["nav", "header", "ad", "notice", "form", "nav", "aside"])) for _ in range(rng.randrange(0, 4))]
        after = [boiler(rng.choice(["footer", "comments", "aside", "ad", "share", "notice", "footer", "form", "nav"])) for _ in range(rng.randrange(0, 4))]
        inside = "".join([*before, body, *after])
        if rng.random() < 0.3:
            inside = f"<div{attr('wrap', 0.9)}>{inside}</div>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{inside}</body></html>"

    content = lambda leaf: leaf.text.startswith("c")
    return tuple((page(), content) for _ in range(n))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extracted(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """pages with text (main text of the whole html) and n_chars (its code points); columns of these names are replaced.

    A null or empty page, or one without content, gives '' and 0.
    """
    tune(pages.sparkSession)
    pages = pages.withColumnRenamed(html, "__html").drop("text", "n_chars").withColumnRenamed("__html", html)
    keep = [c for c in pages.columns if c != html]
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for b in batches:
            own = [sent.value.text(h) for h in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(own, pa.string())], names=[*keep, "text"])

    out = pages.mapInArrow(run, pages.drop(html).withColumn("text", F.lit("")).schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
