"""Main text of web pages by a tree-structured graphical model.

A page is a tree of block elements and runs of text. Each node is content or not; a logistic potential rates what can be
seen at the node (its tag, words in its class, id and role, its text and links), and a two-by-two potential connects
it with its parent. Messages pass up from the leaves and down from the root (sum-product), which gives every
run's exact marginal; the runs likelier content than not are the main text. Both potentials are
trained on labelled pages, which :mod:`tonearm.llm.page_samples` makes; the weights that :func:`trained_model` learns lie beside this module, so that nothing
is trained when a job starts, and :func:`retrain` makes them anew.

Headers are left out wherever they stand: a title in an article's own ``header`` is part of that header, one outside it is part of the article.

Scripts, styles, templates, the head, controls and other elements that never show prose are left out when the tree is built, as are comments.
A form is a block like any other, and the model judges it: some pages stand in a form as a whole. Controls don't cut the block they stand in.
Reading takes time in proportion to the page: tags are found in one pass forward, and open tags are kept by name.

Defined results: null, empty and text-less pages give an empty text; a tag or comment that never ends takes the rest of the page; stray and
misnested tags are read as browsers recover from them, roughly; long pages are read whole; repeated rows give the
same text; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape
from importlib import resources
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import read

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
CONTROLS = frozenset("select button input textarea".split())
SKIPPED = frozenset("head script style noscript template select option button input textarea svg math canvas iframe object audio video dialog".split())
BLOCK = frozenset("html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
#: What an opening tag closes when it is open nearer than the tags after it.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Groups of words in class, id, role and label attributes that speak for or against content.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination toc tabs toolbar skip sitemap",
    "head": "header masthead topbar banner logo brand head",
    "foot": "footer foot copyright colophon contentinfo legal imprint bottom credits",
    "side": "sidebar aside side rail widget widgets complementary secondary related recommended recommendations popular trending more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate banner dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay privacy paywall disclaimer warning toast",
    "form": "form search newsletter subscribe subscription signup login register contact",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback reviews review thread reader readers responses",
    "share": "share sharing social follow like likes twitter facebook tags tag meta author byline date rating",
    "main": "article content main post entry story body text page article-body prose maincontent",
    "hide": "hidden hide invisible none sr visually",
}
#: Elements that say which part of a page they hold, and those that head what follows.
ZONES, HEADINGS = frozenset("article main nav header footer aside form".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}


class Node:
    __slots__ = ("tag", "parent", "hints", "text", "linked", "kids", "controls", "size", "zone", "before", "lead", "replies")

    def __init__(self, tag, parent, hints=frozenset()):
        self.tag, self.parent, self.hints = tag, parent, hints
        self.text, self.linked, self.kids, self.controls, self.size = None, 0, 0, 0, 0
        self.zone, self.before, self.lead, self.replies = "none", "none", "none", False


def hints_of(attrs: str) -> frozenset:
    found = set()
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "data-role", "itemprop"):
            words = _WORD.findall(_CAMEL.sub(" ", value).lower())
            found.update(_HINT_OF[w] for w in words if w in _HINT_OF)
        elif name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.add("hide")
    return frozenset(found)


def tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at ``at`` ends, or -1; ``last`` has the last place of each quotation mark.

    A mark counts only as the start of a value, and only if it has a partner.
    """
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while before > 0 and html[before].isspace():
            before -= 1
        if html[before] == "=" and m.start() < last[m[0]]:
            at = html.find(m[0], m.end()) + 1
        else:
            at = m.end()
    return -1


def tree(html: str) -> list[Node]:
    """The page's blocks and text runs, parents before children; runs hold text in page order."""
    root = Node("#root", -1)
    nodes = [root]
    stack = [("#root", 0)]  # open tags and the node each stands for; inline ones stand for their block's
    where: dict[str, list[int]] = {}  # where in the stack each tag is open
    blocks = [0]
    pieces, linked, links, skip = [], 0, 0, 0

    def flush():
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            run = Node("#text", stack[-1][1])
            run.text, run.linked = text, min(linked, len(text))
            nodes[run.parent].kids += 1
            nodes.append(run)
        pieces, linked = [], 0

    def enter(tag, owner):
        nonlocal links, skip
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, owner))
        links += tag == "a"
        skip += tag in SKIPPED

    def close(to):
        nonlocal links, skip
        while len(stack) > to:
            tag, _ = stack.pop()
            where[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            links -= tag == "a"
            skip -= tag in SKIPPED

    def open_at(*tags):
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def say(raw):
        nonlocal linked
        if not skip and raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text)

    def opened(tag, attrs):
        if tag in BLOCK:
            flush()
            if (p := open_at("p")) and open_at("td", "th", "table") < p:
                close(p)
        if tag in CLOSES:
            closed, walls = CLOSES[tag]
            own = open_at(*closed.split())
            if own > open_at(*walls):
                flush()
                close(own)
        if tag == "body" and skip and open_at("head"):
            close(where["head"][0])
        if tag in VOID:
            if tag != "wbr":
                say(" ")
            return
        owner = stack[-1][1]
        if tag in CONTROLS:
            form = open_at("form")
            if form and 'type="hidden"' not in attrs and "type=hidden" not in attrs:
                nodes[stack[form][1]].controls += 1
            if tag == "input":
                say(" ")
                return
        if attrs.endswith("/") and tag not in BLOCK:
            return
        if tag in BLOCK:
            nodes[owner].kids += 1
            nodes.append(Node(tag, owner, hints_of(attrs) if attrs else frozenset()))
            owner = len(nodes) - 1
        elif attrs and tag not in SKIPPED and tag != "a":
            own = hints_of(attrs)
            if "hide" in own or own and tag in ("span", "ins", "font", "custom"):
                flush()
                nodes.append(Node(tag, owner, own))
                owner = len(nodes) - 1
        enter(tag, owner)

    def ended(tag):
        own = open_at(tag)
        if tag == "br":
            say(" ")
        elif tag == "p" and not own:
            flush()
        elif own and (tag in BLOCK or tag in SKIPPED):
            if tag in BLOCK or tag in ("head", "dialog"):
                flush()
            close(own)
        elif own > blocks[-1]:
            close(own)

    at, last = 0, {q: html.rfind(q) for q in "\"'"}
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            break
        m = _OPEN.match(html, start)
        if m:
            say(html[at:start])
            end = tag_end(html, m.end(), last)
            at = end + 1 if end >= 0 else len(html)
            if end < 0:
                break
            tag = m[2].lower()
            if m[1]:
                ended(tag)
            elif tag in RAW:
                if tag in CONTROLS:
                    opened("input", "")
                found = _RAW_END[tag].search(html, at)
                at = found.end() if found else len(html)
            else:
                opened(tag, html[m.end() : end])
        elif html.startswith(("<!", "<?", "</"), start):
            say(html[at:start])
            mark = "-->" if html.startswith("<!--", start) else ">"
            end = html.find(mark, start + 2)
            at = end + len(mark) if end >= 0 else len(html)
        else:
            say(html[at : start + 1])
            at = start + 1
    say(html[at:])
    flush()
    measured(nodes)
    return nodes


def measured(nodes: list[Node]) -> None:
    """Sets how much text stands in each form, the part of the page that each node stands in, what kind of node stands before it and before the list it is in, and whether it stands among readers' comments or heads them."""
    last: dict[int, tuple[str, Node]] = {}
    for x in nodes[1:]:
        x.zone = x.tag if x.tag in ZONES else nodes[x.parent].zone
        x.before, own = last.get(x.parent, ("none", x))
        x.lead = x.before if x.tag in ("ul", "ol") else nodes[x.parent].lead
        x.replies = "comment" in x.hints and x.tag not in ("html", "body")
        if x.replies and x.before == "head":
            own.replies = True
        last[x.parent] = "head" if x.tag in HEADINGS else "list" if x.tag in ("ul", "ol", "dl") else "text" if x.tag in ("p", "#text") else "block", x
    for x in nodes[1:]:
        x.replies = x.replies or nodes[x.parent].replies
    if any(x.tag == "form" for x in nodes):
        for x in reversed(nodes):
            size = len(x.text) if x.text is not None else x.size
            x.size = size
            if x.parent >= 0:
                nodes[x.parent].size += size


def features_of(node: Node, nodes: list[Node]) -> list[str]:
    """What the unary potential sees of a node."""
    out = [f"tag={node.tag}"] + [f"hint={h}" for h in node.hints]
    out.append(f"zone={node.zone}")
    if node.replies:
        out.append("among replies")
    if node.text is not None:
        n = len(node.text)
        share = node.linked / n
        if share > 0.8:
            out += [f"link zone={node.zone}", f"link in list after={node.lead} zone={node.zone}"]
        out += [f"len={min(8, int(log(n + 1, 2)))}", f"links={'all' if share > 0.8 else 'some' if share > 0.3 else 'few'}", f"in={nodes[node.parent].tag}"]
        if node.text[0] in "©" or "©" in node.text[:40]:
            out.append("copyright")
        if node.text[-1] in ".!?…\"'”":
            out.append("ends")
        if share > 0.8 and n < 60:
            out.append("label")
    elif node.tag == "form":
        out.append(f"form={'text' if node.size >= 200 * node.controls else 'some' if node.size >= 60 * node.controls else 'controls'}")
    elif node.tag in ("ul", "ol", "div", "section"):
        out.append(f"kids={min(4, node.kids)}")
        if node.tag in ("ul", "ol"):
            out.append(f"list after={node.before} zone={node.zone}")
    return out


def _add(a: float, b: float) -> float:
    return (a if a > b else b) + log(1 + exp(-abs(a - b)))


def _share(d: float) -> float:
    return 1 / (1 + exp(-max(-60.0, min(60.0, d))))


def pass_messages(parents: list[int], own: list[float], pairs: list, kinds: list[int]):
    """Sum-product on a tree whose parents come before children.

    ``own`` are log odds of content, ``pairs[kind][parent][child]`` log potentials. Returns each node's
    probability of content and each node's joint distribution with its parent (00, 01, 10, 11).
    """
    n = len(own)
    up0, up1 = [0.0] * n, list(own)
    sent = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        (p00, p01), (p10, p11) = pairs[kinds[i]]
        a, b = up0[i], up1[i]
        m0, m1 = _add(p00 + a, p01 + b), _add(p10 + a, p11 + b)
        top = m0 if m0 > m1 else m1
        sent[i] = (m0 - top, m1 - top)
        up0[parents[i]] += m0 - top
        up1[parents[i]] += m1 - top
    down0, down1 = [0.0] * n, [0.0] * n
    share, joint = [0.0] * n, [(1.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        if i:
            (p00, p01), (p10, p11) = pairs[kinds[i]]
            p = parents[i]
            a = down0[p] + up0[p] - sent[i][0]
            b = down1[p] + up1[p] - sent[i][1]
            m0, m1 = _add(a + p00, b + p10), _add(a + p01, b + p11)
            top = m0 if m0 > m1 else m1
            down0[i], down1[i] = m0 - top, m1 - top
            joint[i] = (a + p00 + up0[i], a + p01 + up1[i], b + p10 + up0[i], b + p11 + up1[i])
        share[i] = _share(down1[i] + up1[i] - down0[i] - up0[i])
    return share, joint


class PageModel:
    """Weights by feature (log odds of content) and log potentials ``pairs[kind][parent][child]`` of blocks and runs."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, [[[float(v) for v in row] for row in table] for table in pairs]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is content."""
        w = self.weights
        own = [0.0] + [sum([w.get(f, 0.0) for f in features_of(x, nodes)]) for x in nodes[1:]]
        return pass_messages([x.parent for x in nodes], own, self.pairs, [int(x.text is not None) for x in nodes])[0]

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = tree(html)
        return " ".join(x.text for x, p in zip(nodes, self.marginals(nodes)) if x.text is not None and p >= 0.5)


def train(pages: list[tuple[list[Node], list[int]]], steps: int = 60, rate: float = 0.25, l2: float = 0.5, least: int = 3) -> PageModel:
    """Potentials that make the labels of all nodes likely, given the pages: the gradient is what features
    and label pairs the labelled pages show, less what the model expects by its marginals (Adam steps)."""
    seen: dict[str, int] = {}
    shown = [[features_of(x, nodes) for x in nodes[1:]] for nodes, _ in pages]
    for page in shown:
        for fs in page:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    place = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    y = np.concatenate([np.array(labels, dtype=float) for _, labels in pages])
    begin = np.cumsum([0] + [len(nodes) for nodes, _ in pages])
    rows, cols = [], []
    for at, page in zip(begin, shown):
        for i, fs in enumerate(page, 1):
            for f in fs:
                if f in place:
                    rows.append(at + i)
                    cols.append(place[f])
    rows, cols = np.array(rows), np.array(cols)
    parents = [[x.parent for x in nodes] for nodes, _ in pages]
    kinds = [[int(x.text is not None) for x in nodes] for nodes, _ in pages]
    flat_kinds = np.concatenate(kinds)
    inner = np.ones(len(y), dtype=bool)
    inner[begin[:-1]] = False
    above = np.concatenate([np.array(p) + at for p, at in zip(parents, begin)])
    state = np.where(inner, 2 * y[np.where(inner, above, 0)] + y, 0).astype(int)
    want = np.zeros((2, 4))
    np.add.at(want, (flat_kinds[inner], state[inner]), 1)
    theta = np.zeros(len(place) + 8)
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        own = np.bincount(rows, weights=theta[cols], minlength=len(y))
        pairs = theta[len(place) :].reshape(2, 2, 2).tolist()
        share, expect = np.zeros(len(y)), np.zeros((2, 4))
        for at, ps, ks in zip(begin, parents, kinds):
            p, joint = pass_messages(ps, own[at : at + len(ps)].tolist(), pairs, ks)
            share[at : at + len(ps)] = p
            j = np.array(joint[1:])
            if len(j):
                j = np.exp(j - j.max(1, keepdims=True))
                np.add.at(expect, np.array(ks[1:]), j / j.sum(1, keepdims=True))
        grad = np.concatenate([np.bincount(cols, weights=(y - share)[rows], minlength=len(place)), (want - expect).ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad * grad
        theta += rate / (1 + t / 30) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return PageModel({f: float(theta[i]) for f, i in place.items()}, theta[len(place) :].reshape(2, 2, 2))


WEIGHTS = "page_weights.json"


def retrain(pages: int = 400, seed: int = 11) -> PageModel:
    """A model trained on labelled pages made from ``seed``; the same arguments give the same weights."""
    from tonearm.llm.page_samples import labelled_pages

    return train(labelled_pages(pages, seed))


def saved(model: PageModel) -> str:
    return json.dumps({"weights": {k: round(v, 5) for k, v in sorted(model.weights.items())}, "pairs": [[[round(v, 5) for v in row] for row in table] for table in model.pairs]}, indent=0, ensure_ascii=True)


@lru_cache(maxsize=1)
def trained_model() -> PageModel:
    """The model whose weights are part of this package, as :func:`retrain` makes them."""
    found = json.loads(resources.files("tonearm.llm").joinpath(WEIGHTS).read_text(encoding="ascii"))
    return PageModel(found["weights"], np.array(found["pairs"]))


def extract_pages(pages: DataFrame, model: PageModel | None = None, html_col: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns to keep, and ``text``: the page's main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_model())

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns="_html").assign(text=[shared.value.extract(h) for h in pdf["_html"]])

    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, f"{schema}, text string")


def op2_pages(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
