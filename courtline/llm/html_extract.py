"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements whose leaves are runs of text. Each node has features of
its subtree density, attribute tokens (its own and those above), depth and siblings. Gradient-boosted
trees (Spark ML) estimate whether a node holds main text. The decoding picks the labels of
highest joint likelihood under one rule: a node that holds main text has no ancestor that holds none. It
is exact, by one pass up and one down the tree, so no choice contradicts another.

There are no labels for pages, so the trees are fitted on pages made by rule, with known main text in
varied layouts (``FIT_MADE``), and on a bounded sample of the table (``FIT_PAGES`` pages in the order of
a hash of the id) labelled by its semantic elements. Every page is extracted whole.
"""

from __future__ import annotations

import os
import re
import uuid
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import step_table

FIT_MADE, FIT_PAGES, FIT_CHARS = 300, 150, 20_000
TREES, DEPTH = 12, 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                            "pre section table ul figure".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
             "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())  # any other element ends an open head
SCOPE = frozenset("html body div article main section aside nav header footer ul ol table form blockquote td".split())
GOOD = ("content", "article", "post", "main", "body", "entry", "story", "text", "prose")
BAD = ("nav", "menu", "foot", "head", "side", "ad", "ads", "advert", "promo", "banner", "sponsor", "cookie", "notice", "consent",
       "alert", "comment", "reply", "discuss", "share", "social", "related", "widget", "breadcrumb", "popup", "modal", "newsletter",
       "subscribe", "login", "search", "form", "copyright", "pager", "toolbar")
GROUPS = (("article", "main"), ("nav", "menu"), ("footer",), ("header",), ("aside",), ("form", "fieldset"), ("p", "blockquote", "pre"),
          ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("table", "tr", "td", "th", "tbody"), ("div",), ("section",),
          ("#text",))
_BLANKS = re.compile(r"\s+")


class _Tree(HTMLParser):
    """Nodes in page order as parallel lists; text runs are leaves named ``#text``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.name, self.parent, self.marks, self.text, self.linked = ["#root"], [-1], [""], [""], [0]
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.run: list[str] = []
        self.unseen = 0
        self.links = 0
        self.run_linked = 0

    def _flush(self):
        text = _BLANKS.sub(" ", "".join(self.run)).strip()
        if text:
            at = self.open[-1][1]
            self._add("#text", at, "", text, min(self.run_linked, len(text)))
        self.run, self.run_linked = [], 0

    def _add(self, name, parent, marks, text="", linked=0):
        self.name.append(name)
        self.parent.append(parent)
        self.marks.append(marks)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.name) - 1

    def _close(self, at: int):
        for name, _ in self.open[at:]:
            self.unseen -= name in UNSEEN
            self.links -= name == "a"
        self._flush()
        del self.open[at:]

    def _end_head(self):
        """Close a head whose end tag is left out."""
        if self.open[-1][0] == "head":
            self._close(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and tag != "html":
            self._end_head()
        if tag == "br":
            self.run.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if tag in CLOSED_BY.get(name, ()):
                self._close(k)
                break
            if name in SCOPE and name not in CLOSED_BY:
                break
        if tag in INLINE or tag in UNSEEN:
            self.links += tag == "a"
            self.unseen += tag in UNSEEN
            self.open.append((tag, self.open[-1][1]))
            return
        self._flush()
        values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        self.open.append((tag, self._add(tag, self.open[-1][1], values.lower())))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in INLINE:  # what was opened inside stays open
                    self.links -= tag == "a"
                    del self.open[k]
                else:
                    self._close(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_startendtag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag == "br":
            self.run.append(" ")

    def handle_data(self, data):
        if self.unseen and not data.isspace():  # blanks may stand in a head
            self._end_head()
        if not self.unseen:
            self.run.append(data)
            if self.links:
                self.run_linked += len(data)


def tree(html: str) -> _Tree:
    t = _Tree()
    t.feed(html)
    t.close()
    t._close(1)
    t._flush()
    return t


def _tokens(marks: str) -> list[str]:
    return [x for x in re.split(r"[^a-z]+", marks) if x]


def _hits(tokens: list[str], words) -> int:
    return sum(any(t == w or len(w) > 3 and w in t for w in words) for t in tokens)


def features(t: _Tree) -> np.ndarray:
    """One row of features per node."""
    n = len(t.name)
    parent = np.array(t.parent)
    chars, linked, leaves, nodes, stops = (np.zeros(n) for _ in range(5))
    paragraphs = np.zeros(n)
    depth, place, children, same, good, bad = (np.zeros(n) for _ in range(6))
    group = np.zeros((n, len(GROUPS)))
    above = np.zeros((n, 8))
    for i in range(n):
        p = parent[i]
        g = next((k for k, names in enumerate(GROUPS) if t.name[i] in names), None)
        if g is not None:
            group[i, g] = 1
        chars[i], linked[i] = len(t.text[i]), t.linked[i]
        leaves[i], nodes[i] = t.name[i] == "#text", 1
        paragraphs[i] = t.name[i] in ("p", "blockquote", "pre")
        stops[i] = sum(t.text[i].count(c) for c in ".,;!?")
        tokens = _tokens(t.marks[i])
        good[i], bad[i] = _hits(tokens, GOOD), _hits(tokens, BAD)
        if p >= 0:
            depth[i], place[i] = depth[p] + 1, children[p]
            children[p] += 1
            above[i] = above[p] + np.array([group[p, 0], group[p, 1], group[p, 2], group[p, 3], group[p, 4], group[p, 5], good[p] > 0, bad[p] > 0])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for x in (chars, linked, leaves, nodes, stops, paragraphs):
            x[p] += x[i]
    kinds: dict[tuple, int] = {}
    for i in range(n):
        kinds[(parent[i], t.name[i])] = kinds.get((parent[i], t.name[i]), 0) + 1
    for i in range(n):
        same[i] = kinds[(parent[i], t.name[i])]
    up = np.maximum(parent, 0)
    page = max(chars[0], 1)
    return np.column_stack([
        group, np.minimum(above, 3), np.minimum(good, 3), np.minimum(bad, 3), np.log1p(chars), linked / np.maximum(chars, 1),
        chars / np.maximum(nodes, 1), chars / np.maximum(leaves, 1), stops / np.maximum(chars, 1), chars / page,
        chars / np.maximum(chars[up], 1), np.log1p(paragraphs), np.log1p(paragraphs[up]), depth, place, children[up],
        (place + 1) / np.maximum(children[up], 1), same / np.maximum(children[up], 1), np.log1p(nodes)])


def decode(t: _Tree, p: np.ndarray) -> list[int]:
    """Numbers of the leaves that are main text, given each node's estimate."""
    n = len(t.name)
    yes, no = -np.log(np.clip(p, 1e-6, 1)), -np.log(np.clip(1 - p, 1e-6, 1))
    for i in range(n - 1, 0, -1):  # children come after their parents
        yes[t.parent[i]] += min(yes[i], no[i])
        no[t.parent[i]] += no[i]
    keep = np.zeros(n, dtype=bool)
    for i in range(n):
        keep[i] = (i == 0 or keep[t.parent[i]]) and (yes[i] <= no[i])
    return [i for i in range(n) if keep[i] and t.name[i] == "#text"]


class Trees:
    """The fitted ensemble as arrays, small enough to travel with the tasks."""

    def __init__(self, rows):
        self.trees = []
        for nodes, weight in rows:
            size = max(x["id"] for x in nodes) + 1
            feature, cut, left, right, value = (np.zeros(size, dtype=d) for d in (int, float, int, int, float))
            for x in nodes:
                leaf = x["leftChild"] < 0
                feature[x["id"]] = -1 if leaf else x["split"]["featureIndex"]
                cut[x["id"]] = 0 if leaf else x["split"]["leftCategoriesOrThreshold"][0]
                left[x["id"]], right[x["id"]], value[x["id"]] = x["leftChild"], x["rightChild"], x["prediction"]
            self.trees.append((weight, feature, cut, left, right, value))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f = feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, down)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * np.clip(total, -15, 15)))


# ------------------------------------------------------------------ pages with known main text

def _prose(rng, n):
    parts = ["an", "the", "re", "ou", "ti", "el", "mo", "sa", "ver", "ko", "lin", "du", "que", "ein"]
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(max(1, n))]
    return " ".join(w + ("." if rng.random() < 0.1 else "," if rng.random() < 0.08 else "") for w in words)


def made_page(seed: int) -> str:
    """A page whose main text stands in elements marked ``data-main``."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    maybe = lambda s, q=0.5: s if rng.random() < q else ""
    some = lambda lo, hi: int(rng.integers(lo, hi))
    links = lambda k: "".join(f'<li><a href="/{j}">{_prose(rng, some(1, 4))}</a></li>' for j in range(k))
    para = lambda tag="p": f"<{tag}>{maybe('<b>', .2)}{_prose(rng, some(4, 120))}{maybe('<br>', .2)}</{tag}>"
    mark = lambda *xs: f' {pick("class", "id")}="{pick(*xs)}"' if rng.random() < 0.85 else ""
    ad = lambda: f'<div{mark("ad", "ads", "advert-box", "sponsor", "promo")}>{maybe("<p>")}{_prose(rng, some(4, 30))}</div>'
    body = "".join((f"<h2>{_prose(rng, some(2, 6))}</h2>" if rng.random() < 0.15 else "") + (
        f"<ul>{''.join(f'<li>{_prose(rng, some(5, 25))}</li>' for _ in range(some(2, 5)))}</ul>" if rng.random() < 0.1 else para(pick("p", "p", "p", "blockquote")))
        + (f'<aside data-out{mark("ad", "related", "pullout")}>{_prose(rng, some(4, 20))}</aside>' if rng.random() < 0.04 else "")
        + (ad().replace("<div", "<div data-out", 1) if rng.random() < 0.04 else "") for _ in range(some(1, 12)))
    title = maybe(f"<h1>{_prose(rng, some(3, 12))}</h1>", 0.85)
    shell = pick("article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry"',
                 'section class="story"', 'div class="article-text"')
    main = f"<{shell} data-main>{title}{body}</{shell.split()[0]}>"
    comments = "".join(f'<{pick("div", "li", "article")}{mark("comment", "reply")}><p>{_prose(rng, some(5, 50))}</p></div>' for _ in range(some(1, 6)))
    top = [f'<nav{mark("menu", "nav")}><ul>{links(some(2, 9))}</ul></nav>' if rng.random() < .6 else f'<div{mark("menu", "navbar", "topnav")}><ul>{links(some(2, 9))}</ul></div>',
           maybe(f'<{pick("header", "div class=header")}><p>{_prose(rng, some(1, 8))}</p></{pick("header", "div")}>', .4),
           maybe(f'<div{mark("cookie-notice", "banner", "consent")}>{_prose(rng, some(6, 40))} <button>OK</button></div>', .4), maybe(ad(), .6)]
    end = [maybe(f'<{pick("section", "div", "div")} class="{pick("comments", "comment-list", "discussion")}"><h3>{_prose(rng, 2)}</h3>{comments}</section>', .45),
           maybe(f'<{pick("aside", "div class=sidebar", "div id=sidebar")}><h3>{_prose(rng, 2)}</h3><ul>{links(some(2, 8))}</ul><p>{_prose(rng, some(4, 40))}</p></aside>', .5),
           maybe(f'<form{mark("newsletter", "login", "search")}><label>{_prose(rng, 3)}</label><input><p>{_prose(rng, some(4, 20))}</p></form>', .35),
           maybe(ad(), .3),
           f'<{pick("footer", "footer", "div class=footer")}>&copy; {_prose(rng, some(3, 25))}</footer>']
    return f"<html><head><title>x</title></head><body>{''.join(top)}{main}{''.join(end)}</body></html>"


class _Marked(_Tree):
    def handle_starttag(self, tag, attrs):
        before = len(self.name)
        super().handle_starttag(tag, attrs)
        keys = {k for k, _ in attrs}
        if len(self.name) > before:
            self.marked = getattr(self, "marked", {})
            self.marked[self.open[-1][1]] = 1 if "data-main" in keys else 0 if "data-out" in keys else None


def _spread(t, seed_of) -> np.ndarray:
    """Labels from the leaves: main text below the nearest labelled element; inner nodes hold any."""
    n = len(t.name)
    state, y = [0] * n, np.zeros(n)
    for i in range(1, n):
        own = seed_of(i)
        state[i] = state[t.parent[i]] if own is None else own
    for i in range(n - 1, 0, -1):
        if t.name[i] == "#text":
            y[i] = state[i]
        y[t.parent[i]] = max(y[t.parent[i]], y[i])
    return y


def _made(seed: int):
    t = _Marked()
    t.feed(made_page(seed))
    t.close()
    t._close(1)
    t._flush()
    return t, _spread(t, lambda i: getattr(t, "marked", {}).get(i))


def _weak(html: str):
    t = tree(html)
    if not any(x in ("article", "main") for x in t.name):
        return t, None
    return t, _spread(t, lambda i: 1 if t.name[i] in ("article", "main") else 0 if t.name[i] in (
        "nav", "footer", "header", "aside", "form") or _hits(_tokens(t.marks[i]), BAD) else None)


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> Trees:
    """The ensemble from made pages and the bounded sample; an empty table leaves the made pages."""
    spark: SparkSession = pages.sparkSession

    def frames(pairs):
        for t, y in pairs:
            if y is not None and len(t.name) > 1:
                yield pd.DataFrame({"x": list(features(t)), "y": y})

    def from_seeds(batches):
        for batch in batches:
            yield from frames(_made(int(s)) for s in batch["id"])

    def from_pages(batches):
        for batch in batches:
            yield from frames(_weak(h) for h in batch["html"])

    schema = "x array<double>, y double"
    sample = pages.where(F.length(html).between(1, FIT_CHARS)).orderBy(F.xxhash64(page_id), page_id).limit(FIT_PAGES).select(F.col(html).alias("html"))
    rows = spark.range(0, FIT_MADE, 1, 4).mapInPandas(from_seeds, schema).unionByName(sample.mapInPandas(from_pages, schema))
    rows = step_table(rows).select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=2, maxMemoryInMB=64).fit(rows)
    path = os.path.join(checkpoint_dir(spark), "models", uuid.uuid4().hex)
    model.write().save(path)
    saved = spark.read.parquet(os.path.join(path, "data")).groupBy("treeID").agg(F.collect_list("nodeData").alias("nodes")).collect()
    return Trees([(r["nodes"], model.treeWeights[r["treeID"]]) for r in saved])


def main_text(html: str | None, model: Trees) -> str:
    """Blocks of the main text, one per line."""
    if not html:
        return ""
    t = tree(html)
    if len(t.name) == 1:
        return ""
    if all(x in ("#root", "#text", "html", "body") for x in t.name):
        return "\n".join(x for x in t.text if x)
    return "\n".join(t.text[i] for i in decode(t, model.probability(features(t))))


def extract(pages: DataFrame, model: Trees, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null or empty html, and html without text, give an empty text. Html without any element but
    html and body is all main text. Rows that repeat an id are extracted each. Unclosed, crossed and
    unknown elements are parsed as far as they go. Other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    @F.pandas_udf("string")
    def apply(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in htmls], dtype=object)

    return rows.select("page_id", "url", apply("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
