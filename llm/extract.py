"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded as a hierarchy.

Every block element of a page is a node. Its features are the size and density of its subtree, its links, its depth, its
place and peers among its siblings, its tag and the tokens of its attributes (as log-odds learned in training, also those
of its parents). Boosted trees give each node the log-odds that it holds main text. Decoding then chooses, by one sweep up
and one down the tree, the best set of nodes in which no kept node lies in a dropped one, so ancestors and descendants
cannot contradict each other.

Training needs no labels from outside: it takes at most ``SAMPLE`` pages, reads those whose markup says what is article and
what is not, and lays the sampled sentences out anew in random page layouts whose parts are known. The model is small and
bounded; every page is then extracted in one pass without a shuffle, however long it is.

Defined results: null or empty pages give an empty text and 0 characters; null ids and repeated rows are rows like any
other; broken or cut markup is read as far as it goes; other columns play no part, whatever their names.
"""

from __future__ import annotations

import html
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import pieces
from llm.dom import Node, parse
from llm.sampling import bounded

#: Pages that training reads, and the longest it takes; both only bound the model's training, not what is extracted.
SAMPLE, LONGEST = 300, 200_000
LAYOUTS = 900
TREES, DEPTH, RATE, BINS = 80, 4, 0.2, 32
#: Stands before main sentences in training layouts; not a character of any page's text.
MARK = "\x01"

TAGS = (
    "page html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th form fieldset nav aside header footer blockquote pre figure figcaption select option button details".split()
)
NUMBERS = (
    "chars tags density links depth place peers tail sentences mean_run like_peers share parent_links token_best token_worst above_worst above_best p_share "
    "list_share kids own ends_open next_chars before"
).split()


def features(nodes: list[Node], runs: list[tuple[int, str]], odds: dict[str, float]) -> np.ndarray:
    """A row of numbers per node."""
    n = len(nodes)
    chars, linked, tags, runs_in, marks, p_chars, li_chars = (np.zeros(n) for _ in range(7))
    for i, (node, text) in enumerate(runs):
        runs_in[node] += 1
        marks[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
    before = np.zeros(n)
    for i, x in enumerate(nodes):
        chars[i], linked[i], tags[i] = x.own, x.linked, 1 + x.inline
        if x.tag == "p":
            p_chars[i] = x.own
        elif x.tag in ("li", "td", "option"):
            li_chars[i] = x.own
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = nodes[i].parent
        for total in (chars, linked, tags, runs_in, marks, p_chars, li_chars):
            total[up] += total[i]
    all_chars = max(1.0, chars[0])
    out = np.zeros((n, len(NUMBERS) + len(TAGS)))
    worst, best = np.zeros(n), np.zeros(n)
    tag_at = {t: len(NUMBERS) + i for i, t in enumerate(TAGS)}
    seen = 0.0
    place_of, same_of = [0] * n, [1] * n
    for x in nodes:
        if x.kids:
            tags_here = Counter([nodes[k].tag for k in x.kids])
            for place, k in enumerate(x.kids):
                place_of[k], same_of[k] = place, tags_here[nodes[k].tag]
    for i, x in enumerate(nodes):
        known = [odds[t] for t in x.tokens if t in odds]
        low, high = min(known, default=0.0), max(known, default=0.0)
        up = x.parent
        worst[i] = min(low, worst[up]) if up >= 0 else low
        best[i] = max(high, best[up]) if up >= 0 else high
        kids = nodes[up].kids if up >= 0 else [0]
        place = place_of[i]
        following = kids[place + 1] if place + 1 < len(kids) else -1
        before[i] = seen
        seen += x.own
        out[i, : len(NUMBERS)] = (
            math.log1p(chars[i]), math.log1p(tags[i]), math.log1p(chars[i] / tags[i]), linked[i] / max(1.0, chars[i]), min(x.depth, 30), min(place, 50), min(len(kids), 50),
            min(len(kids) - 1 - place, 50), marks[i] / max(1.0, chars[i]) * 100, math.log1p(chars[i] / max(1.0, runs_in[i])), same_of[i] / len(kids), chars[i] / all_chars,
            linked[up] / max(1.0, chars[up]) if up >= 0 else 0.0, high, low, worst[up] if up >= 0 else 0.0, best[up] if up >= 0 else 0.0, p_chars[i] / max(1.0, chars[i]),
            li_chars[i] / max(1.0, chars[i]), min(len(x.kids), 50), x.own / max(1.0, chars[i]), float(i == n - 1), math.log1p(chars[following]) if following >= 0 else 0.0, before[i] / all_chars,
        )
        if x.tag in tag_at:
            out[i, tag_at[x.tag]] = 1.0
    return out


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays: at node k of tree t, ``value <= cut`` goes to 2k+1, else to 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Logistic boosting with full trees of ``DEPTH`` over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    rate = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    z = np.full(len(y), start)
    inner = 2**DEPTH - 1
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = at - first
            best = np.full(width, 1e-6)
            where = np.full((width, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = cell * BINS + bins[:, j]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = gain[:, : len(e)]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                where[better] = np.stack([np.full(width, j), top], 1)[better]
            for k, (j, b) in enumerate(where):
                if j >= 0:
                    feature[first + k], cut[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        cell = at - inner
        leaf = RATE * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + 1)
        z = z + leaf[cell]
        trees.append((feature, cut, leaf))
    return Boosted(*(np.stack(a) for a in zip(*trees)), start)


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The kept nodes: the best labelling in which whatever lies in a dropped node is dropped."""
    keep, drop = logits.copy(), -logits
    for i in range(len(nodes) - 1, 0, -1):
        keep[nodes[i].parent] += max(keep[i], drop[i])
        drop[nodes[i].parent] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


# ---- training pages whose parts are known

#: Attribute words that layouts use for each part; samples of common usage, not rules.
_PARTS = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination skip links tabs",
    "header": "header masthead top brand logo site branding topbar hero",
    "footer": "footer bottom copyright legal colophon foot credits",
    "aside": "sidebar aside widget related recommended rail secondary trending popular archive tags",
    "notice": "cookie consent notice banner alert gdpr popup modal overlay message subscribe paywall",
    "ad": "ad ads advert advertisement sponsored promo sponsor adsense promotion commercial",
    "form": "form search newsletter signup login register contact subscribe",
    "comments": "comments comment discussion replies reply responses respond disqus commentlist feedback",
    "share": "share social sharing buttons follow toolbar meta byline tools",
}
_MAIN = "content article post entry story main body text article-body entry-content post-content articlebody primary page-content"


def _layout(r: random.Random, words: list[str]) -> str:
    """A random page; every sentence of its main parts begins with ``MARK``."""

    def sentence(a: int, b: int) -> str:
        k = r.randrange(max(1, len(words) - b))
        return html.escape(" ".join(words[k : k + r.randint(a, b)]).replace(MARK, ""), quote=False).rstrip(".,") + "."

    def said(a: int, b: int) -> str:
        return MARK + sentence(a, b)

    def attribute(names: str) -> str:
        if r.random() < 0.2:
            return ""
        known = names.split()
        name = "-".join(r.sample(known, min(len(known), r.choice((1, 1, 1, 2))))) + r.choice(("", "", "-1", "_x", " clearfix"))
        return f' {r.choice(("class", "class", "id", "role"))}="{name}"'

    def wrap(body: str, tag: str, names: str) -> str:
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<div>{body}</div>"
        return f"<{tag}{attribute(names)}>{body}</{tag}>"

    def links(k: int) -> str:
        items = [f'<a href="/{i}">{sentence(1, 4)[:-1]}</a>' for i in range(k)]
        return r.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def boiler(kind: str) -> str:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else r.choice(("div", "div", "section"))
        body = {
            "nav": lambda: links(r.randint(2, 9)),
            "header": lambda: r.choice(("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "<h2>{}</h2>{}")).format(sentence(1, 5), links(r.randint(1, 4))),
            "footer": lambda: r.choice(("&copy; 2024 {}", "<p>&copy; {}</p>", "{}")).format(sentence(2, 14)) + (links(r.randint(1, 5)) if r.random() < 0.5 else ""),
            "aside": lambda: f"<h3>{sentence(1, 4)}</h3>" + links(r.randint(2, 7)) + (f"<p>{sentence(5, 25)}</p>" if r.random() < 0.5 else ""),
            "notice": lambda: r.choice(("<p>{}</p>", "{}", "<span>{}</span>")).format(sentence(5, 30)) + r.choice(("", "<button>OK</button>", '<a href="#">ok</a>')),
            "ad": lambda: r.choice(("<p>{}</p>", "{}", '<a href="/x">{}</a>')).format(sentence(3, 25)),
            "form": lambda: f"<label>{sentence(1, 4)}</label><input name=q><button>{sentence(1, 2)}</button>" + (f"<p>{sentence(4, 15)}</p>" if r.random() < 0.4 else ""),
            "comments": lambda: f"<h3>{sentence(1, 3)}</h3>"
            + "".join(wrap(f"<b>{sentence(1, 2)}</b> <p>{sentence(5, 50)}</p>", r.choice(("div", "li", "article")), "comment reply comment-body") for _ in range(r.randint(1, 5))),
            "share": lambda: links(r.randint(2, 5)),
        }[kind]()
        names = _PARTS[kind]
        if tag == "div" and kind == "comments" or tag == "div" and kind in ("ad", "notice"):
            names = names if r.random() < 0.9 else "box"
        return wrap(body, tag, names)

    def block() -> str:
        kind = r.random()
        text = said(6, 70)
        if r.random() < 0.2:
            text += f' <a href="/l">{said(1, 3)[:-1]}</a> ' + said(4, 30)
        if kind < 0.72:
            return r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p>{}<br></p>")).format(text)
        if kind < 0.82:
            return f"<h{(k := r.randint(2, 4))}>{said(1, 8)}</h{k}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{said(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{said(1, 6)}</td><td>{said(1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return r.choice(("<div>{}</div>", "<div><p>{}</p></div>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>")).format(text)

    parts = [f"<h1>{said(2, 9)}</h1>"] if r.random() < 0.7 else []
    parts += [block() for _ in range(r.choice((1, 2, 3, 5, 8, 14)))]
    main = list(parts)
    if r.random() < 0.3:
        main.insert(r.randrange(len(main) + 1), boiler(r.choice(("ad", "share", "notice", "aside", "form"))))
    if r.random() < 0.25:
        main.append(boiler(r.choice(("comments", "share", "nav"))))
    body = "".join(main)
    tag = r.choice(("article", "article", "main", "div", "div", "section"))
    body = f"<{tag}{attribute(_MAIN) if tag in ('div', 'section') or r.random() < 0.5 else ''}>{body}</{tag}>"
    for _ in range(r.choice((0, 0, 1, 2))):
        body = f"<div{attribute('wrapper container page main content row col site inner layout')}>{body}</div>"
    head = [boiler(k) for k in r.sample(("nav", "header", "notice", "ad", "form", "share"), r.randint(0, 3))]
    foot = [boiler(k) for k in r.sample(("footer", "aside", "comments", "notice", "ad", "nav", "form"), r.randint(0, 4))]
    if r.random() < 0.25:
        head, foot = head + foot[:1], foot[1:]
    if r.random() < 0.2:
        body = f"<div{attribute('wrapper container page')}>{''.join(head)}{body}{''.join(foot)}</div>"
        head, foot = [], []
    page = "<html><head><title>t</title></head><body>" + "".join(head) + body + "".join(foot) + "</body></html>"
    return page


_OUT = frozenset("nav aside footer form header".split())


def _labelled(page: str, semantic: bool) -> tuple[list[Node], list[tuple[int, str]], np.ndarray] | None:
    """A training page with a label per node (-1: no text); of a real page, None unless its markup says what is article."""
    nodes, runs = parse(page)
    main = np.zeros(len(nodes), bool)
    text = np.zeros(len(nodes), bool)
    inside = np.zeros(len(nodes), np.int64)
    for i, x in enumerate(nodes[1:], 1):
        up = inside[x.parent]
        inside[i] = -1 if x.tag in _OUT or up == -1 else 1 if x.tag in ("article", "main") else up
    if semantic and not (inside == 1).any():
        return None
    for node, run in runs:
        text[node] = True
        main[node] |= inside[node] == 1 if semantic else MARK in run
        nodes[node].own -= run.count(MARK)
    for i in range(len(nodes) - 1, 0, -1):
        main[nodes[i].parent] |= main[i]
        text[nodes[i].parent] |= text[i]
    return nodes, [(i, run.replace(MARK, "")) for i, run in runs], np.where(text, main.astype(int), -1)


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]
    trees: Boosted


def train(real: list[str], seed: int = 0, layouts: int = LAYOUTS) -> Model:
    """A model from sampled pages and from random layouts of their words."""
    r = random.Random(seed)
    known = [x for x in (_labelled(p, True) for p in real) if x]
    words = [w for p in real for _, run in parse(p)[1] for w in run.split()] or ["text", "more", "words"] * 200
    r.shuffle(words)
    known += [_labelled(_layout(r, words), False) for _ in range(layouts)]
    good, bad = Counter(), Counter()
    for nodes, _, label in known:
        for node, y in zip(nodes, label):
            for token in set(node.tokens):
                if y >= 0:
                    (good if y else bad)[token] += 1
    n_good, n_bad = sum(good.values()) + 1, sum(bad.values()) + 1
    odds = {
        t: round(math.log((good[t] + 0.5) / n_good) - math.log((bad[t] + 0.5) / n_bad), 3) for t in {*good, *bad} if good[t] + bad[t] >= 5
    }
    x = np.concatenate([features(nodes, runs, odds if r.random() < 0.85 else {}) for nodes, runs, _ in known])
    y = np.concatenate([label for *_, label in known])
    use = y >= 0
    return Model(odds, boost(x[use], y[use].astype(float), np.ones(use.sum())))


def fit(pages: DataFrame, html_column: str = "html", page_id: str = "page_id", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` pages of at most ``LONGEST`` characters, chosen by a hash of the id."""
    rows = pages.select(pages[page_id].cast("string").alias("id"), pages[html_column].alias("html"))
    rows = bounded(rows.where(F.length("html").between(1, LONGEST)), ["id", "html"], sample)
    return train([r.html for r in rows.collect()])


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    trees = [parse(p or "") for p in pages]
    table = np.concatenate([features(nodes, runs, model.odds) for nodes, runs in trees]) if trees else np.zeros((0, 1))
    logits = model.trees.logits(table)
    out, at = [], 0
    for nodes, runs in trees:
        kept = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(text for node, text in runs if kept[node]))
    return out


def extract(pages: DataFrame, model: Model, html_column: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].alias("url"), pages[html_column].alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 20):
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))


QUERIES = {"op3_html_extraction": op3_html_extraction}
SQL: dict[str, str] = {}
