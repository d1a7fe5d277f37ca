"""Main text of web pages: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

Nodes are block elements and runs of inline text.  Features: tag, how often words of its class, id and role
(and those of its ancestors) named main text among the examples, depth, place among siblings, and of the subtree: characters of text, text per node, share of linked text, commas, paragraphs, share
of the page.  A node's label says whether it holds main text or lies in it.  The trees learn from layouts made by rule
(``layouts``: containers named as sites commonly name them, in random arrangement, with known labels) and from a
bounded sample of the pages at hand that mark their article themselves (``SAMPLE`` pages with exactly one article or
main element, chosen by a hash).

Decoding chooses the most likely labels under the rules that everything inside an outside node is outside and that a
node in the main text holds nothing but main text and, at a price, outside nodes; one pass goes from the leaves up and
one down.  The runs of text that lie in the main text are joined in page order.

Defined cases: null, empty and text-free pages give the empty text; a page that is plain text is one block; repeated
rows and other columns make no difference; white space of any kind inside a block becomes one space.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.boosting import Trees
from isohyet.llm.common import slices
from isohyet.llm.dom import Node, in_order, parse

SAMPLE, LAYOUTS = 200, 600
TAGS = ["#root", "#text", "html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "dl",
        "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "center",
        "address", "details", "dialog", "fieldset"]
_TAG = {t: i for i, t in enumerate(TAGS)}


def features(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    """One row for each node of a page, in page order (parents first); ``odds``: log-odds of main text for each word."""
    place = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    chars, linked, commas, runs, paragraphs, items, size = (np.zeros(n) for _ in range(7))
    for i, node in enumerate(nodes):
        if node.tag == "#text":
            text = "".join(node.text)
            chars[i], linked[i], commas[i], runs[i] = len(text), node.linked, sum(map(text.count, ",.;:!?")), 1
        paragraphs[i], items[i], size[i] = node.tag == "p", node.tag == "li", 1
    parent = np.array([place[id(x.parent)] if x.parent else -1 for x in nodes])
    for i in range(n - 1, 0, -1):
        for a in (chars, linked, commas, runs, paragraphs, items, size):
            a[parent[i]] += a[i]
    total = max(chars[0], 1)
    before = np.concatenate(([0.0], np.cumsum([len("".join(x.text)) for x in nodes])[:-1])) / total
    index, count, same = np.zeros(n), np.ones(n), np.ones(n)
    low, high, above = np.zeros(n), np.zeros(n), np.zeros(n)  # of the node's words, of its ancestors' words
    tags = np.zeros((n, 2 * len(TAGS) + 1), np.float32)
    for i, node in enumerate(nodes):
        if node.parent:
            above[i] = min(above[parent[i]], low[parent[i]])
            tags[i, len(TAGS) + 1 + _TAG.get(node.parent.tag, 4)] = 1
        known = [odds[w] for w in node.words if w in odds]
        if known:
            low[i], high[i] = min(known), max(known)
        tags[i, _TAG.get(node.tag, len(TAGS))] = 1
        of_tag: dict[str, int] = {}
        for k, c in enumerate(node.children):
            of_tag[c.tag] = of_tag.get(c.tag, 0) + 1
        for k, c in enumerate(node.children):
            j = place[id(c)]
            index[j], count[j], same[j] = k / len(node.children), len(node.children), of_tag[c.tag] / len(node.children)
    up = np.maximum(parent, 0)
    numbers = np.stack([
        np.log1p(chars), np.log1p(chars / size), linked / np.maximum(chars, 1), commas / np.maximum(chars, 1) * 100,
        np.log1p(chars / np.maximum(runs, 1)), paragraphs / size, items / size, chars / total, chars / np.maximum(chars[up], 1),
        before, before + chars / total, np.array([x.depth for x in nodes]), index, np.log1p(count), same,
        linked[up] / np.maximum(chars[up], 1), np.log1p(chars[up]), np.array([_hidden(x) for x in nodes], float),
        low, high, above, low[up], np.array([len(x.words) for x in nodes])], 1)
    return np.concatenate((numbers, tags), 1).astype(np.float32)


def word_odds(pages: list[list[Node]], found: list[np.ndarray]) -> dict[str, float]:
    """Smoothed log-odds that a node with a word is main text or holds it."""
    counts: dict[str, list[float]] = {}
    for nodes, y in zip(pages, found):
        for node, k in zip(nodes, y):
            for w in set(node.words):
                counts.setdefault(w, [1.0, 1.0])[int(k > 0)] += 1
    return {w: float(np.log(yes / no)) for w, (no, yes) in counts.items()}


def _hidden(node: Node | None) -> bool:
    while node:
        if node.hidden:
            return True
        node = node.parent
    return False


# --- what the trees learn from -------------------------------------------------------------------------------------

CONTENT = ["content", "article", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content",
           "articleBody", "page-content", "main-content", "prose", "blog-post", "news", "md"]
WRAP = ["wrap", "container", "page", "layout", "row", "col", "inner", "site", "outer", "grid", "app", ""]
NOISE = {
    "menu": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "navigation", "topnav", "main-menu", "tabs", "pagination", "pager", "toc"],
    "header": ["header", "masthead", "top", "topbar", "banner", "site-header", "branding", "logo"],
    "footer": ["footer", "foot", "bottom", "copyright", "site-footer", "legal", "colophon"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "tags", "archive", "right", "more", "see-also"],
    "notice": ["cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "subscribe", "newsletter", "paywall", "privacy"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "banner-ad", "adsense"],
    "form": ["form", "search", "login", "signup", "contact", "subscribe-form", "searchbox"],
    "comments": ["comment", "comments", "comment-list", "discussion", "replies", "respond", "disqus", "reviews", "reader-comments"],
    "share": ["share", "social", "sharing", "follow", "share-buttons", "meta", "byline-share"],
}


def _words(rng: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(rng.randint(low, high)):
        out.append("".join(rng.choice("aeiouybcdfghlmnprstéüñ") for _ in range(rng.randint(1, 10))) + rng.choice(["", "", "", "", ",", "."]))
    return " ".join(out) or "a"


def _named(rng: random.Random, names: list[str]) -> str:
    name = rng.choice(names)
    return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(WRAP)}"', f' class="{name}-{rng.randint(1, 9)}"']) if name else ""


def _links(rng: random.Random, low: int, high: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(rng, 1, 4)}</a></li>' for i in range(rng.randint(low, high))) + "</ul>"


def _noise(rng: random.Random, kind: str) -> str:
    name = _named(rng, NOISE[kind])
    if kind == "menu":
        tag = rng.choice(["nav", "nav", "div", "ul"])
        return _links(rng, 3, 12) if tag == "ul" else f"<{tag}{name if rng.random() < 0.7 or tag == 'div' else ''}>{_links(rng, 3, 12)}</{tag}>"
    if kind == "header":
        tag = rng.choice(["header", "div"])
        return f"<{tag}{name}>" + rng.choice([f"<h1>{_words(rng, 1, 4)}</h1>", f"<a href='/'>{_words(rng, 1, 3)}</a>", f"<p>{_words(rng, 2, 12)}</p>"]) + rng.choice(["", _links(rng, 2, 7)]) + f"</{tag}>"
    if kind == "footer":
        tag = rng.choice(["footer", "footer", "div"])
        return f"<{tag}{name if tag == 'div' or rng.random() < 0.5 else ''}>&copy; {_words(rng, 2, 30)}" + rng.choice(["", f"<p>{_words(rng, 3, 30)}</p>", _links(rng, 2, 9)]) + f"</{tag}>"
    if kind == "side":
        tag = rng.choice(["aside", "div", "section"])
        return f"<{tag}{name if tag != 'aside' or rng.random() < 0.6 else ''}><h3>{_words(rng, 1, 3)}</h3>" + rng.choice([_links(rng, 3, 9), f"<p>{_words(rng, 5, 50)}</p>"]) + f"</{tag}>"
    if kind == "form":
        return f"<form{name}><label>{_words(rng, 1, 4)}</label><p>{_words(rng, 1, 15)}</p><input name='q'></form>"
    if kind == "comments":
        each = rng.choice(["div", "li", "article"])
        inner = "".join(f"<{each} class='{rng.choice(['comment', 'reply', 'comment-body', 'review'])}'><p>{_words(rng, 1, 3)}</p><p>{_words(rng, 5, 80)}</p></{each}>" for _ in range(rng.randint(1, 6)))
        tag = rng.choice(["section", "div", "ol" if each == "li" else "div"])
        return f"<{tag}{name}><h3>{_words(rng, 1, 3)}</h3>{inner}</{tag}>"
    if kind == "share":
        return f"<div{name}>" + rng.choice([_links(rng, 2, 5), f"<span>{_words(rng, 1, 4)}</span>"]) + "</div>"
    tag = rng.choice(["div", "div", "section", "aside"])  # notice, advert
    return f"<{tag}{name}>" + rng.choice([_words(rng, 3, 30), f"<p>{_words(rng, 4, 40)}</p>", f"<a href='#'>{_words(rng, 2, 9)}</a>"]) + f"</{tag}>"


def _article(rng: random.Random) -> str:
    parts = [rng.choice([f"<h1>{_words(rng, 2, 14)}</h1>", f"<h1>{_words(rng, 2, 14)}</h1>", f"<header><h1>{_words(rng, 2, 12)}</h1></header>", ""])]
    for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 30])):
        p = _words(rng, 1, rng.choice([2, 8, 40, 150]))
        parts.append(rng.choice([f"<p>{p}</p>"] * 8 + [
            f"<p><b>{p}<br>", f"<p>{p} <a href='/x'>{_words(rng, 1, 3)}</a> {p}</p>", f"<h2>{_words(rng, 1, 6)}</h2><p>{p}</p>",
            f"<blockquote><p>{p}</p></blockquote>", f"<ul><li>{p}</li><li>{_words(rng, 1, 20)}</li></ul>", f"<pre>{p}</pre>",
            f"<table><tr><td>{_words(rng, 1, 5)}</td><td>{_words(rng, 1, 5)}</td></tr></table>", f"<div>{p}</div>",
            f"<figure><img src='i'><figcaption>{_words(rng, 2, 12)}</figcaption></figure>"]))
    return "\n".join(parts)


def layouts(n: int = LAYOUTS, seed: int = 5) -> list[str]:
    """Pages made by rule; ``data-part`` marks the element that holds the main text (if none does, all is), and noise in it."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        inner = _article(rng)
        if rng.random() < 0.1:  # nothing but main text: a fragment, a bare body, plain text
            out.append(rng.choice([inner, f"<html><body>{inner}</body></html>", _words(rng, 1, 60), f"<p>{_words(rng, 1, 30)}</p>"]))
            continue
        if rng.random() < 0.35:
            noise = _noise(rng, rng.choice(["share", "advert", "side", "comments", "notice", "form"]))
            noise = noise.replace(">", ' data-part="noise">', 1)
            inner = rng.choice([inner + noise, noise + inner])
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        name = _named(rng, CONTENT) if tag in ("div", "section") or rng.random() < 0.3 else ""
        main = f'<{tag}{name} data-part="main">{inner}</{tag}>'
        for _ in range(rng.choice([0, 0, 1, 2])):
            around = [_noise(rng, rng.choice(list(NOISE))) if rng.random() < 0.4 else "" for _ in range(2)]
            main = f"<div{_named(rng, WRAP)}>{around[0]}{main}{around[1]}</div>"
        top = "".join(_noise(rng, k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "menu"], rng.randint(0, 4)))
        end = "".join(_noise(rng, k) for k in rng.sample(["footer", "side", "comments", "advert", "notice", "share", "menu", "footer"], rng.randint(0, 4)))
        out.append(f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 5)}</title></head><body>{top}{main}{end}</body></html>")
    return out


def labels(nodes: list[Node], main, noise) -> np.ndarray:
    """2 for nodes in main text, 1 for those that hold it, 0 for others; noise is 0 even inside main text."""
    state: dict[int, bool] = {}
    holds: set[int] = set()
    for node in nodes:
        inside = state.get(id(node.parent), False)
        state[id(node)] = (inside or main(node)) and not noise(node)
        if state[id(node)] and not inside:
            up = node.parent
            while up and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    return np.array([2 if state[id(n)] else 1 if id(n) in holds else 0 for n in nodes], np.int64)


def made_labels(nodes: list[Node]) -> np.ndarray:
    whole = not any(n.mark == "main" for n in nodes)
    return labels(nodes, lambda n: whole or n.mark == "main", lambda n: n.mark == "noise")


def own_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels of a page that marks its article itself; none for other pages."""
    marked = [n for n in nodes if n.tag in ("article", "main")]
    if len(marked) != 1:
        return None
    return labels(nodes, lambda n: n is marked[0], lambda n: n.tag in ("nav", "aside", "form", "footer"))


class Model:
    """Log-probabilities of the three labels from two sets of trees."""

    def __init__(self, pages: list[str] = ()):
        """Learns from the layouts and from those of ``pages`` that mark their article."""
        made = [in_order(parse(page)) for page in layouts()]
        found = [made_labels(nodes) for nodes in made]
        for page in pages:
            nodes = in_order(parse(page))
            y = own_labels(nodes)
            if y is not None:
                made.append(nodes)
                found.append(y)
        self.odds = word_odds(made, found)
        x, y = np.concatenate([features(nodes, self.odds) for nodes in made]), np.concatenate(found)
        self.some, self.inside = (Trees(x, (y >= k).astype(float), np.ones(len(y))) for k in (1, 2))

    def log_probabilities(self, pages: list[list[Node]]) -> np.ndarray:
        """For all nodes of all pages, one page after the other."""
        x = np.concatenate([features(nodes, self.odds) for nodes in pages])
        some, inside = (1 / (1 + np.exp(-np.clip(t.margin(x), -30, 30))) for t in (self.some, self.inside))
        p = np.stack([1 - some, some - inside, np.minimum(inside, some)], 1)
        return np.log(np.clip(p, 1e-4, 1))


def fit(pages: DataFrame) -> Model:
    """Learns from the layouts and from up to SAMPLE of the pages (of up to 100,000 characters)."""
    usable = pages.filter("html is not null and length(html) <= 100000").select(F.xxhash64("page_id", "html").alias("key"), "html")
    keys = [r["key"] for r in usable.select("key").distinct().orderBy("key").limit(SAMPLE).collect()]
    chosen = usable.filter(F.col("key") <= max(keys)).dropDuplicates(["key"]).orderBy("key").collect() if keys else []
    return Model([r["html"] for r in chosen])


# --- reading pages --------------------------------------------------------------------------------------------------

CHANGE = 3.0  # log-odds it takes to drop a node out of main text


def decode(nodes: list[Node], log_p: np.ndarray) -> np.ndarray:
    """The most likely labels of all nodes that do not contradict each other."""
    place = {id(n): i for i, n in enumerate(nodes)}
    parent = [place[id(n.parent)] if n.parent else -1 for n in nodes]
    best = log_p.astype(np.float64).copy()
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag == "#text":
            best[i, 1] = -np.inf  # a run of text holds nothing else
        if i:
            out, hold, inside = best[i]
            best[parent[i]] += out, max(out, hold, inside), max(inside, out - CHANGE)
    found = np.zeros(len(nodes), np.int64)
    for i, (out, hold, inside) in enumerate(best):
        above = found[parent[i]] if i else 1
        if above == 1:
            found[i] = int(np.argmax(best[i]))
        elif above == 2:
            found[i] = 2 if inside >= out - CHANGE else 0
    return found


def main_text(nodes: list[Node], log_p: np.ndarray) -> str:
    blocks = (" ".join("".join(n.text).split()) for n, k in zip(nodes, decode(nodes, log_p)) if k == 2 and n.tag == "#text")
    return "\n\n".join(b for b in blocks if b)


def _extractor(model: Model):
    def run(batches):
        for batch in batches:
            pages = batch["html"].to_pylist()
            for a, b in slices(pages, 2_000_000):
                nodes = [in_order(parse(h)) for h in pages[a:b]]
                log_p = model.log_probabilities(nodes)
                limits = np.cumsum([0, *map(len, nodes)])
                texts = [main_text(n, log_p[x:y]) for n, x, y in zip(nodes, limits[:-1], limits[1:])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return run


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select("page_id", "url", "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return (rows.mapInArrow(_extractor(model), f"{schema}, text string").drop("html")
            .withColumn("n_chars", F.char_length("text").cast("long")))
