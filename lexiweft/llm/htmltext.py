"""Main text of web pages by a tree-structured graphical model.

A page is parsed leniently into a tree of block elements. Each node is content or not: features of the node (tag, words of
class, id and role, own text, share of link text) give its potential, and a table of four values those of each parent and
child. Sum-product messages, upward from the leaves and downward from the root, give exact marginals; text whose block has
a content marginal of a half or more is kept. The weights maximize the likelihood of labelled pages, by its exact
gradient from the same messages. The labelled pages are generated from a fixed seed, in many layouts.

Contract: one row per input row. Null and empty html gives an empty text. Unclosed tags and pages cut short are closed at
their end. Repeated rows repeat; extra columns are ignored. Whole pages are read, of any length.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import column, in_arrow, slices, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>?|[^<]++|<", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg select textarea button object canvas math audio video option datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "dialog", "head", "title", "body", "html", "menu", "address", "details"]
HINTS = [
    frozenset("content article post entry main story text body prose markdown articlebody".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner doubleclick".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs topbar toc pager pagination".split()),
    frozenset("sidebar side aside rail widget widgets related recommended trending more complementary".split()),
    frozenset("comment comments reply replies discussion respond disqus reviews thread".split()),
    frozenset("cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup subscription paywall warning".split()),
    frozenset("share social sharing follow tags meta byline author toolbar tools rating".split()),
    frozenset("footer foot header masthead contentinfo copyright legal logo hidden".split()),
    frozenset("form search login contact survey poll".split()),
]
HINT_OF = {w: k for k, ws in enumerate(HINTS) for w in ws}
TAG_OF = {t: k for k, t in enumerate(TAGS)}
N_TAG, N_HINT = len(TAGS) + 1, len(HINTS)
N_FEATURES = N_TAG + N_HINT + 7
LABEL = "data-y"


#: Stands for all tags of blocks where open ones are counted.
SOLID = "*"


class Page:
    """parent, depth, feats: by node in document order. blocks: (node, text) in page order."""

    __slots__ = ("parent", "depth", "tags", "hints", "chars", "linked", "runs", "hidden", "labels", "blocks")

    def __init__(self, source: str):
        self.parent, self.depth, self.tags, self.hints = [-1], [0], [""], [()]
        self.chars, self.linked, self.runs, self.hidden, self.labels, self.blocks = [0], [0], [0], [False], [0], []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack = [("", 0)]  # (tag, its node or that of the block around it)
        places: dict[str, list[int]] = {}  # of each open tag, and of what is not INLINE (under SOLID), in the stack
        piece: list[str] = []
        links = linked = 0  # open <a> elements; link characters of the current run
        skip = 0  # depth inside hidden elements
        raw = ""

        def flush() -> None:
            nonlocal linked
            if piece:
                text = " ".join(entities.unescape("".join(piece)).split())
                node = stack[-1][1]
                if text:
                    self.blocks.append((node, text))
                    self.chars[node] += len(text)
                    self.linked[node] += min(linked, len(text))
                    self.runs[node] += 1
                piece.clear()
            linked = 0

        def pop_to(k: int) -> None:
            nonlocal links, skip
            if any(t not in INLINE for t, _ in stack[k:]):
                flush()
            for t, _ in reversed(stack[k:]):
                links -= t == "a"
                skip -= t in HIDDEN
                places[t].pop()
                if t not in INLINE:
                    places[SOLID].pop()
            del stack[k:]

        def push(tag: str, node: int) -> None:
            places.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                places.setdefault(SOLID, []).append(len(stack))
            stack.append((tag, node))

        def place(tag: str) -> int:
            """Of the innermost open one, 0 without any."""
            found = places.get(tag)
            return found[-1] if found else 0

        for m in TOKEN.finditer(source):
            tag = m["tag"] or m["tag2"]
            if raw and not (tag and (m["end"] or m["end2"]) and tag.lower() == raw):
                if raw == "title" and not skip:
                    piece.append(m[0])
                continue
            if tag is None:
                if skip == 0 and not m[0].startswith(("<!", "<?")):
                    piece.append(m[0])
                    if links:
                        linked += len(m[0])
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                raw = ""
                k = place(tag)
                if k and not (tag in ("p", "li", "b", "i", "a", "span") and k < max(map(place, ("article", "table", "td")))):
                    pop_to(k)
                continue
            if tag in CLOSES_P:
                k = place(SOLID)
                if k and (stack[k][0] == "p" or stack[k][0] in SAME.get(tag, ())):
                    pop_to(k)
            elif tag in SAME:
                while (k := max(map(place, SAME[tag]))) > max(map(place, BARRIER[tag])):
                    pop_to(k)
                    if tag != "tr":
                        break
            if tag == "br":
                piece.append(" ")
            if tag in VOID:
                if tag not in INLINE:
                    flush()
                continue
            attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"]
            if tag in INLINE:
                push(tag, stack[-1][1])
                links += tag == "a"
            else:
                flush()
                around, node = stack[-1][1], len(self.parent)
                self.parent.append(around)
                self.depth.append(self.depth[around] + 1)
                self.tags.append(tag)
                hints, hidden, label = self._attributes(attrs) if attrs.strip() else ((), False, 0)
                self.hints.append(hints)
                self.hidden.append(hidden)
                self.labels.append(label)
                for column_of in (self.chars, self.linked, self.runs):
                    column_of.append(0)
                push(tag, node)
                skip += tag in HIDDEN
            if tag in RAW:
                raw = tag
        flush()

    @staticmethod
    def _attributes(text: str) -> tuple[tuple[int, ...], bool, int]:
        hints, hidden, label = set(), False, 0
        for name, a, b, c in ATTR.findall(text):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                hints.update(HINT_OF[w] for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w in HINT_OF)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif name == LABEL:
                label = int(value)
        return tuple(sorted(hints)), hidden, label


def forest_of(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All pages' nodes together: parent (of roots: -1), depth, features, and where each page begins."""
    begins, parent, depth = [], [], []
    total = 0
    for p in pages:
        begins.append(total)
        parent += [q + total if q >= 0 else -1 for q in p.parent]
        depth += p.depth
        total += len(p.parent)
    x = np.zeros((total, N_FEATURES), np.float32)
    at = 0
    base = N_TAG + N_HINT
    for p in pages:
        n = len(p.parent)
        x[np.arange(at, at + n), [TAG_OF.get(t, N_TAG - 1) for t in p.tags]] = 1
        for k, hints in enumerate(p.hints):
            for h in hints:
                x[at + k, N_TAG + h] = 1
        chars, linked = np.array(p.chars, np.float32), np.array(p.linked, np.float32)
        rows = slice(at, at + n)
        x[rows, base] = 1
        x[rows, base + 1] = np.log1p(chars) / 5
        x[rows, base + 2] = linked / np.maximum(chars, 1)
        x[rows, base + 3] = chars == 0
        x[rows, base + 4] = np.minimum(np.array(p.depth), 12) / 12
        x[rows, base + 5] = np.array(p.hidden)
        x[rows, base + 6] = np.array(p.runs) > 1
        at += n
    return np.array(parent, np.int64), np.array(depth, np.int64), x, begins


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(parent: np.ndarray, depth: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the nodes (n x 2) and of each node with its parent (n x 2 x 2, parent first; zero at roots)."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0]
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    below = unary.astype(np.float64).copy()  # a node's own potential with the messages of its children
    up = np.zeros_like(below)
    for level in reversed(levels[1:]):
        up[level] = _lse(pair[None] + below[level][:, None, :], 2)
        np.add.at(below, parent[level], up[level])
    belief = below.copy()
    joint = np.zeros((len(unary), 2, 2))
    for level in levels[1:]:
        outside = belief[parent[level]] - up[level]
        belief[level] = below[level] + _lse(pair[None] + outside[:, :, None], 1)
        both = outside[:, :, None] + pair[None] + below[level][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
    marginal = np.exp(belief - belief.max(axis=1, keepdims=True)) if len(belief) else belief
    return marginal / marginal.sum(axis=1, keepdims=True), joint


def labelled_pages(n: int = 400, seed: int = 17) -> list[Page]:
    """Generated pages whose block elements carry their label."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    y = lambda v: f' {LABEL}="{v}"'
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def el(tag: str, body: str, label: int, names: str = "") -> str:
        attrs = f' {rng.choice(["class", "id"])}="{names}"' if names else ""
        return f"<{tag}{attrs}{y(label)}>{body}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>")

    def links(label: int = 0) -> str:
        if rng.random() < 0.7:
            return el(rng.choice(["ul", "ul", "ol"]), "".join(el("li", link(), label) for _ in range(rng.randint(2, 7))), label)
        return el("div", " ".join(link() for _ in range(rng.randint(2, 6))), label)

    def boiler() -> str:
        kind = rng.choice(["nav", "header", "footer", "aside", "ad", "form", "comments", "notice", "share"])
        text = words(2, 40)
        if kind == "nav":
            return el(rng.choice(["nav", "nav", "div", "menu"]), links(), 0, rng.choice(["nav", "menu", "navbar", "breadcrumb"]))
        if kind == "header":
            return el("header", rng.choice([el("h1", words(1, 4), 0), el("p", text, 0), el("div", text, 0, "logo")]) + rng.choice(["", links()]), 0, rng.choice(["", "site-header", "masthead"]))
        if kind == "footer":
            return el(*rng.choice([("footer", "&copy; " + text, 0, ""), ("footer", el("p", text, 0) + links(), 0, ""), ("div", el("p", text, 0), 0, "footer")]))
        if kind == "aside":
            return el(*rng.choice([("aside", el("h3", words(1, 3), 0) + links(), 0, ""), ("aside", el("p", text, 0), 0, ""), ("div", el("p", words(5, 60), 0), 0, "sidebar"), ("div", links(), 0, "related widget")]))
        if kind == "ad":
            return el(rng.choice(["div", "div", "section", "aside"]), rng.choice([text, el("p", text, 0), el("p", words(20, 60), 0)]), 0, rng.choice(["ad", "ads", "advert", "banner", "sponsored", "promo"]))
        if kind == "form":
            return el("form", f'<label>{words(1, 3)}</label><input name="q">' + rng.choice(["", el("p", text, 0)]) + "<button>go</button>", 0, rng.choice(["", "search", "newsletter", "contact"]))
        if kind == "comments":
            return el(rng.choice(["div", "section"]), rng.choice(["", el("h2", words(1, 2), 0)]) + "".join(el(rng.choice(["div", "article", "li"]), el("p", words(3, 50), 0), 0, rng.choice(["comment", "reply"])) for _ in range(rng.randint(1, 4))), 0, rng.choice(["comments", "discussion", "comment-list"]))
        if kind == "notice":
            return el(rng.choice(["div", "section", "dialog", "p"]), rng.choice([text, words(15, 50)]), 0, rng.choice(["cookie-notice", "consent", "notice", "alert", "newsletter", "paywall", "popup"]))
        return el("div", " ".join(link() for _ in range(3)) + rng.choice(["", words(1, 5)]), 0, rng.choice(["share", "social", "tags", "toolbar"]))

    def content(label: int = 1) -> str:
        parts = [el("h1", words(1, 9), label)] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 7)):
            pick = rng.random()
            inline = words(1, 60) + rng.choice(["", f" <b>{words(1, 4)}</b> ", f" {link()} ", "<br>", f"<b>{words(1, 9)}<br>"]) + rng.choice(["", words(1, 30)])
            if pick < 0.6:
                parts.append(el("p", inline, label))
            elif pick < 0.7:
                parts.append(el(rng.choice(["h2", "h3"]), words(1, 6), label))
            elif pick < 0.78:
                parts.append(el("ul", "".join(el("li", words(1, 15), label) for _ in range(rng.randint(1, 5))), label))
            elif pick < 0.84:
                parts.append(el("blockquote", rng.choice([words(3, 30), el("p", words(3, 30), label)]), label))
            elif pick < 0.88:
                parts.append(el("table", el("tr", "".join(el("td", words(1, 4), label) for _ in range(3)), label), label))
            elif pick < 0.92:
                parts.append(el("pre", words(3, 20), label))
            elif pick < 0.95:
                parts.append(el("figure", el("figcaption", words(2, 12), label), label))
            else:
                parts.append(el(rng.choice(["div", "section"]), rng.choice([inline, el("p", inline, label)]), label))
        return "".join(parts)

    def page() -> str:
        inner = content()
        if rng.random() < 0.25:
            cut = inner.find("</p>") + 4
            inner = inner[:cut] + boiler() + inner[cut:] if cut > 4 else boiler() + inner
        if rng.random() < 0.2:
            inner += boiler()
        main = rng.random()
        if main < 0.5:
            body = el("article", inner, 1, rng.choice(["", "", "post", "story"]))
        elif main < 0.65:
            body = el("main", rng.choice([inner, el("article", inner, 1)]), 1)
        elif main < 0.9:
            body = el(rng.choice(["div", "section"]), inner, 1, rng.choice(["content", "main-content", "article-body", "entry", "post", "story text"]))
        else:
            body = el("div", inner, 1)
        before, after = "".join(boiler() for _ in range(rng.randint(0, 3))), "".join(boiler() for _ in range(rng.randint(0, 3)))
        body = before + body + after
        if rng.random() < 0.3:
            body = el("div", body, 0, rng.choice(["", "wrapper", "page", "container"]))
        head = f'<head{y(0)}><meta charset="utf-8"><title{y(0)}>{words(1, 8)}</title><style>p{{margin:0}}</style><script>track("</p>");</script></head>'
        return f"<!DOCTYPE html><html{y(0)}>{head if rng.random() < 0.9 else ''}<body{y(0)}>{body}" + rng.choice(["</body></html>", ""])

    return [Page(page()) for _ in range(n)]


class ContentModel:
    def __init__(self):
        self.w, self.pair = np.zeros(N_FEATURES), np.zeros((2, 2))

    def potentials(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.w
        return np.stack([np.zeros_like(s), s], axis=1)

    def fit(self, pages: list[Page], rounds: int = 300, rate: float = 0.1, decay: float = 2e-4) -> ContentModel:
        parent, depth, x, _ = forest_of(pages)
        y = np.concatenate([p.labels for p in pages]).astype(int)
        child = parent >= 0
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[parent[child]], y[child]), 1)
        wanted, n = x[y == 1].sum(axis=0), len(y)
        theta = np.zeros(N_FEATURES + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            marginal, joint = sum_product(parent, depth, self.potentials(x), self.pair)
            slope = np.concatenate([wanted - marginal[:, 1] @ x, (seen - joint.sum(axis=0)).ravel()]) / n - decay * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, self.pair = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        return self

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, the content marginal of each node."""
        if not pages:
            return []
        parent, depth, x, begins = forest_of(pages)
        p = sum_product(parent, depth, self.potentials(x), self.pair)[0][:, 1]
        return np.split(p, begins[1:])


@lru_cache(maxsize=1)
def trained() -> ContentModel:
    return ContentModel().fit(labelled_pages())


def extract(sources: list[str | None], model: ContentModel) -> list[str]:
    pages = [Page(s or "") for s in sources]
    return ["\n".join(text for node, text in page.blocks if p[node] >= 0.5) for page, p in zip(pages, model.marginals(pages))]


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text, n_chars for each row."""
    model = trained()

    def run(batches):
        for batch in slices(batches, most_bytes=4_000_000, most_rows=500):
            texts = extract(column(batch, "html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    picked = pages.select(pages[key].cast("long").alias("key"), pages[url].cast("string").alias("url"), pages[html].alias("html"))
    return in_arrow(picked, run, "key long, url string, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op4_main_text": op4_main_text}
ORACLES: dict[str, str] = {}
