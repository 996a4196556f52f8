"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and its runs of text; each is content or not. Unary potentials come
from tags, class and id words and text shape, pairwise potentials join parent and child by the child's kind.
Sum-product messages pass once upward and once downward, level by level over a whole batch of pages, and give
exact marginals. The same messages give the gradient in training, on labelled pages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without end tags, raw text elements, inline elements, ends that may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Element -> (elements that it closes, elements that the search for them does not leave).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}

#: Kinds of nodes; a text run is ``#text`` and any other element ``other``.
KINDS = (
    "#text html head title body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption "
    "nav header footer aside form fieldset button select option textarea script style noscript template iframe address details summary dialog menu other"
).split()
KIND = {k: i for i, k in enumerate(KINDS)}
NAME_BUCKETS = 512
_NAMES = len(KINDS)
_SHAPE = _NAMES + NAME_BUCKETS
WIDTH = _SHAPE + 24

# A tag ends at '>' outside quotes or with the page, and a quote that is never closed is a plain character, so
# each place of a page is scanned a bounded number of times.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:\b(?:class|id|role|itemprop)|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The nodes of a page: parents come before children."""

    __slots__ = ("parent", "kind", "features", "text", "node", "depth")

    def __init__(self, html: str):
        self.parent, self.kind, self.features, self.depth = [-1], [KIND["html"]], [[KIND["html"]]], [0]
        self.text: list[str] = []  # runs in page order
        self.node: list[int] = []  # their nodes
        stack = [("html", 0)]
        open_at: dict[str, list[int]] = {}  # where each tag stands in the stack
        run: list[str] = []
        linked = in_link = at = 0

        def add(tag: str, attributes: str = "") -> int:
            k = KIND.get(tag, KIND["other"])
            self.parent.append(stack[-1][1])
            self.depth.append(self.depth[stack[-1][1]] + 1)
            self.kind.append(k)
            f = [k]
            if attributes and "=" in attributes:
                for m in _NAMED.finditer(attributes):
                    f += {_NAMES + crc32(w.lower().encode()) % NAME_BUCKETS for w in _WORD.findall(m[1] or m[2] or m[3] or "")}
            self.features.append(f)
            return len(self.parent) - 1

        def flush() -> None:
            nonlocal linked, in_link
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.node.append(add("#text"))
                    self.text.append(text)
                    self.features[-1] += shape(text, linked)
                run.clear()
            linked = in_link = 0

        def say(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                run.append(piece)
                if in_link:
                    linked += len(piece)

        def push(tag: str, node: int) -> None:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))

        def last(names: set[str]) -> int:
            return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

        def cut(i: int) -> None:
            while len(stack) > i:
                open_at[stack.pop()[0]].pop()

        def close(names: set[str], until: set[str]) -> None:
            while (i := last(names)) > last(until):
                cut(i)
                if len(names) == 1:
                    return

        while m := _TAG.search(html, at):
            say(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    in_link = 0
                elif tag not in INLINE:
                    flush()
                    if i := last({tag}):
                        cut(i)
                continue
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = 1
            if tag in INLINE:
                continue
            flush()
            if tag == "html":
                continue
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = add(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if tag in ("title", "textarea"):
                    push(tag, node)
                    say(html[at:stop])
                    flush()
                    cut(len(stack) - 1)
                at = end.end() if end else len(html)
            elif tag not in VOID and not m[3].endswith("/"):
                push(tag, node)
        say(html[at:])
        flush()


def shape(text: str, linked: int) -> list[int]:
    """Features of a run of text: length, words, links, end, symbols."""
    n, words = len(text), text.count(" ") + 1
    f = [_SHAPE + min(9, n.bit_length()), _SHAPE + 10 + min(4, words.bit_length())]
    f.append(_SHAPE + (15 if not linked else 16 if 2 * linked < n else 17))
    if text[-1] in ".!?…:;\"')]":
        f.append(_SHAPE + 18)
    if "©" in text or "®" in text:
        f.append(_SHAPE + 19)
    if "»" in text or "·" in text:
        f.append(_SHAPE + 20)
    return f


class Forest:
    """Many pages as flat arrays, with nodes by depth for the messages."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages], np.int64)
        self.offset = np.cumsum(size) - size
        n = int(size.sum())
        self.parent = np.fromiter((q + o if q >= 0 else -1 for p, o in zip(pages, self.offset.tolist()) for q in p.parent), np.int64, n)
        self.kind = np.fromiter((k for p in pages for k in p.kind), np.int64, n)
        depth = np.fromiter((d for p in pages for d in p.depth), np.int64, n)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        count = np.fromiter((len(f) for p in pages for f in p.features), np.int64, n)
        self.row = np.repeat(np.arange(n), count)
        self.column = np.fromiter((c for p in pages for f in p.features for c in f), np.int64, int(count.sum()))
        self.n = n

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, own state) of each node with a parent."""
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.row, weights[self.column], self.n)
        table = pair[self.kind]  # [node, parent's state, own state]
        below, up = unary.copy(), np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(table[level] + below[level][:, None, :], axis=2)
            for s in (0, 1):
                below[:, s] += np.bincount(self.parent[level], up[level, s], self.n) if len(level) * 8 > self.n else 0
            if len(level) * 8 <= self.n:
                np.add.at(below, self.parent[level], up[level])
        belief = below.copy()
        both = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            from_parent = belief[self.parent[level]] - up[level]
            joint = from_parent[:, :, None] + table[level] + below[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            both[level] = np.exp(joint)
            both[level] /= both[level].sum(axis=(1, 2), keepdims=True)
            down = np.logaddexp.reduce(from_parent[:, :, None] + table[level], axis=1)
            belief[level] = below[level] + down
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return p, both


def labels(page: Page, content: list[bool]) -> np.ndarray:
    """A label for each node from those of its runs: an element is content if most of its text is."""
    yes, total = np.zeros(len(page.parent)), np.zeros(len(page.parent))
    for node, text, c in zip(page.node, page.text, content):
        yes[node] += c * len(text)
        total[node] += len(text)
    for i in range(len(page.parent) - 1, 0, -1):
        yes[page.parent[i]] += yes[i]
        total[page.parent[i]] += total[i]
    return 2 * yes > total


def train(pages: list[Page], marks: list[list[bool]], steps: int = 150, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair tables by Adam on the exact log-likelihood of labelled pages."""
    forest = Forest(pages)
    y = np.concatenate([labels(p, m) for p, m in zip(pages, marks)]).astype(float)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    x = np.zeros(WIDTH + 4 * len(KINDS))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, pair = x[:WIDTH], x[WIDTH:].reshape(-1, 2, 2)
        p, both = forest.marginals(w, pair)
        g = np.bincount(forest.column, (y - p)[forest.row], WIDTH)
        made = np.zeros_like(seen)
        np.add.at(made, forest.kind[child], both[child])
        g = np.concatenate([g, (seen - made).ravel()]) / len(pages) - decay * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:WIDTH], x[WIDTH:].reshape(-1, 2, 2)


#: Marks content in generated pages; a private-use character that is taken out before training.
MARK = ""


def labelled_page(r: random.Random) -> str:
    """A random page whose content runs begin with MARK: articles in several layouts amid other matter."""
    syllable = r.choice([("th", "er", "on", "ing", "re"), ("é", "eau", "le", "ou", "ment"), ("ción", "que", "os", "la"), ("ung", "sch", "ei", "er", "ß")])
    odd = r.choice([[""]] * 4 + [["", "", ","], [" |"], ["###", "%%%", "***", "&amp;&amp;"], [" 12", " +1 (487) 555", " a@b.example", " /x/y", "&nbsp;&euro;"]])
    word = lambda: "".join(r.choices(syllable, k=r.randrange(1, 4))) + r.choice(odd)
    words = lambda n: " ".join(word() for _ in range(n)).capitalize()
    says = lambda n: ". ".join(words(r.randrange(1, 14)) for _ in range(n)) + r.choice([".", ".", ".", ""])
    link = lambda: f'<a href="/{word()}">{words(r.randrange(1, 4))}</a>'
    named = lambda *names: r.choice([' class="{}"', ' id="{}"', " class='{}'", ' class="x1 {} col"']).format(r.choice(names) + r.choice(["", "", "-box", "_wrap", "-1"]))

    def links() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randrange(2, 9))) + "</ul>"

    def block() -> str:
        c = MARK
        end = r.choice(["</p>", "</p>", "</p>", ""])
        return r.choices(
            [
                lambda: f"<p>{c}{says(r.randrange(1, 8))}{end}",
                lambda: f"<p><b>{c}{says(r.randrange(1, 4))}<br>",
                lambda: f"<p>{c}{words(r.randrange(1, 5))}.{end}",
                lambda: f"<p>{c}{says(2)} {link()} {says(1)}{end}",
                lambda: f"<p>{c}{' '.join([word()] * r.randrange(5, 90))}{end}",
                lambda: f"<p>{c}{words(r.randrange(15, 150))}{end}",
                lambda: f"<h2>{c}{words(4)}</h2>",
                lambda: "<ul>" + "".join(f"<li>{c}{says(1)}" for _ in range(3)) + "</ul>",
                lambda: f"<blockquote>{c}{says(2)}</blockquote>",
                lambda: f"<pre>{c}{says(1)}</pre>",
                lambda: "<table>" + "".join(f"<tr><td>{c}{words(2)}</td><td>{c}{words(3)}</td></tr>" for _ in range(3)) + "</table>",
                lambda: f"<div>{c}{says(r.randrange(1, 5))}</div>",
                lambda: f"<figure><img src=x><figcaption>{c}{words(5)}</figcaption></figure>",
            ],
            [12, 3, 4, 2, 1, 1, 2, 1, 1, 0.5, 0.5, 2, 0.5],
        )[0]()

    def comments() -> str:
        one = lambda: f"<div{named('comment', 'reply')}><p>{says(r.randrange(1, 6))}</p></div>"
        return r.choice(["section", "div", "ol"]).join(["<", f"{named('comments', 'responses', 'discussion', 'disqus')}><h3>{words(2)}</h3>" + "".join(one() for _ in range(r.randrange(1, 4))) + "</", ">"])

    def junk() -> str:
        return r.choice(
            [
                lambda: f"<nav>{links()}</nav>",
                lambda: f"<div{named('nav', 'menu', 'navbar', 'breadcrumb', 'breadcrumbs', 'navigation', 'toolbar')}>{links()}</div>",
                lambda: f"<header{r.choice(['', named('header', 'masthead', 'top')])}><h1>{words(3)}</h1><p>{says(1)}</p>{r.choice(['', links()])}</header>",
                lambda: f"<div{named('header', 'masthead', 'banner', 'top', 'site')}><p>{says(1)}</p></div>",
                lambda: f"<aside{r.choice(['', named('sidebar', 'related', 'widget')])}><h3>{words(2)}</h3>{r.choice([links(), '<p>' + says(3) + '</p>'])}</aside>",
                lambda: f"<div{named('sidebar', 'widget', 'related', 'recommended', 'popular', 'trending', 'tags')}><h4>{words(2)}</h4>{r.choice([links(), '<p>' + says(2) + '</p>'])}</div>",
                lambda: f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'promotion')}>{r.choice([says(r.randrange(1, 5)), '<p>' + says(2) + '</p>', link()])}</div>",
                lambda: f"<div{named('cookie', 'notice', 'consent', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'gdpr', 'banner', 'warning', 'disclaimer')}><p>{says(r.randrange(1, 4))}</p></div>",
                lambda: f"<form action=/s{r.choice(['', named('search', 'login', 'form', 'signup')])}><label>{words(2)}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{words(2)}</textarea><button>{word()}</button></form>",
                lambda: f"<div{named('share', 'social', 'follow', 'pagination', 'pager', 'buttons', 'meta', 'author', 'byline')}>{link()} {link()}</div>",
                lambda: f"<noscript><p>{says(1)}</p></noscript>",
                lambda: f"<dialog><p>{says(2)}</p></dialog>",
                comments,
            ]
        )()

    def footer() -> str:
        c = r.choice(["&copy; ", "© ", ""]) + f"{word()}.example &middot; {says(r.randrange(1, 4))}"
        return r.choice([f"<footer>{c}</footer>", f"<footer><p>{c}</p>{links()}</footer>", f"<div{named('footer', 'copyright', 'bottom', 'legal', 'colophon')}><p>{c}</p></div>"])

    body = [block() for _ in range(r.randrange(1, 14))]
    if r.random() < 0.25:  # other matter in the middle of the article
        body.insert(r.randrange(len(body) + 1), r.choice([junk, junk, comments])())
    head = r.choice([f"<h1>{MARK}{words(r.randrange(3, 9))}</h1>", f"<h1>{MARK}{words(5)}</h1>", f"<h2>{MARK}{words(5)}</h2>", ""])
    inner = head + "".join(body) + (comments() if r.random() < 0.2 else "")
    place = r.choices(
        ["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div{n}>{}</div>", "<div{n}><article>{}</article></div>", "<section{n}>{}</section>"], [5, 1, 1, 3, 1, 1]
    )[0]
    place = place.replace("{n}", named("content", "main", "post", "entry", "story", "article", "body", "text", "page")).replace("{}", inner)
    before = "".join(junk() for _ in range(r.randrange(0, 4)))
    after = "".join(junk() for _ in range(r.randrange(0, 3)))
    page = f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>{before}<!-- {word()} -->{place}{after}{footer()}"
    return page + r.choice(["</body></html>", ""])


def labelled(pages: list[str]) -> tuple[list[Page], list[list[bool]]]:
    """Generated pages without their marks, and which of their runs had one."""
    clean, marks = [], []
    for html in pages:
        marks.append([MARK in t for t in Page(html).text])
        clean.append(Page(html.replace(MARK, "")))
    return clean, marks


@lru_cache(4)
def model(n_pages: int = 700, seed: int = 11, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The model trained on ``n_pages`` generated labelled pages (a bound by parameter)."""
    r = random.Random(seed)
    return train(*labelled([labelled_page(r) for _ in range(n_pages)]), steps=steps)


def extract(pages: list[str | None], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """The main text of each page; '' for a null or empty one."""
    parsed = [Page(h or "") for h in pages]
    if not parsed:
        return []
    forest = Forest(parsed)
    p, _ = forest.marginals(weights, pair)
    return ["\n".join(t for t, i in zip(x.text, x.node) if p[i + o] > 0.5) for x, o in zip(parsed, forest.offset.tolist())]


def main_text(pages: DataFrame, html_col: str = "html", model_args: tuple = ()) -> DataFrame:
    """The columns of ``pages`` but ``html_col``, and ``text``, ``n_chars`` (replacing columns of these names).

    A null html gives an empty text, an empty table an empty result, repeated rows a row each. Whole pages are
    read, in time that grows with their length and their depth; nothing is shuffled and each page is decided by
    itself. A run of text is content if its probability is over 0.5; at 0.5 exactly it is not. A tag that is
    never closed ends with the page. The model, some kilobytes, is trained once on the driver and travels with
    the tasks.
    """
    weights, pair = model(*model_args)

    @F.pandas_udf("string")
    def each(html: pd.Series) -> pd.Series:
        h = [x if isinstance(x, str) else None for x in html]
        return pd.Series([t for i in range(0, len(h), 500) for t in extract(h[i : i + 500], weights, pair)], dtype=object)

    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    out = pages.select(*rest, each(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html(pages: DataFrame) -> DataFrame:
    """The contract's columns for whole ``pages``."""
    return main_text(pages).select("page_id", "url", "text", "n_chars")
