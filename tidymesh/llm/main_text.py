"""Main text of web pages: blocks are labelled as content or boilerplate by a minimum cut of each page's graph of blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.common import modest_batches, numbered, release, renamed

# The kinds of elements and the names that tell what an element is for.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("noscript template svg canvas object audio video select button datalist option map head".split())
BESIDE = frozenset("nav footer aside header form menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BESIDE_NAMES = re.compile(
    r"sidebar|footer|cookie|breadcrumb|navbar|disqus|newsletter|advert|masthead"
    r"|(?<![a-z])(?:side-bar|consent|gdpr|comment|respond|subscri|signup|sign-up|sponsor|promo|banner|navigation|topbar|toolbar|related|recommend|social"
    r"|sharing|popup|modal|overlay|copyright|disclaimer|pagination|widget|login|search|notice|notification|skip-link)"
    r"|(?<![a-z])(?:ad|ads|nav|menu|aside|alert|alerts|pager|legal|replies|reply|form|share|tags)(?![a-z])"
)
HEADER_NAMES = re.compile(r"header(?![a-z])")
MAIN_NAMES = re.compile(r"article|(?<![a-z])(?:content|main|story|entry|post|prose)(?![a-z])")
HIDING = re.compile(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
ENDED = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*\Z")

#: Costs are whole numbers, so that cuts are exact. Log odds of the classifier go to CLASSIFIED at most; what the page itself says about
#: an element counts as STATED, a place outside its article as OUTSIDE; blocks next to each other and of one parent cost APART where they part.
UNIT = 1000
CLASSIFIED, STATED, OUTSIDE, APART, KIN = 4 * UNIT, 20 * UNIT, 10 * UNIT, 3 * UNIT, UNIT
N_WORDS, N_LINKS, N_KINDS = 8, 3, 4
CELLS = N_WORDS * N_LINKS * N_KINDS * 4


class Block(NamedTuple):
    text: str
    cell: int  # of the classifier's features
    stated: int  # 1: content, -1: boilerplate, 0: the page doesn't say
    inside: bool  # of an article or main element
    parent: int
    depth: int
    low: int  # least depth since the block before


class Open(NamedTuple):
    tag: str
    number: int
    beside: bool  # it or what it is in is boilerplate
    main: bool
    article: bool
    unseen: bool


def stated_by(tag: str, attrs: str, outer: Open) -> tuple[bool, bool, bool]:
    """(boilerplate, content, an article) by an element's name, class, id, role and by whether it is hidden."""
    names, role = "", ""
    if attrs and "=" in attrs:
        for m in NAMED.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
            else:
                names += " " + HUMP.sub("-", value).lower()
    article = tag in MAIN or role in ("main", "article")
    main = article or bool(names and MAIN_NAMES.search(names))
    top = (tag == "header" or bool(names and HEADER_NAMES.search(names))) and not (outer.main or main)
    beside = top or (tag in BESIDE and tag not in ("header", "form")) or role in BESIDE_ROLES or bool(names and BESIDE_NAMES.search(names)) or bool(attrs and HIDING.search(attrs))
    return beside, main, article


def cell_of(text: str, links: int, tag: str) -> int:
    """Number of a block's features: words, share of links, end of a sentence, kind of element, signs of notices."""
    words = min(N_WORDS - 1, (text.count(" ") + 1).bit_length() - 1)
    share = 0 if not links else 1 if 2 * links < len(text) else 2
    kind = 0 if tag == "p" else 1 if tag in HEADINGS else 2 if tag in ITEMS else 3
    ended, signs = bool(ENDED.search(text)), any(c in text for c in "©|»·•→")
    return ((words * N_LINKS + share) * N_KINDS + kind) * 4 + 2 * ended + signs


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order: what stands between the tags of block elements, references decoded, white space made one space.

    Tags that end others by rule (a paragraph by a block, an item by an item) do so here; scripts, styles and what is never text are left out."""
    found: list[Block] = []
    root = Open("", 0, False, False, False, False)
    stack, count, n = [root], Counter(), 0
    parts: list[str] = []
    linked, links, low, at = False, 0, 1, 0
    form, form_inside = 0, False  # a form around the article is the page's, one in it is not the article's

    def flush() -> None:
        nonlocal links, low
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1]
                leaf = len(stack) > 1 and (top.tag == "p" or top.tag in HEADINGS or top.tag in ITEMS)
                beside = top.beside or (form > 0 and (form_inside or not top.article))
                found.append(Block(text, cell_of(text, links, top.tag), -1 if beside else 1 if top.main else 0, top.article, stack[-2].number if leaf else top.number, len(stack), min(low, len(stack))))
                low = len(stack)
            links = 0

    def close(tag: str) -> None:
        nonlocal low
        while True:
            top = stack.pop()
            count[top.tag] -= 1
            if top.tag == tag:
                break
        low = min(low, len(stack))

    def say(piece: str) -> None:
        nonlocal links
        if piece and not stack[-1].unseen:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if linked:
                links += len(piece)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not ends:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            say(" ")
        elif tag in INLINE:
            if tag == "a":
                linked = not ends
        elif tag in ("html", "body", "hr"):
            flush()
            if count["head"]:
                close("head")
        elif tag == "form":
            flush()
            form = max(0, form + (-1 if ends else 1))
            form_inside = stack[-1].article
        elif ends:
            if tag not in UNSEEN:
                flush()
            if count[tag]:
                close(tag)
        else:
            if tag not in UNSEEN:
                flush()
                if stack[-1].tag == "p" or (tag in HEADINGS and stack[-1].tag in HEADINGS):
                    close(stack[-1].tag)
                if tag in ITEMS and stack[-1].tag in ITEMS:
                    close(stack[-1].tag)
                if tag == "tr" and stack[-1].tag in ITEMS:
                    close(stack[-1].tag)
                if stack[-1].tag == "head":
                    close("head")
            outer, n = stack[-1], n + 1
            beside, main, article = stated_by(tag, attrs, outer)
            if not attrs.rstrip().endswith("/") or tag not in UNSEEN:
                stack.append(Open(tag, n, outer.beside or beside, outer.main or main, outer.article or article, outer.unseen or tag in UNSEEN))
                count[tag] += 1
    flush()
    return found


def content_side(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: a node with odds o costs o as boilerplate where o > 0 and -o as content where o < 0, and an edge (i, j, c) costs c where its ends differ.

    By a maximum flow from nodes of positive odds to nodes of negative ones, in rounds of shortest paths; content is what the residual still reaches, so ties are boilerplate.
    """
    n = len(odds)
    ways: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, c in edges:
        ways[i].append(len(to))
        to.append(j)
        room.append(c)
        ways[j].append(len(to))
        to.append(i)
        room.append(c)  # the edge holds both ways; e ^ 1 is the other way
    left = list(odds)
    while True:
        level = [0 if o > 0 else -1 for o in left]
        line = [i for i in range(n) if level[i] == 0]
        reached = False
        for i in line:
            reached = reached or left[i] < 0
            for e in ways[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    line.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for source in [i for i in range(n) if left[i] > 0]:
            path: list[int] = []
            at = source
            while left[source] > 0:
                if left[at] < 0:
                    flow = min(left[source], -left[at], *(room[e] for e in path))
                    left[source] -= flow
                    left[at] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, at = [], source
                    continue
                for k in range(tried[at], len(ways[at])):
                    e = ways[at][k]
                    if room[e] and level[to[e]] == level[at] + 1:
                        break
                    tried[at] = k + 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    at = to[e ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                at = to[e]


def graph_of(blocks: list[Block], log_odds: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(odds of content, edges) of a page: neighbours by how near they are in the tree, and blocks of one parent that others stand between."""
    article = any(b.inside and b.stated > 0 for b in blocks)
    odds = [log_odds[b.cell] + STATED * b.stated - (OUTSIDE if article and not b.inside and b.stated >= 0 else 0) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 2 * APART // max(2, blocks[i - 1].depth + b.depth - 2 * b.low)))
        k = last.get(b.parent)
        if k is not None and k < i - 1:
            edges.append((k, i, KIN))
        last[b.parent] = i
    return odds, edges


def main_text(page: str | None, log_odds: list[int]) -> str:
    blocks = blocks_of(page or "")
    kept = content_side(*graph_of(blocks, log_odds))
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def features() -> np.ndarray:
    """A row of regressors for each cell: each value of each feature, and words times links."""
    cell = np.arange(CELLS)
    signs, ended, kind = cell % 2, cell // 2 % 2, cell // 4 % N_KINDS
    share, words = cell // (4 * N_KINDS) % N_LINKS, cell // (4 * N_KINDS * N_LINKS)
    hot = [np.eye(n)[x] for n, x in ((N_WORDS, words), (N_LINKS, share), (N_KINDS, kind), (2, ended), (2, signs))]
    return np.hstack([np.ones((CELLS, 1)), *hot])


def fit_costs(pages: DataFrame, html_col: str = "html", ridge: float = 1.0, rounds: int = 25) -> list[int]:
    """Log odds of content (times UNIT, at most CLASSIFIED) for each cell of a block's features.

    A logistic regression on the blocks of all pages whose part the page itself states, by its elements and their names; what it learns
    serves the blocks about which pages say nothing. Spark counts blocks by cell and part, so the driver gets at most 2 * CELLS rows however many
    pages there are. Both parts weigh the same. Pages that state nothing, or only one part, teach nothing: long sentences are then content, links not.
    """
    modest_batches(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = Counter((b.cell, b.stated) for page in frame["html"] if page for b in blocks_of(page) if b.stated)
            release()
            yield pd.DataFrame([(c, s, n) for (c, s), n in counts.items()], columns=["cell", "stated", "n"]).astype({"cell": "int32", "stated": "int32", "n": "int64"})

    told = pages.select(F.col(html_col).alias("html")).mapInPandas(run, "cell int, stated int, n bigint").groupBy("cell", "stated").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((2, CELLS))
    for r in told:
        n[int(r["stated"] > 0), r["cell"]] = r["n"]
    x = features()
    if not n[0].any() or not n[1].any():
        words, share = np.arange(CELLS) // (4 * N_KINDS * N_LINKS), np.arange(CELLS) // (4 * N_KINDS) % N_LINKS
        odds = words - 2.5 - 2.0 * share
    else:
        weight = n / n.sum(axis=1, keepdims=True) * min(n.sum(), 10_000) / 2
        b = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            both = weight.sum(axis=0)
            slope = x.T @ (weight[1] - both * p) - ridge * b
            b = b + np.linalg.solve(x.T @ (x * (both * p * (1 - p))[:, None]) + ridge * np.eye(len(b)), slope)
        odds = x @ b
    return [int(v) for v in np.clip(np.rint(odds * UNIT), -CLASSIFIED, CLASSIFIED)]


def extract_main(pages: DataFrame, log_odds: list[int], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each in ``text_col`` and its code points in n_chars (which replace columns so named).

    A page's blocks are the nodes of a graph. A block's odds of content, by the classifier, by what its elements say and by whether it is outside
    the page's article, are its terminal capacity; edges hold neighbours together, the more the nearer they are in the tree of elements, and blocks of
    one parent; the minimum cut tells content from boilerplate. Blocks that are kept are joined by two line feeds, in page order. Pages are
    independent rows, so nothing is shuffled. A null or empty page, and one without content, has an empty text; repeated rows stay; pages of any length are
    taken whole, in time linear in their length but for the cut's rounds; broken or cut markup is read as far as it goes.
    """
    modest_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def main(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield pd.Series([main_text(p, log_odds) for p in frame], dtype=object)
            release()

    pages, names = numbered(pages)
    done = pages.withColumn("__main", main(F.col(names[html_col])))
    return renamed(done, names, {text_col: F.col("__main"), "n_chars": F.length("__main").cast("long")})
