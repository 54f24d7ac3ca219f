"""Main text of web pages by minimum-cut labelling.

The markup becomes blocks: runs of text between block-level tags. A logistic classifier gives each block the cost of being
called boilerplate or content, from its shape (length, links, sentence end, place in the page, its parent's link share)
and from hashed tokens (its tag, the tags and the names of class, id and role of its nearest NEAR ancestors). What its
neighbours are is left to the cut. All weights are learned. Training blocks come from a bounded sample of pages (`sample_pages`) and are labelled by the
nearest ancestor whose element or class says what it is (article and main against nav, aside, footer, form ...); each is
learned from three times, with its tokens, without those that may have given the label, and without any tag, so that
shape and the cut must do where a page says nothing. The word lists enter as a few training rows too, and are all that is learned from where there are no pages.

The costs are the capacities from the source and to the sink; neighbours in the page and neighbours under one parent are
joined by smoothness edges, which weigh less the further apart they are in the tree, by weights that do best on the
training pages without their telling tags, or without any. The minimum cut is the cheapest labelling; content blocks are joined in page
order by \n. The cut is exact: a block whose own cost outweighs all its edges keeps its label in every minimum cut, so it
is fixed and its edges become its neighbours' costs; what is left is solved by augmenting paths from block to block.

Nulls and edges: null, empty and text-less pages give "". Character references are decoded, white space in a block is
one space, <br> is white space. Unclosed tags end with their parent, unclosed form parts with the next block; a quote that never closes ends with its tag; a tag
cut off by the page's end is markup. Text is never cut short, and parsing is linear in the page's length, however deep
it nests. Repeated rows give the same text, an empty table no rows. Extra columns pass through; `text` and `n_chars` are
replaced.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, with_columns

# HTML's elements and the words that pages name their parts by.
RAW = "script style textarea title noscript noframes iframe xmp".split()
PHRASING = "button select option optgroup datalist".split()  # silent, and ended by any block
SILENT = frozenset([*PHRASING, "template"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math svg object audio video canvas".split()) | SILENT
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HOLDERS = frozenset("table ul ol dl div section article main aside nav header footer body form blockquote".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav aside footer form menu dialog header fieldset".split())
GOOD_WORDS = frozenset("article story post entry content body main text prose".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget footer header masthead topbar "
    "toolbar comment comments disqus reply replies respond discussion share sharing social related recommended newsletter "
    "subscribe subscription signup login search pagination pager copyright legal skip complementary contentinfo dialog".split()
)
NEUTRAL_WORDS = frozenset("area bar block bottom box col column container inner item left list outer page panel region right row section site the top wrap wrapper".split())

#: A quote counts only after =, where an attribute's value begins.
ATTRS = r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s>]*)*+"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b" + ATTRS + r"(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)(" + ATTRS + r")>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Ancestors whose tokens a block has.
NEAR = 12
CELLS = 1 << 14


@dataclass
class Block:
    text: str
    tag: str
    parent: int  # number of the element around the block's own
    linked: int  # characters in links
    apart: int  # steps in the tree from the block before
    tokens: tuple[str, ...]  # of the nearest ancestors; those that may tell the label begin with !
    label: int  # 1, 0, or -1 where nothing says


class _Element:
    __slots__ = ("tag", "number", "tokens", "label", "depth", "block")

    def __init__(self, tag: str, number: int, tokens: tuple[str, ...], label: int, depth: int, block: bool):
        self.tag, self.number, self.tokens, self.label, self.depth, self.block = tag, number, tokens, label, depth, block


def _said(tag: str, attrs: str, inside: bool) -> tuple[tuple[str, ...], int]:
    """(tokens, label or -1) of an element. inside: an article."""
    telling = tag in GOOD_TAGS or tag in BAD_TAGS
    tokens, label = [f"{'!' if telling else ''}a:{tag}"], -1
    if tag in GOOD_TAGS:
        label = 1
    elif tag in BAD_TAGS and not (inside and tag == "header"):
        label = 0
    if attrs and tag not in ("html", "body"):
        names = [x for m in NAMES.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()]
        for name in names:
            words = {w.lower() for w in WORD.findall(name)}
            tokens.append(f"!c:{name.lower()}")
            if words <= BAD_WORDS | NEUTRAL_WORDS:  # a word of the list beside others, as in share-price, says nothing
                tokens += [f"!w:{w}" for w in sorted(words & BAD_WORDS)]
                label = 0 if label < 0 and words & BAD_WORDS else label
            elif words <= GOOD_WORDS | NEUTRAL_WORDS:
                tokens += [f"!w:{w}" for w in sorted(words & GOOD_WORDS)]
        if HIDDEN.search(attrs):
            tokens.append("!hidden")
            label = 0
    return tuple(tokens), label


def parse(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    root = _Element("", 0, (), -1, 0, True)
    open_ = [root]
    around = [root]  # of the open elements, the block-level ones
    count: dict[str, int] = {}
    words: list[str] = []
    linked, number, low = 0, 0, 0  # low: the least depth since the last block

    def end_block() -> None:
        nonlocal linked, low
        text = " ".join("".join(words).split())
        if text:
            own = around[-1]
            apart = own.depth - low + ((out_depth[0] - low) if out else 0)
            tokens = dict.fromkeys([*(t for e in around[-NEAR - 1 : -1] for t in e.tokens), *(t for t in own.tokens if t[0] == "!")])
            out.append(Block(text, own.tag, around[-2].number if len(around) > 1 else 0, linked, apart, tuple(tokens), own.label))
            out_depth[0] = low = own.depth
        words.clear()
        linked = 0

    out_depth = [0]

    def pop() -> None:
        nonlocal low
        e = open_.pop()
        count[e.tag] -= 1
        if e.block:
            around.pop()
            low = min(low, around[-1].depth)

    def close(tag: str) -> None:
        if count.get(tag):
            while open_[-1].tag != tag:
                pop()
            pop()

    def say(text: str) -> None:
        nonlocal linked
        if any(count.get(t) for t in SILENT):
            return
        text = html_lib.unescape(text)
        words.append(text)
        if count.get("a"):
            linked += len(text.strip())

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag not in INLINE:
            for old in PHRASING:
                close(old)
            end_block()
        if m[2]:
            close(tag)
            continue
        for old in CLOSES.get(tag, "").split():
            if count.get(old):
                k = len(open_) - 1
                while open_[k].tag != old and open_[k].tag not in HOLDERS and k:
                    k -= 1
                if open_[k].tag == old:
                    close(old)
        if tag not in VOID and not m[4].endswith("/"):
            number += 1
            inside = any(count.get(t) for t in GOOD_TAGS)
            count[tag] = count.get(tag, 0) + 1
            if tag in INLINE:
                open_.append(_Element(tag, number, (), -1, 0, False))
            else:
                tokens, label = _said(tag, m[4], inside)
                e = _Element(tag, number, tokens, around[-1].label if label < 0 else label, len(around), True)
                open_.append(e)
                around.append(e)
    if at < len(page):
        say(page[at:])
    end_block()
    return out


# ---------------------------------------------------------------- classifier

#: Numeric features of a block.
SHAPES = 9


def cell(token: str) -> int:
    return SHAPES + zlib.crc32(token.encode()) % CELLS


def shapes(blocks: list[Block]) -> np.ndarray:
    """A row of SHAPES numbers for each block of a page."""
    n = len(blocks)
    size = [len(b.text) for b in blocks]
    share = [min(1.0, b.linked / k) for b, k in zip(blocks, size, strict=True)]
    total: dict[int, list[float]] = {}
    for b, k, s in zip(blocks, size, share, strict=True):
        t = total.setdefault(b.parent, [0.0, 0.0])
        t[0] += k
        t[1] += k * s
    out = np.zeros((n, SHAPES))
    for i, b in enumerate(blocks):
        at = i / max(1, n - 1)
        t = total[b.parent]
        out[i] = (
            1.0, log1p(size[i]) / 5, share[i], b.text[-1] in ".!?…»\"”", "©" in b.text, t[1] / t[0], log1p(b.text.count(",")) / 2, max(0.0, 1 - 10 * at),
            max(0.0, 10 * at - 9),
        )
    return out


def tokens_of(b: Block, less: int = 0) -> list[str]:
    """less: 1: without what may have told the label; 2: with no tags either."""
    own = [f"w:{len(b.text.split()).bit_length()}"]
    if less < 2:
        own += [t for t in b.tokens if t[0] != "!" or not less]
    return own if less == 2 or less and b.tag in GOOD_TAGS | BAD_TAGS else [*own, f"t:{b.tag}"]


@dataclass
class Model:
    """w: a weight for each shape and cell. beside, kin: weights of edges between neighbours, in the page and under one parent."""

    w: np.ndarray
    beside: float = 1.0
    kin: float = 1.0

    def logits(self, blocks: list[Block], less: int = 0) -> list[float]:
        base = shapes(blocks) @ self.w[:SHAPES]
        return [float(x) + sum(float(self.w[cell(t)]) for t in tokens_of(b, less)) for x, b in zip(base, blocks, strict=True)]


def _expected() -> dict[str, float]:
    """What tokens weigh before anything is learned."""
    out = {f"!w:{w}": -8.0 for w in BAD_WORDS} | {f"!w:{w}": 1.0 for w in GOOD_WORDS}
    return out | {f"!a:{t}": -8.0 for t in BAD_TAGS} | {f"!a:{t}": 4.0 for t in GOOD_TAGS} | {"!hidden": -8.0}


def _typical() -> list[tuple[np.ndarray, list[str], int, float]]:
    """Rows of typical shapes."""
    made = lambda n, link, end, mark=0.0: np.array([1, log1p(n) / 5, link, end, mark, link, 0, 0, 0])
    return [(made(n, 0, 1), [], 1, 2.0) for n in (60, 150, 400, 1200)] + [(made(n, 1, 0), [], 0, 2.0) for n in (4, 8, 20)] + [(made(20, 0, 0, 1.0), [], 0, 2.0), (made(10, 0, 0), [], 1, 0.5)]


def fit(rows: list[tuple[np.ndarray, list[str], int, float]], ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Logistic weights by gradient steps scaled for each weight, drawn to what is expected. rows: (shapes, tokens, label, weight)."""
    rows = [*rows, *_typical()]
    x = np.stack([r[0] for r in rows])
    y, weight = (np.array([r[k] for r in rows], float) for k in (2, 3))
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    expected = {cell(t): v for t, v in sorted(_expected().items())}
    seen, col = np.unique(np.array([cell(t) for r in rows for t in r[1]] + sorted(expected), np.int64), return_inverse=True)
    col = col[: len(row)]
    mean = np.array([expected.get(int(c), 0.0) for c in seen])
    w, v = np.zeros(SHAPES), mean.copy()
    gw, gv = np.full(SHAPES, 1e-9), np.full(len(seen), 1e-9)
    for _ in range(rounds):
        z = x @ w + np.bincount(row, v[col], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        dw, dv = x.T @ g + ridge * w, np.bincount(col, g[row], len(seen)) + ridge * (v - mean)
        gw += dw**2
        gv += dv**2
        w -= 0.5 * dw / np.sqrt(gw)
        v -= 0.5 * dv / np.sqrt(gv)
    out = np.zeros(SHAPES + CELLS)
    out[:SHAPES], out[seen] = w, v
    return out


#: Weights of edges that are tried.
TRIED = (0.5, 1.0, 2.0, 4.0)


def learn(pages: list[str]) -> Model:
    """A model from pages whose markup says which of their blocks are content."""
    parsed = [p for p in (parse(x) for x in pages) if p]
    rows = []
    for blocks in parsed:
        for b, s in zip(blocks, shapes(blocks), strict=True):
            if b.label >= 0:
                rows += [(s, tokens_of(b, less), b.label, 1 / 3) for less in range(3)]
    model = Model(fit(rows))
    trial = [p for p in parsed if {b.label for b in p} >= {0, 1}]
    best = None
    for beside in TRIED if trial else ():
        for kin in TRIED:
            tried = Model(model.w, beside, kin)
            right = sum(x == (b.label == 1) for less in (1, 2) for p in trial for x, b in zip(labels(p, tried, less), p, strict=True) if b.label >= 0)
            if best is None or right > best[0]:  # ties: the smaller weights
                best = (right, tried)
    return best[1] if best else model


def train(pages: DataFrame, html: str = "html", sample_pages: int = 300, order: str | None = None) -> Model:
    """A model from the sample_pages pages with the smallest hash of `order` (or of the page)."""
    key = F.xxhash64(quoted(order) if order else quoted(html))
    keyed = pages.filter(quoted(html).isNotNull()).select(key.alias("k"), quoted(html).alias("h"))
    low = [r[0] for r in keyed.select("k").orderBy("k").limit(sample_pages).collect()]  # keys alone; then those pages
    rows = keyed.filter(F.col("k") <= (low[-1] if low else 0)).orderBy("k", "h").limit(sample_pages).collect()
    return learn([r["h"] for r in rows])


# ---------------------------------------------------------------- minimum cut

def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise sum of unary[i] over false ones (negative: a gain) plus the weights of cut edges."""
    n = len(unary)
    u, near = list(unary), [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # blocks that their own cost decides
        i = todo.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    for i, side in zip(rest, _source_side(rest, u, near), strict=True):
        label[i] = side
    return [bool(x) for x in label]


def _source_side(rest: list[int], u: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Augmenting paths from each block with a cost above 0 to the nearest below 0.

    Where a block reaches none, all that it reaches is on the source's side and is never searched again.
    """
    left = {i: u[i] for i in rest}  # what is left of the arc from the source (above 0) or to the sink (below 0)
    cap = {i: dict(near[i]) for i in rest}
    done: set[int] = set()
    for s in rest:
        while left[s] > 1e-9 and s not in done:
            came, queue, end = {s: s}, deque([s]), None
            while queue and end is None:
                i = queue.popleft()
                for j, c in cap[i].items():
                    if c > 1e-9 and j not in came and j not in done:
                        came[j] = i
                        if left[j] < -1e-9:
                            end = j
                            break
                        queue.append(j)
            if end is None:
                done.update(came)
                break
            path, j = [], end
            while j != s:
                path.append((came[j], j))
                j = came[j]
            push = min(left[s], -left[end], *(cap[i][j] for i, j in path))
            for i, j in path:
                cap[i][j] -= push
                cap[j][i] = cap[j].get(i, 0.0) + push
            left[s] -= push
            left[end] += push
    return [i in done for i in rest]


def labels(blocks: list[Block], model: Model, less: int = 0) -> list[bool]:
    """Which blocks are content."""
    unary = [max(-6.0, min(6.0, x)) for x in model.logits(blocks, less)]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i and model.beside:
            edges.append((i - 1, i, model.beside * exp(-0.5 * b.apart)))
        if (j := last.get(b.parent)) is not None and model.kin:
            edges.append((j, i, model.kin * exp(-0.25 * (i - j))))
        last[b.parent] = i
    return min_cut(unary, edges)


def main_text(page: str | None, model: Model) -> str:
    """The page's content blocks."""
    blocks = parse(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, labels(blocks, model), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", model: Model | None = None, order: str | None = None) -> DataFrame:
    """pages with text and n_chars (its code points) instead of the html column."""
    model = train(pages, html, order=order) if model is None else model
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(x.as_py(), model) for x in part.column(len(names))]
                yield [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_columns(pages, names, html, run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
