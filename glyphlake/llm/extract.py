"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (runs of text between block-level tags, with their open ancestors). Each block has
features of its ancestors' tags, classes and ids, and of its text; a two-label chain (article or not), trained by maximum
likelihood on labelled pages, is decoded by Viterbi, and the article's blocks are joined in page order.

Training pages are a bounded, documented set: TRAIN_PAGES pages laid out from fixed seeds in invented templates (pages.py),
whose blocks are labelled by construction. The weights have a fixed size and are broadcast.

Nulls, empties, ties: a null or empty html has the empty text; so has a page without article blocks. A Viterbi tie goes to
"not article". Broken markup is read on: an unclosed tag at the end is dropped, unmatched end tags are ignored, unknown
references stay as they are. Rows that repeat are extracted each; an empty table gives an empty result. Nothing is capped.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table
from .pages import Page

TRAIN_PAGES = 500
STEPS = 120

#: HTML elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option button object head".split())
#: Of these only such hide a page to its end where their own end is missing; the others end with what is around them.
CLOSED = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: An open element of the first kind is closed by a start tag of the others.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PIECES = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"\d")
#: Fixed value: parts of class and id names that tell what an element is for.
HINTS = tuple("nav menu head foot side ad ads advert sponsor promo banner cookie consent notice alert popup modal comment repl discuss respon form search login subscri newsletter share social related recommend widget breadcrumb copyright legal content article post entry story main body text".split())


def leaf_blocks(page: str | None) -> list[tuple[str, float, tuple]]:
    """(text, share of its characters in links, open ancestors as (tag, names)) for each leaf block, in page order."""
    out: list[tuple[str, float, tuple]] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked, links, where = 0, 0, ()

    def flush():
        nonlocal linked, where
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, min(1.0, linked / len(text)), where))
            pieces.clear()
            linked = 0

    def words(raw: str):
        nonlocal linked, where
        if not pieces:
            if raw.isspace():
                return
            where = tuple(stack)
        text = html_lib.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    at, end, hidden, missing = 0, len(page), "", set()
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at and not hidden:
            words(page[at:start])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if hidden:
            if closing and tag == hidden:
                hidden = ""
            continue
        if tag in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                # what it holds isn't markup: go on where it ends
                if tag == "head" and not _ENDS[tag].search(page, at):
                    continue
                around = next((x[0] for x in reversed(stack) if x[0] not in INLINE), "")
                at, closed = _hidden_end(page, tag, at, around, missing)
                hidden = tag if closed else ""
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                # an inline end tag doesn't close blocks
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            links = sum(s[0] == "a" for s in stack)
        elif tag not in VOID:
            if tag not in INLINE:
                while stack and (stack[-1][0] in INLINE or tag in CLOSED_BY.get(stack[-1][0], ())):
                    stack.pop()
            attrs = m[3] or m[6] or ""
            names = " ".join(x or y or z for x, y, z in _NAMES.findall(attrs)).lower() if "=" in attrs else ""
            stack.append((tag, names))
            links = sum(s[0] == "a" for s in stack)
    flush()
    return out


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ENDS = {tag: re.compile(rf"</{re.escape(tag)}\b", re.I) for tag in RAW}
_OPTION = frozenset("option optgroup select datalist".split())


def _hidden_end(page: str, tag: str, at: int, around: str, missing: set[str]) -> tuple[int, bool]:
    """(where what an element of RAW hides ends, whether its own end tag is there). around: the innermost open block; missing:
    elements whose end tag doesn't occur any more."""
    if tag == "option":
        # an option ends with the next, with its list, or where a block begins
        for m in _TAG.finditer(page, at):
            name = m[2].lower()
            if name in _OPTION or name not in INLINE and name not in VOID:
                return m.start(), name == tag and bool(m[1])
        return len(page), False
    own = None if tag in missing else _ENDS[tag].search(page, at)
    if own is None:
        missing.add(tag)
        if tag in CLOSED:
            return len(page), False
    else:
        depth = 0
        if tag not in CLOSED and around:
            for m in _TAG.finditer(page, at, own.start()):
                if m[2].lower() == around:
                    depth += -1 if m[1] else 1
                    if depth < 0:
                        break
        if depth >= 0:
            return own.start(), True
    # its end is missing: it ends where a block begins or ends
    for m in _TAG.finditer(page, at):
        name = m[2].lower()
        if name not in INLINE and name not in VOID:
            return m.start(), False
    return len(page), False


@lru_cache(1 << 14)
def _of_place(where: tuple) -> tuple:
    """Features of open ancestors."""
    seen = set()
    solid = [x for x in where if x[0] not in INLINE]
    for depth, (tag, names) in enumerate(reversed(solid)):
        seen.add(f"in {tag}")
        if depth < 2:
            seen.add(f"up{depth} {tag}")
        for piece in _PIECES.findall(names):
            seen.add(f"name {piece}")
            for hint in HINTS:
                if piece.startswith(hint):
                    seen.add(f"hint {hint}")
                    if depth == 0:
                        seen.add(f"own hint {hint}")
    tags = {x[0] for x in solid}
    seen.add("no main" if not tags & {"article", "main"} else "some main")
    return tuple(sorted(seen))


def features(found: list[tuple[str, float, tuple]]) -> list[list[str]]:
    """Features of each block of a page."""
    out, n = [], len(found)
    for k, (text, linked, where) in enumerate(found):
        count = text.count(" ") + 1
        size = min(count.bit_length(), 7)
        link = 3 if linked > 0.9 else 2 if linked > 0.4 else 1 if linked > 0 else 0
        f = [f"words {size}", f"link {link}", f"words {size} link {link}", f"from start {min(k, 5)}", f"to end {min(n - 1 - k, 3)}"]
        last = text[-1]
        f.append("ends " + ("stop" if last in ".?!…" else "letter" if last.isalnum() else "other"))
        if "©" in text:
            f.append("copyright")
        if "|" in text or "·" in text:
            f.append("bars")
        if _DIGIT.search(text):
            f.append("digits")
        if k:
            f.append("same place" if found[k - 1][2][:-1] == where[:-1] else "new place")
        out.append([*f, *_of_place(where)])
    return out


class Chain:
    """Labels 0 and 1; scores: of a block's features for label 1, of neighbouring labels, of the first label."""

    def __init__(self, weights: dict[str, float], turns: np.ndarray, first: np.ndarray):
        self.weights, self.turns, self.first = weights, turns.tolist(), first.tolist()

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        get = self.weights.get
        (t00, t01), (t10, t11) = self.turns
        a, b, back = self.first[0], self.first[1] + sum(get(f, 0.0) for f in rows[0]), []
        for f in rows[1:]:
            up0, up1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((up0, up1))
            a, b = (b + t10 if up0 else a + t00), (b + t11 if up1 else a + t01) + sum(get(x, 0.0) for x in f)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = 0.15, penalty: float = 0.02) -> Chain:
    """Maximum likelihood with an L2 penalty, by Adam on forward-backward gradients over all pages at once. pages: the
    features and the label of each block."""
    names = {f: k + 1 for k, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    n, t, width = len(pages), max(len(r) for r, _ in pages), max(len(f) for r, _ in pages for f in r)
    ids, gold, real = np.zeros((n, t, width), np.int32), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, f in enumerate(rows):
            ids[i, j, : len(f)] = [names[x] for x in f]
        gold[i, : len(labels)], real[i, : len(labels)] = labels, True
    parts = [len(names) + 1, 4, 2]
    w = np.zeros(sum(parts))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        e, turns, first = w[: parts[0]], w[parts[0] : parts[0] + 4].reshape(2, 2), w[-2:]
        s = np.zeros((n, t, 2))
        s[..., 1] = e[ids].sum(axis=2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = first + s[:, 0]
        for j in range(1, t):
            step_in = np.logaddexp.reduce(fwd[:, j - 1, :, None] + turns, axis=1) + s[:, j]
            fwd[:, j] = np.where(real[:, j, None], step_in, fwd[:, j - 1])
        for j in range(t - 2, -1, -1):
            step_out = np.logaddexp.reduce(turns + (s[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(real[:, j + 1, None], step_out, 0.0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        g = np.zeros_like(w)
        g[: parts[0]] = np.bincount(ids.ravel(), weights=np.repeat(((gold - p[..., 1]) * real).ravel(), width), minlength=parts[0])
        g[0] = 0
        pairs = np.zeros((2, 2))
        both = real[:, 1:] & real[:, :-1]
        for x in (0, 1):
            for y in (0, 1):
                q = np.exp(fwd[:, :-1, x] + turns[x, y] + s[:, 1:, y] + bwd[:, 1:, y] - z[:, None])
                pairs[x, y] = (((gold[:, :-1] == x) & (gold[:, 1:] == y)) * both).sum() - (q * both).sum()
        g[parts[0] : parts[0] + 4] = pairs.ravel()
        g[-2:] = [(gold[:, 0] == y).sum() - p[:, 0, y].sum() for y in (0, 1)]
        g = g / n - penalty * w / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain({f: float(w[k]) for f, k in names.items()}, w[parts[0] : parts[0] + 4].reshape(2, 2), w[-2:])


def labelled(seeds) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of laid-out pages. A page whose blocks are read otherwise than laid out is left out."""
    out = []
    for seed in seeds:
        page = Page(seed)
        found = leaf_blocks(page.html)
        if found and [b[0] for b in found] == [b[0] for b in page.blocks]:
            out.append((features(found), [b[1] for b in page.blocks]))
    return out


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES) -> Chain:
    return train(labelled(range(pages)))


def main_text(page: str | None, chain: Chain) -> str:
    found = leaf_blocks(page)
    return "\n\n".join(b[0] for b, keep in zip(found, chain.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text."""
    held = pages.sparkSession.sparkContext.broadcast(chain)

    def each(batches):
        for b in blocks(batches, "html"):
            texts = [main_text(x.as_py(), held.value) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(each, f"page_id {kind}, url string, text string")


def op4_crf_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"), trained()).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
