"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags, each with its open
ancestors.  Features are the ancestors' tags and attribute words and the shape of the
text; labels are main and other, with weights for neighbouring pairs.  The field is
trained on labelled pages (``labelled_pages``) by gradient ascent on the conditional
likelihood and decoded by Viterbi.  Training takes the same few seconds whatever the
corpus; the weights, not the pages, are broadcast.

Defined results: a null or empty page, and one without main blocks, gives ''; a page
without tags is one block; unclosed tags, stray end tags and comments left open are taken
as browsers take them; ``<br>`` is white space inside a block; script, style and other
hidden elements are no text; rows with equal ids are extracted each, those without an id or url
too; very long and deeply nested pages take time in proportion to their length; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import labelled_pages
from ._store import table

TRAIN_PAGES = 700
EPOCHS = 14

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|itemprop|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Element classes of the HTML standard.
HIDDEN = frozenset("script style template noscript iframe svg math head title object canvas audio video select datalist textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption head html label legend option optgroup tbody td tfoot th thead tr title".split())
#: A start tag closes these, up to the nearest of the elements after them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
#: Elements inside which a block does not close a p outside.
P_SCOPE = frozenset("td th table button caption object".split())
INLINE_BREAK = frozenset("br wbr img input".split())
WORD = re.compile(r"[a-z]+")
FURNITURE = frozenset(w.lower() for words in labelled_pages.FURNITURE.values() for w in words if len(w) > 2) | {"©"}


@dataclass
class Leaf:
    text: str
    path: tuple[str, ...]  # ancestors' features
    parent: str
    linked: int  # characters inside links


def _attribute_words(rest: str) -> tuple[tuple[str, ...], bool]:
    found, hidden = [], False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            hidden = True
        elif name != "style":
            found += WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower())
    return tuple(found), hidden


class _Open:
    """The open elements, with the places of each tag, so that none is searched for."""

    def __init__(self):
        # Tag, path's features, hidden, in a link, nearest block tag, nearest p that a block closes.
        self.rows: list[tuple[str, tuple[str, ...], bool, bool, str, int]] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> tuple[str, tuple[str, ...], bool, bool, str, int]:
        return self.rows[-1] if self.rows else ("", (), False, False, "", -1)

    def nearest(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, tag: str, path: tuple[str, ...], hidden: bool, link: bool) -> None:
        before, place = self.top(), len(self.rows)
        p = place if tag == "p" else -1 if tag in P_SCOPE else before[5]
        self.rows.append((tag, path, hidden, link, tag if tag in BLOCK else before[4], p))
        self.places.setdefault(tag, []).append(place)

    def cut(self, place: int) -> bool:
        """Closes all from a place on; whether a block was among them."""
        block = False
        while len(self.rows) > place:
            tag = self.rows.pop()[0]
            self.places[tag].pop()
            block |= tag in BLOCK
        return block


def leaves(page: str, known: frozenset[str] | None = None) -> list[Leaf]:
    """The leaf blocks of a page in order, with character references decoded, in time
    proportional to the page's length however its tags nest.  Of the path's features only
    ``known`` ones are kept, if given."""
    out: list[Leaf] = []
    open_ = _Open()
    buffer: list[str] = []
    blank, linked = True, 0
    where: tuple[tuple[str, ...], str] = ((), "")

    def flush() -> None:
        nonlocal linked, blank
        if not blank:
            out.append(Leaf(" ".join("".join(buffer).split()), *where, linked))
        buffer.clear()
        blank, linked = True, 0

    def add(raw: str) -> None:
        nonlocal linked, where, blank
        _, path, hidden, link, block, _ = open_.top()
        if not raw or hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if blank:
            where = (path, block)
        buffer.append(text)
        bare = text.strip()
        blank &= not bare
        if link:
            linked += len(bare)

    def close(place: int) -> None:
        if open_.cut(place):
            flush()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if (place := open_.nearest((tag,))) >= 0:
                close(place)
            elif tag in ("p", "br"):
                flush() if tag == "p" else buffer.append(" ")
            continue
        if tag in INLINE_BREAK:
            buffer.append(" ")
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P and (place := open_.top()[5]) >= 0:
            close(place)
        if tag in IMPLIED:
            shut, scope = IMPLIED[tag]
            while (place := open_.nearest(shut)) > open_.nearest(scope):
                close(place)
                if tag != "tr":
                    break
        if tag in VOID:
            continue
        rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
        words, hidden = _attribute_words(rest) if rest and not rest.isspace() else ((), False)
        before = open_.top()
        path = before[1]
        more = [f"in:{tag}"] if tag in BLOCK and tag not in ("html", "body") else []
        more = [f for f in dict.fromkeys(more + [f"at:{w}" for w in words]) if f not in path and (known is None or f in known)]
        if rest.endswith("/") and tag not in BLOCK and tag not in HIDDEN and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else n
            continue
        open_.push(tag, (*path, *more) if more else path, before[2] or hidden or tag in HIDDEN, before[3] or tag == "a")
    flush()
    return out


def features(blocks: list[Leaf]) -> list[list[str]]:
    """Feature names of every block."""
    out = []
    seen: dict[tuple, list[str]] = {}
    total = len(blocks)
    for i, b in enumerate(blocks):
        if b.path not in seen:
            seen[b.path] = list(dict.fromkeys(b.path))
        text = b.text
        n = len(text)
        tokens = text.split(" ")
        f = [*seen[b.path], "bias", f"tag:{b.parent}", f"len:{min(8, n.bit_length())}", f"words:{min(7, len(tokens).bit_length())}", f"link:{min(4, 5 * b.linked // max(1, n))}"]
        f.append(f"end:{text[-1] in '.!?:,;'}")
        if text[0] == "©" or "©" in text:
            f.append("w:©")
        if n < 240:
            f += [f"w:{w}" for w in dict.fromkeys(WORD.findall(text.lower())) if w in FURNITURE]
        f.append(f"at:third:{3 * i // total}")
        if b.parent in ("h1", "h2", "h3"):
            f.append(f"head:{3 * i // total}")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of a chain field with labels 0 (other) and 1 (main)."""

    emit: dict[str, np.ndarray]
    step: np.ndarray  # 2 x 2, from the label before to this one
    start: np.ndarray

    def __post_init__(self):
        self.known = frozenset(self.emit)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.emit.get(f, zero) for f in r), zero) for r in rows]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels; ties go to other."""
        if not rows:
            return []
        e = self.scores(rows).tolist()
        (a00, a01), (a10, a11) = self.step.tolist()
        s0, s1 = e[0][0] + self.start[0], e[0][1] + self.start[1]
        back = []
        for e0, e1 in e[1:]:
            from0, from1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
            back.append((from0, from1))
            s0, s1 = (s1 + a10 if from0 else s0 + a00) + e0, (s1 + a11 if from1 else s0 + a01) + e1
        label = int(s1 > s0)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]


def _marginals(e: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums: P(label) of each block, and P(pair) summed over the chain."""
    n = len(e)
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    up[0] = e[0] + start
    for i in range(1, n):
        up[i] = e[i] + np.logaddexp(up[i - 1, 0] + step[0], up[i - 1, 1] + step[1])
    for i in range(n - 2, -1, -1):
        x = step + (e[i + 1] + down[i + 1])[None, :]
        down[i] = np.logaddexp(x[:, 0], x[:, 1])
    z = np.logaddexp(*(up[-1]))
    one = np.exp(up + down - z)
    pair = np.exp(up[:-1, :, None] + step[None] + (e[1:] + down[1:])[:, None, :] - z).sum(0)
    return one, pair


def train(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS, rate: float = 0.25, ridge: float = 2e-4, seed: int = 5) -> Field:
    """Adagrad on the conditional log-likelihood, page by page."""
    examples = []
    names: dict[str, int] = {}
    for page, labels in pages:
        blocks = leaves(page)
        if blocks and len(blocks) == len(labels):
            examples.append(([np.array([names.setdefault(f, len(names)) for f in r]) for r in features(blocks)], np.array(labels)))
    w, gw = np.zeros((len(names), 2)), np.full((len(names), 2), 1e-2)
    step, gs = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    start, gt = np.zeros(2), np.full(2, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            rows, y = examples[k]
            e = np.array([w[r].sum(0) for r in rows])
            one, pair = _marginals(e, step, start)
            want = np.eye(2)[y]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            idx = np.concatenate(rows)
            used, inverse = np.unique(idx, return_inverse=True)
            g = np.zeros((len(used), 2))
            np.add.at(g, inverse, np.repeat(want - one, [len(r) for r in rows], axis=0))
            g -= ridge * len(rows) * w[used]
            gw[used] += g * g
            w[used] += rate * g / np.sqrt(gw[used])
            d = seen - pair
            gs += d * d
            step += rate * d / np.sqrt(gs)
            d = want[0] - one[0]
            gt += d * d
            start += rate * d / np.sqrt(gt)
    return Field({f: w[i] for f, i in names.items()}, step, start)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages.draw(TRAIN_PAGES))


def main_text(page: str | None, field: Field) -> str:
    blocks = leaves(page or "", field.known)
    return "\n".join(b.text for b, keep in zip(blocks, field.decode(features(blocks)), strict=True) if keep)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), sent.value) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
