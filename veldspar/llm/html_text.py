"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is scanned once for tags; the text between block-level tags, inline markup aside, is
a leaf block. A block's features are its ancestors' tags and class or id words, and the length, links and signs
of its text. Weights of features and of label pairs of neighbouring blocks maximise the
likelihood of labelled pages; a page is decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.labelled_pages import Page, pages

TRAIN_PAGES = 400
STEPS = 150
PENALTY = 1e-3
OUTPUT_BYTES = 8 << 20

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE |= frozenset("svg g path rect circle ellipse line polyline polygon text tspan textpath defs use symbol marker mask pattern lineargradient radialgradient stop clippath desc animate".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped up to the closing tag: their content is not markup.
RAW = frozenset("script style textarea title iframe".split())
#: An opening tag of the key ends an open element of the value's tags, up to the nearest other block.
ENDS = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}

#: Quotes hold a tag open where they begin a value; what else they stand for is of no account.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+)>|<[!?/][^>]*>""", re.S)
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_PARTS = re.compile(r"[A-Za-z][a-z]*")


@dataclass
class Block:
    """A leaf block: its text, the features of its ancestors, and how many of its characters are links."""

    text: str
    above: tuple[str, ...]
    linked: int


@dataclass
class _Open:
    tag: str
    features: tuple[str, ...]


def _own_features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"tag:{tag}", *(["tag:form"] if tag == "select" else [])]  # a control of a form, wherever it stands
    for m in _NAMED.finditer(attributes):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out += [f"word:{w.lower()}" for w in _PARTS.findall(value)]
    return tuple(dict.fromkeys(out))


@dataclass
class _Scan:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)  # of the open elements
    above: Counter = field(default_factory=Counter)  # features of the open elements
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    link_depth: int = 0

    def flush(self) -> None:
        if self.pieces:
            text = _SPACE.sub(" ", html.unescape("".join(self.pieces))).strip(" ")
            if text:
                own = f"own:{self.stack[-1].tag}" if self.stack else "own:"
                self.blocks.append(Block(text, (*self.above, own), min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append(raw)
            if self.link_depth:
                self.linked += len(raw)

    def pop(self) -> str:
        last = self.stack.pop()
        self.tags[last.tag] -= 1
        for f in last.features:
            self.above[f] -= 1
            if not self.above[f]:
                del self.above[f]
        return last.tag

    def close(self, tag: str) -> None:
        while self.tags[tag] and self.pop() != tag:
            pass

    def open(self, tag: str, attributes: str) -> None:
        ends = ENDS.get(tag, {"p"})
        while self.stack and self.stack[-1].tag in ends:
            self.pop()
        if tag not in ("option", "optgroup", "hr"):  # nothing else stands in a select
            self.close("select")
        if tag not in VOID:
            self.stack.append(_Open(tag, _own_features(tag, attributes)))
            self.tags[tag] += 1
            self.above.update(self.stack[-1].features)


class _Tags:
    """Tags of a page, found from left to right in linear time.

    A tag that does not end before the page does is text. It has then been read to the end,
    and so fails each tag that begins within it but in none of its quoted values; ``failed``
    keeps where those begin and end.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.failed: list[tuple[list[int], list[int]]] = []

    def after(self, at: int) -> re.Match | None:
        """The first tag that begins at ``at`` or behind it."""
        while 0 <= (at := self.source.find("<", at)):
            comment = self.source.startswith(("<!--", "<![CDATA["), at)
            if at > self.last and not comment:
                at += 1
                continue
            if comment or not any((k := bisect_right(begins, at)) == 0 or ends[k - 1] <= at for begins, ends in self.failed):
                if m := _TAG.match(self.source, at):
                    return m
                if re.match("</?[a-zA-Z]", self.source[at : at + 3]):
                    values = [m.span() for m in _VALUE.finditer(self.source, at)]
                    self.failed.append(([a for a, _ in values], [b for _, b in values]))
            at += 1
        return None


def leaf_blocks(source: str) -> list[Block]:
    """Non-empty leaf blocks of a page in order. Markup that never closes ends with the page."""
    scan, tags, at, n = _Scan(), _Tags(source), 0, len(source)
    while at < n:
        m = tags.after(at)
        if not m:
            scan.text(source[at:])
            break
        scan.text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "head":  # may lack its closing tag; what may stand in it has no text but that of RAW
            scan.flush()
        elif tag in RAW:
            if not closing and not (tag in ("title", "style") and m[3].endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = source.find(">", end.end()) + 1 or n if end else n
        elif tag == "a":
            scan.link_depth = 0 if closing else 1
        elif tag == "br":
            scan.text(" ")
        elif tag in INLINE and not (tag == "ins" and "class" in m[3]) and tag != "label":
            continue
        else:
            scan.flush()
            if closing:
                scan.close(tag)
            else:
                scan.open(tag, m[3])
    scan.flush()
    return scan.blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for b in blocks:
        n, words = len(b.text), b.text.count(" ") + 1
        marks = sum(map(b.text.count, ",.;:!?"))
        own = [*b.above, f"length:{min(int(np.log2(n + 1)), 11)}", f"links:{int(4 * b.linked / n)}", f"words:{min(words, 4)}", f"marks:{min(int(20 * marks / words), 6)}", f"end:{b.text[-1] if b.text[-1] in '.!?:' else 'other'}"]
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("copyright")
        out.append([*own, "any"])
    return out


@dataclass
class Field:
    """Weights of features for the label 1, and of neighbouring labels."""

    weights: dict[str, float]
    pairs: np.ndarray

    def labels(self, rows: list[list[str]]) -> list[bool]:
        """The most likely labels of a page's blocks; of equal paths the one with fewer ones at the end."""
        if not rows:
            return []
        best, back = [0.0, 0.0], []
        pairs = self.pairs.tolist()
        for k, row in enumerate(rows):
            unary = (0.0, sum(self.weights.get(f, 0.0) for f in row))
            step, come = [], []
            for y in (0, 1):
                ways = [best[x] + (pairs[x][y] if k else 0.0) for x in (0, 1)]
                come.append(int(ways[1] > ways[0]))
                step.append(max(ways) + unary[y])
            best = step
            back.append(come)
        y = int(best[1] > best[0])
        out = []
        for come in reversed(back):
            out.append(bool(y))
            y = come[y]
        return out[::-1]


def fit(labelled: list[Page], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximise the penalised log-likelihood of labelled pages by Adam steps over all of them.

    Blocks are matched with the labelled parts in order; features seen once are left out.
    """
    rows, labels = [], []
    for source, parts in labelled:
        blocks = leaf_blocks(source)
        if [b.text for b in blocks] != [_SPACE.sub(" ", html.unescape(t)).strip(" ") for t, _ in parts]:
            continue
        rows.append(features(blocks))
        labels.append([y for _, y in parts])
    counts: dict[str, int] = {}
    for page in rows:
        for f in {f for r in page for f in r}:
            counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c > 1))}
    longest = max(map(len, rows))
    x = np.zeros((len(rows), longest, len(names)), np.float32)
    y, live = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    for p, (page, ys) in enumerate(zip(rows, labels, strict=True)):
        for k, (r, label) in enumerate(zip(page, ys, strict=True)):
            x[p, k, [names[f] for f in r if f in names]] = 1
            y[p, k], live[p, k] = label, True
    both = live[:, 1:] & live[:, :-1]
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    flat = x.reshape(-1, len(names))
    for step in range(1, steps + 1):
        unary = np.stack([np.zeros(y.shape), (flat @ w.astype(np.float32)).reshape(y.shape)], -1)
        alpha, beta = unary.copy(), np.zeros(unary.shape)
        for k in range(1, longest):
            came = np.logaddexp.reduce(alpha[:, k - 1, :, None] + pairs[None], axis=1) + unary[:, k]
            alpha[:, k] = np.where(live[:, k, None], came, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            goes = np.logaddexp.reduce(pairs[None] + (unary[:, k + 1] + beta[:, k + 1])[:, None], axis=2)
            beta[:, k] = np.where(live[:, k + 1, None], goes, 0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        chance = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * live
        pair = np.exp(alpha[:, :-1, :, None] + pairs[None, None] + (unary[:, 1:] + beta[:, 1:])[:, :, None] - total[:, None, None, None])
        expected = (pair * both[..., None, None]).sum((0, 1))
        grad = np.concatenate([flat.T @ ((y - chance) * live).reshape(-1).astype(np.float32), (seen - expected).ravel()]) / len(rows)
        grad -= penalty * np.concatenate([w, pairs.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[:-4], pairs + move[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in names.items()}, pairs)


@functools.cache
def trained(n: int = TRAIN_PAGES, seed: int = 1) -> Field:
    """The field fitted to ``n`` labelled pages."""
    return fit(pages(n, seed))


def main_text(source: str, model: Field) -> str:
    """The article's blocks, two line feeds between them."""
    blocks = leaf_blocks(source)
    return "\n\n".join(b.text for b, keep in zip(blocks, model.labels(features(blocks)), strict=True) if keep)


def extract(table: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text.

    Null or empty html, and pages without an article, give the empty text. Pages are read
    whole, in time about linear in the length, however broken their markup. Repeated rows
    give repeated rows; extra columns are ignored; an empty table gives an empty table.
    """
    model = model or trained()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, done = [], 0, 0
            for source in batch.column(2):
                out.append(main_text(source.as_py() or "", model))
                size += len(out[-1])
                if size > OUTPUT_BYTES or done + len(out) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(out)), batch.column(1).slice(done, len(out)), pa.array(out, pa.string())], ["page_id", "url", "text"])
                    done, out, size = done + len(out), [], 0

    kinds = [table.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return table.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string")
