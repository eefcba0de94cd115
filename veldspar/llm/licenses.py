"""License notices in texts, misspelt ones included: exact seeds, then bounded-error matching.

A notice is a short phrase. A run of words that is at most k edits away from it keeps at least one
of any k + 1 pieces of the phrase letter for letter (the pigeonhole rule). One automaton finds the
pieces of all notices in one pass over the words of a slice of documents; where a piece stands tells
where the run must begin, give or take what k edits can add or take away, and only runs of words that begin and end there
are matched with the regex library's error bound. Nothing reaches beyond one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.textkit import slices, text_bytes


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words and its label. Up to ``errors`` edits are allowed, none of them in the words ``fixed``."""

    label: str
    phrase: str
    errors: int = 0
    fixed: tuple[str, ...] = ()


#: Phrases that are counted where they stand word for word.
BASE = (Notice("mit", "under the mit license"), Notice("apache-2", "apache license version 2"), Notice("cc-by-nc", "cc by nc"))
#: Notices that are looked for with errors. Versions and letters that tell licenses apart are fixed.
NOTICES = (
    Notice("mit", "under the mit license", 3, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge", 6, ("permission",)),
    Notice("apache-2", "apache license version 2", 3, ("2",)),
    Notice("cc-by-nc", "cc by nc", 1, ("nc",)),
    Notice("cc-by-sa", "cc by sa", 1, ("sa",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 5, ()),
    Notice("cc-by-sa", "creative commons attribution sharealike", 5, ()),
    Notice("cc0", "creative commons zero", 2, ()),
    Notice("gpl", "gnu general public license", 3, ("gnu",)),
    Notice("gpl-2", "gnu general public license version 2", 4, ("gnu", "2")),
    Notice("gpl-3", "gnu general public license version 3", 4, ("gnu", "3")),
    Notice("lgpl", "gnu lesser general public license", 4, ("gnu",)),
    Notice("agpl", "gnu affero general public license", 4, ("gnu",)),
    Notice("mpl-2", "mozilla public license version 2", 4, ("2",)),
    Notice("epl", "eclipse public license", 2, ()),
    Notice("bsd", "redistribution and use in source and binary forms", 6, ()),
    Notice("bsd-2-clause", "bsd 2 clause license", 2, ("bsd", "2")),
    Notice("bsd-3-clause", "bsd 3 clause license", 2, ("bsd", "3")),
)

SPAN = "label string, first_word bigint, n_words bigint, start bigint, end bigint, text string, errors int"
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
#: Most bytes that an edit can add.
WIDEST = 4
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


@dataclass
class Slice:
    """Documents ``lo`` to ``hi`` as one text: lower-cased words, a space between two, a line feed around each document."""

    text: str  # one character a byte
    begin: np.ndarray  # where each word begins in the text
    end: np.ndarray
    source: np.ndarray  # where it begins in the bytes of the slice
    source_end: np.ndarray
    first: np.ndarray  # words of documents, as first[d] : first[d + 1]
    bounds: np.ndarray
    data: np.ndarray

    def doc(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Slice:
    """Words are runs of digits, ASCII letters and bytes from 0x80 on; A to Z become lower case."""
    bounds = offsets[lo : hi + 1] - offsets[lo]
    part = data[offsets[lo] : offsets[hi]]
    small = part | ((part - np.uint8(ord("A"))) < 26).view(np.uint8) * np.uint8(32)
    inside = _IS_WORD[part]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(part))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    source, source_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = source_end - source
    first = np.searchsorted(source, bounds)
    begin = 1 + np.cumsum(size + 1) - size - 1
    out = np.full(1 + int(size.sum()) + len(size), 0x20, np.uint8)
    out[0] = 0x0A
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + 1, size)] = small[inside]
    last = first[1:][first[1:] > first[:-1]] - 1
    out[begin[last] + size[last]] = 0x0A
    return Slice(out.tobytes().decode("latin-1"), begin, begin + size, source, source_end, first, bounds, part)


def places(text: str, phrase: str) -> list[int]:
    """Where the phrase stands as whole words, overlaps included."""
    out, at = [], text.find(phrase)
    while at >= 0:
        if text[at - 1] in " \n" and text[at + len(phrase)] in " \n":
            out.append(at)
        at = text.find(phrase, at + 1)
    return out


@dataclass
class Finder:
    """The pieces of all notices in one automaton, and a matcher for each notice."""

    notices: tuple[Notice, ...]
    pieces: list[tuple[int, int]] = field(default_factory=list)  # notice, place in its phrase

    def __post_init__(self) -> None:
        at: dict[str, list[int]] = {}
        for k, n in enumerate(self.notices):
            cuts = np.linspace(0, len(n.phrase), n.errors + 2).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    raise ValueError(f"more errors than letters: {n.phrase}")
                at.setdefault(n.phrase[a:b], []).append(len(self.pieces))
                self.pieces.append((k, a))
        self._seeds = ahocorasick.Automaton()
        for piece, numbers in at.items():
            self._seeds.add_word(piece, (len(piece), tuple(numbers)))
        self._seeds.make_automaton()
        self._match = [regex.compile(rf"(?b)(?:{regex.escape(n.phrase, special_only=True)}){{e<={n.errors}}}") for n in self.notices]

    def runs(self, found: Slice) -> Iterator[tuple[int, int, int]]:
        """Runs of words (notice, first word, last word) that a seed allows, each once."""
        hits: dict[int, list[int]] = {}
        for end, (size, numbers) in self._seeds.iter(found.text):
            for p in numbers:
                hits.setdefault(p, []).append(end - size + 1)
        seen: dict[int, list[np.ndarray]] = {}
        for p, at in hits.items():
            k, place = self.pieces[p]
            n = self.notices[k]
            about = np.array(at) - place
            lo, hi = np.searchsorted(found.begin, about - WIDEST * n.errors), np.searchsorted(found.begin, about + n.errors, side="right")
            seen.setdefault(k, []).append(_ranges(lo, hi))
        for k, firsts in seen.items():
            n = self.notices[k]
            first = np.unique(np.concatenate(firsts))
            about = found.begin[first] + len(n.phrase)
            lo, hi = np.searchsorted(found.end, about - n.errors), np.searchsorted(found.end, about + WIDEST * n.errors, side="right")
            pair = np.stack([np.repeat(first, hi - lo), _ranges(lo, hi)], 1)
            pair = pair[pair[:, 1] >= pair[:, 0]]
            pair = pair[found.doc(pair[:, 0]) == found.doc(pair[:, 1])]
            yield from ((k, i, j) for i, j in pair.tolist())

    def matches(self, found: Slice) -> list[tuple[int, int, int, int]]:
        """Notices found: (notice, first word, last word, errors). Of runs of one notice that overlap, the one of fewest errors, then the first, then the shortest."""
        good: dict[int, list[tuple[int, int, int]]] = {}
        for k, i, j in self.runs(found):
            n = self.notices[k]
            run = found.text[found.begin[i] : found.end[j]]
            if n.fixed and not set(n.fixed) <= set(run.split(" ")):
                continue
            m = self._match[k].fullmatch(run.encode("latin-1").decode("utf-8", "replace"))
            if m:
                good.setdefault(k, []).append((i, j, sum(m.fuzzy_counts)))
        out = []
        for k, spans in good.items():
            best, reach = None, -1
            for i, j, e in sorted(spans):
                if i > reach and best:
                    out.append((k, best[1], best[2], best[0]))
                    best = None
                reach = max(reach, j)
                best = min(best or (e, i, j), (e, i, j))
            out.append((k, best[1], best[2], best[0]))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo : hi, one after the other."""
    size = np.maximum(hi - lo, 0)
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _scanned(found: Slice, finder: Finder, base: tuple[Notice, ...]) -> list[tuple]:
    n_docs = len(found.bounds) - 1
    starts: list[list[int]] = [[] for _ in range(n_docs)]
    known: list[set[str]] = [set() for _ in range(n_docs)]
    labels: list[set[str]] = [set() for _ in range(n_docs)]
    score = [0.0] * n_docs
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    for n in base:
        word = np.searchsorted(found.begin, places(found.text, n.phrase))
        for d, w in zip(found.doc(word).tolist(), word.tolist(), strict=True):
            starts[d].append(w)
            known[d].add(n.label)
            score[d] = 1.0
    for k, i, j, errors in finder.matches(found):
        n, d = finder.notices[k], int(found.doc(np.array(i)))
        text = found.data[found.bounds[d] : found.bounds[d + 1]]
        a, b = int(found.source[i] - found.bounds[d]), int(found.source_end[j] - found.bounds[d])
        letters = lambda x: int(((x & 0xC0) != 0x80).sum())  # noqa: E731  code points, not bytes
        begin = letters(text[:a])
        spans[d].append({"label": n.label, "first_word": i - int(found.first[d]), "n_words": j - i + 1, "start": begin, "end": begin + letters(text[a:b]), "text": text[a:b].tobytes().decode("utf-8", "replace"), "errors": errors})
        labels[d].add(n.label)
        score[d] = max(score[d], 1 - errors / len(n.phrase))
    n_words = np.diff(found.first).tolist()
    rows = []
    for d in range(n_docs):
        at = [w - int(found.first[d]) for w in starts[d]]
        rows.append((n_words[d], len(at), min(at, default=None), max(at, default=None), ",".join(sorted(known[d])), ",".join(sorted(known[d] | labels[d])), score[d], spans[d]))
    return rows


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base: tuple[Notice, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Texts are read whole, however long; a null text counts as empty. n_base counts all places where a
    phrase of ``base`` stands word for word, first_word and last_word are the smallest and the
    largest of them (words from 0, null without any). ``spans`` has every run of whole words that is
    within a notice's errors and holds its fixed words: label, words, start and end as code points of
    the text, the text itself and its errors. Of runs of one notice that overlap, the one of fewest
    errors stays, of equals the first, then the shortest. Labels are distinct, sorted and joined by a
    comma; score is the largest share of a phrase that is right: 1 for an exact one, 0 without any.
    Repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty table.
    """
    finder_of = lambda: Finder(notices)  # noqa: E731  an automaton is built in the task

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                rows = _scanned(words_of(data, offsets, lo, hi), finder, base)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ', ')}>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanned, schema)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("errors", pa.int32())]))
