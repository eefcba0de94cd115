"""BPE encoding and decoding by speculation and verification.

A word's tokens are guessed by greedy longest match over the vocabulary. The guess is
the merge result if every token merges to itself and, for every adjacent pair, merging
the two tokens' characters leaves exactly these two: no earlier merge crosses the
boundary. All pairs of a batch of new words are tested at once in numpy. Only words
with a failing pair go through the merges, one merge of each word at a time, or long words
one by one from a heap.

The vocabulary is a file of the ``tokenizers`` library with byte-level BPE and an end of
word suffix, its path a parameter. Words between white space are encoded once and kept
while CACHE_SPANS allows; the limits bound memory, not results.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
CACHE_SPANS = 250_000
CACHE_PIECES = 150_000
LEARN_SPANS = 25_000
LONG = 64  #: A failing word of more letters is merged alone, by a heap.

#: Fixed values of the tokenizer's format: its word pattern and the white space it drops.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_NOT_WHITE = re.compile(f"[^{WHITE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() drops these, the tokenizer does not


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """A word-level BPE vocabulary with its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * n
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.letters = byte_letters()
        self.longest = max(map(len, self.ids))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        # Of each token the merge that makes it; letters have none and rank -1.
        self.made, self.left, self.right = np.full(n, -1), np.arange(n), np.arange(n)
        pairs = np.empty(len(merges), np.int64)
        self.product = np.array([self.ids[a + b] for a, b in merges])
        for r, (a, b) in enumerate(merges):
            i, x, y = self.ids[a + b], self.ids[a], self.ids[b]
            self.made[i], self.left[i], self.right[i], pairs[r] = r, x, y, x * n + y
        self.pair_order = np.argsort(pairs)
        self.pair_codes = pairs[self.pair_order]
        self.pair_rank = dict(zip(pairs.tolist(), range(len(merges)), strict=True))
        self.size = n
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.pieces: dict[str, bytes] = {}
        self.exact_merges = 0
        spelled = [t.encode("utf-8") for t in self.tokens]
        self.spelling = np.frombuffer(b"".join(t + b" " for t in spelled), np.uint8)
        self.spelled_end = np.cumsum([len(t) + 1 for t in spelled])
        self.spelled_size = np.array([len(t) + 1 for t in spelled])

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges one by one: lowest rank first, leftmost of equal ranks."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, word: str) -> list[str]:
        """Letters of a word's bytes, the suffix on the last."""
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.suffix
        return letters

    def exact(self, new: list[str]) -> list[list[int]]:
        """Token ids of words by the merges: in each round every word makes its next one."""
        out: list[list[int]] = [[] for _ in new]
        spelled = [self.symbols(w) for w in new]
        by_length: dict[int, list[int]] = {}
        for i, letters in enumerate(spelled):
            if len(letters) > LONG:
                out[i] = self.merged_long([self.ids[c] for c in letters])
            else:
                by_length.setdefault(-(-len(letters) // 8), []).append(i)
        for members in by_length.values():
            live = np.array(members)
            width = max(len(spelled[i]) for i in members)
            rows = np.array([[self.ids[c] for c in spelled[i]] + [-1] * (width - len(spelled[i])) for i in members])
            ranks = np.full(rows.shape, 1 << 40)
            ranks[:, :-1] = np.where(rows[:, 1:] >= 0, self._ranks(rows[:, :-1], rows[:, 1:]), 1 << 40)
            place = np.arange(width)
            while len(live):
                at = ranks.argmin(1)
                every = np.arange(len(live))
                going = ranks[every, at] < 1 << 40
                for i, row in zip(live[~going].tolist(), rows[~going].tolist(), strict=True):
                    out[i] = [t for t in row if t >= 0]
                live, rows, ranks, at = live[going], rows[going], ranks[going], at[going]
                if not len(live):
                    break
                every = every[: len(live)]
                token = self.product[ranks[every, at]]
                after = np.minimum(place + (place > at[:, None]), width - 1)
                rows, ranks = np.take_along_axis(rows, after, 1), np.take_along_axis(ranks, after, 1)
                rows[:, -1] = -1
                ranks[:, -1] = 1 << 40
                rows[every, at] = token
                for side in (0, -1):
                    x = at + side
                    ok = (x >= 0) & (x + 1 < width)
                    r, x = every[ok], x[ok]
                    ranks[r, x] = np.where(rows[r, x + 1] >= 0, self._ranks(rows[r, x], rows[r, x + 1]), 1 << 40)
        return out

    def merged_long(self, ids: list[int]) -> list[int]:
        """Ids of one word after its merges, in about linear time: the next merge comes from a heap, neighbours from links."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        row = np.array(ids)
        ranks = self._ranks(row[:-1], row[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks < 1 << 40)]
        heapq.heapify(heap)
        product, pairs = self.product, self.pair_rank
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] * self.size + ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = int(product[rank]), -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := pairs.get(ids[i] * self.size + ids[j])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] * self.size + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; the suffix belongs to the last letter."""
        text = "".join(self.letters[b] for b in word.encode("utf-8"))
        out, at, n, ids = [], 0, len(text), self.ids
        while at < n:
            if n - at <= self.longest and (i := ids.get(text[at:] + self.suffix)) is not None:
                out.append(i)
                break
            for end in range(min(n - 1, at + self.longest), at, -1):
                if (i := ids.get(text[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def _is_whole(self, token: int) -> bool:
        if token not in self.whole:
            text = self.tokens[token]
            ended = text.endswith(self.suffix) and len(text) > len(self.suffix)
            letters = [*text.removesuffix(self.suffix)] if ended else [*text]
            if ended:
                letters[-1] += self.suffix
            self.whole[token] = self.merged(letters) == [text]
        return self.whole[token]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs; a huge one where there is none."""
        code = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_order[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of ``a`` and ``b`` together gives back ``a`` and ``b``.

        The newest merge beside the boundary is undone again and again. Whenever the two
        parts that then touch have a merge of their own, it must not come before the merge
        that was undone last: of equal ranks the left one comes first, so a merge across
        the boundary loses a tie to the left token and wins it against the right one.
        """
        a, b, good, live = a.copy(), b.copy(), np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 39)
        while len(live):
            x, y = a[live], b[live]
            bad = self._ranks(x, y) < limit[live]
            good[live[bad]] = False
            rx, ry = self.made[x], self.made[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live], b[live] = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good

    def encode_words(self, new: list[str]) -> list[list[int]]:
        """Token ids of words of the pattern, none empty."""
        guesses = [self.greedy(w) for w in new]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(new)), lengths)
        inner = np.flatnonzero(word[1:] == word[:-1])
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        known = np.fromiter((self.fits.get(c, -1) for c in codes.tolist()), np.int8, len(codes))
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            known[fresh] = self.compatible(codes[fresh] // self.size, codes[fresh] % self.size)
            if len(self.fits) > CACHE_PIECES:
                self.fits.clear()
            self.fits.update(zip(codes[fresh].tolist(), known[fresh].tolist(), strict=True))
        failing = set(word[inner[known[back] == 0]].tolist())
        tokens, at = np.unique(flat, return_inverse=True)
        odd = ~np.fromiter(map(self._is_whole, tokens.tolist()), bool, len(tokens))
        failing.update(word[odd[at]].tolist())
        self.exact_merges += len(failing)
        wrong = sorted(failing)
        for i, ids in zip(wrong, self.exact([new[i] for i in wrong]), strict=True):
            guesses[i] = ids
        return guesses

    def learn(self, spans: list[str]) -> None:
        """Cache the packed ids of spans between white space."""
        split = [[s.lower()] if s.isascii() and s.isalpha() else PIECE.findall(lowered(unicodedata.normalize("NFC", s))) for s in spans]
        new = list({p for ps in split for p in ps}.difference(self.pieces))
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
            new = list({p for ps in split for p in ps})
        if new:
            self.pieces.update(zip(new, (np.array(ids, "<u4").tobytes() for ids in self.encode_words(new)), strict=True))
        self.cache.update((s, self.pieces[ps[0]] if len(ps) == 1 else b"".join(map(self.pieces.__getitem__, ps))) for s, ps in zip(spans, split, strict=True))

    def spans(self, text: str) -> list[str]:
        """The parts of a text between white space; its special tokens are parts of their own."""
        if self.split_special and "<|" in text:
            parts = self.split_special.split(text)
            return [s for p in parts for s in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return _NOT_WHITE.findall(text) if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of whole texts."""
        if len(self.cache) > CACHE_SPANS:
            self.cache.clear()
            self.cache.update((t, np.array([i], "<u4").tobytes()) for t, i in self.special.items())
        split = [self.spans(t) for t in texts]
        fresh = list(set().union(*split).difference(self.cache))
        for lo in range(0, len(fresh), LEARN_SPANS):
            self.learn(fresh[lo : lo + LEARN_SPANS])
        return [b"".join(map(self.cache.__getitem__, spans)) for spans in split]

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the tokens of packed ids with a space between, as the library does where a file names no decoder."""
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        size = self.spelled_size[ids]
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(self.spelled_end[ids] - stop, size)
        return self.spelling[at].tobytes()[:-1]


def lowered(text: str) -> str:
    """Lower case letter by letter, so a final capital sigma is no exception."""
    return text.replace("Σ", "σ").lower()


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and decoded.

    Null and empty texts have no tokens and decode to the empty string. Texts and words of any
    length are encoded whole, in time about linear in the length. Repeated rows give
    repeated rows; extra columns are ignored; an empty table gives an empty table.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lo = 0
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                packed = vocab.encode([t or "" for t in part.column(1).to_pylist()])
                decoded = [vocab.decode(p) for p in packed]
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(packed, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
