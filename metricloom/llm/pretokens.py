"""The pre-token splits of the public tokenizers, for many texts at once.

Texts become one array of code points; the class of each (letter, number, space, other) comes from a table,
and the borders of pre-tokens from comparisons of neighbours. Two splits are known:

* ``bytes``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``words``: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` after NFC and lower case, space dropped

Strings of special tokens are cut out before, as the library does by default, and become their ids.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from metricloom.llm.textarrays import Spans, U, distinct, mix, slices

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The contractions of both patterns, in the patterns' order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache
def classes() -> np.ndarray:
    """Class of every code point, by the tokenizers library's own patterns."""
    out = np.zeros(0x110000, np.uint8)
    points = np.array([*range(0xD800), *range(0xF900, 0x34000)])       # all others are unassigned, private or marks
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        find = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for low in range(0, len(points), 4000):
            part = points[low:low + 4000]
            for _, (start, end) in find.pre_tokenize_str("".join(map(chr, part.tolist()))):
                out[part[start:end]] = kind
    return out


_FAR = re.compile("[\u0370-\U0010ffff]")
_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def lower(text: str) -> str:
    """NFC and then lower case of each character by itself."""
    if text.isascii():
        return text.lower()
    if not _FAR.search(text):
        return unicodedata.normalize("NFC", text).lower()
    return _NORMAL.normalize_str(text)


@lru_cache
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


@dataclass
class Pretokens:
    """Pre-tokens of a batch: where they start and end in ``text``, their hashes, and their offsets by row.

    ``special`` holds (row, place among the pre-tokens, id): the special tokens that stand before that place.
    """
    text: str
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    special: list[tuple[int, int, int]]


def split(texts: list[str], words: bool, special: dict[str, int]) -> Pretokens:
    """Pre-tokens of all texts; ``words`` chooses the split."""
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    pieces, rows, marks = [], [], []                    # marks: (row, piece before which, id)
    for row, text in enumerate(texts):
        rows.append(len(pieces))
        if cut and "<" in text:
            last = 0
            for m in cut.finditer(text):
                pieces.append(text[last:m.start()])
                marks.append((row, len(pieces), special[m[0]]))
                last = m.end()
            text = text[last:]
        pieces.append(text)
    rows.append(len(pieces))
    if words:
        pieces = list(map(lower, pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    borders = np.concatenate(([0], np.cumsum(lengths)))
    text = "".join(pieces)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = _bounds(points, borders, words)
    spans = Spans(mix((points.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)))
    hashes = spans.hash(starts, ends) if len(starts) else np.zeros(0, U)
    before = np.searchsorted(starts, borders)
    return Pretokens(text, starts, ends, hashes, before[np.array(rows)], [(row, int(before[p]), i) for row, p, i in marks])


def _bounds(points: np.ndarray, borders: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    border = np.zeros(n + 1, bool)
    border[borders] = True
    fresh = np.ones(n, bool)                            # a run of one class starts here
    fresh[1:] = (kind[1:] != kind[:-1]) | border[1:n]
    start = fresh.copy()
    if words:
        start |= kind == NUMBER
    else:
        # the last space of a run that a text follows starts a pre-token of its own, which a blank shares with what follows
        final = np.zeros(n, bool)
        final[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~border[1:n]
        start |= final
        joined = np.flatnonzero(final & (points == 0x20)) + 1
        start[joined] = False
    quotes = np.flatnonzero((points == 0x27) & start)   # only where a match starts, so not after a joined blank
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == LETTER) & ~border[quotes + 1]]
    second = points[quotes + 1]
    third = np.where((quotes + 2 < n) & ~border[np.minimum(quotes + 2, n)], points[np.minimum(quotes + 2, n - 1)], 0)
    size = np.zeros(len(quotes), np.int64)
    for suffix in CONTRACTIONS:
        here = (second == ord(suffix[0])) & (size == 0)
        if len(suffix) == 2:
            here &= third == ord(suffix[1])
        size[here] = 1 + len(suffix)
    quotes, size = quotes[size > 0], size[size > 0]
    start[quotes + 1] = False
    after = quotes + size
    start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if words:
        full = kind[starts] != SPACE
        starts, ends = starts[full], ends[full]
    return starts, ends


def groups(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` characters, or one text: as much as a processor's cache likes."""
    borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return slices(borders, limit)


@lru_cache
def library(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, once per process."""
    return Tokenizer.from_file(path)


def specials(tokenizer: Tokenizer) -> dict[str, int]:
    """Strings and ids of the special tokens."""
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


class Memory:
    """Id lists by the hashes of their pre-tokens, in sorted arrays: some 40 bytes each, where a dictionary takes 300."""

    def __init__(self):
        self.keys, self.begins, self.sizes = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or belongs, and whether it is there."""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == hashes[inner]
        return at, known

    def add(self, hashes: np.ndarray, at: np.ndarray, ids: list[tuple[int, ...]]) -> None:
        """Id lists of new hashes, sorted, that belong at the places ``at``."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[:self.used], np.zeros(max(total, self.used // 2), np.int32)))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        begins = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.keys, self.begins, self.sizes = (np.insert(own, at, fresh) for own, fresh in ((self.keys, hashes), (self.begins, begins), (self.sizes, sizes)))
        self.used += total

    def lists(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the lists at these places, and all their ids."""
        sizes = self.sizes[at].astype(np.int64)
        total = np.cumsum(sizes)
        if not len(total):
            return sizes, np.zeros(0, np.int64)
        return sizes, self.flat[np.repeat(self.begins[at] - total + sizes, sizes) + np.arange(total[-1])].astype(np.int64)


class Encoder:
    """Ids of pre-tokens by the library's merges; each distinct pre-token is merged once while it is remembered."""

    def __init__(self, path: str, words: bool, memory: int = 1 << 20):
        self.tokenizer, self.words, self.memory = library(path), words, memory
        self.model, self.special = self.tokenizer.model, specials(self.tokenizer)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.known = Memory()

    def merge(self, pretoken: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        return tuple([t.id for t in self.model.tokenize(self.spell(pretoken))])

    def spell(self, pretoken: str) -> str:
        """A pre-token in the letters of its bytes."""
        return pretoken.encode("utf-8").decode("latin-1").translate(self.letters)

    def distinct(self, p: Pretokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and ids of the id lists of the distinct pre-tokens of a batch, and which of them each pre-token is."""
        hashes, first, which = distinct(p.hashes)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, first = hashes[order], first[order]
        if len(self.known) > self.memory:
            self.known = Memory()
        at, known = self.known.places(hashes)
        if not known.all():
            new = np.flatnonzero(~known)
            self.known.add(hashes[new], at[new], [self.merge(p.text[a:b]) for a, b in zip(p.starts[first[new]].tolist(), p.ends[first[new]].tolist())])
            at = np.searchsorted(self.known.keys, hashes)
        return *self.known.lists(at), rank[which]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and the offsets of the texts in it."""
        parts = [self._ids(texts[low:high]) for low, high in groups(texts)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sizes = np.concatenate([np.diff(offsets) for _, offsets in parts])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = split(texts, self.words, self.special)
        sizes, flat, which = self.distinct(p)
        return placed(p, which, sizes, flat)


def placed(p: Pretokens, which: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch in order, and its texts' offsets in them, from the ids of its distinct pre-tokens (their
    ``sizes``, and all ids in ``flat``) and from which of these each pre-token is."""
    begins = np.cumsum(sizes) - sizes
    own = sizes[which]
    places = np.concatenate(([0], np.cumsum(own)))
    out = flat[np.repeat(begins[which] - places[:-1], own) + np.arange(places[-1])]
    offsets = places[p.offsets]
    if p.special:
        rows, at, ids = map(np.array, zip(*p.special))
        out = np.insert(out, places[at], ids)
        offsets = offsets + np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))))
    return out, offsets


@lru_cache
def encoder(path: str, words: bool) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path, words)
