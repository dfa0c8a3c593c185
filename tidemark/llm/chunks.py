"""Words of texts for cached tokenisation.

Byte-level BPE never merges across a match of its split pattern, so a text's ids are those of its pieces.
``TextCoder`` cuts whole Arrow columns of texts at places where such a match surely ends, encodes each
distinct piece once a worker, and puts the ids of all texts together by numpy, without a step a word in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The split pattern of the rank files (a fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with a space on the right of other white space, empty lines or unusual white space go through the pattern.
ODD = r"  |\n\n|\n |[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Ids of known pieces that a coder holds, about.
POOL = 24_000_000
#: Marks a piece that has no space before it.
BARE = "\0"

_matches = regex.compile(PATTERN).findall


def pattern_matches(text: str) -> list[str]:
    return _matches(text)


def chunk_of(piece: str) -> str:
    """The text of a piece: a space stands before it, unless it is marked as bare."""
    return piece[1:] if piece[:1] == BARE else " " + piece


class Cached:
    """Values by key. ``make(keys)`` gives the values of unseen keys; the cache is emptied when it passes
    ``limit`` entries, which bounds its memory and never changes a result."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = 600_000, longest: int = 64):
        self.make, self.limit, self.longest, self.known = make, limit, longest, {}

    def __call__(self, lists: list[list[str]]) -> list[list]:
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        fresh = list({c for x in lists for c in x if c not in known})
        if fresh:
            known.update(zip(fresh, self.make(fresh), strict=True))
        out = [list(map(known.__getitem__, x)) for x in lists]
        for c in fresh:
            if len(c) > self.longest:
                del known[c]
        return out


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of runs of these sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class TextCoder:
    """Ids of whole columns of texts.

    ``encode(pieces)`` gives the ids of unseen pieces as little-endian unsigned 32-bit integers. ``spaced``:
    a space before a word belongs to it, as in byte-level vocabularies; else white space only parts words,
    and ASCII letters of Latin-1 texts are lower-cased before they are looked up. Beyond ``limit`` known
    pieces, those that most calls had stay known, half of ``limit`` at most; what is forgotten is encoded
    again where it comes back, which bounds the memory and never changes a result.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spaced: bool, limit: int = 1_000_000, longest: int = 64):
        self.encode, self.spaced, self.limit, self.longest = encode, spaced, limit, longest
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {"": 0} | ({BARE: 0} if self.spaced else {})
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.calls = np.zeros(1 << 12, np.int64)
        self.count = 1

    def _forget(self) -> None:
        """Drops the pieces that one call had only, and of the others those of the fewest calls."""
        calls = self.calls[: self.count]
        calls[0] = 0
        kept = calls > 1
        if kept.sum() > self.limit // 2:
            top = np.argsort(calls, kind="stable")[self.count - self.limit // 2 :]
            kept[:] = False
            kept[top] = True
        sizes = self.sizes[: self.count][kept]
        if int(sizes.sum()) > POOL // 2:
            return self._reset()
        flat = self.pool[ragged(self.starts[: self.count][kept], sizes)]
        places = np.where(kept, np.cumsum(kept), 0).tolist()
        known = {p: places[n] for p, n in self.known.items() if places[n]}
        calls = calls[kept] // 2
        self._reset()
        self.known.update(known)
        self._add(flat, sizes)
        self.calls[1 : self.count] = calls

    def _store(self, values: list[bytes]) -> None:
        self._add(np.frombuffer(b"".join(values), "<u4"), np.array([len(v) >> 2 for v in values], np.int64))

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Appends values: their ids, one after the other, and their sizes."""
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.starts) < self.count + len(sizes):
            self.starts, self.sizes, self.calls = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.calls))
        at = slice(self.count, self.count + len(sizes))
        self.pool[self.used : self.used + len(flat)] = flat
        self.sizes[at] = sizes
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(flat), self.count + len(sizes)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; unseen ones are encoded. A match surely ends between a letter and a last
        comma or full stop, so that the piece before it may be known already."""
        known = self.known
        fresh = list({p for p in pieces if p not in known})
        if fresh:
            parted = [p for p in fresh if p[-1] in ",." and "A" <= p[-2:-1] < "\u0100" and p[-2].isalpha()] if self.spaced else []
            apart = set(parted)
            whole = [p for p in fresh if p not in apart] if apart else fresh
            first = self.count
            self._store(self.encode(whole))
            known.update(zip(whole, range(first, first + len(whole)), strict=True))
            if parted:
                both = np.empty(2 * len(parted), np.int64)
                both[::2] = self._numbers([p[:-1] for p in parted])
                both[1::2] = self._numbers([BARE + p[-1] for p in parted])
                sizes = self.sizes[both]
                first = self.count
                self._add(self.pool[ragged(self.starts[both], sizes)], sizes[::2] + sizes[1::2])
                known.update(zip(parted, range(first, first + len(parted)), strict=True))
        out = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        self.calls[out] += 1
        for p in fresh:
            if len(p) > self.longest:
                del known[p]
        return out

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, and how many each text has."""
        if self.spaced:  # a line feed between others than white space is a match of its own
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}"), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        flat, edges = lists.flatten(), lists.offsets.to_numpy()
        edges = edges - edges[0]
        coded = flat.dictionary_encode()
        numbers = self._numbers(strings(coded.dictionary))[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        if self.spaced and len(flat):
            heads = edges[:-1][np.diff(edges) > 0]
            empty = (coded.dictionary.to_numpy(zero_copy_only=False) == "")[coded.indices.to_numpy()]
            empty[heads] = False
            if empty.any():  # behind the first piece, an empty one is a space with nothing behind it
                numbers[empty] = self._numbers([BARE + " "])[0]
            numbers[heads] = self._numbers([BARE + x if x else "" for x in strings(flat.take(pa.array(heads)))])
        return numbers, np.diff(edges)

    def _matched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [[BARE + x for x in _matches(t)] for t in texts]
        return self._numbers([x for own in lists for x in own]), np.array([len(x) for x in lists], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if len(self.known) > self.limit or self.used > POOL:
            self._forget()
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.spaced:
            odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
            if odd.any():
                plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
                a, na = self._pieces(texts.take(pa.array(plain)))
                b, nb = self._matched(strings(texts.take(pa.array(rest))))
                sizes, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
                sizes[plain], sizes[rest] = na, nb
                starts[plain], starts[rest] = np.cumsum(na) - na, len(a) + np.cumsum(nb) - nb
                numbers = np.concatenate([a, b])[ragged(starts, sizes)]
            else:
                numbers, sizes = self._pieces(texts)
        else:
            wide = pc.match_substring_regex(texts, r"[^\x{00}-\x{ff}]")
            numbers, sizes = self._pieces(pc.if_else(wide, texts, pc.ascii_lower(texts)))
        own = self.sizes[numbers]
        ids = self.pool[ragged(self.starts[numbers], own)]
        ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(sizes)]
        return ids, np.diff(np.concatenate([[0], ends]))
