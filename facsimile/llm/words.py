"""Words of many texts at once: their places and hashes, as arrays."""

from __future__ import annotations

from typing import Iterator

import numpy as np

from facsimile.llm.rolling import BUFFER, U, mix, prefix_sums, substring_hash

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, row, begin, end) of the words of rows of UTF-8 text: what ASCII white space separates, A-Z in lower case."""
    raw = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # words end with their row
    space = SPACES[raw]
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1] | edge[1:-1]
    closes[:-1] &= space[1:] | edge[1:-1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return LOWER[raw], np.searchsorted(offsets, begin, side="right") - 1, begin, end


def word_hashes(lowered: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words at sorted places, buffer by buffer; they depend on the word alone."""
    out = np.zeros(len(begin), U)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + BUFFER, side="right")))
        base = begin[i]
        if j == i + 1 and end[i] - base > BUFFER:  # a word longer than a buffer: hash of its pieces' hashes
            whole = U(0)
            for at in range(base, end[i], BUFFER):
                piece = lowered[at : min(at + BUFFER, end[i])]
                whole = mix(np.array([whole + U(1)]) ^ substring_hash(prefix_sums(piece), np.array([0]), np.array([len(piece)])))[0]
            out[i] = whole
        else:
            out[i:j] = mix(substring_hash(prefix_sums(lowered[base : end[j - 1]]), begin[i:j] - base, end[i:j] - base))
        i = j
    return out


LONGEST_SHORT = 7  # bytes of a word that is its own key
LONG = 0xFF << 56
KEPT_BYTES = 64 << 20


class Numbered(dict):
    """Byte strings under consecutive numbers, given when they are first asked for."""

    def __init__(self) -> None:
        self.kept_bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.kept_bytes += len(word)
        return number


class WordTable:
    """Token ids of words: sorted keys, and for each the place and number of its ids.

    A key stands for one word: its bytes and their number if they fit eight bytes, and
    beyond that the number under which the table keeps the word's bytes.
    """

    def __init__(self) -> None:
        self.key, self.at, self.n = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.long = Numbered()

    def full(self, words: int) -> bool:
        """Whether more than ``words`` entries or too many bytes are held; keys of a new table are other ones."""
        return len(self.key) > words or self.long.kept_bytes > KEPT_BYTES

    def keys(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The keys of the words at these places."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = end - begin
        bits = np.minimum(size, LONGEST_SHORT).astype(U)
        found = (eight[begin] & ((U(1) << (bits << U(3))) - U(1))) | (bits << U(56))
        far = np.flatnonzero(size > LONGEST_SHORT)
        if len(far):
            raw = data.tobytes()
            words = map(raw.__getitem__, map(slice, begin[far].tolist(), end[far].tolist()))
            found[far] = np.fromiter(map(self.long.__getitem__, words), U, len(far)) | U(LONG)
        return found

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        if not len(self.key):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[place] == keys, place, -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Enter new keys, each once; ``ids`` holds their ids one after the other."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(ids) + self.used + (1 << 16), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        order = np.argsort(keys)
        place = np.searchsorted(self.key, keys[order])
        self.key = np.insert(self.key, place, keys[order])
        self.at = np.insert(self.at, place, (self.used + np.cumsum(n) - n)[order])
        self.n = np.insert(self.n, place, n[order])
        self.used += len(ids)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after the other, and how many each has."""
        n = self.n[entries]
        first = np.repeat(self.at[entries] - (np.cumsum(n) - n), n)
        return self.ids[first + np.arange(len(first))], n


def byte_slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one longer row."""
    i = 0
    while i < len(offsets) - 1:
        j = min(len(offsets) - 1, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, j
        i = j
