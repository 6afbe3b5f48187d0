"""Words of texts as arrays of hashes, many texts at a time.

A word is a run of bytes other than space, tab, newline, vertical tab, form
feed and return. Hashes are 64 bits: the sum of byte values times powers of an
odd number, scaled back to the word's own start and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
# Texts are hashed about this many bytes at a time; one text is never cut.
SLICE_BYTES = 2 << 20
_CHUNK = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_is_newline = np.zeros(256, bool)
_is_newline[10] = True
_values = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_folded = _values.copy()
_folded[ord("A") : ord("Z") + 1] = _values[ord("a") : ord("z") + 1]
# Bytes that are neither A-Z, a-z, 0-9 nor part of a character beyond ASCII.
not_alphanumeric = np.ones(256, bool)
not_alphanumeric[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers = _inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; equal in, equal out."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, _CHUNK * 2)
        _powers, _inverses = (
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_ODD, _INVERSE)
        )
    return _powers, _inverses


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edges[::2], edges[1::2]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash per span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        powers, inverses = _power_tables(int(ends[to - 1] - base) + 1)
        part = values[data[base : ends[to - 1]]] * powers[: ends[to - 1] - base]
        sums = np.r_[np.uint64(0), np.cumsum(part, dtype=np.uint64)]
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * np.uint64(_INVERSE))
        at = to
    return out


class Texts:
    """Some texts in one buffer, a newline after each."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.n = len(texts)
        self.ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)

    def count(self, of_byte: np.ndarray) -> np.ndarray:
        """How many bytes of each text a 256-entry mask marks; not its closing newline."""
        sums = np.r_[0, np.cumsum(of_byte[self.data], dtype=np.int64)]
        return sums[np.maximum(self.ends - 1, self.starts)] - sums[self.starts]

    def owners(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, starts, "right")

    def words(self, fold: bool = False, apart: np.ndarray = _is_space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, owning text and start of every word; ``fold`` equates A-Z and a-z.
        ``apart`` marks the bytes between words."""
        starts, ends = _runs(~apart[self.data])
        return _hash_spans(self.data, starts, ends, _folded if fold else _values), self.owners(starts), starts

    def word_spans(self, apart: np.ndarray = _is_space) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word in the buffer."""
        return _runs(~apart[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each of some spans in order, A-Z folded."""
        return _hash_spans(self.data, starts, ends, _folded)

    def characters(self) -> np.ndarray:
        """The code points before each byte of the buffer, and after the last."""
        return np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, owning text and start of every line that isn't empty."""
        starts, ends = _runs(~_is_newline[self.data])
        return _hash_spans(self.data, starts, ends, _values), self.owners(starts), starts


def windows(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every window of ``n`` words within a text."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out = mix(out) + hashes[k : k + size]
    first = np.flatnonzero(owners[:size] == owners[n - 1 :])
    return mix(out[first]), first


def as_bytes(text) -> bytes:
    """A text in UTF-8; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)
