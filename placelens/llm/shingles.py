"""Hashes of word shingles, computed over Arrow batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

# Bytes hashed in one go; longer texts are cut at white space, so memory stays bounded.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACES = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts, A-Z lower-cased; words are runs of anything but space and controls 9 to 13."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        self.powers = np.ones(0, dtype=np.uint64)

    def _power(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, dtype=np.uint64)])
                self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, dtype=np.uint64)])
        return self.powers, self.inverses

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        hashes, firsts, at = [], [], 0
        everything = np.frombuffer(data, dtype=np.uint8)
        while at < len(data):
            end = min(at + SLICE_BYTES, len(data))
            while end < len(data) and not self.space[everything[end]]:
                end += 1
            part = everything[at:end]
            space = self.space[part]
            edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
            starts, ends = edges[::2], edges[1::2]
            powers, inverses = self._power(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
            value = (sums[ends] - sums[starts]) * inverses[starts]
            hashes.append(_mixed(value + (ends - starts).astype(np.uint64) * _PLACES[4]))
            firsts.append(starts + at)
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(firsts)

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text its distinct shingle hashes, ascending; with fewer words the whole sequence is one shingle."""
        with np.errstate(over="ignore"):
            encoded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
            hashes, firsts = self.word_hashes(b" ".join(encoded))
            bounds = np.cumsum([0, *(len(e) + 1 for e in encoded)])
            cuts = np.searchsorted(firsts, bounds)
            n = max(0, len(hashes) - self.words + 1)
            rolling = np.full(n, self.words, dtype=np.uint64)
            for j in range(self.words):
                rolling = _mixed(rolling + hashes[j : j + n] * _PLACES[j])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a >= self.words:
                    yield np.unique(rolling[a : b - self.words + 1].view(np.int64))
                elif b > a:
                    one = np.full(1, b - a, dtype=np.uint64)
                    for j in range(a, b):
                        one = _mixed(one + hashes[j : j + 1] * _PLACES[j - a])
                    yield one.view(np.int64)
                else:
                    yield np.zeros(0, dtype=np.int64)


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
