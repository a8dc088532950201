"""Word hashes and shingle sets of whole texts, with numpy over UTF-8 bytes.

Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased. A word's hash is a sum over its bytes, so a
text of any length is worked through in slices; a word that crosses slices is put together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quern.llm.common import mix64

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = frozenset((32, 9, 10, 11, 12, 13))


class Hasher:
    """The tables of a task."""

    def __init__(self, width: int = 5):
        u = np.arange(256, dtype=np.uint64)
        self.values = mix64(u + np.uint64(0x51ED270B))
        self.values[65:91] = self.values[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[list(_SPACE)] = True
        self.values[self.blank] = 0
        self.powers = np.cumprod(np.full(256, _BASE, np.uint64), dtype=np.uint64)
        self.width = width
        self.places = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def _powers(self, n: int) -> np.ndarray:
        if n > len(self.powers):
            self.powers = np.cumprod(np.full(max(n, 2 * len(self.powers)), _BASE, np.uint64), dtype=np.uint64)
        return self.powers

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words in data (uint8)."""
        hashes, starts = [], []
        crossing = 0  # bytes so far of a word that reaches the slice's end
        for at in range(0, len(data), SLICE):
            part = data[at : at + SLICE]
            blank = self.blank[part]
            edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
            first = edge[~blank[edge]]
            if not blank[0]:
                first = np.concatenate([[0], first])
            if not len(first):
                crossing = 0
                continue
            last = edge[blank[edge]]
            if not blank[-1]:
                last = np.concatenate([last, [len(part)]])
            size = last - first
            of = np.zeros(len(part), np.int64)
            of[first[1:]] = np.diff(first)
            place = np.arange(len(part)) - first[0]
            place -= np.cumsum(of)
            powers = self._powers(int(np.diff(np.append(first, len(part))).max()) + 1)
            h = np.add.reduceat((self.values[part] * powers[np.maximum(place, 0)]), first)
            if crossing and not blank[0]:
                hashes[-1][-1:] += h[:1] * np.uint64(pow(_BASE, crossing, 1 << 64))
                crossing = crossing + int(size[0]) if len(first) == 1 and not blank[-1] else 0 if blank[-1] else int(size[-1])
                h, first = h[1:], first[1:]
            else:
                crossing = 0 if blank[-1] else int(size[-1])
            if len(h):
                hashes.append(h)
                starts.append(first + at)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return mix64(np.concatenate(hashes)), np.concatenate(starts)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its sorted distinct shingle hashes; the whole sequence is one shingle if it has fewer words."""
        for run in _runs(texts):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in run]
            data = np.frombuffer(b"\n".join(raw), np.uint8)
            ends = np.cumsum([len(r) + 1 for r in raw])
            words, starts = self.words(data)
            cut = np.searchsorted(starts, ends)
            k, w = self.width, words
            wide = np.zeros(max(0, len(w) - k + 1), np.uint64)
            for j in range(k):
                wide += w[j : len(w) - k + 1 + j] * self.places[j] if len(wide) else np.uint64(0)
            wide = mix64(wide)
            a = 0
            for b in cut.tolist():
                if b - a >= k:
                    s = np.sort(wide[a : b - k + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])]
                elif b > a:
                    yield mix64(np.array([(w[a:b] * self.places[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
                else:
                    yield w[:0]
                a = b


def _runs(texts: list[str | None], most: int = SLICE) -> Iterator[list[str | None]]:
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield texts[at:]
