"""Word shingles of whole texts as sorted sets of 64-bit hashes (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_CHARS = 250_000
STEP = 0x9E3779B97F4A7C15        # odd, so that it has an inverse modulo 2 ** 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (shift and multiply, wrapping)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(STEP)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle sets of blocks of texts.

    A word's hash is a polynomial over its bytes, read off running sums over
    the whole block: no work in Python for each word.
    """

    def __init__(self, k: int = 1, letters: bytes | None = None):
        """``letters``: the bytes that make words (default: all but the six ASCII spaces)."""
        self.k = k
        self.gap = np.zeros(256, bool)
        if letters is None:
            self.gap[[9, 10, 11, 12, 13, 32]] = True
        else:
            self.gap[:] = True
            self.gap[list(letters)] = False
        self.letter = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, texts: list[str | None], heads: tuple[int, ...] = (), tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every word, in order (A-Z lowered)."""
        # bytes.lower() knows ASCII letters only
        raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        gap = self.gap[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[0::2], edge[1::2]
        self._powers(len(data))
        run = np.empty(len(data) + 1, np.uint64)
        run[0] = 0
        np.cumsum(self.letter[data] * self.up[: len(data)], out=run[1:])
        h = mix((run[end] - run[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        ends = np.cumsum([len(r) + 1 for r in raw])
        own = np.searchsorted(ends, begin, side="right")
        # tail: the last so many bytes of each word, hashed
        if tail:
            b = np.maximum(begin, end - tail)
            self.tails = mix((run[end] - run[b]) * self.down[b])
        # heads: the first so many bytes of the words that are longer
        self.heads = []
        for n in heads:
            long = end - begin > n
            b = begin[long]
            self.heads.append((mix((run[b + n] - run[b]) * self.down[b] + np.uint64(1 << 32 | n)), own[long]))
        return h, own

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's runs of ``k`` words.

        A text with fewer words has its whole sequence as one shingle; one
        without words has none.
        """
        w, own = self.words(texts)
        bounds = np.searchsorted(own, np.arange(len(texts) + 1))
        full = self._runs(w, self.k)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = b - a
            if n >= self.k:
                h = np.sort(full[a: b - self.k + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            else:
                out.append(self._runs(w[a:b], n) if n else np.empty(0, np.uint64))
        return out

    @staticmethod
    def _runs(w: np.ndarray, span: int) -> np.ndarray:
        if len(w) < span:
            return np.empty(0, np.uint64)
        h = w[: len(w) - span + 1].copy()
        for i in range(1, span):
            h = mix(h) + w[i: len(w) - span + 1 + i]
        return mix(h + np.uint64(span))


def texts_of(column, rows: int = 128) -> Iterator[str | None]:
    """Texts of an Arrow column, made into Python strings a few rows at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def blocks(texts: Iterable[str | None], chars: int = BLOCK_CHARS) -> Iterator[list[str | None]]:
    """Consecutive runs of texts of about ``chars`` characters."""
    block: list[str | None] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= chars or len(block) >= 4096:
            yield block
            block, size = [], 0
    if block:
        yield block
