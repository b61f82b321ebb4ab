"""Character n-grams of texts as bucket numbers, computed with numpy inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from fundlens.llm.words import mix, slices

PAD = 5  # marks before each text; grams with them are those at its ends
_STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE_CHARS = 1 << 19


def _codes(text: str | None) -> np.ndarray:
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes <= 32, np.uint32(32), codes)


def gram_buckets(texts: list[str | None], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of texts: (first row, rows, row in the slice, bucket) of every n-gram.

    Letters are lower-cased and all white space is a space. Each text is taken with marks before
    and after it, so its buckets don't depend on its neighbours.
    """
    for lo, hi in slices(texts, SLICE_CHARS):
        parts, lengths = [], []
        pad = np.zeros(PAD, np.uint32)
        for t in texts[lo:hi]:
            codes = _codes(t)
            parts += [pad, codes]
            lengths.append(PAD + len(codes))
        parts.append(pad)
        codes = np.concatenate(parts).astype(np.uint64) + np.uint64(1)
        total = int(sum(lengths))
        row = np.repeat(np.arange(hi - lo), lengths)
        h = np.zeros(total, np.uint64)
        out = []
        for j in range(max(sizes)):
            h = h * _STEP + codes[j : j + total]
            if j + 1 in sizes:
                out.append(mix(h + np.uint64(j)) >> np.uint64(64 - bits))
        yield lo, hi - lo, np.tile(row, len(sizes)), np.concatenate(out).astype(np.int64)


def distinct_pairs(row: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), sorted."""
    both = np.unique((row << bits) | feature)
    return both >> bits, both & ((1 << bits) - 1)
