"""Words and shingles of texts as 64-bit hashes, computed with numpy inside Arrow tasks.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased. Both are single bytes in
UTF-8, so bytes give the same words as code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        steps = np.full(size, _STEP, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets): the words of text i are ``hashes[offsets[i]:offsets[i + 1]]``."""
    return _hashes([(t or "").encode() for t in texts])


def _pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """``raw`` cut at white space into pieces of about ``limit`` bytes."""
    start = 0
    while len(raw) - start > limit:
        gap = _SPACE.search(raw, start + limit)
        if gap is None:
            break
        yield raw[start : gap.start()]
        start = gap.end()
    yield raw[start:]


def _hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = ~_SEPARATOR[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    text_starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    offsets = np.searchsorted(starts, text_starts)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    values = (_LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)) * _power_table(int(lengths.max()))[at]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)), offsets


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-word windows; the whole sequence as one when it has fewer words."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        k = n
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(_STEP) + words[j : n - k + 1 + j]
    return mix(out)


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each, so that the arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        here = len(t or "") + 1
        if start < i and size + here > limit:  # a long text stands alone
            yield start, i
            start, size = i, 0
        size += here
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def texts_with_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its word hashes) for every text."""
    for lo, hi in slices(texts):
        if hi - lo == 1 and len(texts[lo] or "") > SLICE_BYTES:
            yield lo, np.concatenate([_hashes([piece])[0] for piece in _pieces(texts[lo].encode(), SLICE_BYTES)])
            continue
        hashes, offsets = word_hashes(texts[lo:hi])
        for i in range(lo, hi):
            yield i, hashes[offsets[i - lo] : offsets[i - lo + 1]]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them; a run may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
