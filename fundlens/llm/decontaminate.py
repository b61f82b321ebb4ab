"""Benchmark decontamination: size-partitioned MinHash containment search with an exact check.

Items are grouped into size classes by their number of shingles; a class with items of at most
``s`` shingles looks at every document in windows of ``2 * s`` shingles, one starting every ``s``,
so a copied item lies whole in some window and makes up a known least part of it. Item and window
are compared by one-permutation MinHash: a shingle's hash names one of ``BINS`` bins and its rank
in it, and they are candidates if the least rank of some bin is the same. Only shingles that are a
least rank of some item can make a candidate, so the windows' other bins need not be filled in.
Each candidate is then checked exactly: |item & whole document| * 100 >= percent * |item|.

An item of fewer than ``k`` words is one shingle of all its words. It is its own least rank and is
looked up among the document's runs of that many words.

The items are the stated query set. They are read in blocks of about ``BLOCK_CHARS`` characters
(the bound of what is broadcast at a time: with more than one block, each block's result is stored
before the next is sent), and each block meets every document once; no document is shuffled.

Cases: a null or wordless text has no shingles; such an item is never found and such a document
never contains one. Equal (item_id, text) rows count once; document rows are
judged one by one, repeated ones alike. Empty tables give no rows. Other columns are kept by
``remove_contaminated`` and not read by ``find_contamination``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm import words as w
from fundlens.llm.columns import map_in_arrow
from fundlens.session import materialise

BINS = 64
BLOCK_CHARS = 16 << 20
_BIN = np.uint64(BINS - 1)


def _distinct_shingles(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(w.shingle_hashes(words, k)) if len(words) >= k else np.zeros(0, np.uint64)


class ItemIndex:
    """Sets of a block of items, and their MinHash values by size class."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int):
        self.k = k
        self.items, short = [], {}
        for i, x in w.texts_with_words(texts):
            if len(x) >= k:
                self.items.append((ids[i], _distinct_shingles(x, k)))
            elif len(x):
                short.setdefault(len(x), []).append((int(w.shingle_hashes(x, len(x))[0]), ids[i]))
        # By number of words: hashes in order, and the item of each.
        self.short = {n: (np.array(sorted(h for h, _ in rows), np.uint64), [i for _, i in sorted(rows, key=lambda r: r[0])]) for n, rows in short.items()}
        values, owners, strides = [], [], []
        for at, (_, s) in enumerate(self.items):
            # Sorted by bin and then value: the first of each bin is its least rank.
            ranked = s[np.lexsort((s, s & _BIN))]
            least = ranked[np.concatenate(([True], np.diff((ranked & _BIN).astype(np.int64)) != 0))]
            values.append(least)
            owners.append(np.full(len(least), at))
            strides.append(np.full(len(least), 1 << int(len(s)).bit_length()))
        self.values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(self.values, kind="stable")
        self.values = self.values[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.strides = np.concatenate(strides)[order] if strides else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.values >> np.uint64(44)] = True

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that share a least rank with some window of the document."""
        out: set[int] = set()
        near = np.flatnonzero(self.seen[shingles >> np.uint64(44)])
        left = np.searchsorted(self.values, shingles[near], "left")
        right = np.searchsorted(self.values, shingles[near], "right")
        done: set[tuple[int, int]] = set()
        for pos, a, b in zip(near.tolist(), left.tolist(), right.tolist()):
            # All items of one least rank and size class have the same windows.
            value, strides = shingles[pos], self.strides[a:b]
            for stride in np.unique(strides).tolist():
                if (a, stride) in done:
                    continue
                block = pos // stride
                for start in (block - 1, block):
                    window = shingles[max(0, start * stride) : (start + 2) * stride]
                    same = window[(window & _BIN) == (value & _BIN)]
                    if len(same) and same.min() == value:
                        out.update(self.owners[a:b][strides == stride].tolist())
                        done.add((a, stride))
                        break
        return out

    def matches(self, words: np.ndarray, percent: int) -> list[tuple[int | None, int, int]]:
        """(item_id, shingles of the item, how many of them the document has)."""
        out = []
        for n, (hashes, ids) in self.short.items():
            if len(words) >= n:
                own = np.unique(w.shingle_hashes(words, n))
                left, right = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                out += [(ids[at], 1, 1) for a, b in zip(left.tolist(), right.tolist()) for at in range(a, b)]
        if len(words) < self.k or not self.items:
            return out
        shingles = w.shingle_hashes(words, self.k)
        found = self.candidates(shingles)
        if not found:
            return out
        own = np.unique(shingles)
        for at in sorted(found):
            item_id, s = self.items[at]
            where = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[where] == s).sum())
            if 100 * shared >= percent * len(s):
                out.append((item_id, len(s), shared))
        return out


def _item_blocks(benchmark: DataFrame, k: int) -> Iterator[tuple[ItemIndex, int]]:
    """(index of a block of items, number of blocks)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()
        ids = [None if x != x or x is None else int(x) for x in part["item_id"].tolist()]
        yield ItemIndex(ids, part["text"].tolist(), k), blocks


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) of contaminated documents."""
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    out = None
    for index, blocks in _item_blocks(benchmark, k):
        shared = sc.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *m) for i, x in w.texts_with_words(batch.column(1).to_pylist()) for m in shared.value.matches(x, percent)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "item_shingles", "shared_shingles"])

        found = base.mapInArrow(search, schema)
        if blocks > 1:
            found = materialise(found, "contamination")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item; one pass for each block of items."""
    sc = docs.sparkSession.sparkContext
    column = docs.columns.index("text")
    for index, blocks in _item_blocks(benchmark, k):
        shared = sc.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not shared.value.matches(x, percent) for _, x in w.texts_with_words(batch.column(column).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_in_arrow(docs, clean, docs.schema)
        if blocks > 1:
            docs = materialise(docs, "decontaminated")
            shared.unpersist()
    return docs
