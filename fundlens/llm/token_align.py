"""Alignment of two tokenizers by galloping intersection of their token ends.

A text is encoded by a byte-level vocabulary A (with a space before it) and a piece vocabulary B
(which adds that space itself). Each gives a rising list of byte offsets where its tokens end. The
shorter list drives: each of its ends starts in the longer list at the place in proportion to its
rank, widens its step 1, 2, 4, ... in the direction of the end until it has passed it, and searches
the last step by halves. Ends found in both lists cut the tokens into groups; the ranks of an end in
the two lists, less those of the end before, are the group's ranges of A and B tokens. Many texts'
lists lie end to end in one pair of arrays, so a batch is searched at once.

A link is a pair of tokens, one of A and one of B, that end together. Links are counted by pair of
ids over all documents. A pair occurs in the corpus at most once for each pair of ids the two
vocabularies have; the ``HEAVY`` most frequent at most are broadcast back to the documents, the rest
are joined by pair.

Cases: null and empty texts have no tokens, nor has a text that one of the two can't spell again
byte for byte (U+2581, say, which B reads as a space); they have zeros and empty lists. Repeated
rows count as often as they occur. Strings of special tokens are ordinary text. An empty table gives
no rows. Other columns are not read. Very long texts take memory by their own length only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.vocabulary import Spelled, byte_vocabulary, piece_vocabulary
from fundlens.llm.words import slices
from fundlens.session import materialise

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_CHARS = 1 << 19
HEAVY = 1 << 20  # pairs that are broadcast, with two longs each
_MARKS = np.frombuffer(b",|;", np.uint8)


def gallop(ends: np.ndarray, wanted: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of ``wanted`` the first place in ``ends`` that isn't below it, searched from ``start``."""
    n = len(ends)
    low, high = np.full(len(wanted), -1), np.full(len(wanted), n)  # ends[low] < wanted <= ends[high]
    start = np.minimum(start, n - 1)
    below = ends[start] < wanted
    low, high = np.where(below, start, low), np.where(below, high, start)
    going, step = np.arange(len(wanted)), 1
    while len(going):
        up = below[going]
        at = np.where(up, start[going] + step, start[going] - step)
        inside = (at >= 0) & (at < n)
        going, at, up = going[inside], at[inside], up[inside]
        less = ends[at] < wanted[going]
        low[going[less]] = at[less]
        high[going[~less]] = at[~less]
        going = going[less == up]  # not passed yet
        step *= 2
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = ends[middle] < wanted[going]
        low[going[less]] = middle[less]
        high[going[~less]] = middle[~less]
        going = going[high[going] - low[going] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and ``b`` of the ends in both. Text i has ``a[a_first[i]:a_first[i + 1]]``; all ends rise."""
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    a_drives = n_a <= n_b
    found = []
    for drives, short, long, short_first, long_first in ((a_drives, a, b, a_first, b_first), (~a_drives, b, a, b_first, a_first)):
        text = np.flatnonzero(drives)
        size = np.diff(short_first)[text]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        rank = np.repeat(short_first[text], size) + place
        ratio = np.diff(long_first)[text] / np.maximum(size, 1)
        if not len(rank):
            continue
        at = gallop(long, short[rank], np.repeat(long_first[text], size) + (place * np.repeat(ratio, size)).astype(np.int64))
        hit = np.flatnonzero(at < len(long))
        hit = hit[long[at[hit]] == short[rank[hit]]]
        found.append((rank[hit], at[hit]) if short is a else (at[hit], rank[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(i)
    return i[order], j[order]


class Alignment:
    """Tokens of some texts, text by text, and their groups.

    ``a_first`` and ``b_first`` are each text's first tokens, ``group_first`` its first groups;
    ``a_last`` and ``b_last`` are the last tokens of the groups.
    """

    def __init__(self, texts: list[str | None], byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE):
        a_words, b_words = byte_vocabulary(byte_path), piece_vocabulary(piece_path)
        a_spelled, b_spelled = spelled(byte_path), spelled(piece_path)
        a_ids, b_ids, sizes = [], [], []
        none = np.zeros(0, np.int64)
        for text in texts:
            a = b = none
            size = 0
            if text:
                a, b = np.array(a_words.encode(" " + text), np.int64), np.array(b_words.encode(text), np.int64)
                whole = b" " + text.encode()
                size = len(whole)
                if any(s.lengths[x].sum() != size or s.join(x)[0].tobytes() != whole for s, x in ((a_spelled, a), (b_spelled, b))):
                    a, b, size = none, none, 0
            a_ids.append(a)
            b_ids.append(b)
            sizes.append(size)
        first = lambda parts: np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        self.a_first, self.b_first = first(a_ids), first(b_ids)
        self.a, self.b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
        # Byte offsets go on from text to text, so all ends of a batch rise.
        a_ends, b_ends = np.cumsum(a_spelled.lengths[self.a]), np.cumsum(b_spelled.lengths[self.b])
        self.a_last, self.b_last = common_ends(a_ends, b_ends, self.a_first, self.b_first)
        self.group_first = np.searchsorted(self.a_last, self.a_first)

    def written(self) -> list[bytes]:
        """For each text ``a1,a2|b1;a3|b2,b3``: the ids of every group."""
        groups = len(self.a_last)
        a_size, b_size = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)
        # A group's A tokens and then its B tokens, each with the mark behind it.
        out = np.empty(len(self.a) + len(self.b), np.int64)
        marks = np.zeros(len(out), np.int64)
        a_place = np.arange(len(self.a)) + np.repeat(self.b_last + 1 - b_size, a_size)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_last + 1, b_size)
        out[a_place], out[b_place] = self.a, self.b
        if groups:
            marks[a_place[self.a_last]], marks[b_place[self.b_last]] = 1, 2
        letters, ends = decimals(int(out.max(initial=0)) + 1).join(out)
        letters = letters.copy()
        if len(ends):
            letters[ends - 1] = _MARKS[marks]
        cuts = np.concatenate(([0], ends))[self.a_first + self.b_first]
        return [letters[lo : hi - 1].tobytes() if hi > lo else b"" for lo, hi in zip(cuts, cuts[1:])]

    def links(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids as a * ``size`` + b, how often) of the links of every text."""
        text = np.repeat(np.arange(len(self.group_first) - 1), np.diff(self.group_first))
        pair = self.a[self.a_last] * size + self.b[self.b_last]
        order = np.lexsort((pair, text))
        text, pair = text[order], pair[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(pair) != 0)))) if len(pair) else order
        return text[first], pair[first], np.diff(np.append(first, len(pair)))


_spelled: dict[str, Spelled] = {}


def spelled(path: str) -> Spelled:
    if path not in _spelled:
        _spelled[path] = Spelled((piece_vocabulary(path) if path.endswith(".model") else byte_vocabulary(path)).bytes)
    return _spelled[path]


_decimals: dict[str, Spelled] = {}


def decimals(size: int) -> Spelled:
    """Numbers below ``size`` or more, each with room for a mark."""
    known = _decimals.get("table")
    if known is None or len(known.lengths) < size:
        known = _decimals["table"] = Spelled({i: b"%d," % i for i in range(max(size, 1 << 16))})
    return known


def _base(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def token_groups(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends) of every row: tokens, and how many of each end with each group."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                x = Alignment(texts[lo:hi], byte_path, piece_path)
                size = np.diff(x.group_first)
                ends = [last + 1 - np.repeat(first[:-1], size) for last, first in ((x.a_last, x.a_first), (x.b_last, x.b_first))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _lists(x.a, x.a_first, pa.int32()), _lists(x.b, x.b_first, pa.int32())]
                    + [_lists(e, x.group_first, pa.int32()) for e in ends],
                    ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"],
                )

    return _base(docs, id_column, text_column).mapInArrow(align, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def linked_documents(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of every row; links are (pair, n) with pair = a * size of B + b."""
    size = len(spelled(piece_path).lengths)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                x = Alignment(texts[lo:hi], byte_path, piece_path)
                told = [hashlib.sha256(g).hexdigest() if g else "" for g in x.written()]
                text, pair, n = x.links(size)
                links = pa.StructArray.from_arrays([pa.array(pair), pa.array(n.astype(np.int32))], ["pair", "n"])
                first = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(np.diff(f)) for f in (x.a_first, x.b_first, x.group_first)), pa.array(told, pa.string()), pa.ListArray.from_arrays(first, links)],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair: long, n: int>>"
    return _base(docs, id_column, text_column).mapInArrow(align, schema)


def pair_counts(linked: DataFrame, size: int) -> DataFrame:
    """(pair, count, best) over all documents; best if no other pair of its B id is more frequent."""
    counts = linked.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = materialise(counts.withColumn("b", F.col("pair") % size), "pair-counts")
    # At most one row for each of the vocabulary's ids.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def heavy_limit(counts: DataFrame) -> int:
    """The least power of two with at most ``HEAVY`` pairs of that count or more."""
    sizes = {r.k: r["count"] for r in counts.groupBy(F.floor(F.log2("count") + 1e-9).alias("k")).count().collect()}
    total = 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > HEAVY:
            return 1 << (k + 1)
    return 1


def align_corpus(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best are the links whose count over all documents is the highest of their B id; count_sum adds
    up the counts of all links.
    """
    size = len(spelled(piece_path).lengths)
    linked = linked_documents(docs, byte_path, piece_path, id_column, text_column)
    linked = materialise(linked.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(linked, size), "pair-judged")
    limit = heavy_limit(counts)
    heavy = F.broadcast(counts.where(F.col("count") >= limit))
    each = linked.select("row", F.inline("links"))
    found = each.join(heavy, "pair")
    if limit > 1:
        light = each.join(heavy.select("pair"), "pair", "left_anti").join(counts.where(F.col("count") < limit), "pair")
        found = found.unionByName(light)
    told = found.groupBy("row").agg(F.sum(F.col("count") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    return linked.drop("links").join(told, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )
