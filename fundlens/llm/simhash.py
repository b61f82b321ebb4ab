"""SimHash near-duplicates: fingerprints in Gray order under a hierarchy of masked bit patterns.

A fingerprint has 64 bits; each is set if more than half of the text's shingle hashes have it set,
repeated shingles counted as often as they occur. Documents link when their fingerprints differ in
at most ``distance`` bits, so the join works on distinct fingerprints, however many copies each has.

The fingerprints are dealt into groups that agree on one of ``distance + 1`` ranges of bits: of two
that link, some range is equal. A group of more than ``GROUP`` fingerprints is dealt again by ranges
of its remaining bits; after ``LEVELS`` rounds few bits are left, which bounds every group whatever
the data. Within a task, each group is sorted by Gray rank, where neighbours share most bits, and
gets a tree: a node's pattern is the bits that all fingerprints below it share, and a child holds
only the bits that its parent's pattern lacks. A search adds up the differences on its way down and
leaves a whole subtree as soon as they exceed the distance. Of the links found in a task only a
spanning forest is passed on, so a dense group of near copies sends no more rows than it has members.

Cases: a null, empty or wordless text has fingerprint zero and links like any other; texts with
fewer words than a shingle are one shingle. A row without doc_id gets a fingerprint, takes no part
in links, and its component is null. Repeated rows are rows of their own with equal results. An
empty table gives no rows. Other columns are not read. Texts are hashed in pieces of about
``PIECE`` bytes, so a very long one takes no more memory than its own bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.operators.components import connected_components
from fundlens.session import materialise

GROUP = 4096  # fingerprints of a group that is not dealt again
LEVELS = 4  # with three ranges each, a group of the last round has at most 2**13 fingerprints
FAN = 8  # children of a node
QUERIES = 4096  # searched at once
PIECE = 1 << 20
SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BYTE_AT = np.arange(8, dtype=np.int64) * 256
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space."""
    start = 0
    while len(raw) - start > PIECE:
        gap = _SPACE.search(raw, start + PIECE)
        if gap is None:
            break
        yield raw[start : gap.start()]
        start = gap.end()
    yield raw[start:] if start else raw


def fingerprint(raw: bytes | None, k: int = 3) -> int:
    """The SimHash of a UTF-8 text's ``k``-word shingles."""
    from xxhash import xxh64_intdigest

    total, counts = 0, np.zeros((8, 256), np.int64)
    held: list[bytes] = []  # the last words of the piece before
    for piece in _pieces((raw or b"").lower()):  # bytes: only A-Z change
        words = held + piece.split()  # bytes: split at 0x20 and 0x09-0x0D
        if len(words) < k:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
        total += len(hashes)
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
        held = words[len(words) - k + 1 :] if k > 1 else []
    if not total:
        return xxh64_intdigest(b" ".join(held), SEED) if held else 0
    ones = (counts @ _BITS_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the fingerprint's 64 bits as a long."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), k) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return base.mapInArrow(sketch, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit code among all codes in Gray order, shifted so that signed longs sort right."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def bit_ranges(fixed: int, parts: int) -> list[int]:
    """``fixed`` with, in turn, each of ``parts`` ranges of its free bits; as masks."""
    free = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [fixed | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


class GrayIndex:
    """Groups of codes, each sorted by Gray rank, under trees of ``FAN`` children a node.

    ``starts`` are the groups' first positions and the end. Level 0 are the codes themselves; the
    last level has one node for each group.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.codes = codes
        sizes = np.diff(starts)
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        every, some = codes, codes
        shared = np.full(len(codes), 2**64 - 1, np.uint64)
        ends = np.arange(1, len(codes) + 1)
        # For each level: pattern, bits that the parent's pattern lacks, last leaf + 1, first child.
        self.levels = [[every, shared, ends, None]]
        while sizes.max(initial=1) > 1:
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.flatnonzero(place % FAN == 0)
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            above = ~(every ^ some)
            last = np.append(first[1:], len(place)) - 1
            self.levels[-1][1] = shared & ~np.repeat(above, last - first + 1)
            ends, shared, sizes = ends[last], above, -(-sizes // FAN)
            self.levels.append([every, shared, ends, np.append(first, len(place))])

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j > i) of every pair within ``distance`` bits in one group."""
        top = len(self.levels) - 1
        for lo in range(0, len(self.codes), QUERIES):
            query = np.arange(lo, min(lo + QUERIES, len(self.codes)))
            node, differ = self.group[query], np.zeros(len(query), np.int64)
            for level in range(top, 0, -1):
                first = self.levels[level][3]
                count = first[node + 1] - first[node]
                child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                node = np.repeat(first[node], count) + child
                query, differ = np.repeat(query, count), np.repeat(differ, count)
                pattern, own, ends, _ = self.levels[level - 1]
                differ = differ + np.bitwise_count((self.codes[query] ^ pattern[node]) & own[node])
                near = (differ <= distance) & (ends[node] > query + 1)
                query, node, differ = query[near], node[near], differ[near]
            if top and len(query):
                yield query, node


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` positions the least one that the pairs connect it with."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        low = low[low]
        if (low == before).all():
            return low


def _forest(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect what is within ``distance`` in the groups of (mask, value, gray, fp, node)."""

    def search(codes: np.ndarray, nodes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
        low = np.arange(len(codes))
        for i, j in GrayIndex(codes, starts).links(distance):
            low = spanning(np.append(i, np.arange(len(low))), np.append(j, low), len(codes))
        joined = np.flatnonzero(low != np.arange(len(codes)))
        if not len(joined):
            return None
        return pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.array(nodes[low[joined]])], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "value", "fp", "node")])], axis=1)
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(change):  # the last group may go on in the next batch
                done = change[-1]
                found = search(held[2, :done].view(np.uint64), held[3, :done], np.append(0, change))
                if found:
                    yield found
                held = held[:, done:].copy()
        if held.shape[1]:
            found = search(held[2].view(np.uint64), held[3], np.array([0, held.shape[1]]))
            if found:
                yield found

    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "gray").mapInArrow(join, "a long, b long")


def fingerprint_links(codes: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) of rows (fp, node) with distinct fp, enough to connect all that is within ``distance``."""
    signed = lambda x: x - 2**64 if x >> 63 else x
    current, out, fixed = codes.withColumns({"gray": gray_rank(F.col("fp")), "mask": F.lit(0).cast("long")}), None, [0]
    for level in range(LEVELS):
        # Each mask of the round before is followed by its own: a row goes to one group of each.
        nexts = F.create_map(*[y for m in fixed for y in (F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in bit_ranges(m, distance + 1)]))])
        dealt = current.select("fp", "node", "gray", F.explode(nexts[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if level:  # two rounds may fix the same bits in another order
            dealt = dealt.distinct()
        fixed = sorted({x for m in fixed for x in bit_ranges(m, distance + 1)})
        if level < LEVELS - 1:
            large = materialise(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), "simhash-large")
            if not large.isEmpty():
                current = materialise(dealt.join(large.select("mask", "value"), ["mask", "value"], "left_semi"), "simhash-again")
                dealt = dealt.join(large.select("mask", "value"), ["mask", "value"], "left_anti")
            else:
                current = None
        else:
            current = None
        links = _forest(dealt, distance)
        out = links if out is None else out.unionByName(links)
        if current is None:
            return out
    return out


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id that links reach."""
    records = materialise(fingerprints(docs, k, id_column, text_column), "simhash-fingerprints")
    classes = materialise(records.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    # The minimum of many doc_ids keeps each fingerprint's copies out of the join.
    links = materialise(fingerprint_links(classes, distance), "simhash-links")
    found = connected_components(links, "a", "b")
    final = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return records.join(final, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
