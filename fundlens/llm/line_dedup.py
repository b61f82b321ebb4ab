"""Line deduplication by pairwise alignment.

A line is compared by its words. Documents overlap if they share a rare line hash: the hash of the
shortest run of lines, from some line on, that has ``min_words`` words (one line, if it is long
enough). Each such hash leads from the first document that has it, by doc_id, to every later one:
a star, so the pairs grow with the documents and not with the square of a group. Each pair is
aligned by patience diff, and blocks of aligned lines with ``min_words`` words at least are deleted
from the later document. After a deletion the rest is aligned again, which finds moved blocks;
lines that are nowhere unique are matched by their runs. Of every deleted line the first document
that has it keeps it.

Cases: a null text stays null; empty texts have no lines to delete. Lines without a word are never
compared, and go only with a block that surrounds them. Rows without doc_id are left as they are.
Rows that repeat a doc_id are one document to the search (its lines are those of the row with the
least hash), and what is deleted from it is deleted from each by line content. Other columns stay.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.llm.columns import fresh, map_in_arrow, packed, unpacked
from fundlens.session import materialise

MIN_WORDS = 50
BLOCK = 256  # later documents that are aligned with one copy of the first one's lines


def word_lines(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    """(position among all lines, words) of the lines with a word; bytes split at the six white space bytes."""
    for i, line in enumerate((text or "").encode().split(b"\n")):
        found = line.split()
        if found:
            yield i, found


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """(hash, number of words) of the lines with a word."""
    hashes, counts = [], []
    for _, found in word_lines(text):
        hashes.append(xxhash.xxh3_64_intdigest(b" ".join(found).lower()) - (1 << 63))
        counts.append(len(found))
    return hashes, counts


def run_hashes(hashes: list[int], counts: list[int], min_words: int) -> list[int | None]:
    """For every line the hash of the shortest run from it on with ``min_words`` words."""
    packed = np.array(hashes, np.int64).tobytes()
    sums = np.concatenate(([0], np.cumsum(counts))) if counts else np.zeros(1, int)
    ends = np.searchsorted(sums, sums[:-1] + min_words)
    return [xxhash.xxh3_64_intdigest(packed[8 * i : 8 * e]) - (1 << 63) if e < len(sums) else None for i, e in enumerate(ends.tolist())]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) in order: common ends, then lines unique on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {x: i for i, x in enumerate(b[blo:bhi], blo) if in_b[x] == 1}
        both = [(i, place[x]) for i, x in enumerate(a[alo:ahi], alo) if in_a[x] == 1 and x in place]
        # Longest increasing sequence of the places in b.
        tails: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(both):
            k = bisect.bisect_left(tails, j)
            back.append(piles[k - 1] if k else -1)
            if k == len(tails):
                tails.append(j)
                piles.append(n)
            else:
                tails[k], piles[k] = j, n
        chain = []
        n = piles[-1] if piles else -1
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        if not chain:
            continue
        chain.reverse()
        out.extend(chain)
        edges = [(alo - 1, blo - 1), *chain, (ahi, bhi)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], counts: list[int], min_words: int) -> list[int]:
    """Positions in b of the lines that belong to a common block with ``min_words`` words."""
    gone: set[int] = set()
    left = list(range(len(b)))
    while left:
        aligned = [(i, left[j]) for i, j in patience(a, [b[j] for j in left])]
        new: list[int] = []
        block: list[int] = []
        for n, (i, j) in enumerate(aligned):
            if n and (aligned[n - 1][0], aligned[n - 1][1]) != (i - 1, j - 1):
                block = []
            block.append(j)
            if n + 1 == len(aligned) or aligned[n + 1] != (i + 1, j + 1):
                if sum(counts[x] for x in block) >= min_words:
                    new.extend(block)
        if not new:
            break
        gone.update(new)
        left = [j for j in left if j not in gone]
    # Runs whose lines are nowhere unique.
    place = {}
    words_a = dict(zip(b, counts))
    runs_a = run_hashes(a, [words_a.get(x, min_words) for x in a], min_words)
    for i, r in enumerate(runs_a):
        if r is not None:
            place.setdefault(r, i)
    for j, r in enumerate(run_hashes(b, counts, min_words)):
        if j not in gone and r is not None and r in place:
            i = place[r]
            while i < len(a) and j < len(b) and a[i] == b[j]:
                gone.add(j)
                i, j = i + 1, j + 1
    return sorted(gone)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ([], [], [])
            for text in batch.column(1).to_pylist():
                hashes, counts = line_hashes(text)
                for c, x in zip(columns, (hashes, counts, sorted({r for r in run_hashes(hashes, counts, min_words) if r is not None}))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int64()))],
                ["doc_id", "lines", "counts", "runs"],
            )

    base = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(measure, "doc_id long, lines array<long>, counts array<int>, runs array<long>")


def common_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gone): hashes of the lines to delete, one for each occurrence to delete."""
    lines = materialise(_lines(docs, min_words), "lines")
    starts = lines.select("doc_id", F.explode("runs").alias("run"))
    firsts = starts.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "first")
    pairs = starts.join(firsts, "run").where("first < doc_id").select("first", "doc_id").distinct()
    # Of rows that repeat a doc_id, one stands for it.
    one = lines.groupBy("doc_id").agg(F.min_by(F.struct("lines", "counts"), F.xxhash64("lines")).alias("x")).select("doc_id", "x.*")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        for batch in batches:
            ids, gone = [], []
            # A block begins with the first document, whose doc_id is null here.
            for doc, b, counts in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lines", "counts"))):
                if doc is None:
                    a = b
                    continue
                found = common_blocks(a, b, counts, min_words)
                if found:
                    ids.append(doc)
                    gone.append(found)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"])

    # A first document of very many later ones is sent once to each BLOCK of them.
    pairs = materialise(pairs, "line-pairs")
    blocks = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "first").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks")
    later = dealt.join(one, "doc_id").select("first", "block", "doc_id", "lines", "counts")
    heads = (
        blocks.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        .join(one.withColumnRenamed("doc_id", "first"), "first").select("first", "block", F.lit(None).cast("long").alias("doc_id"), "lines", "counts")
    )
    both = heads.unionByName(later).repartition("first", "block").sortWithinPartitions("first", "block", F.asc_nulls_first("doc_id"))
    return both.mapInArrow(align, "doc_id long, gone array<int>").groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: str | None = None) -> DataFrame:
    """``docs`` without the lines that an earlier document has in a common block.

    A text that loses all its lines with words becomes empty. ``report`` adds a struct
    (lines, lines_gone, words, words_gone) under that name.
    """
    columns = docs.columns
    if report in columns:
        raise ValueError(f"docs has a column {report}")
    found = common_lines(docs, min_words).withColumnRenamed("doc_id", "id")
    joined = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id")).join(found, "id", "left")
    joined = joined.select(*unpacked(columns), F.col("gone").alias(fresh(columns, "gone")))
    at = docs.columns.index("text")
    schema = docs.schema if report is None else T.StructType([*docs.schema.fields, T.StructField(report, T.StructType.fromDDL("lines bigint, lines_gone bigint, words bigint, words_gone bigint"))])

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            told = []
            for n, gone in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spoken_lines = [(i, len(found)) for i, found in word_lines(texts[n])] if gone or report else []
                places, counts = [i for i, _ in spoken_lines], [c for _, c in spoken_lines]
                gone = [g for g in gone or () if g < len(places)]
                told.append((len(places), len(gone), sum(counts), sum(counts[g] for g in gone)))
                if gone:
                    # Lines without a word go with the deleted line before them.
                    lines, drop, cut = texts[n].split("\n"), {places[g] for g in gone}, False
                    spoken, kept = set(places), []
                    for i, line in enumerate(lines):
                        cut = i in drop or (cut and i not in spoken)
                        if not cut:
                            kept.append(line)
                    texts[n] = "\n".join(kept) if len(gone) < len(places) else ""
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            if report is not None:
                names = ("lines", "lines_gone", "words", "words_gone")
                columns.append(pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)] if told else [pa.array([], pa.int64())] * 4, names))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return map_in_arrow(joined, delete, schema)
