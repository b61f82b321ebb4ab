"""Exact similarity join of short names by matching-block ratio.

The ratio of two names is ``2 M / (|a| + |b|)`` where ``M`` counts the characters of the matching
blocks. A pair at a threshold ``t`` is turned into each other by at most ``(1 - t) (|a| + |b|)``
single-character deletions and insertions. So the longer name is cut into one segment more than
that can be for any partner: each edit spoils one segment at most, and some segment stands unspoiled
in the shorter name, shifted by no more than the edits on either side of it allow. Names meet where
a segment of the longer one equals a substring of the shorter one within that shift.

Any cut is right; each name is cut so that its segments are rare together, which hides what all
names have in common inside longer segments. Counts of letters and letter pairs then rule candidates
out before they are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import difflib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.operators.pairing import salted_join
from fundlens.session import materialise


KNOWN_TEXTS = 1 << 16  # frequent substrings whose counts guide the cuts
SPARE_LENGTH = 6  # by which a segment may exceed the average


def _ratio_udf(threshold: float):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        matcher = difflib.SequenceMatcher(None)
        last = None
        for x, y in zip(a, b):
            if y != last:
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            # Both bounds are upper bounds of the ratio and cheaper than it.
            if matcher.real_quick_ratio() < threshold or matcher.quick_ratio() < threshold:
                out.append(0.0)
            else:
                out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    # Keeps the optimiser from moving the comparison ahead of the cheaper filters.
    return ratio.asNondeterministic()


def _grams(name: Column, size: int) -> Column:
    """Character n-grams, each with how often it has occurred so far in the name."""
    n = F.length(name) - (size - 1)
    grams = F.when(
        n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(
        grams,
        lambda g, i: F.concat(
            F.lit(f"{size}:"), g, F.lit("#"),
            F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string"),
        ),
    )


def _longest_segment(threshold: float) -> int:
    return math.ceil(1 / max(2 * (1 - threshold), 1e-3)) + SPARE_LENGTH


def _edits(threshold: float, total: int) -> int:
    """Most edits between names of this total length.

    Deletions and insertions of two names differ by their lengths, so edits are even or odd with them.
    """
    most = math.floor((1 - threshold) * total + 1e-9)
    return max(0, most - (total - most) % 2)


def cut(name: str, parts: int, longest: int, counts: dict[tuple[str, int], int], least: int) -> list[int]:
    """Starts of ``parts`` segments of ``name``, cut so that they are rarely met.

    ``counts`` has the frequent substrings by place; others count ``least``. A segment costs what
    stands at the places that its shift allows. A name shorter than ``parts`` gets empty segments,
    which stand in every name.
    """
    n = len(name)
    if parts >= n:
        return [min(i, n) for i in range(parts)]
    # Sums of the counts of name[a:b] round its place, by shift.
    met: dict[tuple[int, int], list[int]] = {}
    for a in range(n):
        for b in range(a + 1, min(n, a + longest) + 1):
            text, sums = name[a:b], [counts.get((name[a:b], a), least)]
            for d in range(1, parts // 2 + 1):
                sums.append(sums[-1] + counts.get((text, a - d), least) + counts.get((text, a + d), least))
            met[a, b] = sums
    best: list[float] = [0.0] + [math.inf] * n
    back = []
    for i in range(1, parts + 1):
        now, last = [math.inf] * (n + 1), [0] * (n + 1)
        shift = min(i - 1, parts - i)
        for start in range(i - 1, n - (parts - i)):
            before = best[start]
            if before < math.inf:
                for end in range(start + 1, min(n, start + longest) + 1):
                    c = before + met[start, end][shift]
                    if c < now[end]:
                        now[end], last[end] = c, start
        best = now
        back.append(last)
    starts, end = [], n
    for last in reversed(back):
        end = last[end]
        starts.append(end)
    return starts[::-1]


def _frequent(substrings: list[DataFrame]) -> tuple[dict[tuple[str, int], int], int]:
    """Counts of the most frequent substrings by place, ``KNOWN_TEXTS`` a side at most, and that of all others."""
    counts: dict[tuple[str, int], int] = {}
    least = 1
    for table in substrings:
        found = table.groupBy("text", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "text", "at").limit(KNOWN_TEXTS).collect()
        for r in found:
            counts[r.text, r["at"]] = counts.get((r.text, r["at"]), 0) + r.n
        if len(found) == KNOWN_TEXTS:
            least = max(least, found[-1].n)
    return counts, least


def _segments(grams: DataFrame, threshold: float, frequent: tuple[dict[tuple[str, int], int], int]) -> DataFrame:
    """(text, name, la, at, place, parts, parity): the segments of each name as the longer one.

    Partners of even and of odd difference in length have cuts of their own: an edit less is allowed
    for one of the two, so its segments are longer.
    """
    shared = grams.sparkSession.sparkContext.broadcast(frequent)
    longest = _longest_segment(threshold)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                n = len(name)
                for parity in (0, 1):
                    parts = _edits(threshold, 2 * n - parity) + 1
                    starts = [*cut(name, parts, longest, *shared.value), n]
                    rows += [(name[a:b], name, n, a, i, parts, parity) for i, (a, b) in enumerate(zip(starts, starts[1:]), 1)]
            if rows:
                text, owner, *numbers = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(text), pa.array(owner), *[pa.array(c, pa.int32()) for c in numbers]], ["text", "name", "la", "at", "place", "parts", "parity"])

    return grams.select("name").mapInArrow(split, "text string, name string, la int, at int, place int, parts int, parity int")


def _substrings(grams: DataFrame, threshold: float) -> DataFrame:
    """(text, name, lb, at): what may equal a segment of a longer name."""
    n = F.length("name")
    sizes = F.sequence(F.lit(0), F.least(n, F.lit(_longest_segment(threshold))))
    sized = grams.select("name", n.alias("lb"), F.explode(sizes).alias("size"))
    # Empty segments occur in very short names only.
    sized = sized.where((F.col("size") > 0) | (F.col("lb") * (2 * threshold - 1) <= 1))
    placed = sized.select("name", "lb", "size", F.explode(F.sequence(F.lit(0), F.col("lb") - F.col("size"))).alias("at"))
    return placed.select(F.col("name").substr(F.col("at") + 1, F.col("size")).alias("text"), "name", "lb", "at")


def _meetings(longer: DataFrame, shorter: DataFrame, threshold: float, equal_too: Column) -> DataFrame:
    """(long, short) names that share a segment within the allowed shift.

    With at most ``d`` edits and ``parts`` segments, take the last segment i with at most
    ``i - (parts - d)`` edits before it: it is unspoiled, and ``parts - i`` edits at most follow.
    """
    t = threshold
    long = longer.toDF("text", "long", "la", "at_l", "place", "parts", "parity")
    short = shorter.toDF("text", "short", "lb", "at_s")
    most = F.floor((1 - t) * (F.col("la") + F.col("lb")) + 1e-9)
    d = most - F.pmod(F.col("la") + F.col("lb") - most, F.lit(2))
    shift, apart = F.col("at_s") - F.col("at_l"), F.col("lb") - F.col("la")
    fits = (
        ((F.col("lb") < F.col("la")) | ((F.col("lb") == F.col("la")) & equal_too))
        & (F.pmod(F.col("la") - F.col("lb"), F.lit(2)) == F.col("parity"))
        & (F.col("lb") * (2 - t) >= F.col("la") * t - 1e-9)
        & (F.abs(shift) <= F.col("place") - F.col("parts") + d)
        & (F.abs(apart - shift) <= F.col("parts") - F.col("place"))
        & (2 * shift <= d + apart) & (-2 * shift <= d - apart)
    )
    return salted_join(long, short, ["text"], fits).select("long", "short")


def _gram_table(names: DataFrame) -> DataFrame:
    """Distinct names with their character pairs and characters, stored: several steps read it."""
    distinct = names.where(F.length("name") > 0).select("name").distinct()
    return materialise(
        distinct.select(
            "name", _grams(F.col("name"), 2).alias("pairs"), _grams(F.col("name"), 1).alias("chars")
        ),
        "name-grams",
    )


def similar_names(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(name_a, name_b, ratio) for distinct names with ratio at or above ``threshold``.

    ``left`` and ``right`` have one column ``name``. Without ``right`` the join is a self join and
    only ``name_a < name_b`` is returned. The ratio depends on the order of its arguments; it is
    taken as ``ratio(name_a, name_b)``.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must lie in (0.5, 1]")
    grams_l = _gram_table(left)
    grams_r = grams_l if right is None else _gram_table(right)
    # Each side is read twice, for the block sizes and for the join.
    sub_l = materialise(_substrings(grams_l, threshold), "name-substrings")
    sub_r = sub_l if right is None else materialise(_substrings(grams_r, threshold), "name-substrings")
    frequent = _frequent([sub_l] if right is None else [sub_l, sub_r])
    cut_l = materialise(_segments(grams_l, threshold, frequent), "name-segments")
    if right is None:
        met = _meetings(cut_l, sub_l, threshold, F.col("long") < F.col("short"))
        candidates = met.select(F.least("long", "short").alias("name_a"), F.greatest("long", "short").alias("name_b"))
    else:
        cut_r = materialise(_segments(grams_r, threshold, frequent), "name-segments")
        candidates = _meetings(cut_l, sub_r, threshold, F.lit(True)).toDF("name_a", "name_b").unionByName(
            _meetings(cut_r, sub_l, threshold, F.lit(False)).toDF("name_b", "name_a")
        )
    candidates = candidates.distinct()
    la, lb = F.length("name_a"), F.length("name_b")
    grams_a = grams_l.toDF("name_a", "pairs_a", "chars_a")
    grams_b = grams_r.toDF("name_b", "pairs_b", "chars_b")
    slack = 2 * F.floor((1 - threshold) * (la + lb) + 1e-9)
    likely = (
        F.size(F.array_intersect("pairs_a", "pairs_b")) >= F.greatest(la, lb) - 1 - slack
    ) & (F.size(F.array_intersect("chars_a", "chars_b")) * 2 >= (la + lb) * threshold - 1e-9)
    counted = candidates.join(grams_a, "name_a").join(grams_b, "name_b").where(likely)
    ratio = _ratio_udf(threshold)
    return counted.select("name_a", "name_b", ratio("name_a", "name_b").alias("ratio")).where(
        F.col("ratio") >= threshold
    )
