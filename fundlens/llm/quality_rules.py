"""Quality rules: a decision list learned by sequential covering, as Spark conditional expressions.

``text_statistics`` measures every whole text with built-in expressions only. ``learn_rules`` grows
conjunctions of thresholds that single out bad rows, one condition at a time: each step is one
aggregate over the labelled rows that counts labels per (measure, bin), so what reaches the driver
is bounded by measures x bins. Two thirds of the labelled rows grow a rule by FOIL gain, the rest
prune its last conditions and decide whether it is good enough. Rows a rule covers leave the set,
and the next rule is learned on the others.

Cases: a null text counts as empty; a text without words has all measures 0 and fails the base
rule. Rows without label or doc_id aren't learned from. Repeated rows count as often as they occur
for learning and are judged alike. Without bad labels the list is empty and only the base rule
acts. Other columns stay, whatever their names; ``into`` must not be one of them. A list has at most
``MAX_RULES`` rules of ``MAX_CONDITIONS`` conditions, each of which covers ``MIN_COVERED`` bad rows of
the pruning part with a precision of ``MIN_PRECISION``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.columns import named, packed, unpacked
from fundlens.session import materialise

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Measures that rules test: (name, expression over the counts, scale of its bins).
BINS = 48
MEASURES = (
    ("n_words", "n_words", "log"),
    ("word_length", "word_chars / n_words", "length"),
    ("symbols", "n_symbols / n_words", "share"),
    ("dup_lines", "n_dup_lines / n_word_lines", "share"),
    ("repeats", "n_repeat_words / n_words", "share"),
    ("distinct", "n_distinct / n_words", "share"),
    ("upper", "n_upper / word_chars", "share"),
    ("marks", "n_marks / n_words", "share"),
    ("digits", "n_digits / word_chars", "share"),
)
MIN_PRECISION = 0.95
MIN_COVERED = 8
MAX_RULES = 16
MAX_CONDITIONS = 4


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    bin: int

    def column(self, at: str) -> Column:
        x = F.col(f"{at}.{self.measure}")
        return x > self.bin if self.above else x <= self.bin


def _removed(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_statistics(df: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """``df`` with the struct ``into`` of counts of its whole text.

    A window of three words repeats when another position of the text has the same words; the
    windows are compared as 64-bit hashes by sorting (hash, position).
    """
    t = F.coalesce(named(text).cast("string"), F.lit(""))
    white = F.lit(WHITE)
    columns = df.columns
    if into in columns:
        raise ValueError(f"the table has a column {into}")
    df = df.select(packed(df), t.alias("__t"), F.btrim(t, white).alias("__s"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, white) != "")
    df = df.select(
        "*", F.when(F.col("__s") != "", F.split("__s", "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")).alias("__w"),
        F.when(F.col("__s") != "", lines).otherwise(F.array().cast("array<string>")).alias("__l"),
    )
    df = df.withColumn(
        "__h",
        F.expr(
            "CASE WHEN size(__w) >= 3 THEN sort_array(transform(sequence(0, size(__w) - 3), "
            "i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) AS h, i AS i))) END"
        ),
    )
    df = df.withColumn(
        "__p",
        F.expr(
            "CASE WHEN __h IS NOT NULL THEN sort_array(transform(filter(__h, (x, j) -> "
            "coalesce(x.h = get(__h, j - 1).h, false) OR coalesce(x.h = get(__h, j + 1).h, false)), x -> x.i)) END"
        ),
    )
    covered = F.expr(
        "coalesce(aggregate(__p, struct(-3 AS last, 0L AS n), (a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n)).n, 0L)"
    )
    count = lambda c: c.cast("long")
    stats = F.struct(
        count(F.size("__w")).alias("n_words"),
        count(F.length("__t") - _removed(F.col("__t"), WHITE)).alias("word_chars"),
        count(_removed(F.col("__t"), SYMBOLS)).alias("n_symbols"),
        count(F.size("__l")).alias("n_word_lines"),
        count(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        count(covered).alias("n_repeat_words"),
        count(F.size(F.array_distinct("__w"))).alias("n_distinct"),
        count(F.length("__t") - F.length(F.regexp_replace("__t", "\\p{Lu}", ""))).alias("n_upper"),
        count(_removed(F.col("__t"), "!?")).alias("n_marks"),
        count(_removed(F.col("__t"), "0123456789")).alias("n_digits"),
    )
    return df.select(*unpacked(columns), stats.alias(into))


def base_failed(stats: str = "stats") -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def measure_bins(stats: str = "stats") -> Column:
    """Struct of the bins, 0 to ``BINS``, that the rules test."""
    out = []
    for name, sql, scale in MEASURES:
        for field in ("n_words", "word_chars", "n_symbols", "n_word_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_digits"):
            sql = " ".join(f"{stats}.{field}" if part == field else part for part in sql.split(" "))
        top, _, bottom = sql.partition(" / ")
        value = f"(CASE WHEN {bottom} = 0 THEN 0D ELSE {top} / cast({bottom} AS double) END)" if bottom else top
        step = {"share": f"{value} * 40", "length": f"{value} * 3", "log": f"log2({value} + 1) * 2.5"}[scale]
        out.append(F.expr(f"cast(least({BINS}, floor({step})) as int)").alias(name))
    return F.struct(*out)


def _counts(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(measure, bin) -> (bad, good) rows of the growing part."""
    bins = F.array(*[F.col(f"bins.{name}") for name, _, _ in MEASURES])
    found = rows.where("grow").select("bad", F.posexplode(bins).alias("measure", "bin")).groupBy("measure", "bin").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    return {(r.measure, r.bin): (r.bad, r.good) for r in found.collect()}


def _best(counts: dict[tuple[int, int], tuple[int, int]]) -> tuple[Condition, float] | None:
    """The condition of the largest FOIL gain; ties go to the first measure and lowest bin."""
    best = None
    for m, (name, _, _) in enumerate(MEASURES):
        per_bin = [counts.get((m, b), (0, 0)) for b in range(BINS + 1)]
        bad, good = sum(x for x, _ in per_bin), sum(x for _, x in per_bin)
        if not bad:
            return None
        low_bad = low_good = 0
        for b in range(BINS):
            low_bad, low_good = low_bad + per_bin[b][0], low_good + per_bin[b][1]
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                    if gain > 1e-9 and (best is None or gain > best[1] + 1e-9):
                        best = Condition(name, above, b), gain
    return best


def _holds(conditions: list[Condition], at: str = "bins") -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(at)
    return out


def learn_rules(labelled: DataFrame) -> list[list[Condition]]:
    """Rules in order from rows (bad, grow, bins); each is a conjunction."""
    rules: list[list[Condition]] = []
    rest = labelled
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            found = _best(_counts(rest.where(_holds(rule))))
            if found is None:
                break
            rule.append(found[0])
        if not rule:
            break
        # On the other rows: the shortest beginning of the rule that is as good as any.
        sums = []
        for i in range(1, len(rule) + 1):
            for kind, cond in (("bad", F.col("bad")), ("good", ~F.col("bad"))):
                sums.append(F.count_if(_holds(rule[:i]) & cond & ~F.col("grow")).alias(f"{kind}{i}"))
        seen = rest.agg(*sums).first()
        value = [(seen[f"bad{i}"] + 1) / (seen[f"bad{i}"] + seen[f"good{i}"] + 2) for i in range(1, len(rule) + 1)]
        keep = 1 + max(range(len(rule)), key=lambda i: (value[i], -i))
        bad, good = seen[f"bad{keep}"], seen[f"good{keep}"]
        if bad < MIN_COVERED or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule[:keep])
        rest = rest.where(~_holds(rule[:keep]))
    return rules


def labelled_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(bad, grow, bins) of measured rows (doc_id, bins) with a quality label."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.select("doc_id", "bins").join(known, "doc_id").select(
        (F.col("quality") == 0).alias("bad"), F.expr("pmod(xxhash64(doc_id), 3) > 0").alias("grow"), "bins"
    )
    return materialise(rows, "labelled")  # every condition of every rule reads them


def decision(rules: list[list[Condition]], bins: str = "bins") -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(_holds(rule, bins), i) if out is None else out.when(_holds(rule, bins), i)
    return out.otherwise(0)
