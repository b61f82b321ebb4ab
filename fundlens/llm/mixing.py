"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of its documents in a keyed random order, repeated as often as needed, and
cut into blocks of equally many words. Slot i of the schedule takes the point frac(i * golden
ratio), which the cumulative weights map to a source; the r-th slot of a source takes its r-th
block. The points spread so evenly that each source has its blocks within a few slots of its share
at every place of the schedule. What a source still lacks is appended, what exceeds its target is
left out, and its last block ends at the target.

Offsets in a stream and ranks of slots are summed in two steps, within parts and over parts, so a
source that holds most rows is spread over many tasks.

Cases: a null text has size 0 and is never taken. A null source is a source of its own, the last.
A null doc_id is a document like others; rows that repeat a doc_id are documents of their own, of
which equal ones are interchangeable. An empty table gives no rows. Other columns are not read.
``mixed_documents`` keeps them whatever their names; its own get an underscore behind a name that is
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.columns import fresh, packed, unpacked
from fundlens.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
SLOTS = 1 << 17  # blocks of the whole mixture
PARTS = 1024  # of a source's stream, at least
PART_ROWS = 1 << 16  # documents of a part, about, where a source has more parts
CHUNK = 4096  # slots
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, repeats: int = MAX_REPEATS) -> list[float]:
    """Targets of sources in order: ``share`` of all by weight, none above ``repeats`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        full = {i for i in free if unit * w[i] > repeats * sizes[i]}
        for i in full or free:
            out[i] = float(repeats * sizes[i]) if full else unit * w[i]
        left -= sum(out[i] for i in full)
        free = free - full if full else set()
    return out


def schedule(spark, needs: list[int], weights: list[float]) -> DataFrame:
    """(slot, source, rank): ``needs[s]`` slots of source s, by golden-ratio points through ``weights``."""
    total = sum(weights)
    bounds, reached = [], 0.0
    for x in weights:
        reached += x / total
        bounds.append(reached)
    count = sum(needs)
    point = (F.col("slot") * F.lit(GOLDEN)) % 1
    source = F.least(F.size(F.filter(F.lit(bounds), lambda b: b <= point)), F.lit(len(needs) - 1))
    slots = spark.range(count).select(F.col("id").alias("slot")).select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), source.alias("source"))
    base = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = base.select(
        "source", "chunk",
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(before, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("inside")).alias("rank"))
    need = F.element_at(F.lit(needs), F.col("source") + 1)
    have = base.groupBy("source").agg(F.sum("n").alias("have"))
    lacking = (
        spark.range(len(needs)).select(F.col("id").cast("int").alias("source")).join(have, "source", "left")
        .select("source", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < need)
        .select("source", F.explode(F.sequence(F.col("have"), need - 1)).alias("rank"))
    )
    return ranked.where(F.col("rank") < need).unionByName(
        lacking.select((F.lit(count) + F.col("rank") * len(needs) + F.col("source")).alias("slot"), "source", "rank")
    )


def mix(docs: DataFrame, seed: int = 0, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, text_hash) of every row of ``docs``.

    ``taken`` counts the words that the slots of the schedule take from the document, twice if its
    stream is repeated. The list of sources with their sizes is read by the driver.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.lit(seed))
    sized = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("name"), word_count(F.col("text").cast("string")).alias("size"), h.alias("h"), F.xxhash64("text").alias("text_hash")),
        "mix-sizes",
    )
    found = sized.groupBy("name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    # Parts grow in number with the largest source, and not in size.
    part_count = max(PARTS, 1 << max(0, max((r.rows for r in found), default=0) // PART_ROWS).bit_length())
    sized = sized.withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(part_count)))
    found.sort(key=lambda r: (r.name is None, (r.name or "").encode()))
    sizes = [r.size for r in found]
    wanted = targets(sizes)
    takes = [round(t) for t in wanted]
    block = max(1, -(-sum(takes) // slots))
    needs = [-(-t // block) for t in takes]

    listed = spark.createDataFrame(
        [(i, r.name, sizes[i], wanted[i], takes[i]) for i, r in enumerate(found)],
        "source int, name string, source_size long, target double, take long",
    )
    known = sized.join(F.broadcast(listed), sized["name"].eqNullSafe(listed["name"])).drop(listed["name"])  # one row for each source
    parts = known.groupBy("source", "part").agg(F.sum("size").alias("n"))
    whole = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(
        known.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source", "part"])
        .withColumn("at", F.col("start") + F.col("inside")).drop("inside", "start", "part", "h"),
        "mix-places",
    )
    copies = (
        placed.where("size > 0").select("source", "at", "size", "source_size", "take", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("pass"))
        .select("source", "at", (F.col("pass") * F.col("source_size") + F.col("at")).alias("a"), "size", "take")
        .select("source", "at", "a", F.least(F.col("a") + F.col("size"), "take").alias("b")).where("a < b")
    )
    pieces = copies.select("source", "at", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
    if sum(needs):
        plan = schedule(spark, needs, wanted)
        taken = (
            pieces.join(plan, ["source", "rank"])
            .groupBy("source", "at").agg(F.sum(F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)).alias("taken"))
        )
    else:
        taken = pieces.select("source", "at", F.lit(0).cast("long").alias("taken"))
    full = placed.where("size > 0").join(taken, ["source", "at"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.select("doc_id", "size", F.col("name").alias("source"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, seed: int = 0, slots: int = SLOTS) -> DataFrame:
    """Rows of ``docs`` that the mixture takes from, with size, source_size, target and taken.

    Equal rows are interchangeable, so rows of one doc_id, source and text share what was taken from
    them evenly.
    """
    shares = mix(docs, seed, slots).groupBy("doc_id", "source", "text_hash").agg(
        *[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.avg("taken").alias("taken")
    ).where("taken > 0").withColumnsRenamed({"doc_id": "id", "source": "name"})
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("own_id"), F.col("source").cast("string").alias("own_name"), F.xxhash64("text").alias("own_hash"))
    joined = rows.join(
        shares, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_name").eqNullSafe(F.col("name")) & (F.col("own_hash") == F.col("text_hash"))
    )
    return joined.select(*unpacked(docs.columns), *[F.col(c).alias(fresh(docs.columns, c)) for c in ("size", "source_size", "target", "taken")])
