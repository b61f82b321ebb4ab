"""Joins that must survive hot keys, and exact order statistics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROWS_PER_BLOCK = 4096


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    condition: Column | None = None,
    left_tag: Column | None = None,
    right_tag: Column | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Inner equi-join whose hot keys are cut into blocks.

    For each key the rows of either side are dealt into ``ceil(rows / rows_per_block)`` blocks
    and every block of one side meets every block of the other in a task of its own, so no task
    sees more than ``rows_per_block`` rows of a side per key. Keys below the block size get one
    block and cost nothing extra. The pairs are exactly those of the plain join. ``left_tag`` and
    ``right_tag`` pick the block (default: a hash of the row); columns of both sides other than
    ``keys`` must differ in name.
    """

    def block_counts(df: DataFrame, name: str) -> DataFrame:
        size = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block)).cast("bigint")
        return df.groupBy(*keys).agg(size.alias(name))

    blocks = block_counts(left, "_nl").join(block_counts(right, "_nr"), keys)
    own_l = left_tag if left_tag is not None else F.xxhash64(*left.columns)
    own_r = right_tag if right_tag is not None else F.xxhash64(*right.columns)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    dealt_left = (
        left.join(blocks, keys)
        .withColumn("_bl", F.pmod(own_l, F.col("_nl")))
        .withColumn("_br", every("_nr"))
        .drop("_nl", "_nr")
    )
    dealt_right = (
        right.join(blocks, keys)
        .withColumn("_br", F.pmod(own_r, F.col("_nr")))
        .withColumn("_bl", every("_nl"))
        .drop("_nl", "_nr")
    )
    # A fixed number of partitions: the join grows its input, so tasks must not be merged by the
    # size of what they read.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = [*keys, "_bl", "_br"]
    joined = dealt_left.repartition(n, *spread).join(dealt_right, spread).drop("_bl", "_br")
    return joined if condition is None else joined.where(condition)


def order_statistic(
    df: DataFrame, group: list[str], value: Column, rank: Column, shift: int = 20
) -> DataFrame:
    """The ``rank``-th smallest value (1-based) per group, exact, as column ``value``.

    ``value`` is an integer column and ``rank`` an expression over ``n``, the group's row count.
    Two counting passes: the first counts rows per high part of the value and finds the part that
    holds the rank, the second counts exact values inside that part only. Rows are counted before
    they are shuffled, so a hot group never meets in one task; the windows run over at most
    (value range / 2**shift) and 2**shift counts per group.
    """
    rows = df.select(*group, value.cast("bigint").alias("_v"))
    by_group = W.partitionBy(*group)
    parts = (
        rows.groupBy(*group, F.shiftright("_v", shift).alias("_hi"))
        .agg(F.count("_v").alias("_c"))
        .where(F.col("_c") > 0)
        .withColumn("_upto", F.sum("_c").over(by_group.orderBy("_hi")))
        .withColumn("n", F.sum("_c").over(by_group))
        .withColumn("_rank", rank.cast("bigint"))
        .where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
        .select(*group, "_hi", "n", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_left"))
    )
    inside = (
        rows.withColumn("_hi", F.shiftright("_v", shift))
        .join(parts, [*group, "_hi"])
        .groupBy(*group, "_hi", "n", "_left", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(by_group.orderBy("_v")))
        .where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_c") < F.col("_left")))
    )
    return inside.select(*group, "n", F.col("_v").alias("value"))


def sequential_number(
    df: DataFrame, bucket: list[Column], order: Column, name: str
) -> DataFrame:
    """Dense numbers 1, 2, 3... in ``order`` over the whole frame.

    ``bucket`` is a sortable prefix of the order with a bounded number of rows per value (for a
    unique long id, the id without its low 20 bits). Rows are numbered inside their bucket and
    shifted by the rows of earlier buckets; only the bucket counts meet in one window.
    """
    tagged = df.withColumn("_bucket", F.struct(*[b.alias(f"b{i}") for i, b in enumerate(bucket)]))
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("_bucket", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(order))
    return (
        tagged.withColumn("_rn", inside)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_bucket", "_offset", "_rn")
    )


def top_k_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank_name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group. Spark cuts every group to ``k`` rows before the shuffle."""
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank_name, position).where(F.col(rank_name) <= k)


def first_by(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row per key in ``order``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def last_by(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row per key in ``order``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
