"""Token counts from an exact histogram of encoded lengths.

Every whole text is encoded once with a public tokenizer; documents are then aggregated by their
length. Suffix sums over the histogram answer how many documents and tokens there are from each
length on, and so the totals, quantiles and truncated totals for every context limit. The suffix
sums run within blocks of lengths and over the blocks' totals, so no task gets all lengths.

Cases: a null or empty text has length 0. Repeated rows count as often as they occur. An empty
table has an empty histogram; answers for limits are then 0 and quantiles null. Strings of special
tokens in a text are ordinary text. Other columns aren't read. Long runs of white space are encoded
apart from the text round them (``vocabulary.ByteVocabulary``), so very long texts of any kind pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.vocabulary import byte_vocabulary

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 512  # lengths


def length_histogram(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(length, documents) of all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_vocabulary(ranks).encode
        for batch in batches:
            found = np.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], np.int64)
            length, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["length", "n"])

    base = docs.select(F.col("text").cast("string").alias("text"))
    return base.mapInArrow(count, "length long, n long").groupBy("length").agg(F.sum("n").alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: the histogram with its suffix sums.

    documents_from and tokens_from count from L on; total_documents and total_tokens are of all;
    truncated_tokens is what is left if every document is cut to L tokens; share_up_to is the share
    of documents with at most L tokens.
    """
    h = histogram.select("length", "documents", (F.col("length") * F.col("documents")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    # Over blocks: one row for each BLOCK lengths, at most the longest length / BLOCK.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("total_documents"), F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = h.withColumns({"d_in": F.sum("documents").over(inside), "t_in": F.sum("tokens").over(inside)}).join(blocks, "block")
    summed = joined.select(
        "length", "documents", (F.col("d_in") + F.col("d_after")).alias("documents_from"), (F.col("t_in") + F.col("t_after")).alias("tokens_from"),
        "total_documents", "total_tokens",
    )
    return summed.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("documents_from")).alias("truncated_tokens"),
        (1 - (F.col("documents_from") - F.col("documents")) / F.col("total_documents")).alias("share_up_to"),
    )


def context_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, documents_over, truncated_tokens) for any limits: read from the first length above."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in sorted(set(limits))], "limit long")
    total = sums.agg(F.max("total_tokens").alias("total"))
    above = F.col("length") > F.col("limit")
    next_up = sums.join(F.broadcast(asked), above).groupBy("limit").agg(F.min_by(F.struct("documents_from", "tokens_from"), "length").alias("x"))
    return asked.join(next_up, "limit", "left").join(F.broadcast(total)).select(
        "limit",
        F.coalesce("x.documents_from", F.lit(0)).alias("documents_over"),
        (F.coalesce("total", F.lit(0)) - F.coalesce("x.tokens_from", F.lit(0)) + F.col("limit") * F.coalesce("x.documents_from", F.lit(0))).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    reached = (F.col("total_documents") - F.col("documents_from") + F.col("documents")) >= F.col("share") * F.col("total_documents")
    found = sums.join(F.broadcast(asked), reached).groupBy("share").agg(F.min("length").alias("length"))
    return asked.join(found, "share", "left")
