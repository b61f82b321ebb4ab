"""A corpus pipeline of five stages, from raw documents to a mixture of sources.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; ``docs``
has the columns of the documents table. The last stage adds what the mixture takes of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from fundlens.llm.columns import all_of, packed, unpacked
from fundlens.session import materialise, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or meet a learned rule go."""
    rows = docs.select(packed(docs), "doc_id", "text")
    stored = materialise(quality_rules.text_statistics(rows).withColumn("bins", quality_rules.measure_bins()).drop("text"), "quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rule = quality_rules.decision(quality_rules.learn_rules(quality_rules.labelled_rows(stored, labels)))
    return stored.where(~quality_rules.base_failed() & (rule == 0)).select(*unpacked(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; documents without a word left go."""
    rest = line_dedup.dedup_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*all_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard of 0.8, the one of least doc_id stays."""
    return ngram_join.keep_first(docs, k=5, percent=80).select(*all_of(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with their words, the source's target and the words taken.

    A name of these that the documents have already gets an underscore behind it.
    """
    return mixing.mixed_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mixture)]

# Learned rules, alignments and hashes are beyond SQL: tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
