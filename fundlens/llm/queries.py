"""The operators on the driver's tables: thin queries, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run
from fundlens.llm import chat, decontaminate, language, line_dedup, mixing, ngram_join, pii, quality_rules, simhash, token_align, token_counts, toxicity, whitening
from fundlens.llm.registry import QUERIES, SQL, query, table
from fundlens.session import materialise

# Words of a text as an array: A-Z lower-cased, split at the six white space bytes.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles_sql(name: str, source: str, key: str, k: int, whole: bool) -> str:
    """CTE of distinct (key, g): k-word shingles; short texts as one shingle if ``whole``."""
    words = f"list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    short = f" UNION ALL SELECT {key}, array_to_string(w, chr(10)) FROM {name}_words WHERE len(w) BETWEEN 1 AND {k - 1}" if whole else ""
    return f"""{name}_words AS MATERIALIZED (SELECT {key}, {words} AS w FROM {source} WHERE text IS NOT NULL),
{name} AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], chr(10)))) AS g
  FROM {name}_words WHERE len(w) >= {k}{short}))"""


# Items of fewer than five words: runs of so many words, of the lengths that occur.
OP1_SQL = f"""WITH {_shingles_sql("dl", "documents", "doc_id", 5, False)},
{_shingles_sql("b", "(SELECT DISTINCT item_id, text FROM benchmark)", "item_id", 5, True)},
lengths AS (SELECT DISTINCT len(w) AS n FROM b_words WHERE len(w) BETWEEN 1 AND 4),
d AS MATERIALIZED (SELECT * FROM dl UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], chr(10)))) AS g
  FROM dl_words JOIN lengths ON len(w) >= n),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared_shingles FROM d JOIN b USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles"""


@query(OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def measured_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, stats, bins), stored: both learning and judging read them."""
    m = quality_rules.text_statistics(docs.select("doc_id", "text")).drop("text")
    return materialise(m.withColumn("bins", quality_rules.measure_bins()), "measures")


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measured_documents(table(spark, sf_dir, "documents"))
    rules = quality_rules.learn_rules(quality_rules.labelled_rows(measured, table(spark, sf_dir, "labels")))
    failed = quality_rules.base_failed()
    rule = quality_rules.decision(rules)
    return measured.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"),
    )


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.fit_language(docs))


OP5_SQL = f"""WITH RECURSIVE {_shingles_sql("s", "documents", "doc_id", 3, True)},
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)"""


@query(OP5_SQL)
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, report="r").select("doc_id", "r.*", F.sha2("text", 256).alias("text_sha256"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(materialise(token_counts.length_histogram(table(spark, sf_dir, "documents")), "lengths"))


@query()
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, key="op8-key", report="n_entities")


_ESC = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
OP9_SQL = f"""WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\\### Assistant: </turn> ok'),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format("text")}) + CASE WHEN same THEN 6 ELSE length({_ESC.format("role")}) + 13 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id, own"""


@query(OP9_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


@query()
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, distance=2)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"), components=4)


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_corpus(table(spark, sf_dir, "documents"))


def all_queries() -> tuple[dict, dict]:
    return {**QUERIES, "pipeline": run}, {**SQL, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
