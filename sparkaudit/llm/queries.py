"""The registered queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.llm import block_dedup, bpe, chat, exact_dedup, jaccard, mixing, phrases, quality, rules, secrets, simhash, suffix_dedup, whitening

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


BLOCKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) > 1 AS again
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM w WHERE again),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
k AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed
  FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return quality.classify(documents(spark, folder), labels)


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(documents(spark, folder), ranks, public_tokenizers.PATTERN)


query("op5_mixing")(lambda spark, folder: mixing.mix(documents(spark, folder)))


@query(
    "op9_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY lowered ORDER BY doc_id DESC) = 1 AS kept, sha256(lowered) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)
WINDOW w AS (PARTITION BY lowered)
""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_copies(documents(spark, folder))


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.summary(documents(spark, folder))


@query("op8_block_dedup", BLOCKS_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return block_dedup.summary(documents(spark, folder))


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    stats = rules.statistics(documents(spark, folder))
    judged = rules.judge(stats, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_secret_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return secrets.summary(docs, secrets.learn(docs))


@query("op2_chat_format")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Roles are learned from three quarters of the conversations and recovered in all; the recovery never sees them."""
    turns = spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet")
    transcripts = chat.as_transcripts(turns)
    model = chat.learn(transcripts.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2))
    return chat.recover(transcripts.drop("role"), model).select("conv_id", "turn", "role", "states", "rendered")


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))


@query("op11_collocations", phrases.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder))


@query("op13_jaccard_join", jaccard.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(documents(spark, folder))
