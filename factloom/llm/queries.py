"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, chat, divergence, embedding_dedup, imatch, language_id, line_dedup, minhash, packing, quality, retention, substring_dedup, warc
from factloom.llm.vocabularies import vocabulary
from factloom.session import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the quality of every document."""
    return quality.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups near-duplicate embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document."""
    return language_id.identify(_documents(spark, sf_dir))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document and its edited text."""
    return imatch.compare_with_edits(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, then reads every record back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    folder, files = warc.archive(spark, pages)
    found = warc.read_captures(pages, folder, files)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by a byte-level vocabulary."""
    docs = _documents(spark, sf_dir)
    return byte_bpe.digests(byte_bpe.encode(docs, "doc_id", "text", vocabulary("byte_bpe_multi_50k.tiktoken"), decoded=True), "doc_id")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups near-duplicate documents."""
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes repeated multi-line chunks from every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = line_dedup.remove_repeated_chunks(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes 50-word windows that an earlier document has too."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.digests(substring_dedup.remove_repeats(docs))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 4,096 tokens."""
    docs = _documents(spark, sf_dir)
    return packing.tokenise_and_pack(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compares every source's use of terms with the other sources' and its language's."""
    return divergence.audit(_documents(spark, sf_dir))


def op12_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of clients by cohort, as known at two times."""
    return retention.matrix(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


#: A conversation beside those of the table, whose texts look like marks of templates.
_MARKS = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds every conversation's events, formats it, and reads the formatted texts back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame(_MARKS, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render(chat.conversation_log(rows.unionByName(marks))), in_order=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality,
            op2_embedding_dedup,
            op3_language_id,
            op4_imatch,
            op5_warc,
            op6_byte_bpe,
            op7_minhash,
            op8_line_dedup,
            op9_substring_dedup,
            op10_best_fit_packing,
            op11_source_divergence,
            op12_cohort_retention,
            op13_chat_format,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
            f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                   CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN first <> page_id THEN first END AS refers_to
            FROM p LEFT JOIN f USING (d)""",
        "op8_line_dedup": line_dedup.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_cohort_retention": retention.ORACLE,
        "op13_chat_format": chat.ORACLE,
    }
