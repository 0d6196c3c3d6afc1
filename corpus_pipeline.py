"""A corpus pipeline of five stages over the table ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and is written as Parquet and read again for the next one. All but the
last return the columns of their input, whatever others it has beside ``doc_id`` and ``text``;
``n_chars``, if there is one, follows the text. Null ids and texts, empty and repeated rows
go through as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import line_dedup, minhash, packing, quality, storage, substring_dedup
from factloom.llm.vocabularies import vocabulary
from factloom.session import spread, table


def _aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of ``docs``; own columns named like those that it adds are kept out of its way."""
    renamed = {c: f"_own_{c}" for c in docs.columns if c in names}
    found = stage(docs.withColumnsRenamed(renamed)).drop(*names)
    return found.withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.5."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _aside(docs, ("_score",), lambda d: quality.score_rows(d, model, "text", "_score").where("_score >= 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts multi-line chunks that occurred before from the texts."""
    return _measured(_aside(docs, ("n_lines", "n_removed"), line_dedup.remove_repeated_chunks))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates."""
    copies = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-word windows that a document of smaller id has too from the texts."""
    return _measured(_aside(docs, ("n_words", "n_removed"), substring_dedup.remove_repeats))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokenised texts into sequences."""
    return packing.tokenise_and_pack(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on the written result of the one before."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
