"""The corpus pipeline: documents through five stages, each one of the training-data operators.

Every stage takes ``(spark, docs, sf_dir)``, works on all of ``docs`` and returns the columns it got, whatever other
columns there are and whatever their names; the last returns the pieces of the packed sequences. Rows without a
text are not in a language and end with the first stage. Empty tables pass through. A repeated doc_id stays or
goes as one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm.common import add_columns, table
from sealyard.llm.jaccard import similar_documents
from sealyard.llm.language import LEAST_SCORE, UNKNOWN, fit_language, predict_language
from sealyard.llm.packing import VOCABULARY, pack_documents
from sealyard.llm.quality import rate_quality
from sealyard.llm.suffixes import remove_copied


def _with_names_apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame], used: tuple[str, ...]) -> DataFrame:
    """``work`` on ``docs`` with its other columns under names that no operator uses; the columns as they were."""
    apart = {c: c if c in used else f"__{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.toDF(*apart.values()))
    return done.select([F.col(new).alias(old) for old, new in apart.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known, with a score that can be relied on."""

    def work(rows: DataFrame) -> DataFrame:
        predicted = predict_language(rows, fit_language(rows))
        return predicted.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))

    return _with_names_apart(docs, work, ("doc_id", "text", "lang"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no base rule and read like trusted text."""

    def work(rows: DataFrame) -> DataFrame:
        return rate_quality(rows, table(spark, sf_dir, "labels")).where("kept")

    return _with_names_apart(docs, work, ("doc_id", "text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that hang together by similarity, the one with the smallest doc_id."""

    def work(rows: DataFrame) -> DataFrame:
        rated = similar_documents(rows.select("doc_id", "text"))
        gone = rated.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
        return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")

    return _with_names_apart(docs, work, ("doc_id", "text"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without what an earlier document has; ``n_chars`` follows the text.

    A character of which only some bytes stay is left out.
    """

    def decoded():
        def compute(kept):
            return [[k.decode("utf-8", "ignore") for k in kept]]

        return compute

    def work(rows: DataFrame) -> DataFrame:
        left = add_columns(remove_copied(rows), ["kept"], "text string", decoded)
        return left.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in rows.columns else left

    return _with_names_apart(docs, work, ("doc_id", "text", "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their ids."""
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Trained models, tokenizers and similarity links are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the table that the one before wrote."""
    from sealyard.session import materialise

    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
