"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage works on all that the one before it kept, and all but the last return the columns
of ``documents``. A null text counts as empty everywhere; rows that repeat a doc_id are rows of
their own but for near duplicates, where they are one; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, near_duplicates, packing, pii
from tidemark.plans.staging import drop, scoped, staged


def _aside(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one struct ``row``, so that no added column meets their names."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from :func:`_aside`."""
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as ``lang``: those without a
    letter, null and empty texts among them, go. Where no label can be learned from, ``lang``
    stays as it is."""
    model = langid.train(docs.where(~langid.held_out()))
    if not model:
        return langid.with_letters(docs)
    found = langid.identify(_aside(docs), model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return _back(found.withColumn("row", F.col("row").withField("lang", F.col("lang_pred"))), docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates by five-word
    shingles; all of those without words or without a doc_id."""
    return near_duplicates.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make less than a twentieth of; those without words
    stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _back(decontaminate.with_contamination(_aside(docs), benchmark).where("not contaminated"), docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; null and empty
    texts stay as they are."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences, a null or empty text as its end id alone; few
    words are remembered, as the executors still hold what the stages before took."""
    return packing.pack_documents(docs, cache_chunks=150_000)


STAGES = [("language", language), ("deduplicated", deduplicated), ("decontaminated", decontaminated), ("private", private), ("packed", packed)]

#: SQL can express neither the model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences packed from ``documents`` of ``sf_dir`` (columns of
    ``packing.pack_documents``): each stage's result is stored in the shared folder and read by
    the next, and deleted with all that the stage stored on the way once that is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        here: list[str] = []
        with scoped(spark):
            docs = staged(stage(spark, docs, sf_dir), name, here)
        drop(spark, before)
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)
