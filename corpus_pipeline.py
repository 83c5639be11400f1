"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import jaccard, language, mixing, packing, toxicity
from gapline.llm.shared import bound_batches, crc_fold, table, written

#: A document whose best language has a lower mean probability over its bytes than all but this share of held-out texts in
#: that language is rejected, as are those without letters.
LOST_LANGUAGE_SHARE = 0.005


def _beside(docs: DataFrame) -> DataFrame:
    """The text, and the whole row as one column, so that no column of the row is taken for an operator's result."""
    return docs.select("text", F.struct("*").alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language. Every byte of four fifths of the rows with a language teaches the network;
    all the others give the least score of each language."""
    bound_batches(docs.sparkSession)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language.train_on_all(docs.select("doc_id", "text", "lang").filter(~held_out))
    apart, _ = written(language.identify(_beside(docs.filter(held_out)), model))  # judged once, for the bounds and for the result
    least = F.lit(1.0)
    for name, bound in language.least_of(apart.withColumn("_lang", F.col("_row.lang")), model, LOST_LANGUAGE_SHARE, "_lang").items():
        least = F.when(F.col("lang_pred") == name, bound).otherwise(least)
    judged = language.identify(_beside(docs.filter(~held_out)), model).unionByName(apart)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select("_row.*")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents. The classifier learns from a bounded sample of the labelled rows."""
    bound_batches(docs.sparkSession)
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(_beside(docs), model).filter("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a Jaccard similarity of 0.8 or more over five-word shingles."""
    bound_batches(docs.sparkSession)
    return jaccard.one_of_each(docs, size=5, num=80, den=100).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes, as documents: one for each pass that takes words of a document."""
    bound_batches(docs.sparkSession)
    return mixing.mixed_documents(docs, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all words in sequences of the permitted lengths."""
    bound_batches(docs.sparkSession)
    packed = packing.pack_documents(docs.select("doc_id", "text", "lang", "source"))
    return packed.select("doc_id", "lang", "source", "start", "words", "bin", "capacity", "used", "slot", "offset")


STAGES = [
    ("language ID", identify_language),
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models and iterated joins are beyond SQL; `tests/llm/test_pipeline.py` holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
