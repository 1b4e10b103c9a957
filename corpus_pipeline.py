"""Corpus cleaning as five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read back as the next stage's docs. All but the last return the
columns of ``docs``, further ones with any names included.

In every stage null texts count as empty, very long texts are read in whole,
repeated rows are judged alike, and an empty table gives an empty table.

1. quality: documents scored under 0.3 go (model fitted on ``labels``);
2. near_duplicates: one document of each group stays (five-word shingles, 0.8);
3. decontaminate: documents that hold passages of ``benchmark`` go;
4. personal_data: personal data is replaced by its kind, ``n_chars`` follows;
5. packing: length buckets and token-budget batches of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.llm import decontaminate, near_dedup, packing, pii, quality
from phredloom.llm.common import materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of the labels table train the model: those of ``docs``, the stage's own input.

    Every row is judged by its own text: rows without a doc_id too, and repeats stay repeats.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group stays; of rows with that id, one. Rows without a doc_id are in no group and stay."""
    return near_dedup.keep_first(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id has a contaminated text go, all rows of that id; rows without a doc_id stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, null texts null; ``n_chars`` changes only where the text does."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of ``docs``, without its text: bucket, batch and slot; equal lengths stand in order of doc_id, null first."""
    return packing.pack(docs.select("doc_id", packing.word_tokens(F.col("text")).alias("n")), "doc_id", "n")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None  # the fitted model and the packing have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is a table before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
