"""The corpus pipeline: five stages, each calling one training-data operator.

Every stage takes what the one before kept. All but the last return the columns of documents
as they are, whatever their names; the last returns, for each document, the number of its token
ids and the digests of these ids and of the text decoded from them. Null and empty texts have no
language and go in the first stage; documents with a null id stay in the next ones. Of rows that
repeat an id all stay or go together. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import decontaminate, language_id, near_dedup, personal_data, piece_codec
from prosegauge.llm.common import held_out, shared_folder, table, unused
from prosegauge.llm.queries import PIECE_MODEL

#: Languages less sure than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language and those that the model isn't sure of; lang becomes the predicted one."""
    columns = docs.columns
    model = language_id.fit(docs, ~held_out())
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    found = language_id.predicted(docs, model, names=(lang, score))
    sure = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).withColumn("lang", F.col(lang)).select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    return near_dedup.kept(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks; n_chars follows the new text."""
    columns = docs.columns
    weights = personal_data.train(personal_data.vote_counts(docs))
    base, spans = unused(docs, "pii_base"), unused(docs, "pii_spans")
    found = personal_data.with_spans(docs, weights, names=(base, spans))
    text = F.when(F.col("text").isNotNull(), personal_data.masked(F.col("text"), F.col(spans)))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    return piece_codec.round_trip(docs, PIECE_MODEL)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("pieces", piece_stage),
]

#: Trained models and minhash bands have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
