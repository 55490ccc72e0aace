"""The corpus pipeline: five stages over `documents`, each of which can be run on what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. run(spark, sf_dir) applies them in order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.lineage import cut
from riskframe.llm import language_id
from riskframe.llm.decontaminate import drop_contaminated
from riskframe.llm.line_dedup import line_dedup, passage_dedup
from riskframe.llm.pieces import encode_pieces
from riskframe.llm.simhash import drop_near_duplicates

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
LEAST_SCORE = 0.5

#: No stage but the second has a form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told: null and letterless texts go, and those no language has half a chance for.

    The model learns from the rows with a language; a null lang is filled with the prediction. Without any row that
    has a language nothing can be told and every row goes.
    """
    model = language_id.fit(docs, VOCABULARY)
    told = language_id.predict(docs, model)
    told = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later repeats of runs of lines, then of passages of over 50 words, deleted from their texts."""
    return passage_dedup(line_dedup(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, their checksum, and whether decoding them gives the text back."""
    coded = encode_pieces(docs, VOCABULARY)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), "ids_crc32",
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored"))


STAGES = [("language_id", identify_language), ("line_dedup", remove_repeated_lines),
          ("simhash_near_dedup", remove_near_duplicates), ("decontamination", decontaminate), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
