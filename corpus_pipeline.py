"""A corpus pipeline of five training-data operators: each stage reads what its predecessor wrote.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the last return the columns of
documents. Stages 1 to 3 drop rows, stage 4 repeats or drops them, stage 5 encodes.

Every stage takes what any table of documents may hold, whatever came before it:
- nulls: texts without words don't pass stage 1, nor 2; 3 keeps them; 4 draws them like others, for no words; 5 gives
  them the begin and end ids. Rows without doc_id, source or other values are treated like others.
- repeated rows and ids: 1, 2 and 5 treat each row by itself; 3 keeps one row of each group, also of rows equal in all.
- ties: 3 keeps the least doc_id, then the least text hash; 4 draws by a hash.
- very long texts are read whole; an empty table gives an empty one; more columns are carried along (5 drops them).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm.common import shared_dir, table
from parcelflow.llm.language_id import keep_identified
from parcelflow.llm.mixing import mix
from parcelflow.llm.near_duplicates import keep_one_of_each
from parcelflow.llm.pieces import piece_digest
from parcelflow.llm.quality import keep_clean

#: The similarity in percent from which the pipeline takes documents for near duplicates; operator 2's own is 85.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more."""
    return keep_one_of_each(docs, NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated or left out."""
    return mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document of the mix."""
    return piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]

#: SQL can express neither the classifiers nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
