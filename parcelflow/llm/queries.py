"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import binary_codes, chats, licenses, mixing
from .common import table
from .language_id import language_report
from .lexical import ranked, ranked_sql
from .near_duplicates import near_duplicates
from .neighbours import nearest
from .pieces import piece_digest
from .quality import quality_report
from .token_files import token_file_digest
from .vector_codes import compressed, compressed_sql
from .vector_groups import vector_groups, vector_groups_sql


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.nearest_codes(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.rotated(table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_pages(spark, table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def op12_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_near_duplicates, op3_nearest_neighbours, op4_source_mix, op5_exact_topk, op6_language, op7_chat_perspectives, op8_licenses, op9_quality, op10_pieces, op11_vector_codes, op12_vector_groups, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mix": mixing.mix_sql(),
        "op5_exact_topk": binary_codes.nearest_codes_sql(),
        "op7_chat_perspectives": chats.rotated_sql(),
        "op8_licenses": licenses.scan_pages_sql(),
        "op11_vector_codes": compressed_sql(),
        "op12_vector_groups": vector_groups_sql(),
        "op13_ranked_search": ranked_sql(),
    }
