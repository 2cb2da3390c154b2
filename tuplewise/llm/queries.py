"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses
from .bpe import bpe_round_trip
from .common import table
from .html_text import extract_text
from .langid import language_table
from .media import media_table
from .quality import quality_table
from .simhash import near_duplicates
from .token_store import token_store_digests


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_table(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store_digests(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("matches")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_language": op2_language,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_token_store": op5_token_store,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op10_licenses": licenses.oracle_sql(),
}
