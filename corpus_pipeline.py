"""The corpus pipeline: language, quality, near-duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each stage's rows as Parquet to the
shared folder and reads them again, so a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplewise.llm.bpe import bpe_round_trip
from tuplewise.llm.common import drop_path, durable_at, table
from tuplewise.llm.decontaminate import drop_contaminated
from tuplewise.llm.langid import keep_identified
from tuplewise.llm.near_copies import keep_one
from tuplewise.llm.quality import keep_good


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised: those without a letter, or with too low a score, go."""
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't clearly of the bad class; labels are joined by doc_id from the tables."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (5-word shingles, similarity 0.8 or more): the one with the smallest doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark windows; null and empty ones stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left; null texts have no ids."""
    return bpe_round_trip(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("token_ids", token_ids)]

#: Learned models, fingerprints and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents that all others keep.

    Null, empty and wordless texts have no language and go in the first stage; rows with null or repeated ids are judged as rows, by their texts; an empty
    table gives an empty result; further columns of any name go along to the last stage. A stage's rows are deleted when the next are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = durable_at(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
