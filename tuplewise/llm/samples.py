"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30
#: The most labels that a model tells apart: the most frequent ones.
LABELS = 1_000


def sample_ids(rows: DataFrame, id_col: str, label: Column, per_label: int, salt: int) -> DataFrame:
    """(id, label) of about `per_label` rows of each label: those whose hashed id is under the label's share.

    Counts are pre-aggregated; the ids go through no single task. Equal ids share their fate; the same rows give the same sample.
    """
    named = rows.select(F.col(id_col).alias("id"), label.alias("label")).where("id is not null and label is not null")
    counts = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()}
    if not counts:
        return named.limit(0)
    dealt = F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(_SPACE))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(_SPACE, per_label * _SPACE // n)))])
    return named.where(dealt < share[F.col("label")])


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, whatever the repeats of an id: those of the least hash, so that the same rows give the same sample."""
    return rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(most)
