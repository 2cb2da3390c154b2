"""Dictionary encoding: terms to dense ids from 0, in order of first appearance (subject, predicate, object of each triple)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import durable


def dense_ids(df: DataFrame, order: str, name: str = "id") -> DataFrame:
    """df with ids 0, 1, ... by `order` (distinct values), without sending all rows through one task.

    Rows are range-partitioned and sorted; a row's id is its place in its partition behind the partitions before, of which only
    the sizes (a row each) meet in one place.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    placed = durable(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    low = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + low).drop("__part", "__row", "__before")


def build_dictionary(triples: DataFrame) -> DataFrame:
    """(id, value) of all terms of (s, p, o, pos)."""
    terms = triples.select("pos", F.posexplode(F.array("s", "p", "o")).alias("slot", "value"))
    first = terms.groupBy("value").agg(F.min(F.struct("pos", "slot")).alias("first"))
    return dense_ids(first, "first").select("id", "value")


def encode(triples: DataFrame, dictionary: DataFrame, predicates: Mapping[str, int] | None = None) -> DataFrame:
    """(s, p, o) as ids. Joins shuffle on the term; frequent ones are split by adaptive execution.

    With the ids of all predicates (a schema's worth) those are a constant map, so the few predicates that most triples have make no join keys.
    """
    out = triples.select("s", "p", "o")
    if predicates:
        known = F.create_map(*[F.lit(x) for item in predicates.items() for x in item])
        out = out.withColumn("p_id", known[F.col("p")])
    for c in ("s", "p", "o") if not predicates else ("s", "o"):
        out = out.join(dictionary.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id")), c)
    return out.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))


def decode(result: DataFrame, dictionary: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A result with ids replaced by terms; ids that aren't in the dictionary become null."""
    out = result
    for c in columns or result.columns:
        names = dictionary.select(F.col("id").alias("__id"), F.col("value").alias("__value"))
        out = out.join(names, out[c] == F.col("__id"), "left").withColumn(c, F.col("__value")).drop("__id", "__value")
    return out.select(*result.columns)


def lookup(dictionary: DataFrame, terms: Iterable[str]) -> dict[str, int]:
    """Ids of some terms (those of queries, a bounded list)."""
    terms = sorted(set(terms))
    return {r["value"]: r["id"] for r in dictionary.where(F.col("value").isin(terms)).collect()} if terms else {}


def extend(dictionary: DataFrame, terms: Iterable[str]) -> tuple[DataFrame, dict[str, int]]:
    """The dictionary with fresh ids behind its last one for terms that it lacks, in their order; and the ids of all `terms`."""
    terms = list(dict.fromkeys(terms))
    known = lookup(dictionary, terms)
    fresh = [t for t in terms if t not in known]
    if fresh:
        start = dictionary.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        added = [(start + i, t) for i, t in enumerate(fresh)]
        known |= {t: i for i, t in added}
        dictionary = dictionary.unionByName(dictionary.sparkSession.createDataFrame(added, "id long, value string"))
    return dictionary, known
