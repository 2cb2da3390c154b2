"""Incremental evaluation of a rule over a relation that arrives as a stream.

A tuple of the result is new only if at least one of its witnesses is. So for each place of the growing relation in the body the rule
runs once with the new tuples in that place and all tuples, old and new, in the others; the union of these runs holds every new result, and
costs no run over old tuples alone. Batches and their results are written by batch number, so that a batch which is run again after a failure
replaces what its first run left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Database, Relation
from ..errors import UnknownRelationError
from ..parser import parse_rule
from ..plans.planner import plan_rule
from ..rules import Atom, Rule


def added_results(db: Database, name: str, new: DataFrame, rule: Rule | str) -> DataFrame:
    """What `new` tuples, not yet in db's relation `name`, add to the rule's result: a set, some of which may have been there before."""
    rule = parse_rule(rule) if isinstance(rule, str) else rule
    if name not in db.relations:
        raise UnknownRelationError(f"no relation {name!r}")
    old, fresh = db.relations[name], Relation.from_df(name, new.toDF(*db.relations[name].attrs)).df
    frames = {n: r.df for n, r in db.relations.items()} | {name: old.df.union(fresh), f"{name} new": fresh}
    parts = []
    for i, atom in enumerate(rule.body):
        if atom.name == name:
            body = (*rule.body[:i], Atom(f"{name} new", atom.terms), *rule.body[i + 1 :])
            parts.append(plan_rule(db.spark, frames, Rule(rule.head, body), db.strategy))
    if not parts:
        return plan_rule(db.spark, frames, rule, db.strategy).limit(0)
    return reduce(DataFrame.union, parts).distinct()


def follow(db: Database, name: str, stream: DataFrame, rule: Rule | str, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Evaluate the rule as `stream` brings tuples of the relation `name`; db holds those from before.

    Under `path`: `tuples/batch=<n>` and `results/batch=<n>` as Parquet. A result may stand in more than one batch. `trigger` goes to Spark's
    own, e.g. availableNow=True.
    """
    first = db.relations[name]

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.toDF(*first.attrs).distinct().write.mode("overwrite").parquet(f"{path}/tuples/batch={n}")
        schema = first.df.schema
        new = spark.read.schema(schema).parquet(f"{path}/tuples/batch={n}")
        known = first.df
        if n:
            known = known.union(spark.read.schema(f"{', '.join(f'`{a}` long' for a in first.attrs)}, batch long").parquet(f"{path}/tuples").where(f"batch < {n}").drop("batch"))
        db.add(Relation(name, first.attrs, known))
        added_results(db, name, new, rule).write.mode("overwrite").parquet(f"{path}/results/batch={n}")
        db.add(Relation(name, first.attrs, known.union(new)))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
