"""Joins of cyclic bodies, one variable at a time: count, propose, intersect.

Prefixes (bindings of the variables so far) are extended by the next variable: each atom that holds it tells how many values
it has for the prefix, the one with fewest proposes its values, the others only check them by semi-joins. So no step makes more
rows than the least of the atoms allows, whatever the skew; a prefix that any atom doesn't know dies at once.
The atoms' sets are written to the shared folder first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable


def variable_order(atoms: list[frozenset[str]], needed: frozenset[str]) -> list[str]:
    """Connected order: first the variable of most atoms, then always one that shares most atoms with those before; needed ones first on ties."""
    todo = sorted(frozenset().union(*atoms))
    out: list[str] = []
    while todo:
        def rank(v: str) -> tuple:
            near = sum(1 for a in atoms if v in a and a & set(out))
            return (-near, -sum(v in a for a in atoms), v not in needed, v)

        v = min(todo, key=rank)
        out.append(v)
        todo.remove(v)
    return out


def extend_all(pieces: list[tuple[frozenset[str], DataFrame]], needed: frozenset[str]) -> DataFrame:
    """All bindings of a connected body, by prefix extension."""
    order = variable_order([vs for vs, _ in pieces], needed)
    # each atom is read and made a set once, and every later step reads that
    pieces = [(vs, durable(df.distinct(), "atom")) for vs, df in pieces]
    prefix: DataFrame | None = None
    done: list[str] = []
    for v in order:
        # each atom with v, cut to v and the variables bound before
        views = []
        for vs, df in pieces:
            if v in vs:
                on = [d for d in done if d in vs]
                views.append((on, df if len(on) + 1 == len(vs) else df.select(*on, v).distinct()))
        prefix = _extend(prefix, v, views)
        done.append(v)
    assert prefix is not None
    return prefix


def _extend(prefix: DataFrame | None, v: str, views: list[tuple[list[str], DataFrame]]) -> DataFrame:
    if prefix is None:
        return reduce(lambda a, b: a.join(b, v, "left_semi"), [df for _, df in views])
    tied = [(on, df) for on, df in views if on]
    free = [df for on, df in views if not on]
    columns = prefix.columns
    if len(tied) == 1:
        on, df = tied[0]
        out = prefix.join(df, on, "inner")
    else:
        counted = prefix
        for i, (on, df) in enumerate(tied):
            counted = counted.join(df.groupBy(*on).agg(F.count("*").alias(f"n{i}")), on, "inner")
        least = F.least(*[F.col(f"n{i}") for i in range(len(tied))])
        who = reduce(lambda rest, i: F.when(F.col(f"n{i}") == least, F.lit(i)).otherwise(rest), reversed(range(len(tied))), F.lit(-1))
        counted = counted.withColumn("who", who)
        parts = []
        for i, (on, df) in enumerate(tied):
            part = counted.where(F.col("who") == i).select(*columns).join(df, on, "inner")
            for j, (other, check) in enumerate(tied):
                if j != i:
                    part = part.join(check, [*other, v], "left_semi")
            parts.append(part.select(*columns, v))
        out = reduce(DataFrame.unionByName, parts)
    for df in free:
        out = out.join(df, v, "left_semi")
    return out
