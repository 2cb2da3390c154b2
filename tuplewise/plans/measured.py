"""Joins of cyclic bodies by measured sizes.

A cyclic body has no join order that is safe without knowing the data, so its atoms are measured first: rows, distinct rows and distinct values
of each variable, all in one job that reads only the columns needed. Joins are then put together pair by pair: always the pair whose result grows
least over its larger side, so that small functional atoms go into all sides before two atoms meet on a variable of few values. What only checks
(its variables are all there) is a semi-join. A side is broadcast only if its measured size is at most BROADCAST_BYTES.

The first pair that expands is counted exactly, by keys, since averages hide skew. If the largest intermediate result is then expected to exceed
what the body can yield at all (the AGM bound) by WORSE or more, `auto` takes the plan variable by variable (generic.py), which stays under that bound.
Where it is far larger than the atoms, `auto` joins them in cells (cells.py), which shuffles only the atoms.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
#: Growth over the larger side from which a pair is counted exactly, and from which its rows are dealt anew; repeats from which an atom is made a set; see above.
GROWS, EXPANDS, REPEATS, WORSE = 1.5, 4.0, 1.3, 4.0


@dataclass
class Node:
    """A frame with its (estimated) rows and distinct values of each variable."""

    vars: frozenset[str]
    df: DataFrame
    rows: float
    values: dict[str, float]
    #: Rows were counted, not estimated.
    counted: bool = False

    @property
    def small(self) -> bool:
        return self.counted and self.rows * (8 * len(self.vars) + 16) <= BROADCAST_BYTES


def measure(frames: list[tuple[frozenset[str], DataFrame]]) -> list[Node]:
    """Nodes of some frames, whose columns are their variables; one job. Frames with many repeats become sets."""
    jobs = None
    for i, (vs, df) in enumerate(frames):
        each = F.create_map(*[x for v in sorted(vs) for x in (F.lit(v), F.approx_count_distinct(v))])
        one = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*sorted(vs))).alias("sets"), each.alias("each")).select(F.lit(i).alias("i"), "rows", "sets", "each")
        jobs = one if jobs is None else jobs.unionByName(one)
    out = []
    for (vs, df), r in zip(frames, sorted(jobs.collect(), key=lambda r: r["i"]), strict=True):  # a row for each atom
        repeats = r["rows"] > REPEATS * r["sets"]
        out.append(Node(vs, df.distinct() if repeats else df, min(r["rows"], r["sets"] * 1.1) if repeats else r["rows"], {v: max(1.0, r["each"][v]) for v in vs}, True))
    return out


def expected(a: Node, b: Node) -> float:
    """Rows of the join, values taken to be evenly spread."""
    return a.rows * b.rows / prod(max(a.values[v], b.values[v]) for v in a.vars & b.vars)


def exact(a: Node, b: Node) -> int:
    """Rows of the join, from the counts of each key."""
    on = sorted(a.vars & b.vars)
    left, right = a.df.groupBy(*on).agg(F.count("*").alias("m")), b.df.groupBy(*on).agg(F.count("*").alias("n"))
    return left.join(right, on).agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0


def agm_bound(nodes: list[Node]) -> float:
    """The most rows that atoms of these sizes can yield together, over fractional covers of halves."""
    every = frozenset().union(*(n.vars for n in nodes))
    covers = (w for w in product((0.0, 0.5, 1.0), repeat=len(nodes)) if all(sum(x for x, n in zip(w, nodes, strict=True) if v in n.vars) >= 1 for v in every))
    return min(prod(max(1.0, n.rows) ** x for x, n in zip(w, nodes, strict=True)) for w in covers)


def _pick(nodes: list[Node]) -> tuple[Node, Node, float]:
    """The pair whose join grows least over its larger side; the larger side first."""
    best = None
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if a.vars & b.vars:
                rows = expected(a, b)
                big, other = (a, b) if a.rows >= b.rows else (b, a)
                found = (rows / max(1.0, big.rows), rows, big, other)
                best = found if best is None or found[:2] < best[:2] else best
    _, rows, big, other = best
    return big, other, rows


def _merge(big: Node, other: Node, rows: float, later: frozenset[str], build: bool) -> Node:
    on = sorted(big.vars & other.vars)
    have = big.vars | other.vars
    values = {v: min(rows, big.values.get(v, rows), other.values.get(v, rows)) for v in have}
    out = big.df
    if build:
        if big.vars <= other.vars and not other.vars <= big.vars:
            big, other = other, big
        side, left = F.broadcast(other.df) if other.small else other.df, big.df
        if other.small and rows > EXPANDS * big.rows:
            # no shuffle would deal the rows: few large input splits must not make all the results
            spark = left.sparkSession
            left = left.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
        out = left.join(side, on, "left_semi" if other.vars <= big.vars else "inner")
    keep = have & later
    if keep != have and keep:
        sets = min(rows, prod(values[v] for v in keep))
        if build:
            out = out.select(*sorted(keep))
            out = out.distinct() if sets < rows / 2 else out
        rows = sets if sets < rows / 2 else rows
        have = keep
    return Node(have, out, max(1.0, rows), {v: max(1.0, min(values[v], rows)) for v in have})


def _combine(nodes: list[Node], needed: frozenset[str], build: bool) -> tuple[Node, float]:
    """All nodes as one, and the most rows expected on the way."""
    nodes, most, asked = list(nodes), 0.0, False
    while len(nodes) > 1:
        big, other, rows = _pick(nodes)
        if not build and not asked and rows > GROWS * big.rows and big.counted and other.counted:
            asked, rows = True, max(rows, float(exact(big, other)))
        nodes = [n for n in nodes if n is not big and n is not other]
        later = needed.union(*(n.vars for n in nodes))
        most = max(most, rows)
        nodes.append(_merge(big, other, rows, later, build))
    return nodes[0], most


def join_measured(nodes: list[Node], needed: frozenset[str]) -> DataFrame:
    """A connected body joined pair by pair."""
    return _combine(nodes, needed, True)[0].df


def expected_most(nodes: list[Node], needed: frozenset[str]) -> float:
    """The most rows expected on the way, pair by pair."""
    return _combine(nodes, needed, False)[1]


def too_many(nodes: list[Node], most: float) -> bool:
    """Whether so many rows are far more than the body can yield."""
    return len(nodes) <= 8 and most > WORSE * agm_bound(nodes)


def wants_generic(nodes: list[Node], needed: frozenset[str]) -> bool:
    """Whether pairs are expected to make far more rows than the body can yield."""
    return too_many(nodes, expected_most(nodes, needed))
