"""Cyclic bodies in one shuffle: every combination of slots of the variables is a cell, and a cell holds all rows that can meet in it.

Pairs of atoms of a dense cycle make far more rows than any atom has, and a join pair by pair shuffles them. Here only the atoms' rows move: each
variable's values are hashed to a number of slots (its share), and a row belongs to all cells that agree with it on its own variables. Shares are
doubled, always where that adds the fewest copies, until a cell's rows fit a worker. Rows travel as sorted, compressed blocks.

The cells of one row are many, and more with each doubling, so copies aren't shuffled. One variable lies across: atoms without it are dealt by the slots
of the others, atoms with it by its slot, and the product of the two sides reads these blocks again for every cell. Only an atom without it that
lacks another variable too has copies on disk; a triangle has none.

In its cell a body is joined one variable at a time over tries: of the atoms that hold the variable, the one with fewest values proposes and the
others check, a block of prefixes at a time, so memory doesn't grow with the result. The last variable's values leave as one list a prefix and are
exploded by Spark. A binding belongs to one cell, and a cell's tries are sets: so the bindings are a set without another shuffle.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generic import variable_order
from .measured import Node

#: Rows that a cell is meant to hold, and factor over that from which a counted cell is too large for this plan (skewed keys).
CELL_ROWS, SKEWED = 4_000_000, 4
#: Rows packed at once; proposals at once; entries of a table that answers whether a trie's node has a child.
PACK_ROWS, BLOCK, TABLE = 2_000_000, 1 << 20, 1 << 26
#: Rows of all atoms in one slot of the variable that lies across.
SLAB_ROWS = 32_000_000
#: Largest intermediate result from which cells are looked at, and how many times the rows that they shuffle it has to be.
WORTH, GAIN = 1_000_000, 2.0


def shares_of(nodes: list[Node], cells: int) -> dict[str, int]:
    """Slots of each variable, powers of two: cells of CELL_ROWS at most if values are evenly spread, and `cells` of them at least."""
    out = {v: 1 for v in sorted(frozenset().union(*(n.vars for n in nodes)))}
    while sum(n.rows / prod(out[v] for v in n.vars) for n in nodes) > CELL_ROWS or prod(out.values()) < cells:
        doubled = min(out, key=lambda v: (rows_sent(nodes, out | {v: 2 * out[v]}), v))
        out[doubled] *= 2
    return out


def rows_sent(nodes: list[Node], shares: dict[str, int]) -> float:
    """Rows with all copies."""
    return sum(n.rows * prod(k for v, k in shares.items() if v not in n.vars) for n in nodes)


def _slots(vs: list[str], shares: dict[str, int]) -> list:
    return [F.pmod(F.xxhash64(v), F.lit(shares[v])).cast("int").alias(f"slot_{v}") for v in vs]


def largest_cell(nodes: list[Node], shares: dict[str, int]) -> int:
    """Rows of the largest cell, counted."""
    order, most = list(shares), np.zeros(tuple(shares.values()), np.int64)
    jobs = None
    for i, n in enumerate(nodes):
        vs = sorted(n.vars)
        counts = n.df.select(*_slots(vs, shares)).groupBy(*[f"slot_{v}" for v in vs]).agg(F.count("*").alias("rows"))
        one = counts.select(F.lit(i).alias("i"), F.array(*[f"slot_{v}" for v in vs]).alias("at"), "rows")
        jobs = one if jobs is None else jobs.unionByName(one)
    for i, at, rows in jobs.collect():  # a row for each block of an atom, fewer than there are cells
        where = dict(zip(sorted(nodes[i].vars), at, strict=True))
        most[tuple(where.get(v, slice(None)) for v in order)] += rows
    return int(most.max())


def pack(columns: list[np.ndarray]) -> bytes:
    """Rows of non-negative integers, sorted, each column from its least value on in as few bytes as hold it."""
    rows = np.lexsort(columns[::-1])
    parts, head = [], []
    for i, c in enumerate(columns):
        c = c[rows]
        low = int(c.min())
        c = np.diff(c, prepend=low) if i == 0 else c - low
        kind = next(k for k in "BHIQ" if int(c.max()) < 1 << (8 * struct.calcsize(f"<{k}")))
        head.append((low, ord(kind)))
        parts.append(c.astype(f"<{np.dtype(kind).str[1:]}").tobytes())
    raw = b"".join(parts)
    return struct.pack("<qqi", len(rows), len(raw), len(columns)) + b"".join(struct.pack("<qi", *h) for h in head) + pa.compress(raw, "zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    n, size, width = struct.unpack_from("<qqi", block)
    at = struct.calcsize("<qqi")
    step = struct.calcsize("<qi")
    head = [struct.unpack_from("<qi", block, at + i * step) for i in range(width)]
    raw, start, out = pa.decompress(block[at + width * step :], size, "zstd", asbytes=True), 0, []
    for i, (low, kind) in enumerate(head):
        kind = np.dtype(chr(kind))
        c = np.frombuffer(raw, kind.newbyteorder("<"), n, start).astype(np.int64)
        out.append((np.cumsum(c) if i == 0 else c) + low)
        start += n * kind.itemsize
    return out


class Trie:
    """An atom's rows by its variables in order: a node's children are its codes of the next variable, ascending."""

    def __init__(self, vs: list[str], columns: list[np.ndarray], sizes: dict[str, int]):
        self.vs, self.keys, self.codes, self.starts, self.tables = vs, [], [], [], {}
        node, nodes = np.zeros(len(columns[0]), np.int64), 1
        for i, (v, c) in enumerate(zip(vs, columns, strict=True)):
            # node numbers are below the rows and codes below the values of a cell, so keys stay far below 63 bits
            key = node * sizes[v] + c
            keys, node = np.unique(key, return_inverse=True) if i + 1 < len(vs) else (np.unique(key), node)
            self.keys.append(keys)
            self.codes.append(keys % sizes[v])
            self.starts.append(np.searchsorted(keys, np.arange(nodes + 1) * sizes[v]))
            nodes = len(keys)

    def table(self, level: int, size: int) -> np.ndarray | None:
        """Whether a node of a level has a child, where that is small."""
        if level not in self.tables:
            nodes = len(self.starts[level]) - 1
            small = nodes * size <= TABLE
            self.tables[level] = np.zeros((nodes, size), bool) if small else None
            if small:
                self.tables[level].reshape(-1)[self.keys[level]] = True
        return self.tables[level]


def join_cell(atoms: list[tuple[list[str], list[np.ndarray]]], order: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns of prefixes, lengths, values of the last variable): all bindings of some atoms, each once."""
    # only values that every atom knows; codes by rank
    names = {v: reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), [np.unique(cs[vs.index(v)]) for vs, cs in atoms if v in vs]) for v in order}
    sizes = {v: len(x) for v, x in names.items()}
    if not all(sizes.values()):
        return
    tries = []
    for vs, cs in atoms:
        mine = sorted(vs, key=order.index)
        codes, known = [], np.ones(len(cs[0]), bool)
        for v in mine:
            at = np.minimum(np.searchsorted(names[v], c := cs[vs.index(v)]), sizes[v] - 1)
            known &= names[v][at] == c
            codes.append(at)
        tries.append(Trie(mine, [c[known] for c in codes], sizes))
    yield from _extend(tries, order, names, [], [np.zeros(1, np.int64) for _ in tries])


def _extend(tries: list[Trie], order: list[str], names: dict[str, np.ndarray], bound: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator:
    """From prefixes (codes of each variable so far, each trie's node) to their bindings."""
    v = order[len(bound)]
    size, last = len(names[v]), len(bound) + 1 == len(order)
    mine = [(i, t, t.vs.index(v)) for i, t in enumerate(tries) if v in t.vs]
    counts = np.stack([t.starts[k][nodes[i] + 1] - t.starts[k][nodes[i]] for i, t, k in mine])
    least, who = counts.min(axis=0), counts.argmin(axis=0)
    tables = [t.table(k, size) for _, t, k in mine] if last else []
    if last and all(t is not None for t in tables) and int(least.sum()) * 16 >= len(least) * size:
        # many values a prefix: whole rows of the tables at once
        step = max(1, BLOCK // size)
        values = np.tile(names[v], min(step, len(least)))
        for lo in range(0, len(least), step):
            met = reduce(np.logical_and, [table[nodes[i][lo : lo + step]] for table, (i, _, _) in zip(tables, mine, strict=True)])
            yield [names[u][c[lo : lo + step]] for u, c in zip(order, bound, strict=False)], np.count_nonzero(met, axis=1), values[: met.size][met.reshape(-1)]
        return
    ends, lo = np.cumsum(least), 0
    while lo < len(least):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        found = []
        for j, (i, t, k) in enumerate(mine):
            rows = np.flatnonzero(who[lo:hi] == j) + lo
            n = least[rows]
            of = np.repeat(rows, n)
            child = np.arange(len(of)) + np.repeat(t.starts[k][nodes[i][rows]] - (np.cumsum(n) - n), n)
            code, at = t.codes[k][child], {i: child}
            for o, other, level in mine:
                if o == i or not len(of):
                    continue
                key = nodes[o][of] * size + code
                table = other.table(level, size) if last else None
                if table is not None:
                    good = table.reshape(-1)[key]
                else:
                    place = np.minimum(np.searchsorted(other.keys[level], key), len(other.keys[level]) - 1)
                    good = other.keys[level][place] == key
                    at[o] = place
                of, code, at = of[good], code[good], {x: y[good] for x, y in at.items()}
            if len(of):
                found.append((of, code, at))
        for of, code, at in found:
            if last:
                rows, n = np.unique(of, return_counts=True)
                yield [names[u][c[rows]] for u, c in zip(order, bound, strict=False)], n, names[v][code]
            else:
                yield from _extend(tries, order, names, [*(c[of] for c in bound), code], [at[i] if i in at else x[of] for i, x in enumerate(nodes)])
        lo = hi


def across(nodes: list[Node], shares: dict[str, int]) -> str:
    """The variable for which the fewest rows are shuffled when it lies across."""
    some = [v for v in shares if not all(v in n.vars for n in nodes)]
    return min(some, key=lambda v: (rows_stored(nodes, shares, v), _slab(nodes, shares, v), v))


def rows_stored(nodes: list[Node], shares: dict[str, int], v: str) -> float:
    """Rows shuffled, with copies, when v lies across."""
    return sum(n.rows * (1 if v in n.vars else prod(k for u, k in shares.items() if u != v and u not in n.vars)) for n in nodes)


def _slab(nodes: list[Node], shares: dict[str, int], v: str) -> float:
    return sum(n.rows for n in nodes if v in n.vars) / shares[v]


def join_cells(nodes: list[Node], shares: dict[str, int], needed: frozenset[str]) -> DataFrame:
    """All bindings of a connected body, as a set."""
    _importable(nodes[0].df.sparkSession)
    order = variable_order([n.vars for n in nodes], needed)
    v = across(nodes, shares)
    shares = dict(shares)
    while _slab(nodes, shares, v) > SLAB_ROWS:  # more slots of it add no copies
        shares[v] *= 2
    strides, down = {}, 1
    for u, k in shares.items():
        if u != v:
            strides[u], down = down, down * k
    strides[v] = down
    left, right, wanted = None, None, []
    for i, n in enumerate(nodes):
        made = _blocks(n.df, sorted(n.vars), shares, strides)
        if v in n.vars:
            one = made.select(F.expr(f"base div {down}").alias("slot"), F.struct(F.lit(i).alias("atom"), (F.col("base") % down).alias("place"), "block").alias("b"))
            right = one if right is None else right.unionByName(one)
            wanted.append(sum((F.expr(f"cell div {strides[u]} % {shares[u]} * {strides[u]}") for u in sorted(n.vars - {v})), F.lit(0)).cast("int"))
        else:
            copies = [0]
            for u in shares:
                if u != v and u not in n.vars:
                    copies = [c + k * strides[u] for c in copies for k in range(shares[u])]
            cell = F.col("base") if copies == [0] else F.explode(F.array(*[F.col("base") + c for c in copies]))
            one = made.select(cell.alias("cell"), F.struct(F.lit(i).alias("atom"), "block").alias("b"))
            left = one if left is None else left.unionByName(one)
            wanted.append(F.lit(-1))
    names = [sorted(n.vars) for n in nodes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(blocks: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            if not all(blocks):
                return
            atoms = []
            for vs, held in zip(names, blocks, strict=True):
                parts = [unpack(b) for b in held]
                atoms.append((vs, [np.concatenate([p[i] for p in parts]) for i in range(len(vs))]))
            for columns, lengths, values in join_cell(atoms, order):
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64()), pa.array(values, pa.int64())).cast(pa.list_(pa.int64()))
                out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), lists], names=order)
                yield out if lengths.all() else out.filter(pa.array(lengths > 0))

        for batch in batches:
            for row in range(batch.num_rows):
                held = [[] for _ in names]
                for column in batch.columns:
                    for b in column[row].as_py():
                        held[b["atom"]].append(b["block"])
                yield from joined(held)

    schema = ", ".join([*(f"{u} long" for u in order[:-1]), f"{order[-1]} array<long>"])
    left = left.repartition(down, "cell").groupBy("cell").agg(F.collect_list("b").alias("blocks")).withColumn("wanted", F.array(*wanted))
    right = right.groupBy("slot").agg(F.collect_list("b").alias("slab")).coalesce(shares[v])
    # a row a cell on the left, a row a slot on the right; no more tasks than cells
    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    mine = F.transform(F.filter("slab", lambda b: b["place"] == F.get("wanted", b["atom"])), lambda b: F.struct(b["atom"].alias("atom"), b["block"].alias("block")))
    return met.select("blocks", mine.alias("others")).mapInArrow(run, schema).select(*order[:-1], F.explode(order[-1]).alias(order[-1]))


def _importable(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver's path has it."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def _blocks(df: DataFrame, vs: list[str], shares: dict[str, int], strides: dict[str, int]) -> DataFrame:
    """(base, block): an atom's rows by their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, *columns = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            by = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by], prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                rows = by[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[rows[0]])], pa.int32()), pa.array([pack([c[rows] for c in columns])], pa.binary())], names=["base", "block"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    base = sum((F.pmod(F.xxhash64(v), F.lit(shares[v])) * F.lit(strides[v]) for v in vs), F.lit(0)).cast("int")
    return df.select(base.alias("base"), *vs).mapInArrow(run, "base int, block binary")
