"""Cyclic bodies joined in cells, against plain evaluations."""

import random

import numpy as np
import pytest

from tuplewise.catalog import Database
from tuplewise.plans import cells, planner


@pytest.mark.parametrize("block", [7, 1 << 20])
@pytest.mark.parametrize("table", [0, 1 << 26])
@pytest.mark.parametrize("body", [["AB", "AC", "BC"], ["AB", "BC", "CD", "AD"], ["ABC", "BCD", "AD"], ["AB", "BC", "AC", "A"]])
def test_a_cell_yields_every_binding_once(monkeypatch, body, table, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "TABLE", table)
    rng = np.random.default_rng(5)
    for rows, values, low in ((60, 6, 0), (60, 30, (1 << 63) - 31), (1, 1, 0)):
        atoms = [(list(vs), cells.unpack(cells.pack([low + rng.integers(0, values, rows) for _ in vs]))) for vs in body]
        order = cells.variable_order([frozenset(vs) for vs in body], frozenset("ABCD"))
        got = [tuple(r) for columns, n, last in cells.join_cell(atoms, order) for r in np.stack([*(np.repeat(c, n) for c in columns), last], 1).tolist()]
        want = [{}]
        for vs, columns in atoms:
            want = [w | dict(zip(vs, t, strict=True)) for w in want for t in set(zip(*(c.tolist() for c in columns), strict=True)) if all(w.get(v, x) == x for v, x in zip(vs, t, strict=True))]
        assert len(got) == len(set(got)) and set(got) == {tuple(w[v] for v in order) for w in want}


def test_shares_bound_a_cell():
    node = lambda vs, n: planner.Node(frozenset(vs), None, n, {})
    nodes = [node("AB", 3e7), node("AC", 3e7), node("BC", 3e7)]
    shares = cells.shares_of(nodes, 16)
    assert sum(n.rows / np.prod([shares[v] for v in n.vars]) for n in nodes) <= cells.CELL_ROWS
    assert cells.rows_sent(nodes, shares) <= 6 * 9e7


def test_dense_cycles_shuffle_their_atoms_only(spark, monkeypatch):
    """Pairs of the atoms, and a last look for repeats, would be shuffled by the size of the result and more."""
    monkeypatch.setattr(planner, "WORTH", 1000)
    rng = random.Random(9)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(1500)]
    keep = [(x, 3 if x % 5 else 0) for x in range(50)]
    db = Database(spark)
    for name in ("r", "s", "t"):
        db.add_tuples(name, [(a, b, (a + b) % 50) for a, b in rows])
    db.add_tuples("u", keep)
    edges, good = set(rows), {x for x, k in keep if k == 3}
    some = {(a, b) for a, b in edges if (a + b) % 50 in good}
    for rule, first in (("Q(A,B,C) :- r(A,B,_), s(A,C,_), t(B,C,_).", edges), ("Q(C,A,B) :- r(A,B,X), s(A,C,_), t(B,C,_), u(X,c3).", some)):
        df = db.query(rule)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_NUM") == 1
        got = [(r["A"], r["B"], r["C"]) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b, c) for a, b in first for c in range(60) if (a, c) in edges and (b, c) in edges}
    # a head that leaves a variable out, and a constant in it
    assert {tuple(r) for r in db.query("Q(A) :- r(A,B,_), s(A,C,_), t(B,C,_).").collect()} == {(a,) for a, b in edges for c in range(60) if (a, c) in edges and (b, c) in edges}
    assert db.query("Q(A,B,C,c7) :- r(A,B,_), s(A,C,_), t(B,C,_).").where("c7 = 7").count() == len({(a, b, c) for a, b in edges for c in range(60) if (a, c) in edges and (b, c) in edges})


def test_skewed_cells_are_counted(spark):
    df = spark.createDataFrame([(0, i) for i in range(500)], "a long, b long")
    nodes = [planner.Node(frozenset(v), df.toDF(*v), 500, {}) for v in ("AB", "AC", "BC")]
    assert cells.largest_cell(nodes, {"A": 4, "B": 1, "C": 1}) == 1500
    assert cells.largest_cell(nodes, {"A": 4, "B": 2, "C": 2}) < 1500


@pytest.mark.parametrize("slab", [200, cells.SLAB_ROWS])
@pytest.mark.parametrize(("body", "copied"), [(("AB", "AC", "BC"), 0), (("AB", "BC", "CD", "AD"), 2)])
def test_cells_read_blocks_again_instead_of_copies(spark, monkeypatch, body, copied, slab):
    """The rows of a triangle's atoms are shuffled once, however many cells they belong to."""
    monkeypatch.setattr(cells, "SLAB_ROWS", slab)
    rng = random.Random(3)
    sets = [sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(150)}) for _ in body]
    nodes = [planner.Node(frozenset(vs), spark.createDataFrame(rows, ", ".join(f"{v} long" for v in vs)), len(rows), {}) for vs, rows in zip(body, sets, strict=True)]
    shares = {v: 2 for v in sorted(set("".join(body)))}
    df = cells.join_cells(nodes, shares, frozenset(shares))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the result's lists, and atoms that lack a variable besides the one that lies across
    assert plan.count("Generate explode") == 1 + copied and "CartesianProduct" in plan
    want = [{}]
    for vs, rows in zip(body, sets, strict=True):
        want = [w | dict(zip(vs, t, strict=True)) for w in want for t in rows if all(w.get(v, x) == x for v, x in zip(vs, t, strict=True))]
    got = [tuple(r) for r in df.select(*shares).collect()]
    assert len(got) == len(want) and set(got) == {tuple(w[v] for v in shares) for w in want}
    assert cells.rows_stored(nodes, shares, cells.across(nodes, shares)) <= sum(n.rows for n in nodes) * (1 if not copied else 1.6)
