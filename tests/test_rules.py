"""Parser, joins, regressions and random rules against a brute-force evaluator."""

import itertools
import random

import pytest

from tuplewise.catalog import Database, Relation, compute_join, instantiate_database
from tuplewise.errors import ArityMismatchError, BadAtomError, InvalidDataError, ParseError, UnknownRelationError, UnsafeRuleError, UnsupportedFormatError
from tuplewise.parser import parse_rule
from tuplewise.rules import Const, Var, Wildcard

STRATEGIES = ["auto", "yannakakis", "generic"]


@pytest.mark.parametrize("text", [
    "Reach(U, W) :- Hop(U, V), Hop(V, W).", "buys(maria, T):- ticket(T), open(T).", "  K(M,N)  :-  L(M),O(N)  .  ", "none(_,_) :- rows(_,_).",
    "near(D, _, oslo, E) :- road(D, _, oslo, E), paved(D, E).", "Twin(M,\n M) :-\n Pair(M, M).", "Wide(Z) :- " + ", ".join(f"part{i}(Z)" for i in range(24)) + ".",
    "Row(" + ", ".join(f"C{i}" for i in range(18)) + ") :- base(" + ", ".join(f"C{i}" for i in range(18)) + ").",
])
def test_accepts(text):
    rule = parse_rule(text)
    assert parse_rule(rule.to_datalog()) == rule


@pytest.mark.parametrize("text", [
    "T(M) :- U(M)", "T(M) U(M).", "T(M) :- .", "T(M) :- U(M). more", "T(M) :- U(M). T(M) :- V(M).", "T(M) :- U(M)..", "", " \t ", "_(M) :- U(M).", "T(_m) :- U(M).", "T(_7) :- U(M).", "Één(M) :- U(M).",
    "9lives(M) :- U(M).", "T(__) :- U(M).", "T() :- U(M).", "T(M) :- U(5).", "T(M) :- U(M),.", "T(M) := U(M).", "T(M :- U(M).",
])
def test_rejects(text):
    with pytest.raises(ParseError):
        parse_rule(text)


def run(spark, rule, strategy="auto", **relations):
    db = Database(spark, strategy=strategy)
    for name, rows in relations.items():
        db.add_tuples(name, rows) if rows else db.add_relation(name, len(next(a.terms for a in parse_rule(rule).body if a.name == name)))
    return {tuple(r) for r in db.query(rule).collect()}


E = [(1, 2), (2, 3), (3, 4), (1, 3)]
#: Joins whose results are known.
CASES = [
    ("path(X, Y, Z) :- edge(X, Y), edge(Y, Z).", {"edge": E}, {(1, 2, 3), (1, 3, 4), (2, 3, 4)}),
    ("Q(X) :- first(X), second(X).", {"first": [(1,), (2,), (3,)], "second": [(2,), (3,), (4,)]}, {(2,), (3,)}),
    ("Q(X) :- p(X, c10).", {"p": [(1, 10), (2, 20), (3, 30)]}, {(1,)}),
    ("T(A,B,C) :- r(A,B), s(B,C), t(A,C).", {"r": [(1, 2), (2, 3), (3, 1)], "s": [(2, 3), (3, 1), (1, 2)], "t": [(1, 3), (2, 1), (3, 2)]}, {(1, 2, 3), (2, 3, 1), (3, 1, 2)}),
    ("Q(A,B,C,D) :- r(A,B), s(B,C), t(C,D).", {"r": [(1, 2), (2, 3)], "s": [(2, 4), (3, 5)], "t": [(4, 6), (5, 7)]}, {(1, 2, 4, 6), (2, 3, 5, 7)}),
    ("Q(A,B,C) :- r(A,B), s(A,C).", {"r": [(1, 2), (1, 3), (1, 4)], "s": [(1, 10), (1, 20)]}, {(1, b, c) for b in (2, 3, 4) for c in (10, 20)}),
    ("Q(A,B,C) :- r(A,B), s(B,C).", {"r": [(1, 2), (3, 4)], "s": [(5, 6), (7, 8)]}, set()),
    ("T(A,B,C) :- r(A,B), s(B,C), t(A,C).", {"r": [(7, 4)], "s": [(4, 1), (4, 4), (4, 5), (4, 9)], "t": [(7, 2), (7, 3), (7, 5)]}, {(7, 4, 5)}),
    # projection, column order, wildcards, repeats, dead ends, order of first keys, late empty relations
    ("Q(X,Z) :- e(X,Y), e(Y,Z).", {"e": E}, {(1, 3), (1, 4), (2, 4)}),
    ("Q(X,Y) :- e(Y,X).", {"e": E}, {(2, 1), (3, 2), (4, 3), (3, 1)}),
    ("Q(X) :- e(_,X).", {"e": E}, {(2,), (3,), (4,)}),
    ("Q(X) :- e(X,X).", {"e": [(1, 1), (1, 2), (2, 3)]}, {(1,)}),
    ("T(X,Y,Z) :- e(X,Y), e(Y,Z), e(X,Z).", {"e": [(1, 2), (1, 3), (2, 4), (3, 5), (1, 5)]}, {(1, 3, 5)}),
    ("Q(X) :- a(X), b(X).", {"a": [(3,), (5,)], "b": [(1,), (3,), (4,)]}, {(3,)}),
    ("Q(X,Y) :- e(X,Y).", {"e": [(1, 2), (2, 4), (2, 5), (2, 5)]}, {(1, 2), (2, 4), (2, 5)}),
    ("Q(X,Y) :- a(X), b(Y).", {"a": [(1,)], "b": []}, set()),
    # head constants and repeats, guards, products
    ("Q(c5,X,X) :- a(X).", {"a": [(1,)]}, {(5, 1, 1)}),
    ("Q(X) :- a(X), e(c1,c2).", {"a": [(1,)], "e": E}, {(1,)}),
    ("Q(X) :- a(X), e(c9,_).", {"a": [(1,)], "e": E}, set()),
    ("Q(X,Y) :- a(X), b(Y), e(U,V), e(V,W).", {"a": [(1,), (2,)], "b": [(3,)], "e": E}, {(1, 3), (2, 3)}),
    ("Q(c1) :- a(c1).", {"a": [(1,)]}, {(1,)}),
    ("Q(X) :- a(X), b(c99999999999999999999).", {"a": [(1,)], "b": [(1,)]}, set()),
]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize(("rule", "data", "want"), CASES)
def test_cases(spark, rule, data, want, strategy):
    assert run(spark, rule, strategy, **data) == want


def brute(rule, data):
    names = sorted({t.name for a in rule.body for t in a.terms if isinstance(t, Var)})
    out = set()

    def go(i, env):
        if i == len(rule.body):
            out.add(tuple(env[t.name] if isinstance(t, Var) else int(t.name[1:]) for t in rule.head.terms))
            return
        for row in set(data[rule.body[i].name]):
            new = dict(env)
            for t, v in zip(rule.body[i].terms, row, strict=True):
                if isinstance(t, Wildcard):
                    continue
                if isinstance(t, Const):
                    if int(t.name[1:]) != v:
                        break
                elif new.setdefault(t.name, v) != v:
                    break
            else:
                go(i + 1, new)

    go(0, {})
    return out, names


def random_rule(rng):
    sizes = {"p": 1, "q": 2, "r": 2, "s": 3}
    body, used = [], []
    for _ in range(rng.randrange(1, 6)):
        name = rng.choice(list(sizes))
        terms = [rng.choices([rng.choice("ABCDE"), "_", f"c{rng.randrange(4)}"], [8, 1, 1])[0] for _ in range(sizes[name])]
        used += [t for t in terms if t.isupper()]
        body.append(f"{name}({', '.join(terms)})")
    head = rng.sample(sorted(set(used)), rng.randrange(0, len(set(used)) + 1)) or ["c3"]
    return f"Q({', '.join(head)}) :- {', '.join(body)}.", sizes


def test_random_rules_agree(spark):
    rng = random.Random(7)
    for _ in range(25):
        text, sizes = random_rule(rng)
        data = {n: [tuple(rng.randrange(4) for _ in range(k)) for _ in range(rng.choice((0, 3, 9)))] for n, k in sizes.items()}
        want, _ = brute(parse_rule(text), data)
        for strategy in STRATEGIES:
            db = Database(spark, strategy=strategy)
            for n, k in sizes.items():
                db.add(Relation.from_tuples(spark, n, data[n], arity=k))
            assert {tuple(r) for r in db.query(text).collect()} == want, (text, strategy, data)


def test_errors(spark, tmp_path):
    db = Database(spark)
    db.add_tuples("e", E)
    for text, error in [("Q(X) :- m(X).", UnknownRelationError), ("Q(X) :- e(X).", ArityMismatchError), ("Q(X,Y) :- e(X,_).", UnsafeRuleError), ("Q(_) :- e(X,_).", UnsafeRuleError), *[(f"Q(X) :- e(X,{c}).", BadAtomError) for c in ("foo", "c", "c1x", "cc5", "x42")]]:
        with pytest.raises(error):
            db.query(text)
    with pytest.raises(InvalidDataError):
        db.add_tuples("n", [(-1,)])
    with pytest.raises(UnsupportedFormatError):
        db.add_file("x.json")


def test_bindings_order_and_names(spark):
    db = instantiate_database(spark, "column-trie", "leapfrog_triejoin")
    db.add_tuples("e", E)
    df = db.query("Q(X, X, Ab, AB) :- e(X, Ab), e(Ab, AB).", ordered=True)
    assert df.columns == ["X", "X_1", "Ab", "AB"] and [tuple(r) for r in df.collect()] == [(1, 1, 2, 3), (1, 1, 3, 4), (2, 2, 3, 4)]
    assert {tuple(r) for r in db.query("Q(Z) :- e(X,Y), e(Y,Z).", output="bindings").collect()} == {(3, 1, 2), (4, 1, 3), (4, 2, 3)}


def test_relation_api(spark):
    r = Relation.from_tuples(spark, "r", [(1, 2), (1, 3)], ["a", "b"])
    assert {tuple(x) for x in r.project([0]).df.collect()} == {(1,)} and r.project([1, 1]).attrs == ("b", "b_1")
    with pytest.raises(IndexError):
        r.project([2])
    assert r.insert([(1, 2), (5, 6)]).df.count() == 3
    assert {tuple(x) for x in compute_join(spark, [[(1, 2)], [(2, 3)]], [0, 1, 2], [[0, 1], [1, 2]]).collect()} == {(1, 2, 3)}


def test_plan_shapes(spark, tmp_path):
    spark.createDataFrame([(i, i % 7) for i in range(100)], "a long, b long").write.parquet(str(tmp_path / "e.parquet"))
    db = Database(spark)
    db.add_file(str(tmp_path / "e.parquet"))
    plan = lambda rule: db.query(rule)._jdf.queryExecution().toString()
    assert "EqualTo(b,3)" in plan("Q(X) :- e(X, c3).") or "PushedFilters: [IsNotNull(b), EqualTo(b,3)]" in plan("Q(X) :- e(X, c3).")
    assert "LeftSemi" in plan("Q(X) :- e(X, Y), e(Y, _).")


def test_cyclic_bodies_are_measured(spark, tmp_path):
    from tuplewise.plans import measured

    rng = random.Random(3)
    # a large relation over (P, S), a small one that gives each S one of few N: the two small atoms must not meet first
    ps, sn = [(rng.randrange(500), rng.randrange(100)) for _ in range(8000)], [(i, i % 4) for i in range(100)]
    db = Database(spark)
    db.add_tuples("ps", ps)
    db.add_tuples("sn", sn)
    df = db.query("Q(A,B) :- ps(P,A), ps(P,B), sn(A,N), sn(B,N).")
    of, parts = dict(sn), {}
    for p, a in set(ps):
        parts.setdefault(p, set()).add(a)
    assert {tuple(r) for r in df.collect()} == {(a, b) for g in parts.values() for a in g for b in g if of[a] == of[b]}
    most = measured._combine(measured.measure([(frozenset("PA"), db.relations["ps"].df.toDF("P", "A")), (frozenset("PB"), db.relations["ps"].df.toDF("P", "B")), (frozenset("AN"), db.relations["sn"].df.toDF("A", "N")), (frozenset("BN"), db.relations["sn"].df.toDF("B", "N"))]), frozenset("AB"), False)[1]
    assert most < 60_000  # parts first: 8,000 rows a part and supplier; the nations first: 200,000
    assert "BroadcastHashJoin" in df._jdf.queryExecution().toString()


def test_skewed_cycles_go_variable_by_variable(spark):
    from tuplewise.plans import measured

    def nodes(rows):
        frames = [(frozenset(v), spark.createDataFrame(rows, "a long, b long").toDF(*v)) for v in ("AB", "BC", "AC")]
        return measured.measure(frames)

    hub = [(0, i) for i in range(3000)] + [(i, 0) for i in range(1, 3000)]
    even = [(i, (7 * i + k) % 3000) for i in range(3000) for k in range(2)]
    assert measured.wants_generic(nodes(hub), frozenset("ABC")) and not measured.wants_generic(nodes(even), frozenset("ABC"))
    db = Database(spark)
    db.add_tuples("e", hub)
    edges = set(hub)
    want = {(x, y, z) for x, y in edges for z in ({0} | ({w for w in range(3000)} if y == 0 else set())) if (y, z) in edges and (x, z) in edges}
    for strategy in ("auto", "binary"):
        assert {tuple(r) for r in db.query("T(X,Y,Z) :- e(X,Y), e(Y,Z), e(X,Z).", strategy).collect()} == want


def test_agm_bound(spark):
    from tuplewise.plans import measured

    node = lambda vs, n: measured.Node(frozenset(vs), None, n, {})
    assert measured.agm_bound([node("AB", 100), node("BC", 100), node("AC", 100)]) == 1000
    assert measured.agm_bound([node("AB", 100), node("BC", 1), node("AC", 100)]) == 100


def test_all_pairs_of_small_relations(spark):
    # every pair of unary relations over three values
    sets = [[(v,) for v in s] for k in range(3) for s in itertools.combinations(range(3), k)]
    for a, b in itertools.islice(itertools.product(sets, sets), 0, None, 7):
        assert run(spark, "Q(X) :- a(X), b(X).", a=a, b=b) == set(a) & set(b)
