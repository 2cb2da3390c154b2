"""Registered rules over the synthetic tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue_files, catalogue_tools, lab
from .catalog import Database, compute_join
from .catalogue_sql import GEO, geo_triples, triples_of
from .rdf import entail as ent
from .rdf.dictionary import build_dictionary
from .rdf.pipeline import build_store
from .sources.files import read_csv_relation, write_relation

#: Relations by name: table, columns (or expressions over them).
RELATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "o": ("orders", ("o_orderkey", "o_custkey")),
    "lo": ("lineitem", ("l_orderkey", "l_suppkey")),
    "lp": ("lineitem", ("l_orderkey", "l_partkey")),
    "ps": ("lineitem", ("l_partkey", "l_suppkey")),
    "c": ("customer", ("c_custkey", "c_nationkey")),
    "s": ("supplier", ("s_suppkey", "s_nationkey")),
    "n": ("nation", ("n_nationkey", "n_regionkey")),
    "r": ("region", ("r_regionkey",)),
    "cust": ("customer", ("c_custkey",)),
    "part": ("part", ("p_partkey",)),
    "supp": ("supplier", ("s_suppkey",)),
    "e": ("events", ("user_id % 50", "event_id % 50")),
    # sparse relations for the cyclic rules with payloads
    "ra": ("lineitem", ("(l_partkey * 5 + l_linenumber) % 9973", "l_orderkey % 9967", "l_orderkey % 1009")),
    "sa": ("lineitem", ("(l_partkey * 5 + l_linenumber) % 9973", "(l_orderkey * 7 + l_partkey) % 9949", "l_partkey % 1013")),
    "ta": ("lineitem", ("l_orderkey % 9967", "(l_orderkey * 7 + l_partkey) % 9949", "l_suppkey % 1019")),
    "ud": ("orders", ("o_orderkey % 1009", "o_custkey % 11")),
    "ve": ("orders", ("o_orderkey % 1013", "o_custkey % 13")),
    "wf": ("orders", ("o_custkey % 1019", "o_orderkey % 17")),
}


def database(spark: SparkSession, sf_dir: str, names: list[str], strategy: str = "auto") -> Database:
    """The relations as lazy projections of the tables: a query reads only the columns it needs."""
    db = Database(spark, strategy=strategy)
    for name in names:
        table, columns = RELATIONS[name]
        db.add_df(name, spark.read.parquet(f"{sf_dir}/{table}.parquet").select([F.expr(x).cast("bigint").alias(f"c{i}") for i, x in enumerate(columns)]))
    return db


#: name: (rule, SQL).
RULES: dict[str, tuple[str, str]] = {
    "scan_parquet": ("Q(O,C) :- o(O,C).", 'SELECT DISTINCT o_orderkey AS "O", o_custkey AS "C" FROM orders'),
    "project_set": ("Q(S) :- lo(_,S).", 'SELECT DISTINCT l_suppkey AS "S" FROM lineitem'),
    "project_reorder": ("Q(C,O) :- o(O,C).", 'SELECT DISTINCT o_custkey AS "C", o_orderkey AS "O" FROM orders'),
    "select_const": ("Q(O) :- lo(O,c7).", 'SELECT DISTINCT l_orderkey AS "O" FROM lineitem WHERE l_suppkey = 7'),
    "select_const_first": ("Q(S) :- lo(c42,S).", 'SELECT DISTINCT l_suppkey AS "S" FROM lineitem WHERE l_orderkey = 42'),
    "head_const": ("Q(c5,S) :- s(S,c5).", 'SELECT DISTINCT CAST(5 AS BIGINT) AS "c5", s_suppkey AS "S" FROM supplier WHERE s_nationkey = 5'),
    "intra_eq": ("Q(X) :- ps(X,X).", 'SELECT DISTINCT l_partkey AS "X" FROM lineitem WHERE l_partkey = l_suppkey'),
    "unary_intersect": ("Q(X) :- cust(X), part(X).", 'SELECT c_custkey AS "X" FROM customer INTERSECT SELECT p_partkey FROM part'),
    "unary_intersect3": ("Q(X) :- cust(X), part(X), supp(X).", 'SELECT c_custkey AS "X" FROM customer INTERSECT SELECT p_partkey FROM part INTERSECT SELECT s_suppkey FROM supplier'),
    "binary_join": ("Q(C,O,S) :- o(O,C), lo(O,S).", 'SELECT DISTINCT o_custkey AS "C", o_orderkey AS "O", l_suppkey AS "S" FROM orders JOIN lineitem ON o_orderkey = l_orderkey'),
    "chain4": ("Q(C,O,S,N) :- o(O,C), lo(O,S), s(S,N).", 'SELECT DISTINCT o_custkey AS "C", o_orderkey AS "O", l_suppkey AS "S", CAST(s_nationkey AS BIGINT) AS "N" FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey'),
    "chain_region": ("Q(C,N,R) :- c(C,N), n(N,R).", 'SELECT DISTINCT c_custkey AS "C", CAST(n_nationkey AS BIGINT) AS "N", CAST(n_regionkey AS BIGINT) AS "R" FROM customer JOIN nation ON c_nationkey = n_nationkey'),
    "star": ("Q(O,C,P) :- o(O,C), lp(O,P).", 'SELECT DISTINCT o_orderkey AS "O", o_custkey AS "C", l_partkey AS "P" FROM orders JOIN lineitem ON o_orderkey = l_orderkey'),
    "self_join": (
        "Q(A,B) :- ps(P,A), ps(P,B), s(A,N), s(B,N).",
        'SELECT DISTINCT a.l_suppkey AS "A", b.l_suppkey AS "B" FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b USING (l_partkey) JOIN supplier x ON a.l_suppkey = x.s_suppkey JOIN supplier y ON b.l_suppkey = y.s_suppkey AND x.s_nationkey = y.s_nationkey',
    ),
    "triangle": (
        "Q(X,Y,Z) :- e(X,Y), e(Y,Z), e(X,Z).",
        'WITH e AS (SELECT DISTINCT user_id % 50 AS a, event_id % 50 AS b FROM events) SELECT DISTINCT x.a AS "X", x.b AS "Y", y.b AS "Z" FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b',
    ),
    "triangle_payload": (
        "Q(A,B,C) :- ra(A,B,X), sa(A,C,Y), ta(B,C,Z).",
        'WITH r AS (SELECT DISTINCT (l_partkey * 5 + l_linenumber) % 9973 AS a, l_orderkey % 9967 AS b FROM lineitem), s AS (SELECT DISTINCT (l_partkey * 5 + l_linenumber) % 9973 AS a, (l_orderkey * 7 + l_partkey) % 9949 AS c FROM lineitem), t AS (SELECT DISTINCT l_orderkey % 9967 AS b, (l_orderkey * 7 + l_partkey) % 9949 AS c FROM lineitem) SELECT DISTINCT r.a AS "A", r.b AS "B", s.c AS "C" FROM r JOIN s USING (a) JOIN t ON t.b = r.b AND t.c = s.c',
    ),
    "six_way": (
        "Q(A,B,C) :- ra(A,B,X), sa(A,C,Y), ta(B,C,Z), ud(X,c3), ve(Y,c5), wf(Z,c7).",
        "WITH r AS (SELECT DISTINCT (l_partkey * 5 + l_linenumber) % 9973 AS a, l_orderkey % 9967 AS b FROM lineitem WHERE l_orderkey % 1009 IN (SELECT o_orderkey % 1009 FROM orders WHERE o_custkey % 11 = 3)), s AS (SELECT DISTINCT (l_partkey * 5 + l_linenumber) % 9973 AS a, (l_orderkey * 7 + l_partkey) % 9949 AS c FROM lineitem WHERE l_partkey % 1013 IN (SELECT o_orderkey % 1013 FROM orders WHERE o_custkey % 13 = 5)), t AS (SELECT DISTINCT l_orderkey % 9967 AS b, (l_orderkey * 7 + l_partkey) % 9949 AS c FROM lineitem WHERE l_suppkey % 1019 IN (SELECT o_custkey % 1019 FROM orders WHERE o_orderkey % 17 = 7)) SELECT DISTINCT r.a AS \"A\", r.b AS \"B\", s.c AS \"C\" FROM r JOIN s USING (a) JOIN t ON t.b = r.b AND t.c = s.c",
    ),
    "cycle4": (
        "Q(C,O,S,N) :- o(O,C), lo(O,S), c(C,N), s(S,N).",
        'SELECT DISTINCT c_custkey AS "C", o_orderkey AS "O", s_suppkey AS "S", CAST(c_nationkey AS BIGINT) AS "N" FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey',
    ),
    "semi_join": ("Q(C) :- o(O,C), lo(O,_).", 'SELECT DISTINCT o_custkey AS "C" FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)'),
    "semi_chain": ("Q(C) :- c(C,N), n(N,R), r(R).", 'SELECT DISTINCT c_custkey AS "C" FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region))'),
    "cartesian": ("Q(N,R) :- n(N,_), r(R).", 'SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS "N", CAST(r_regionkey AS BIGINT) AS "R" FROM nation CROSS JOIN region'),
    "guard_true": ("Q(R) :- r(R), n(c0,_).", 'SELECT CAST(r_regionkey AS BIGINT) AS "R" FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0)'),
    "guard_false": ("Q(R) :- r(R), n(c999,_).", 'SELECT CAST(r_regionkey AS BIGINT) AS "R" FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 999)'),
}


def run_rule(spark: SparkSession, sf_dir: str, rule: str, strategy: str = "auto") -> DataFrame:
    from .parser import parse_rule

    parsed = parse_rule(rule)
    return database(spark, sf_dir, sorted({a.name for a in parsed.body}), strategy).query(parsed)


def compute_join_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programmatic form, over tuples in memory: the 25 nations and 5 regions."""
    nations = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()]
    regions = [(r[0],) for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()]
    return compute_join(spark, [nations, regions], [0, 1], [[0, 1], [1]])


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation written as CSV and read again with all checks."""
    from .storage import new_path

    path = new_path(spark, "csv")
    write_relation(database(spark, sf_dir, ["o"]).relations["o"].df.toDF("O", "C"), path, "csv")
    return read_csv_relation(spark, path).distinct()


def ordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, ["c", "n"]).query("Q(C,N,R) :- c(C,N), n(N,R).", ordered=True)


def project_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a relation by place."""
    return database(spark, sf_dir, ["ps"]).relations["ps"].project([1, 0]).df.toDF("S", "P")


def insert_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples inserted into a relation, some of them already there."""
    db = database(spark, sf_dir, ["n"])
    db.add_keys_batch("n", [(0, 0), (100, 1), (100, 1), (101, 2)])
    return db.query("Q(N,R) :- n(N,R).")


def least_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least supplier key of 6 or more in each part's set: what a seek in a sorted index answers."""
    return database(spark, sf_dir, ["ps"]).relations["ps"].seek([0], 1, 6).toDF("P", "S")


def _ub(name: str) -> str:
    return ent.ub(name)


_TYPE = ent.RDF_TYPE
_ORG = f"""
SELECT '<http://u/c' || CAST(c_custkey AS STRING) || '>' AS s, '{_TYPE}' AS p, CASE WHEN c_custkey % 3 = 0 THEN '{_ub("GraduateStudent")}' WHEN c_custkey % 3 = 1 THEN '{_ub("FullProfessor")}' ELSE '{_ub("UndergraduateStudent")}' END AS o FROM customer
UNION ALL SELECT '<http://u/c' || CAST(c_custkey AS STRING) || '>', CASE WHEN c_custkey % 50 = 1 THEN '{_ub("headOf")}' ELSE '{_ub("worksFor")}' END, '<http://u/n' || CAST(c_nationkey AS STRING) || '>' FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT '<http://u/c' || CAST(c_custkey AS STRING) || '>', '{_ub("mastersDegreeFrom")}', '<http://u/r' || CAST(c_nationkey % 5 AS STRING) || '>' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT '<http://u/n' || CAST(n_nationkey AS STRING) || '>', '{_TYPE}', '{_ub("Department")}' FROM nation
UNION ALL SELECT '<http://u/n' || CAST(n_nationkey AS STRING) || '>', '{_ub("subOrganizationOf")}', '<http://u/r' || CAST(n_regionkey AS STRING) || '>' FROM nation
UNION ALL SELECT '<http://u/r' || CAST(r_regionkey AS STRING) || '>', '{_ub("subOrganizationOf")}', '<http://u/world>' FROM region
"""


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_triples(spark, sf_dir)


def _org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples_of(spark, sf_dir, _ORG, ("customer", "nation", "region"))


def rdf_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dictionary(_geo(spark, sf_dir))


def rdf_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of one predicate, in ids."""
    store = build_store(_geo(spark, sf_dir))
    return store.database().query("Q(S,O) :- inregion(S,O).")


def rdf_bgp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SPARQL pattern over encoded triples, decoded."""
    store = build_store(_geo(spark, sf_dir))
    return store.select("PREFIX e: <http://example.org/> PREFIX n: <http://example.org/ns#> SELECT ?x ?y WHERE { ?a e:inRegion ?b ; n:name ?x . ?b n:name ?y }").toDF("x", "y")


def rdf_bgp_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build_store(_geo(spark, sf_dir))
    return store.select("SELECT ?x WHERE { ?x <http://example.org/inRegion> <http://example.org/region1> }").toDF("x")


def entail_step(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    """What one kind of inference adds to the triples in a single round."""
    t, o = _org(spark, sf_dir).distinct(), ent.univ_bench()
    found = {
        "subclass": lambda: ent.subclass_step(t, o),
        "subproperty": lambda: ent.subproperty_step(t, o),
        "inverse": lambda: ent.inverse_step(t.withColumn("p", F.when(F.col("p") == _ub("mastersDegreeFrom"), _ub("degreeFrom")).otherwise(F.col("p"))), o),
        "transitive": lambda: ent.transitive_step(t, t, o),
        "realise": lambda: ent.realise_step(t, t, o),
    }[step]()
    return found.distinct()


def entail_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All consequences of the triples."""
    return ent.entail(_org(spark, sf_dir))[0]


def lab_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_orderkey")
    return lab.pivot(df, "l_returnflag", "l_linestatus", "l_orderkey", "max", ["F", "O"])


def lab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two return flags compared by line number, with whole numbers as values."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").cast("double").alias("mean_ns"))
    df = df.select("l_returnflag", F.col("l_linenumber").cast("long").alias("line"), "mean_ns", F.col("mean_ns").alias("mean_lo"), F.col("mean_ns").alias("mean_hi"))
    return lab.compare(df, "A", "R", "l_returnflag").select("line", "baseline_value", "target_value", F.round("speedup", 6).alias("speedup"))


def lab_mannwhitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity")
    return lab.mann_whitney(df, "l_returnflag", "l_quantity", "A", "R").select("n1", "n2", F.round("u1", 1).alias("u1"))


def _entailed_sql() -> str:
    """The closure in DuckDB: a recursive union over the direct edges of the ontology."""
    sub = ", ".join(f"('{a}', '{b}')" for a, bs in ent.univ_bench().superclasses.items() for b in bs)
    prop = ", ".join(f"('{a}', '{b}')" for a, bs in ent.univ_bench().superproperties.items() for b in bs)
    inv = ", ".join(f"('{a}', '{b}')" for a, bs in ent.univ_bench().inverses.items() for b in bs)
    return f"""
WITH RECURSIVE sc(a, b) AS (VALUES {sub}), sp(a, b) AS (VALUES {prop}), iv(a, b) AS (VALUES {inv}), base AS ({_ORG}),
heads AS (SELECT DISTINCT x.s, '{_TYPE}' AS p, '{_ub("Chair")}' AS o FROM base x JOIN base y ON x.p = '{_ub("headOf")}' AND y.s = x.o AND y.p = '{_TYPE}' AND y.o = '{_ub("Department")}'),
reach(s, o) AS (SELECT s, o FROM base WHERE p = '{_ub("subOrganizationOf")}' UNION SELECT r.s, b.o FROM reach r JOIN base b ON b.p = '{_ub("subOrganizationOf")}' AND b.s = r.o),
t0 AS (SELECT s, p, o FROM base UNION SELECT * FROM heads UNION SELECT s, '{_ub("subOrganizationOf")}', o FROM reach),
t1 AS (SELECT * FROM t0 UNION SELECT s, sp.b, o FROM t0 JOIN sp ON p = sp.a),
t2 AS (SELECT * FROM t1 UNION SELECT o, iv.b, s FROM t1 JOIN iv ON p = iv.a AND NOT starts_with(o, '"'))
SELECT * FROM t2 UNION SELECT s, p, sc.b FROM t2 JOIN sc ON p = '{_TYPE}' AND o = sc.a
"""


def _step_sql(step: str) -> str:
    o = ent.univ_bench()
    pairs = lambda table: ", ".join(f"('{a}', '{b}')" for a, bs in table.items() for b in bs)
    base = f"WITH RECURSIVE base AS ({_ORG})"
    return {
        "subclass": f"{base} SELECT DISTINCT s, p, v.b AS o FROM base JOIN (VALUES {pairs(o.superclasses)}) v(a, b) ON o = v.a AND p = '{_TYPE}'",
        "subproperty": f"{base} SELECT DISTINCT s, v.b AS p, o FROM base JOIN (VALUES {pairs(o.superproperties)}) v(a, b) ON p = v.a",
        "inverse": f"{base} SELECT DISTINCT o AS s, '{_ub('hasAlumnus')}' AS p, s AS o FROM base WHERE p = '{_ub('mastersDegreeFrom')}'",
        "transitive": f"{base} SELECT DISTINCT x.s, x.p, y.o FROM base x JOIN base y ON x.p = '{_ub('subOrganizationOf')}' AND y.p = x.p AND y.s = x.o",
        "realise": f"{base} SELECT DISTINCT x.s, '{_TYPE}' AS p, '{_ub('Chair')}' AS o FROM base x JOIN base y ON x.p = '{_ub('headOf')}' AND y.s = x.o AND y.p = '{_TYPE}' AND y.o = '{_ub('Department')}'",
    }[step]


_STEPS = ("subclass", "subproperty", "inverse", "transitive", "realise")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run_rule, rule=rule) for name, (rule, _) in RULES.items()}
QUERIES |= {
    "triangle_generic": partial(run_rule, rule=RULES["triangle"][0], strategy="generic"),
    "cycle4_generic": partial(run_rule, rule=RULES["cycle4"][0], strategy="generic"),
    "chain4_yannakakis": partial(run_rule, rule=RULES["chain4"][0], strategy="yannakakis"),
    "compute_join_api": compute_join_api,
    "csv_roundtrip": csv_roundtrip,
    "ordered_join": ordered_join,
    "project_api": project_api,
    "insert_api": insert_api,
    "least_upper_bound": least_upper_bound,
    "rdf_dictionary": rdf_dictionary,
    "rdf_encoded": rdf_encoded,
    "rdf_bgp": rdf_bgp,
    "rdf_bgp_const": rdf_bgp_const,
    **{f"entail_{step}": partial(entail_step, step=step) for step in _STEPS},
    "entail_fixpoint": entail_fixpoint,
    "lab_pivot": lab_pivot,
    "lab_compare": lab_compare,
    "lab_mannwhitney": lab_mannwhitney,
}

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in RULES.items()}
ORACLE_SQL |= {
    "triangle_generic": RULES["triangle"][1],
    "cycle4_generic": RULES["cycle4"][1],
    "chain4_yannakakis": RULES["chain4"][1],
    "compute_join_api": 'SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS "V0", CAST(n_regionkey AS BIGINT) AS "V1" FROM nation JOIN region ON n_regionkey = r_regionkey',
    "csv_roundtrip": RULES["scan_parquet"][1],
    "ordered_join": RULES["chain_region"][1],
    "project_api": 'SELECT DISTINCT l_suppkey AS "S", l_partkey AS "P" FROM lineitem',
    "insert_api": 'SELECT CAST(n_nationkey AS BIGINT) AS "N", CAST(n_regionkey AS BIGINT) AS "R" FROM nation UNION VALUES (0, 0), (100, 1), (101, 2)',
    "least_upper_bound": 'SELECT l_partkey AS "P", min(l_suppkey) AS "S" FROM lineitem WHERE l_suppkey >= 6 GROUP BY l_partkey',
    "rdf_dictionary": f"WITH t AS ({GEO}), f AS (SELECT v AS value, min(3 * pos + k) AS first FROM (SELECT s AS v, pos, 0 AS k FROM t UNION ALL SELECT p, pos, 1 FROM t UNION ALL SELECT o, pos, 2 FROM t) GROUP BY v) SELECT row_number() OVER (ORDER BY first) - 1 AS id, value FROM f",
    "rdf_encoded": f"WITH t AS ({GEO}), f AS (SELECT v AS value, min(3 * pos + k) AS first FROM (SELECT s AS v, pos, 0 AS k FROM t UNION ALL SELECT p, pos, 1 FROM t UNION ALL SELECT o, pos, 2 FROM t) GROUP BY v), d AS (SELECT row_number() OVER (ORDER BY first) - 1 AS id, value FROM f) SELECT DISTINCT a.id AS \"S\", b.id AS \"O\" FROM t JOIN d a ON a.value = s JOIN d b ON b.value = o WHERE p = '<http://example.org/inRegion>'",
    "rdf_bgp": "SELECT DISTINCT '\"' || n_name || '\"' AS x, '\"' || r_name || '\"' AS y FROM nation JOIN region ON n_regionkey = r_regionkey",
    "rdf_bgp_const": "SELECT DISTINCT '<http://example.org/nation' || CAST(n_nationkey AS STRING) || '>' AS x FROM nation WHERE n_regionkey = 1",
    **{f"entail_{step}": _step_sql(step) for step in _STEPS},
    "entail_fixpoint": _entailed_sql(),
    "lab_pivot": 'SELECT l_returnflag, max(l_orderkey) FILTER (l_linestatus = \'F\') AS "F", max(l_orderkey) FILTER (l_linestatus = \'O\') AS "O" FROM lineitem GROUP BY l_returnflag',
    "lab_compare": "WITH g AS (SELECT l_returnflag AS f, CAST(l_linenumber AS BIGINT) AS line, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL) SELECT a.line, a.n AS baseline_value, b.n AS target_value, round(a.n / b.n, 6) AS speedup FROM g a JOIN g b ON a.line = b.line AND a.f = 'A' AND b.f = 'R'",
    "lab_mannwhitney": "WITH d AS (SELECT l_returnflag AS f, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), r AS (SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM d) SELECT count(*) FILTER (f = 'A') AS n1, count(*) FILTER (f = 'R') AS n2, round(sum(k) FILTER (f = 'A') - count(*) FILTER (f = 'A') * (count(*) FILTER (f = 'A') + 1) / 2.0, 1) AS u1 FROM r",
}


for more in (catalogue_files, catalogue_tools):
    QUERIES |= more.QUERIES
    ORACLE_SQL |= more.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who buy from a supplier of their nation: a cyclic rule over four relations."""
    return QUERIES["cycle4"](spark, sf_dir)
