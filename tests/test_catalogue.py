"""The catalogue's queries against their SQL, and the university queries against a plain evaluation."""

import glob
import os
import re

import duckdb
import pytest

from tuplewise import catalogue, catalogue_files
from tuplewise.rdf import lubm
from tuplewise.rdf.entail import RDF_TYPE, entail, ub

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL and n != "lubm_queries"])
def test_query_equals_its_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = tables.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(columns, df.columns, df.collect()) == plain(columns, want.columns, want.fetchall())


def test_university_counts_equal_a_plain_evaluation(spark):
    """Each SPARQL pattern as a self-join of the triple table in another engine."""
    con = duckdb.connect()
    con.register("t", entail(lubm.generate(spark, 1))[0].toPandas())
    for q in lubm.query_names():
        text = re.sub(r"ub:(\w+)", lambda m: ub(m[1]), lubm.QUERIES[q][0])
        body = re.search(r"\{(.*)\}", text, re.S)[1]
        where, seen, subject, n = [], {}, None, 0
        held: list[str] = []
        for token in re.findall(r"<[^>]*>|\?\w+|\ba\b|[.;]", body):
            if token not in (".", ";"):
                held.append(token)
                continue
            subject, *terms = held if len(held) == 3 else [subject, *held]
            held = []
            for column, term in zip("spo", (subject, *terms), strict=True):
                term = RDF_TYPE if term == "a" else term
                if term.startswith("?"):
                    if term in seen:
                        where.append(f"{seen[term]} = t{n}.{column}")
                    seen.setdefault(term, f"t{n}.{column}")
                else:
                    where.append(f"t{n}.{column} = '{term}'")
            n += 1
        wanted = ", ".join(seen[v] for v in re.findall(r"\?\w+", text[: text.index("{")]))
        ((count,),) = con.sql(f"SELECT count(*) FROM (SELECT DISTINCT {wanted} FROM {', '.join(f't t{i}' for i in range(n))} WHERE {' AND '.join(where)})").fetchall()
        assert catalogue_files.LUBM_COUNTS[q] == count, (q, count)
    assert ub("x").startswith("<")


def test_university_queries(spark):
    assert {r["query"]: r["n"] for r in catalogue_files.lubm_queries(spark, DATA).collect()} == catalogue_files.LUBM_COUNTS
