"""Incremental results against whole evaluations."""

import random

import pytest

from tuplewise.catalog import Database
from tuplewise.errors import UnknownRelationError
from tuplewise.streaming import added_results, follow

RULES = ["T(X,Z) :- e(X,Y), e(Y,Z).", "T(X,Y,Z) :- e(X,Y), e(Y,Z), e(X,Z).", "T(X,L) :- e(X,Y), n(Y,L).", "T(L) :- n(_,L)."]


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("rule", RULES)
def test_added_results_complete_the_old_ones(spark, rule):
    rng = random.Random(len(rule))
    edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(40)]
    db, whole = Database(spark), Database(spark)
    for d, some in ((db, edges[:25]), (whole, edges)):
        d.add_tuples("e", some)
        d.add_tuples("n", [(i, i % 3) for i in range(9)])
    new = spark.createDataFrame(edges[25:], "a long, b long")
    added = rows(added_results(db, "e", new, rule))
    assert rows(db.query(rule)) | added == rows(whole.query(rule)) and added <= rows(whole.query(rule))
    with pytest.raises(UnknownRelationError):
        added_results(db, "nope", new, rule)


def test_follow(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.randrange(12), rng.randrange(12)) for _ in range(15)] for _ in range(3)]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "a long, b long").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    db = Database(spark)
    db.add_tuples("e", [(0, 1), (1, 2)], ["a", "b"])
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    follow(db, "e", stream, RULES[0], f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    whole = Database(spark)
    whole.add_tuples("e", [(0, 1), (1, 2), *(r for b in batches for r in b)])
    got = rows(spark.read.parquet(f"{tmp_path}/out/results").drop("batch"))
    assert got | {(0, 2)} == rows(whole.query(RULES[0])) and len(list((tmp_path / "out/results").glob("batch=*"))) == 3
    assert rows(db.query("Q(X,Y) :- e(X,Y).")) == rows(whole.query("Q(X,Y) :- e(X,Y)."))
