"""Relation files, result sinks, and the command line's join."""

import gzip

import pytest

from tuplewise.catalog import Database
from tuplewise.cli import main
from tuplewise.errors import InvalidDataError
from tuplewise.sources.files import read_csv_relation, read_parquet_relation, read_tbl, validate, write_csv


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    f = put(tmp_path / "edge.csv", "# edges\nsrc,dst\n1,2\n2,3\n# in between\n3,+4\n1,2\n")
    df = read_csv_relation(spark, f)
    assert df.columns == ["src", "dst"] and sorted(map(tuple, df.collect())) == [(1, 2), (1, 2), (2, 3), (3, 4)]
    db = Database(spark)
    assert db.add_file(f).name == "edge" and db.query("Q(X) :- edge(X,_).").count() == 3


@pytest.mark.parametrize(("text", "parts"), [("a,b\n1,2\n3,hello\n", ("hello", "row 1", "column 1")), ("a,b\n-1,2\n", ("-1", "row 0", "column 0")), ("a,b\n1\n", ("row 0",)), ("a,b\n1,2,3\n", ("more fields",)), ("a\n9223372036854775808\n", ("9223372036854775808",)), ("a,a\n1,2\n", ("repeat",)), ("", ("header",))])
def test_csv_errors(spark, tmp_path, text, parts):
    with pytest.raises(InvalidDataError) as e:
        read_csv_relation(spark, put(tmp_path / "x.csv", text), eager=True)
    assert all(p in str(e.value) for p in parts)


def test_csv_header_is_told_by_its_place(spark, tmp_path):
    f = put(tmp_path / "n.csv", "# numbers as names\n1,2\n1,2\n# in between\n3,4\n1,2\n")
    assert sorted(map(tuple, read_csv_relation(spark, f).collect())) == [(1, 2), (1, 2), (3, 4)]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        put(folder / f"part-{k}.csv", f"a,b\n{k},7\n")
    assert sorted(map(tuple, read_csv_relation(spark, str(folder)).collect())) == [(0, 7), (1, 7), (2, 7)]
    for text in ("a,b\n 1,2\n", "a,b\n1, 2\n"):
        with pytest.raises(InvalidDataError):
            read_csv_relation(spark, put(tmp_path / "w.csv", text), eager=True)


def test_tbl_by_extension(spark, tmp_path):
    db = Database(spark)
    assert db.add_file(put(tmp_path / "R.TBL", "1,2,\n3,4,\n")).attrs == ("c0", "c1") and db.query("Q(X) :- R(_,X).").count() == 2
    with pytest.raises(InvalidDataError):
        db.add_file(put(tmp_path / "none.tbl", "\n"))


def test_frames_are_checked(spark):
    db = Database(spark)
    db.add_df("f", spark.createDataFrame([(1, 2), (3, -4)], "a int, b int"))
    assert db.query("Q(X) :- f(X,_).").count() == 2
    for rule in ("Q(Y) :- f(_,Y).", "Q(X,Y) :- f(X,Y)."):
        with pytest.raises(Exception, match="f.b: not a non-negative integer: -4"):
            db.query(rule).collect()
    with pytest.raises(Exception, match="not a non-negative"):
        db.relations["f"].df.collect()


def test_stored_relations_are_released(spark):
    db = Database(spark, index="column-trie")
    first = db.add_tuples("e", [(1, 2), (1, 2)])
    assert first.df.storageLevel.useMemory and db.query("Q(X,Y) :- e(X,Y).").count() == 1
    db.add_keys("e", (5, 6))
    assert not first.df.storageLevel.useMemory and db.query("Q(X,Y) :- e(X,Y).").count() == 2
    held = db.relations["e"]
    db.drop("e")
    assert not held.df.storageLevel.useMemory and "e" not in db.relations


def test_csv_errors_of_lazy_reads(spark, tmp_path):
    with pytest.raises(Exception, match="not a non-negative integer"):
        read_csv_relation(spark, put(tmp_path / "x.csv", "a\nx\n"), eager=False).collect()
    with pytest.raises(Exception):  # noqa: B017
        read_csv_relation(spark, str(tmp_path / "missing.csv"))


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    spark.createDataFrame([(1, 2), (3, 4)], "a int, b long").write.parquet(path)
    df = read_parquet_relation(spark, path, eager=True)
    assert [t for _, t in df.dtypes] == ["bigint", "bigint"] and df.count() == 2
    for rows, schema in (([(None,)], "a long"), ([(-1,)], "a long")):
        with pytest.raises(InvalidDataError):
            validate(spark.createDataFrame(rows, schema), "x")
    spark.createDataFrame([("a",)], "a string").write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(InvalidDataError):
        read_parquet_relation(spark, str(tmp_path / "s.parquet"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really")
    with pytest.raises(Exception):  # noqa: B017
        read_parquet_relation(spark, str(tmp_path / "bad.parquet")).collect()


def test_tbl(spark, tmp_path):
    assert sorted(map(tuple, read_tbl(spark, put(tmp_path / "a.tbl", "1,2,\n3,4,\n"), ["x", "y"]).collect())) == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="malformed"):
        read_tbl(spark, put(tmp_path / "b.tbl", "1,2\n"), ["x", "y"]).collect()


def test_write_csv(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, 2)], "X long, c5 long"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == "X,c5\n1,2\n"


def test_join_command(spark, tmp_path, capsys):
    edge = put(tmp_path / "edge.csv", "src,dst\n1,2\n2,3\n3,4\n1,3\n")
    rule = put(tmp_path / "q.dl", "path(X, Y, Z) :- edge(X, Y), edge(Y, Z).\n")
    out = tmp_path / "out.csv"
    assert main(["join", "-r", edge, "-q", rule, "-o", str(out), "-i", "column-trie", "-a", "leapfrog-triejoin"]) == 0
    assert out.read_text() == "X,Y,Z\n1,2,3\n1,3,4\n2,3,4\n"
    assert main(["join", "-r", edge, "-q", rule]) == 0 and "1,2,3" in capsys.readouterr().out
    assert main(["join", "-r", edge, "-q", put(tmp_path / "bad.dl", "nonsense")]) == 2
    assert main(["nothing"]) == 2


def test_gzip_triples(spark, tmp_path):
    from tuplewise.rdf.ntriples import read_ntriples

    with gzip.open(tmp_path / "t.nt.gz", "wt") as f:
        f.write("<> <http://a> <http://b> .\n<http://s> <http://p> <http://o> .\n")
    assert read_ntriples(spark, str(tmp_path / "t.nt.gz"), skip_empty_subject=True).count() == 1


@pytest.mark.parametrize("bad", [None, -1])
def test_parquet_values_are_checked_with_the_query(spark, tmp_path, bad):
    from tuplewise.catalog import Database

    path = str(tmp_path / "r.parquet")
    spark.createDataFrame([(1, 2), (3, bad)], "a int, b int").write.parquet(path)
    db = Database(spark)
    db.add_file(path)
    with pytest.raises(Exception, match="b: not a non-negative integer"):
        db.query("T(A, B) :- r(A, B).").collect()
