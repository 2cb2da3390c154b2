import pytest

from tuplewise.errors import EntailmentError, NTriplesError, UnsupportedSparql
from tuplewise.rdf import dictionary, lubm
from tuplewise.rdf.entail import RDF_TYPE, entail, reachability, ub, univ_bench
from tuplewise.rdf.ntriples import read_ntriples, write_ntriples
from tuplewise.rdf.partition import predicate_names, sanitize_predicate
from tuplewise.rdf.pipeline import build, build_store, read_desc
from tuplewise.rdf.sparql import split_blocks, split_lines, to_rule, translate_all

E = "http://example/"


def file(tmp_path, text):
    (tmp_path / "x.nt").write_text(text)
    return str(tmp_path / "x.nt")


def test_ntriples(spark, tmp_path):
    text = f'# c\n\n<{E}a> <{E}p> <{E}b> .\n<{E}b> <{E}q> "a \\"quoted\\" text"@en-GB .\n<{E}a> <{E}p> "5"^^<{E}int> .\n<{E}a> <{E}p> _:b1 . # end\n'
    df = read_ntriples(spark, file(tmp_path, text))
    assert [r.o for r in df.orderBy("pos").collect()] == [f"<{E}b>", '"a \\"quoted\\" text"@en-GB', f'"5"^^<{E}int>', "_:b1"]
    write_ntriples(df, str(tmp_path / "out"))
    assert read_ntriples(spark, str(tmp_path / "out")).count() == 4
    with pytest.raises(NTriplesError, match="not a valid"):
        read_ntriples(spark, file(tmp_path, "<not a valid triple>\n"), eager=True)
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, file(tmp_path, f'"literal" <{E}p> <{E}o> .\n')).collect()
    assert read_ntriples(spark, file(tmp_path, "any thing goes here .\n"), strict=False).first().o == "goes here"


def test_dictionary_is_dense_and_first_seen(spark, tmp_path):
    df = read_ntriples(spark, file(tmp_path, f'<{E}a> <{E}p> <{E}b> .\n<{E}b> <{E}q> "literal" .\n<{E}a> <{E}p> <{E}c> .\n'))
    d = dictionary.build_dictionary(df)
    assert {r.value: r.id for r in d.collect()} == {f"<{E}a>": 0, f"<{E}p>": 1, f"<{E}b>": 2, f"<{E}q>": 3, '"literal"': 4, f"<{E}c>": 5}
    more, ids = dictionary.extend(d, [f"<{E}c>", "<new>", "<newer>", "<new>"])
    assert ids == {f"<{E}c>": 5, "<new>": 6, "<newer>": 7} and more.count() == 8
    back = dictionary.decode(dictionary.encode(df, d), d)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.select("s", "p", "o").collect()}


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5003 k").distinct()
    got = sorted(map(tuple, dictionary.dense_ids(df.repartition(7), "k").select("k", "id").collect()))
    assert [i for _, i in got] == list(range(5000))


@pytest.mark.parametrize(("iri", "name"), [("<http://ogp.me/ns#title>", "title"), ("<http://x/has-genre>", "has_genre"), ("<http://x/123abc>", "p_123abc"), ("<http://x/HasGenre>", "hasgenre"), ("<http://x/a/>", "a"), ("<http://x#--->", "p_")])
def test_sanitize(iri, name):
    assert sanitize_predicate(iri) == name


def test_names_collide():
    assert predicate_names({"<http://a#title>": 3, "<http://b#title>": 9, "<http://c#title>": 4}) == {"<http://a#title>": "title", "<http://c#title>": "title_4", "<http://b#title>": "title_9"}


IDS, NAMES = {f"<{E}p>": 0, f"<{E}c>": 1}, {f"<{E}p>": "p", f"<{E}q>": "q", RDF_TYPE: "type"}


@pytest.mark.parametrize(("text", "rule"), [
    (f"SELECT ?x WHERE {{ ?x <{E}p> <{E}c> . }}", "Q(X) :- p(X, c1)."),
    (f"SELECT * WHERE {{ ?x <{E}p> ?y . ?y <{E}q> ?z . }}", "Q(X, Y, Z) :- p(X, Y), q(Y, Z)."),
    (f"PREFIX e: <{E}> SELECT ?v0 {{ ?v0 e:p ?v1 ; e:q e:c , ?v2 . ?v2 a e:c }}", "Q(V0) :- p(V0, V1), q(V0, c1), q(V0, V2), type(V2, c1)."),
])
def test_sparql(text, rule):
    assert str(to_rule(text, IDS.__getitem__, NAMES, "Q")) == rule


@pytest.mark.parametrize("text", [
    f"ASK {{ ?x <{E}p> ?y }}", f"SELECT DISTINCT ?x {{ ?x <{E}p> ?y }}", f"SELECT ?x {{ ?x <{E}p> ?y }} LIMIT 3", f"SELECT ?x {{ ?x <{E}p> ?y FILTER(?y = <{E}c>) }}", f"SELECT ?x {{ ?x <{E}p> ?y . OPTIONAL {{ ?y <{E}q> ?z }} }}",
    f"SELECT ?x {{ {{ ?x <{E}p> ?y }} UNION {{ ?x <{E}q> ?y }} }}", f'SELECT ?x {{ ?x <{E}p> "a" }}', f"SELECT ?x {{ ?x <{E}p> _:b }}", f"SELECT ?x {{ ?x ?p <{E}c> }}", f"SELECT ?z {{ ?x <{E}p> ?y }}", f"SELECT ?x {{ ?x <{E}none> ?y }}", "SELECT ?x { ?x nope:p ?y }", "SELECT ?x { }", "",
])
def test_sparql_beyond_patterns(text):
    with pytest.raises(UnsupportedSparql):
        to_rule(text, IDS.__getitem__, NAMES, "Q")


def test_query_files():
    assert split_lines("a\n\nb\n") == ["a", "b"] and split_blocks("x\ny\n#end\n\n#end\nz") == ["x\ny", "z"]
    assert [n for n, _ in translate_all([f"SELECT * {{ ?x <{E}p> ?y }}"] * 2, IDS.__getitem__, NAMES, "Q_f")] == ["q0000", "q0001"]


def closure(spark, triples, **kw):
    df, stats = entail(spark.createDataFrame(triples, "s string, p string, o string"), **kw)
    return {tuple(r) for r in df.collect()}, stats


def test_each_rule(spark):
    a, b, c, d = "<http://a>", "<http://b>", "<http://c>", "<http://d>"
    got, stats = closure(spark, [
        (a, RDF_TYPE, ub("FullProfessor")), (a, ub("headOf"), b), (b, RDF_TYPE, ub("Department")), (b, ub("subOrganizationOf"), c), (c, ub("subOrganizationOf"), d), (d, ub("subOrganizationOf"), c),
        (a, ub("mastersDegreeFrom"), d), (d, ub("hasAlumnus"), "_:x"), (a, ub("degreeFrom"), '"literal"'), ("<>", ub("worksFor"), b),
    ])
    for t in [(a, RDF_TYPE, ub("Person")), (a, ub("memberOf"), b), (a, ub("worksFor"), b), (a, RDF_TYPE, ub("Chair")), (b, ub("subOrganizationOf"), d), (d, ub("subOrganizationOf"), d), (a, ub("degreeFrom"), d), (d, ub("hasAlumnus"), a), ("_:x", ub("degreeFrom"), d)]:
        assert t in got
    assert not any(s in ("<>", '"literal"') for s, _, _ in got) and stats.output == len(got) == stats.input + stats.derived
    again, more = closure(spark, sorted(got))
    assert again == got and more.derived == 0


def test_rounds_are_bounded(spark):
    chain = [(f"<{i}>", ub("subOrganizationOf"), f"<{i + 1}>") for i in range(12)]
    assert closure(spark, chain)[1].output == 12 * 13 // 2
    with pytest.raises(EntailmentError):
        closure(spark, chain, limit=2)


def test_ontology_tables():
    assert reachability([("a", "b"), ("b", "c"), ("c", "a")]) == {k: ["a", "b", "c"] for k in "abc"}
    assert len(univ_bench().superclasses[ub("FullProfessor")]) == 4 and len(lubm.query_names()) == 14


def test_mini_counts(spark, tmp_path):
    w = "http://db.uwaterloo.ca/~galuc/wsdbm/"
    city = lambda i, c: f"<{w}City{i}> <{w}parentCountry> <{w}Country{c}> .\n"
    text = "".join(city(i, i % 2) for i in range(6)) + f"<{w}R1> <{w}includes> <{w}P9> .\n<{w}R2> <{w}includes> <{w}P9> .\n<{w}R1> <{w}eligibleRegion> <{w}Country0> .\n"
    store = build_store(read_ntriples(spark, file(tmp_path, text)))
    counts = [store.select(q).count() for q in (f"SELECT ?a {{ ?a <{w}parentCountry> <{w}Country0> }}", f"SELECT ?a {{ ?a <{w}includes> <{w}P9> ; <{w}eligibleRegion> <{w}Country0> }}", f"SELECT * {{ ?a <{w}parentCountry> ?b }}", f"SELECT ?a {{ <{w}City0> <{w}parentCountry> <{w}Country0> . ?a <{w}includes> <{w}P9> }}")]
    assert counts == [3, 1, 6, 2]
    about = build(store, {"q0": f"SELECT ?a {{ ?a <{w}includes> <{w}P77> }}"}, str(tmp_path / "out"), "mini", "d", expected={"q0": 0})
    assert (tmp_path / "out/benchmark.yml").exists() and (tmp_path / "out/expected/q0.csv").read_text() == "cardinality\n0\n" and about["relations"] == 3
    assert "includes" in (tmp_path / "out/benchmark.yml").read_text() and "parentcountry" not in (tmp_path / "out/benchmark.yml").read_text()
    (tmp_path / "x.desc").write_text("3\n\n4\n")
    assert read_desc(tmp_path / "x.desc") == [3, 4]


def test_university_queries(spark):
    store = build_store(lubm.generate(spark, 1, 0, departments=3), entailed=True)
    n = {q: store.select(lubm.sparql(q)).count() for q in ("q1", "q5", "q11", "q12", "q13", "q14")}
    assert n["q14"] == 1200 and n["q5"] == 530 and n["q11"] == 36 and n["q12"] == 3 and n["q1"] > 0 and n["q13"] > 0
