import json
import math
import random
import time

import pytest

from tuplewise import lab
from tuplewise.bench import definition as D
from tuplewise.bench.generate import OXFORD, generate, oxford, watdiv_queries, write_oxford
from tuplewise.bench.run import format_bytes, measure, run_benchmark, run_join, run_storage, write_report
from tuplewise.cli import main
from tuplewise.errors import BenchmarkInvalid, BenchmarkNotFound, ReportError, SpecDrift
from tuplewise.parser import parse_rule

STATIC = {"name": "b", "description": "d", "relations": [{"name": "p", "url": "file:///x/p.csv"}], "queries": [{"name": "q", "description": "", "query": "Q(X) :- p(X)."}]}


def made(**changes):
    d = D.Definition(**{**STATIC, **changes})
    d.validate()
    return d


@pytest.mark.parametrize("changes", [
    {"name": ""}, {"name": "a/b"}, {"name": ".."}, {"relations": []}, {"queries": []}, {"relations": [], "queries": []}, {"relations": STATIC["relations"] * 2}, {"queries": STATIC["queries"] * 2}, {"queries": [{"name": "q", "query": ""}]}, {"generator": {"kind": "lubm", "scale": 1}},
    *[{"relations": [], "queries": [], "generator": g} for g in ({"kind": "no"}, {"kind": "lubm"}, {"kind": "lubm", "scale": 0}, {"kind": "lubm", "scale": 1, "ontology": ""}, {"kind": "lubm", "scale": 1, "queries": []}, {"kind": "lubm", "scale": 1, "queries": ["q01"]}, {"kind": "lubm", "scale": 1, "queries": ["q15"]}, {"kind": "lubm", "scale": 1, "queries": ["q1", "q1"]}, {"kind": "watdiv", "scale": 0}, {"kind": "watdiv", "scale": 1, "stress": {"nope": 1}}, {"kind": "lubm", "scale": 1, "nope": 2})],
])
def test_invalid_definitions(changes):
    with pytest.raises(BenchmarkInvalid):
        made(**changes)


def test_discovery_and_drift(tmp_path):
    ws, cache = tmp_path / "ws", tmp_path / "cache"
    ws.mkdir()
    (ws / "b.yml").write_text(made().to_yaml())
    gen = D.Definition("g", "", generator={"kind": "lubm", "scale": 1, "queries": ["q1"]})
    (ws / "g.yml").write_text(gen.to_yaml())
    assert [(n, o) for n, (_, o) in D.discover(ws, cache).items()] == [("b", "workspace"), ("g", "workspace")]
    assert D.status(gen, cache) == "not generated" and D.status(made(), cache) == "not cached"
    with pytest.raises(BenchmarkNotFound):
        D.find("nope", ws)

    def generate(d, folder):
        folder.mkdir(parents=True)
        (folder / "benchmark.yml").write_text(made(name="g").to_yaml())
        return {}

    assert D.materialize(gen, cache, generate).relations and D.status(gen, cache) == "cached"
    assert D.materialize(gen, cache, lambda *a: pytest.fail("made twice")).name == "g"
    assert D.discover(ws, cache)["g"][1] == "cache"
    other = D.Definition("g", "", generator={"kind": "lubm", "scale": 2})
    assert D.status(other, cache) == "stale"
    with pytest.raises(SpecDrift):
        D.materialize(other, cache, generate)
    assert D.materialize(other, cache, generate, force=True) and D.status(other, cache) == "cached"
    assert D.clean("g", cache) and not D.clean("g", cache)
    (ws / "wrong.yml").write_text(made().to_yaml())
    with pytest.raises(BenchmarkInvalid):
        D.discover(ws)
    for tag in ("123", "a/b"):
        with pytest.raises(BenchmarkInvalid):
            D.check_tag(tag, tmp_path)


def test_spec_hash_knows_defaults():
    a = D.Definition("g", "", generator={"kind": "lubm", "scale": 1})
    assert a.spec_hash() == D.Definition("g", "", generator={"scale": 1, "seed": 0, "kind": "lubm"}).spec_hash() != D.Definition("g", "", generator={"kind": "lubm", "scale": 1, "seed": 1}).spec_hash()


def test_generators(spark, tmp_path):
    frames = oxford(spark, 1, "zipf")
    assert {n: f.columns for n, f in frames.items()} == {n: list(c) for n, c in OXFORD.items()} and frames["R"].count() == 1000
    assert frames["P"].exceptAll(oxford(spark, 1, "zipf")["P"]).count() == 0
    queries = watdiv_queries(5, 4, 2)
    assert len(queries) == 5 and all("<http" in q for q in queries.values())
    d = D.Definition("w", "", generator={"kind": "watdiv", "scale": 1, "stress": {"query_count": 2, "max_query_size": 2}})
    ready = D.materialize(d, tmp_path, lambda d, folder: generate(spark, d, folder))
    assert len(ready.queries) == 2 and all(parse_rule(q["query"]) for q in ready.queries)


def test_runs_reports_and_frames(spark, tmp_path):
    bench = write_oxford(spark, str(tmp_path / "data"), 1)
    art = str(tmp_path / "art")
    reports = run_benchmark(spark, bench, str(tmp_path), art, strategies=("auto", "generic"), query="triangle", samples=2, warmup=0)
    path = write_report(reports, str(tmp_path / "r.json"))
    s = lab.load(spark, path, art)
    assert s.count() == 6 and {r.phase for r in s.collect()} == {"insertion", "iteration", None}
    assert lab.load_samples(spark, path, art).where("metric = 'time'").count() == 8
    c = lab.compare(s, "auto", "generic", "algorithm")
    assert c.count() == 3 and abs(c.where("metric = 'space'").first().speedup - 1) < 1e-9
    assert lab.shape_bar_time(s).count() == 4 and lab.shape_bar_space(s).count() == 1 and lab.shape_tradeoff(s).count() == 2 and lab.shape_bar_queries(s, "tree_trie", "auto").count() == 1
    assert lab.shape_dist(lab.load_samples(spark, path, art)).count() == 8
    with pytest.raises(ReportError):
        lab.shape_scaling(s)
    with pytest.raises(ReportError):
        lab.compare(s, "auto", "nope", "algorithm")
    assert {r["triangle"] is not None for r in lab.pivot(s, "algorithm", "query", "mean_ns").collect()} == {True}
    assert main(["lab", "bar-time", path, "--artefacts", art, "-o", str(tmp_path / "x.csv")]) == 0 and "triangle" in (tmp_path / "x.csv").read_text()
    assert main(["lab", "all", path, "--artefacts", art, "-o", str(tmp_path / "all")]) == 0
    frames = {p.stem for p in (tmp_path / "all").glob("*.csv")}
    assert frames == {"bar-space", "bar-time-triangle", "bar-queries-tree_trie-auto", "bar-queries-tree_trie-generic", "dist", "tradeoff"}
    assert lab.shape_bar_time(s, phase="insertion").count() == 2 and lab.shape_dist(lab.load_samples(spark, path, art), "iteration").count() == 4
    for shape in ("compare", "bootstrap", "mann-whitney"):
        assert main(["lab", shape, path, "--artefacts", art, "--group-by", "algorithm", "--baseline", "auto", "--target", "generic", "--alternative", "less", "--phase", "iteration", "--resamples", "50", "-o", str(tmp_path / f"{shape}.csv")]) == 0
        assert len((tmp_path / f"{shape}.csv").read_text().splitlines()) == 2
    (tmp_path / "new.json").write_text(json.dumps([{**reports[0], "schema_version": 9}]))
    with pytest.raises(ReportError):
        lab.load_reports(spark, str(tmp_path / "new.json"))
    with pytest.raises(ReportError):
        lab.resolve(str(tmp_path / "none*.json"))
    (tmp_path / "e.csv").write_text("a,b\n1,2\n2,3\n")
    assert run_join(spark, [str(tmp_path / "e.csv")], "Q(X) :- e(X,_).", art, samples=1)[0]["axes"]["tuples"] == 2
    assert run_storage(spark, str(tmp_path / "e.csv"), art, samples=1)[0]["axes"]["arity"] == 2
    only = run_storage(spark, str(tmp_path / "e.csv"), art, samples=1, warmup=0, name="mine", metrics=("iteration",))[0]
    assert [(g["group"], g["function"]) for g in only["criterion_groups"]] == [("mine", "tree_trie/iteration")]
    assert len(measure(lambda: None, 2, 0)) == 2 and len(measure(lambda: time.sleep(0.02), 1, 0, 0.1)) > 1


def test_statistics(spark):
    rng = random.Random(1)
    a, b = [float(rng.randrange(10)) for _ in range(30)], [float(rng.randrange(3, 13)) for _ in range(25)]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    df = spark.createDataFrame([("a", x) for x in a] + [("b", y) for y in b], "g string, v double")
    r = lab.mann_whitney(df, "g", "v", "a", "b").first()
    ties = sum(n**3 - n for n in (([*a, *b]).count(v) for v in {*a, *b}))
    sd = math.sqrt(30 * 25 / 12 * (56 - ties / (55 * 54)))
    z = -(abs(u - 375) - 0.5) / sd if u < 375 else (abs(u - 375) - 0.5) / sd
    assert (r.n1, r.n2, r.u1) == (30, 25, u) and abs(r.z - z) < 1e-9 and abs(r.p - math.erfc(abs(z) / math.sqrt(2))) < 1e-6
    phi = lambda x: math.erfc(-x / math.sqrt(2)) / 2
    for alternative, p in (("less", phi((u - 375 + 0.5) / sd)), ("greater", 1 - phi((u - 375 - 0.5) / sd))):
        assert abs(lab.mann_whitney(df, "g", "v", "a", "b", alternative).first().p - p) < 1e-6
    with pytest.raises(ReportError):
        lab.mann_whitney(df, "g", "v", "a", "b", "more")
    ratio, low, high = lab.bootstrap_ratio_ci([2, 2.1, 1.9], [1, 1.1, 0.9], 500, seed=1)
    assert low <= ratio <= high and abs(ratio - 2) < 0.01 and lab.bootstrap_ratio_ci([1, 2], [3, 4], 99, seed=5) == lab.bootstrap_ratio_ci([1, 2], [3, 4], 99, seed=5)


def test_bytes():
    assert [format_bytes(n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.00 KiB", "3.00 MiB", "5.00 GiB"]
