"""Command line: `python -m tuplewise ...`."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import lab
from .bench import definition as benches
from .bench.generate import generate, write_oxford
from .bench.run import run_benchmark, run_join, run_storage, write_report
from .catalog import Database
from .errors import EngineError, ReportError
from .rdf.pipeline import build_from_files
from .rdf.sparql import split_blocks, split_lines
from .sources.files import write_csv

INDEXES = ("tree-trie", "column-trie")
STRATEGIES = ("auto", "binary", "yannakakis", "generic", "leapfrog-triejoin")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tuplewise", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def engine(q: argparse.ArgumentParser, many: bool = False) -> None:
        every = ("all",) if many else ()
        q.add_argument("-a", "--algorithm", default="auto", choices=STRATEGIES + every)
        q.add_argument("-i", "--indexstructure", default="tree-trie", choices=INDEXES + every)

    def timing(q: argparse.ArgumentParser) -> None:
        q.add_argument("--samples", type=int, default=3)
        q.add_argument("--warmup", type=int, default=1)
        q.add_argument("--measurement-time", type=float, default=0.0, help="seconds to go on taking samples")
        q.add_argument("--name", help="the group's name in artefacts and reports")
        q.add_argument("--artefacts", default="bench-runs/artefacts")
        q.add_argument("--report")

    j = sub.add_parser("join", help="run a rule over relation files")
    j.add_argument("-r", "--relations", nargs="+", required=True)
    j.add_argument("-q", "--query", required=True, help="a file with the rule")
    j.add_argument("-o", "--output")
    engine(j)

    b = sub.add_parser("bench").add_subparsers(dest="bench", required=True)
    for name in ("run", "list", "fetch", "clean", "join", "ds", "gen"):
        q = b.add_parser(name)
        q.add_argument("--workspace", default="benchmarks")
        q.add_argument("--cache", default=str(Path.home() / ".cache/tuplewise"))
        if name in ("run", "fetch", "clean"):
            q.add_argument("name", nargs="?")
            q.add_argument("--all", action="store_true")
        if name == "run":
            q.add_argument("--query")
            q.add_argument("--metrics", nargs="+", default=["insertion", "iteration", "space"], choices=["insertion", "iteration", "space"])
            q.add_argument("--force", action="store_true")
            engine(q, many=True)
            timing(q)
        if name == "join":
            q.add_argument("-r", "--relations", nargs="+", required=True)
            q.add_argument("-q", "--query", required=True)
            engine(q)
            timing(q)
        if name == "ds":
            q.add_argument("relation")
            q.add_argument("--metrics", nargs="+", default=["insertion", "iteration", "space"], choices=["insertion", "iteration", "space"])
            engine(q)
            timing(q)
        if name == "gen":
            q.add_argument("kind", choices=["lubm", "watdiv", "oxford"])
            q.add_argument("--scale", type=int, default=1)
            q.add_argument("--seed", type=int, default=0)
            q.add_argument("--tag", required=True)
            q.add_argument("--distribution", default="uniform", choices=["uniform", "zipf"])
            q.add_argument("--force", action="store_true")
            q.add_argument("--max-query-size", type=int)
            q.add_argument("--query-count", type=int)
            q.add_argument("--constants-per-query", type=int)
            q.add_argument("--ontology")
            q.add_argument("--queries", nargs="+", help="some of q1 to q14")

    r = sub.add_parser("rdf").add_subparsers(dest="rdf", required=True).add_parser("build", help="N-Triples and SPARQL to a benchmark folder")
    r.add_argument("triples")
    r.add_argument("out")
    r.add_argument("--queries", nargs="+", default=[], help="files with SPARQL: one query a line, or blocks that end in #end")
    r.add_argument("--name", default="rdf")
    r.add_argument("--entail", action="store_true")
    r.add_argument("--loose", action="store_true")

    v = sub.add_parser("lab", help="frames of reports as CSV")
    v.add_argument("shape", choices=["summary", "samples", "dist", "bar-queries", "all", "compare", "bootstrap", "mann-whitney", *lab.SHAPES])
    v.add_argument("reports", nargs="+")
    v.add_argument("--artefacts", default="bench-runs/artefacts")
    v.add_argument("--data-structure", default="tree_trie")
    v.add_argument("--algorithm", default="auto")
    v.add_argument("--phase", choices=["insertion", "iteration"])
    v.add_argument("--group-by", default="data_structure", help="what tells baseline and target apart")
    v.add_argument("--baseline")
    v.add_argument("--target")
    v.add_argument("--alternative", default="two-sided", choices=lab.ALTERNATIVES)
    v.add_argument("--resamples", type=int, default=9999)
    v.add_argument("--seed", type=int)
    v.add_argument("-o", "--output")
    return p


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tuplewise").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _join(a) -> None:
    db = Database(session(), strategy=a.algorithm, index=a.indexstructure)
    for f in a.relations:
        db.add_file(f)
    write_csv(db.query(Path(a.query).read_text().strip(), ordered=True), a.output)


def _bench(a) -> None:
    if a.bench == "list":
        for name, (d, origin) in benches.discover(a.workspace, a.cache).items():
            print(f"{name}\t{benches.status(d, a.cache)}\t[{origin}]\t{d.description}")
        return
    if a.bench in ("fetch", "clean", "run"):
        found = benches.discover(a.workspace, a.cache)
        if not a.all and a.name not in found:
            raise benches.BenchmarkNotFound(f"no benchmark {a.name!r}")
        names = list(found) if a.all else [a.name]
        if a.bench == "clean":
            for n in names:
                benches.clean(n, a.cache)
        elif a.bench == "fetch":
            for n in names:
                benches.ensure_cached(found[n][0], a.cache)
        else:
            spark, reports = session(), []
            strategies = ("auto", "yannakakis", "generic") if a.algorithm == "all" else (a.algorithm,)
            indexes = INDEXES if a.indexstructure == "all" else (a.indexstructure,)
            for n in names:
                made = benches.materialize(found[n][0], a.cache, lambda d, folder: generate(spark, d, folder), a.force)
                reports += run_benchmark(spark, made, a.cache, a.artefacts, strategies, indexes, tuple(a.metrics), a.query, a.samples, a.warmup, a.measurement_time, a.name)
            print(write_report(reports, a.report))
        return
    spark = session()
    if a.bench == "join":
        print(write_report(run_join(spark, a.relations, Path(a.query).read_text().strip(), a.artefacts, a.algorithm, a.indexstructure, a.samples, a.warmup, a.measurement_time, a.name), a.report))
    elif a.bench == "ds":
        print(write_report(run_storage(spark, a.relation, a.artefacts, a.indexstructure, a.samples, a.warmup, a.measurement_time, a.name, tuple(a.metrics)), a.report))
    else:
        benches.check_tag(a.tag, a.workspace)
        if a.kind == "oxford":
            print(write_oxford(spark, str(Path(a.cache) / a.tag), a.scale, a.distribution, a.seed).name)
        else:
            spec: dict = {"kind": a.kind, "scale": a.scale, "seed": a.seed}
            if a.kind == "lubm":
                spec |= {k: v for k, v in (("ontology", a.ontology), ("queries", a.queries)) if v is not None}
            else:
                stress = {k: getattr(a, k) for k in ("max_query_size", "query_count", "constants_per_query") if getattr(a, k) is not None}
                spec |= {"stress": stress} if stress else {}
            d = benches.Definition(a.tag, f"{a.kind} of scale {a.scale}", generator=spec)
            d.validate()
            print(benches.materialize(d, a.cache, lambda d, folder: generate(spark, d, folder), a.force).name)


def _rdf(a) -> None:
    texts: dict[str, str] = {}
    for f in a.queries:
        text = Path(f).read_text()
        for q in split_blocks(text) if "#end" in text else split_lines(text):
            texts[f"q{len(texts):04d}"] = q
    about = build_from_files(session(), a.triples, texts, a.out, a.name, a.entail, not a.loose)
    print(about)


def _lab(a) -> int:
    spark = session()
    summary = lambda: lab.load(spark, a.reports, a.artefacts)
    samples = lambda: lab.load_samples(spark, a.reports, a.artefacts)
    if a.shape == "all":
        made, out = 0, Path(a.output or ".")
        out.mkdir(parents=True, exist_ok=True)
        for name, frame in lab.render_all(summary(), samples(), a.phase).items():
            try:
                write_csv(frame(), str(out / f"{name}.csv"))
                made += 1
            except ReportError:
                continue
        return 0 if made else 3
    if a.shape == "summary":
        df = lab.of_phase(summary(), a.phase)
    elif a.shape == "samples":
        df = samples()
    elif a.shape == "dist":
        df = lab.shape_dist(samples(), a.phase)
    elif a.shape == "bar-queries":
        df = lab.shape_bar_queries(summary(), a.data_structure, a.algorithm, a.phase)
    elif a.shape == "compare":
        df = lab.compare(lab.of_phase(summary(), a.phase), a.baseline, a.target, a.group_by)
    elif a.shape in ("bootstrap", "mann-whitney"):
        timed = lab.of_phase(samples().where("metric = 'time'").withColumn("phase", lab.phase_of(F.col("criterion_function"))), a.phase)
        if a.shape == "mann-whitney":
            df = lab.mann_whitney(timed, a.group_by, "per_iter_ns", a.baseline, a.target, a.alternative)
        else:
            side = lambda v: [r[0] for r in timed.where(F.col(a.group_by) == v).select("per_iter_ns").collect()]  # noqa: E731  samples of a person's runs
            df = spark.createDataFrame([lab.bootstrap_ratio_ci(side(a.baseline), side(a.target), a.resamples, seed=a.seed)], "ratio double, low double, high double")
    else:
        df = lab.SHAPES[a.shape](summary(), phase=a.phase)
    write_csv(df, a.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: bad usage or input; 3: nothing to show."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return {"join": _join, "bench": _bench, "rdf": _rdf, "lab": _lab}[a.command](a) or 0
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3 if isinstance(e, ReportError) else 2
