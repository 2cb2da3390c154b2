"""Registered queries over the parser, benchmarks, reports, their analysis and the command line, with their SQL."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lab
from .bench import definition as benches
from .bench.generate import OXFORD, oxford
from .bench.run import format_bytes, report, run_benchmark, storage_bytes, write_artefact, write_report
from .catalog import Database, instantiate_database
from .catalogue_sql import folder, rows_sql, table
from .errors import EngineError, ReportError
from .parser import parse_rule

CHAIN = "Q(C,N,R) :- c(C,N), n(N,R)."
CHAIN_SQL = 'SELECT DISTINCT CAST(c_custkey AS BIGINT) AS "C", CAST(n_nationkey AS BIGINT) AS "N", CAST(n_regionkey AS BIGINT) AS "R" FROM customer JOIN nation ON c_nationkey = n_nationkey'


def _add(db: Database, spark: SparkSession, sf_dir: str) -> Database:
    db.add_df("c", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    db.add_df("n", table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    return db


#: Rules as they are written, and as they are printed.
FORMS = [
    ("T(X):-r(X,_),s(c5).", "T(X) :- r(X, _), s(c5)."),
    ("  Two(A ,A)  :-\n e(A,B) , e(B,A)  .", "Two(A, A) :- e(A, B), e(B, A)."),
    ("h(c1,X_2):- lower(X_2).", "h(c1, X_2) :- lower(X_2)."),
    ("none(_, _) :- rows(_, _).", "none(_, _) :- rows(_, _)."),
]


def parser_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, str(parse_rule(text))) for i, (text, _) in enumerate(FORMS)], "i long, rule string")


#: What is wrong with a rule, a relation or a file, and the error's name.
BAD = [
    ("Q(X) :- c(X,N)", "ParseError"), ("Q(X) :- nothing(X).", "UnknownRelationError"), ("Q(X) :- c(X).", "ArityMismatchError"), ("Q(Z) :- c(X,N).", "UnsafeRuleError"),
    ("Q(X) :- c(X,foo).", "BadAtomError"), ("file.json", "UnsupportedFormatError"), ("-1", "InvalidDataError"),
]


def error_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, out = _add(Database(spark), spark, sf_dir), []
    for text, _ in BAD:
        try:
            if text.endswith(".json"):
                db.add_file(text)
            elif text == "-1":
                db.add_tuples("bad", [(-1,)])
            else:
                db.query(text)
        except EngineError as e:
            out.append((text, type(e).__name__))
    return spark.createDataFrame(out, "input string, error string")


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule by every strategy and storage mode."""
    out = None
    for index in ("tree_trie", "column-trie"):
        for strategy in ("auto", "binary", "yannakakis", "generic", "leapfrog_triejoin"):
            db = _add(instantiate_database(spark, index, strategy), spark, sf_dir)
            n = db.query(CHAIN).agg(F.lit(index.replace("-", "_")).alias("index"), F.lit(strategy).alias("strategy"), F.count("*").alias("n"))
            out = n if out is None else out.unionByName(n)
    return out


def stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the size metric is above zero and grows with the rows."""
    small, large = (storage_bytes(table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k"))) for t, c in (("nation", "n_nationkey"), ("orders", "o_orderkey")))
    return spark.createDataFrame([(small > 0, large > small)], "positive boolean, grows boolean")


def _definition(spark: SparkSession, sf_dir: str) -> tuple[benches.Definition, Path]:
    """A benchmark over files of its own."""
    root = folder(spark, "bench")
    for name, (t, columns) in {"c": ("customer", ("c_custkey", "c_nationkey")), "n": ("nation", ("n_nationkey", "n_regionkey"))}.items():
        table(spark, sf_dir, t).select(*[F.col(x).cast("long") for x in columns]).write.parquet(f"file://{root}/{name}.parquet")
    d = benches.Definition("geo", "customers", [{"name": n, "url": f"file://{root}/{n}.parquet"} for n in ("c", "n")], [{"name": "chain", "description": "", "query": CHAIN}, {"name": "regions", "description": "", "query": "Q(R) :- c(C,N), n(N,R)."}])
    (root / "ws").mkdir()
    (root / "ws/geo.yml").write_text(d.to_yaml())
    return d, root


def _cli(*args: object) -> tuple[int, str]:
    from .cli import main

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = main(list(map(str, args)))
    return code, out.getvalue()


def bench_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of timed runs: result sizes, and how many functions were measured."""
    d, root = _definition(spark, sf_dir)
    reports = run_benchmark(spark, d, str(root / "cache"), str(root / "art"), ("auto", "generic"), samples=1, warmup=0)
    return spark.createDataFrame([(r["axes"]["query"], r["axes"]["algorithm"], r["axes"]["tuples"], len(r["criterion_groups"])) for r in reports], "query string, algorithm string, tuples long, functions long")


def bench_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, join and ds of the command line: exit code and tuples of the report."""
    _, root = _definition(spark, sf_dir)
    (root / "q.dl").write_text(CHAIN + "\n")
    shared = ("--workspace", root / "ws", "--cache", root / "cache", "--samples", 1, "--warmup", 0, "--artefacts", root / "art", "--report", root / "r.json")
    out = []
    for name, args in {"run": ("run", "geo", "--query", "chain"), "join": ("join", "-r", f"file://{root}/c.parquet", f"file://{root}/n.parquet", "-q", root / "q.dl"), "ds": ("ds", f"file://{root}/n.parquet")}.items():
        code, _ = _cli("bench", *args, *shared)
        out.append((name, code, json.loads((root / "r.json").read_text())[0]["axes"]["tuples"]))
    return spark.createDataFrame(out, "command string, code long, tuples long")


def bench_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list, fetch and clean: what is known of a generated and a fixed benchmark."""
    _, root = _definition(spark, sf_dir)
    (root / "ws/gen.yml").write_text(benches.Definition("gen", "made", generator={"kind": "watdiv", "scale": 1}).to_yaml())
    shared, out = ("--workspace", root / "ws", "--cache", root / "cache"), []

    def listed(step: str) -> None:
        out.extend((step, *line.split("\t")[:3]) for line in _cli("bench", "list", *shared)[1].splitlines())

    def generate(d: benches.Definition, target: Path) -> dict:
        target.mkdir(parents=True)
        (target / "benchmark.yml").write_text((root / "ws/geo.yml").read_text().replace("name: geo", "name: gen", 1))
        return {}

    listed("first")
    benches.materialize(benches.find("gen", root / "ws"), root / "cache", generate)
    listed("generated")
    out.append(("fetch", "geo", str(_cli("bench", "fetch", "geo", *shared)[0]), ""))
    out.append(("clean", "gen", str(_cli("bench", "clean", "gen", *shared)[0]), ""))
    listed("cleaned")
    return spark.createDataFrame(out, "step string, name string, status string, origin string")


STATES = [
    ("first", "gen", "not generated", "[workspace]"), ("first", "geo", "cached", "[workspace]"), ("generated", "gen", "cached", "[cache]"), ("generated", "geo", "cached", "[workspace]"),
    ("fetch", "geo", "0", ""), ("clean", "gen", "0", ""), ("cleaned", "gen", "not generated", "[workspace]"), ("cleaned", "geo", "cached", "[workspace]"),
]

#: Changes to a valid definition, and whether it still is one.
DEFINITIONS = [
    ("as it is", {}, True), ("a name with a slash", {"name": "a/b"}, False), ("no query", {"queries": []}, False), ("a relation twice", {"relations": [{"name": "p", "url": "p.csv"}] * 2}, False),
    ("relations and a generator", {"generator": {"kind": "lubm", "scale": 1}}, False), ("a generator", {"relations": [], "queries": [], "generator": {"kind": "lubm", "scale": 2, "queries": ["q1", "q14"]}}, True),
    ("scale 0", {"relations": [], "queries": [], "generator": {"kind": "watdiv", "scale": 0}}, False), ("query q01", {"relations": [], "queries": [], "generator": {"kind": "lubm", "scale": 1, "queries": ["q01"]}}, False),
    ("query q15", {"relations": [], "queries": [], "generator": {"kind": "lubm", "scale": 1, "queries": ["q15"]}}, False),
]


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for what, changes, _ in DEFINITIONS:
        d = benches.Definition(**{"name": "b", "relations": [{"name": "p", "url": "p.csv"}], "queries": [{"name": "q", "query": "Q(X) :- p(X)."}], **changes})
        try:
            d.validate()
            out.append((what, True))
        except benches.BenchmarkInvalid:
            out.append((what, False))
    return spark.createDataFrame(out, "what string, valid boolean")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of generated data as its specification changes."""
    _, root = _definition(spark, sf_dir)
    made: list[int] = []

    def generate(d: benches.Definition, target: Path) -> dict:
        made.append(d.generator["scale"])
        target.mkdir(parents=True)
        (target / "benchmark.yml").write_text((root / "ws/geo.yml").read_text())
        return {}

    out = []
    for step, (scale, force) in enumerate([(1, False), (1, False), (2, False), (2, True), (2, False)]):
        before = len(made)
        try:
            benches.materialize(benches.Definition("g", "", generator={"kind": "lubm", "scale": scale}), root / "cache", generate, force)
            out.append((step, "made" if len(made) > before else "used again"))
        except benches.SpecDrift:
            out.append((step, "drift"))
    return spark.createDataFrame(out, "step long, what string")


SIZES = [(5, "5 B"), (1023, "1023 B"), (2048, "2.00 KiB"), (3 << 20, "3.00 MiB"), (5 << 30, "5.00 GiB")]


def byte_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, format_bytes(n)) for n, _ in SIZES], "bytes long, text string")


def oxford_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples and columns of the eight generated relations, uniform and skewed."""
    out = None
    for kind, scale in (("uniform", 1), ("zipf", 2)):
        for name, df in oxford(spark, scale, kind).items():
            n = df.agg(F.lit(kind).alias("distribution"), F.lit(name).alias("relation"), F.count("*").alias("tuples"), F.lit(len(df.columns)).cast("long").alias("columns"), F.min(F.least(*df.columns, *df.columns)).alias("least"))
            out = n if out is None else out.unionByName(n)
    return out.select("distribution", "relation", "tuples", "columns", (F.col("least") >= 0).alias("natural"))


def join_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation files and a rule file by the command line; the result from its output file."""
    _, root = _definition(spark, sf_dir)
    (root / "q.dl").write_text(f"\n{CHAIN}\n")
    _cli("join", "-r", f"file://{root}/c.parquet", f"file://{root}/n.parquet", "-q", root / "q.dl", "-o", root / "out.csv", "-a", "yannakakis")
    return spark.read.csv(f"file://{root}/out.csv", header=True, schema="C long, N long, R long")


#: Times that the reports below tell: rows by line number, for each return flag as a structure.
SAMPLES_SQL = "SELECT l_returnflag AS f, CAST(l_linenumber AS BIGINT) AS line, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber"


def _reports(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Reports and artefacts with numbers from the tables: a structure for each return flag, two sizes, and a space metric. Returns (glob, artefacts)."""
    root = folder(spark, "reports")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n")).collect()  # 21
    flags = sorted({r[0] for r in rows})
    for k, flag in enumerate(flags):
        values = [r["n"] for r in sorted(rows, key=lambda r: r[1]) if r[0] == flag]
        reports = []
        for tuples in (10, 20):
            group = f"run/b/q{tuples}"
            write_artefact(root / "art", group, f"{flag}/auto/iteration", [v * tuples for v in values])
            write_artefact(root / "art", group, f"{flag}/auto/space", [tuples * (k + 1)])
            axes = {"benchmark": "b", "query": f"q{tuples}", "data_structure": flag, "algorithm": "auto", "tuples": tuples}
            reports.append(report("run", {"query": f"q{tuples}"}, axes, [(group, f"{flag}/auto/iteration", "time"), (group, f"{flag}/auto/space", "space")]))
        write_report(reports, str(root / f"r-{flag}.json"))
    return str(root / "r-*.json"), str(root / "art")


def lab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.load(spark, *_reports(spark, sf_dir)).select("kind", "metric", "phase", "data_structure", "query", "tuples", F.round("mean_ns", 6).alias("mean_ns"), "median_ns")


def lab_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lab.load_samples(spark, *_reports(spark, sf_dir)).where("metric = 'time'")
    return s.select("data_structure", "query", F.col("sample").cast("long").alias("sample"), "per_iter_ns")


def lab_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports themselves, and a glob that matches nothing."""
    paths, _ = _reports(spark, sf_dir)
    try:
        lab.resolve(paths + ".none")
        found = "nothing raised"
    except ReportError:
        found = "ReportError"
    df = lab.load_reports(spark, paths)
    return df.groupBy("kind").agg(F.count("*").alias("reports"), F.sum(F.size("criterion_groups")).cast("long").alias("functions"), F.max("schema_version").cast("long").alias("version")).withColumn("none", F.lit(found))


def lab_shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    paths, art = _reports(spark, sf_dir)
    if name == "dist":
        return lab.shape_dist(lab.load_samples(spark, paths, art)).select("query", "data_structure", F.col("sample").cast("long").alias("sample"), "per_iter_ns")
    s = lab.load(spark, paths, art)
    rounded = F.round("mean_ns", 6).alias("mean_ns")
    if name == "scaling":
        return lab.shape_scaling(s).select("data_structure", "phase", "tuples", rounded)
    if name == "bar_time":
        return lab.shape_bar_time(s, "q10").select("query", "data_structure", rounded)
    if name == "bar_space":
        return lab.shape_bar_space(s)
    if name == "tradeoff":
        return lab.shape_tradeoff(s).select("data_structure", F.round("time_ns", 6).alias("time_ns"), "bytes")
    return lab.shape_bar_queries(s, "A", "auto").select("query", rounded)


def lab_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of two samples' means; its interval holds it."""
    paths, art = _reports(spark, sf_dir)
    values: dict[str, list[float]] = {}
    for r in lab.load_samples(spark, paths, art).where("metric = 'time' AND query = 'q10'").collect():  # 21
        values.setdefault(r["data_structure"], []).append(r["per_iter_ns"])
    ratio, low, high = lab.bootstrap_ratio_ci(values["A"], values["N"], 999, seed=1)
    return spark.createDataFrame([(round(ratio, 9), low <= ratio <= high)], "ratio double, holds boolean")


def lab_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that the command line's `all` writes, with their lines, and its exit code."""
    paths, art = _reports(spark, sf_dir)
    out = folder(spark, "frames")
    code, _ = _cli("lab", "all", paths, "--artefacts", art, "-o", out)
    return spark.createDataFrame([(p.stem, len(p.read_text().splitlines()) - 1, code) for p in sorted(out.glob("*.csv"))], "frame string, lines long, code long")


def _lab_sql() -> dict[str, str]:
    base = f"WITH g AS ({SAMPLES_SQL}), t AS (SELECT * FROM (VALUES (CAST(10 AS BIGINT)), (CAST(20 AS BIGINT))) v(tuples)), k AS (SELECT f, row_number() OVER (ORDER BY f) AS k FROM (SELECT DISTINCT f FROM g))"
    time = "SELECT 'run' AS kind, 'time' AS metric, 'iteration' AS phase, f AS data_structure, 'q' || CAST(tuples AS VARCHAR) AS query, tuples, round(avg(n * tuples), 6) AS mean_ns, median(n * tuples) AS median_ns FROM g, t GROUP BY f, tuples"
    space = "SELECT 'run', 'space', NULL, f, 'q' || CAST(tuples AS VARCHAR), tuples, CAST(tuples * k AS DOUBLE), CAST(tuples * k AS DOUBLE) FROM k, t"
    samples = "SELECT f AS data_structure, 'q' || CAST(tuples AS VARCHAR) AS query, line - 1 AS sample, n * tuples AS per_iter_ns FROM g, t"
    return {
        "lab_summary": f"{base} {time} UNION ALL {space}",
        "lab_samples": f"{base} {samples}",
        "lab_reports": rows_sql(("kind", "reports", "functions", "version", "none"), [("run", 6, 12, 2, "ReportError")]),
        "lab_scaling": f"{base} SELECT data_structure, phase, tuples, mean_ns FROM ({time})",
        "lab_bar_time": f"{base} SELECT query, data_structure, mean_ns FROM ({time}) WHERE tuples = 10",
        "lab_bar_space": f"{base} SELECT f AS data_structure, avg(CAST(tuples * k AS DOUBLE)) AS bytes FROM k, t GROUP BY f",
        "lab_tradeoff": f"{base} SELECT a.f AS data_structure, round(avg(n) * 15, 6) AS time_ns, avg(15.0 * k) AS bytes FROM g a JOIN k USING (f) GROUP BY a.f",
        "lab_dist": f"{base} SELECT query, data_structure, sample, per_iter_ns FROM ({samples})",
        "lab_bar_queries": f"{base} SELECT query, mean_ns FROM ({time}) WHERE data_structure = 'A'",
        "lab_bootstrap": f"{base} SELECT round(avg(n) FILTER (f = 'A') / avg(n) FILTER (f = 'N'), 9) AS ratio, true AS holds FROM g",
        "lab_command": rows_sql(("frame", "lines", "code"), [("bar-queries-A-auto", 2, 0), ("bar-queries-N-auto", 2, 0), ("bar-queries-R-auto", 2, 0), ("bar-space", 3, 0), ("bar-time-q10", 3, 0), ("bar-time-q20", 3, 0), ("dist", 42, 0), ("scaling", 6, 0), ("tradeoff", 3, 0)]),
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parser_forms": parser_forms,
    "error_names": error_names,
    "engines": engines,
    "stored_sizes": stored_sizes,
    "bench_run": bench_run,
    "bench_commands": bench_commands,
    "bench_states": bench_states,
    "definitions": definitions,
    "drift": drift,
    "byte_formats": byte_formats,
    "oxford_data": oxford_data,
    "join_command": join_command,
    "lab_summary": lab_summary,
    "lab_samples": lab_samples,
    "lab_reports": lab_reports,
    **{f"lab_{name}": partial(lab_shape, name=name) for name in ("scaling", "bar_time", "bar_space", "tradeoff", "dist", "bar_queries")},
    "lab_bootstrap": lab_bootstrap,
    "lab_command": lab_command,
}

_STRATEGIES = ("auto", "binary", "yannakakis", "generic", "leapfrog_triejoin")
ORACLE_SQL: dict[str, str] = {
    "parser_forms": rows_sql(("i", "rule"), [(i, text) for i, (_, text) in enumerate(FORMS)]),
    "error_names": rows_sql(("input", "error"), BAD),
    "engines": f"SELECT i AS index, s AS strategy, n FROM (SELECT count(*) AS n FROM ({CHAIN_SQL})), (VALUES ('tree_trie'), ('column_trie')) a(i), (VALUES {', '.join(f"('{s}')" for s in _STRATEGIES)}) b(s)",
    "stored_sizes": rows_sql(("positive", "grows"), [(True, True)]),
    "bench_run": f"SELECT query, algorithm, tuples, CAST(3 AS BIGINT) AS functions FROM (SELECT 'chain' AS query, count(*) AS tuples FROM ({CHAIN_SQL}) UNION ALL SELECT 'regions', count(DISTINCT \"R\") FROM ({CHAIN_SQL})), (VALUES ('auto'), ('generic')) a(algorithm)",
    "bench_commands": f"SELECT command, CAST(0 AS BIGINT) AS code, tuples FROM (SELECT count(*) AS tuples FROM ({CHAIN_SQL})), (VALUES ('run'), ('join')) c(command) UNION ALL SELECT 'ds', 0, count(*) FROM nation",
    "bench_states": rows_sql(("step", "name", "status", "origin"), STATES),
    "definitions": rows_sql(("what", "valid"), [(what, ok) for what, _, ok in DEFINITIONS]),
    "drift": rows_sql(("step", "what"), enumerate(["made", "used again", "drift", "made", "used again"])),
    "byte_formats": rows_sql(("bytes", "text"), SIZES),
    "oxford_data": rows_sql(("distribution", "relation", "tuples", "columns", "natural"), [(kind, name, n, len(columns), True) for kind, n in (("uniform", 1000), ("zipf", 2000)) for name, columns in OXFORD.items()]),
    "join_command": CHAIN_SQL,
    **_lab_sql(),
}
