"""Analysis of benchmark reports as DataFrames."""

from __future__ import annotations

import glob
import json
import re
from collections.abc import Callable, Iterable
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ReportError
from ..storage import durable

#: The columns of a summary.
STR_AXES = ("data_structure", "algorithm", "query", "benchmark", "relation_path")
INT_AXES = ("tuples", "arity", "relations", "relation_bytes")
VALUES = ("mean_ns", "mean_lo", "mean_hi", "mean_se", "median_ns", "median_lo", "median_hi")
PROVENANCE = ("source_path", "criterion_group", "criterion_function")
MAX_VERSION = 2

_REPORT = "schema_version int, kind string, metadata array<struct<label: string, value: string>>, axes map<string, string>, criterion_groups array<struct<group: string, function: string, metric: string>>"
_SUMMARY = ", ".join(["kind string", "metric string", "phase string", *[f"{c} string" for c in STR_AXES], *[f"{c} long" for c in INT_AXES], *[f"{c} double" for c in VALUES], *[f"{c} string" for c in PROVENANCE]])


def resolve(paths: str | Iterable[str]) -> list[str]:
    """Files of paths and globs; a glob that matches nothing is an error."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        found = sorted(glob.glob(p, recursive=True)) if glob.has_magic(p) else [p]
        if not found:
            raise ReportError(f"nothing matches {p!r}")
        out += found
    return out


def load_reports(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Reports, one a row, with source_path; newer schema versions are an error."""
    files = resolve(paths)
    for f in files:
        if not isinstance(json.loads(Path(f).read_text()), list):
            raise ReportError(f"{f}: not an array")
    df = spark.read.schema(_REPORT).json([f"file://{Path(f).resolve()}" for f in files], multiLine=True).withColumn("source_path", F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", ""))
    newest = df.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > MAX_VERSION:
        raise ReportError(f"schema version {newest}; up to {MAX_VERSION} is known")
    return df


def phase_of(function: Column) -> Column:
    """insertion or iteration if that is the last segment of a function's name, else null."""
    last = F.element_at(F.split(function, "/"), -1)
    return F.when(last.isin("insertion", "iteration"), last)


def _artefact(root: str, group: str, function: str) -> dict:
    folder = Path(root) / group.replace("/", "_")
    for d in sorted(folder.glob("*/new")) if folder.is_dir() else []:
        about = json.loads((d / "benchmark.json").read_text())
        if about.get("function_id") == function:
            return {"estimates": json.loads((d / "estimates.json").read_text()), "sample": json.loads((d / "sample.json").read_text())}
    raise ReportError(f"no artefact of {group} {function} under {root}")


def _functions(spark: SparkSession, paths: str | Iterable[str]) -> list:
    rows = load_reports(spark, paths).select("kind", "axes", "source_path", F.explode("criterion_groups").alias("g")).select("*", phase_of(F.col("g.function")).alias("phase"))
    return rows.collect()  # a row for each measured function: a person's runs


def load(spark: SparkSession, paths: str | Iterable[str], root: str) -> DataFrame:
    """The summary: a row for each report and function."""
    out = []
    for r in _functions(spark, paths):
        e = _artefact(root, r["g"]["group"], r["g"]["function"])["estimates"]
        axes = r["axes"] or {}
        mean, median = e["mean"], e["median"]
        ints = [int(float(axes[c])) if axes.get(c) is not None else None for c in INT_AXES]
        values = [mean["point_estimate"], mean["confidence_interval"]["lower_bound"], mean["confidence_interval"]["upper_bound"], mean["standard_error"], median["point_estimate"], median["confidence_interval"]["lower_bound"], median["confidence_interval"]["upper_bound"]]
        out.append((r["kind"], r["g"]["metric"], r["phase"], *[axes.get(c) for c in STR_AXES], *ints, *map(float, values), r["source_path"], r["g"]["group"], r["g"]["function"]))
    return spark.createDataFrame(out, _SUMMARY)


def load_samples(spark: SparkSession, paths: str | Iterable[str], root: str) -> DataFrame:
    """A row for each sample of each function: iters, total_ns, per_iter_ns."""
    out = []
    for r in _functions(spark, paths):
        s = _artefact(root, r["g"]["group"], r["g"]["function"])["sample"]
        axes = r["axes"] or {}
        out.append((r["kind"], r["g"]["metric"], *[axes.get(c) for c in STR_AXES], r["source_path"], r["g"]["group"], r["g"]["function"], list(map(float, s["iters"])), list(map(float, s["times"]))))
    schema = ", ".join(["kind string", "metric string", *[f"{c} string" for c in STR_AXES], *[f"{c} string" for c in PROVENANCE], "iters array<double>", "times array<double>"])
    df = spark.createDataFrame(out, schema)
    flat = df.select(*[c for c in df.columns if c not in ("iters", "times")], F.posexplode(F.arrays_zip("iters", "times")).alias("sample", "x"))
    return flat.select("*", F.col("x.iters").alias("iters"), F.col("x.times").alias("total_ns"), (F.col("x.times") / F.col("x.iters")).alias("per_iter_ns")).drop("x")


def pivot(df: DataFrame, rows: str | list[str], cols: str, value: str, agg: str = "avg", levels: list | None = None) -> DataFrame:
    """Rows by columns, cells aggregated; give `levels` to spare a pass that finds the columns."""
    grouped = df.groupBy(*([rows] if isinstance(rows, str) else rows))
    return (grouped.pivot(cols, levels) if levels is not None else grouped.pivot(cols)).agg(getattr(F, agg)(value))


def compare(df: DataFrame, baseline: str, target: str, group_by: str = "data_structure", value: str = "mean_ns") -> DataFrame:
    """Pairs of baseline and target rows that agree (nulls too) on all else, and how many times faster the target is, with an envelope."""
    stem = value.removesuffix("_ns")
    low, high = f"{stem}_lo", f"{stem}_hi"
    for c in (group_by, value, low, high):
        if c not in df.columns:
            raise ReportError(f"no column {c}")
    keys = [c for c in df.columns if c != group_by and c not in PROVENANCE and c not in VALUES and c not in (value, low, high)]
    side = lambda v, name: df.where(F.col(group_by) == v).select(*[F.col(k).alias(f"{name}__{k}") for k in keys], F.col(value).alias(f"{name}_value"), F.col(low).alias(f"{name}_lo"), F.col(high).alias(f"{name}_hi"))
    a, b = side(baseline, "baseline"), side(target, "target")
    if a.isEmpty() or b.isEmpty():
        raise ReportError(f"no rows of {group_by} {baseline!r} or {target!r}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"baseline__{k}").eqNullSafe(F.col(f"target__{k}"))
    numbers = [f"{n}_{x}" for n in ("baseline", "target") for x in ("value", "lo", "hi")]
    out = a.join(b, on).select(*[F.col(f"baseline__{k}").alias(k) for k in keys], *numbers)
    return out.withColumns({"speedup": F.col("baseline_value") / F.col("target_value"), "speedup_lo": F.col("baseline_lo") / F.col("target_hi"), "speedup_hi": F.col("baseline_hi") / F.col("target_lo")})


def bootstrap_ratio_ci(a, b, resamples: int = 9999, level: float = 0.95, seed: int | None = None) -> tuple[float, float, float]:
    """Ratio of the means of two samples, and its percentile interval."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not len(a) or not len(b):
        raise ReportError("an empty sample")
    rng = np.random.default_rng(seed)
    step = max(1, 1_000_000 // max(len(a), len(b)))
    means = lambda x, n: x[rng.integers(0, len(x), (n, len(x)))].mean(axis=1)
    ratios = np.concatenate([means(a, n) / means(b, n) for n in (min(step, resamples - at) for at in range(0, resamples, step))])
    low, high = np.quantile(ratios, [(1 - level) / 2, (1 + level) / 2])
    return float(a.mean() / b.mean()), float(low), float(high)


ALTERNATIVES = ("two-sided", "less", "greater")


def mann_whitney(df: DataFrame, group: str, value: str, first, second, alternative: str = "two-sided") -> DataFrame:
    """One row (n1, n2, u1, z, p): the U statistic of two groups, normal approximation with tie and continuity correction.

    `alternative`: whether the first group's values differ, are less, or are greater. Ranks come from counts of each distinct value, so ties get
    their mean rank. Distinct values are dealt to ranges; what lies below a range are the sums of those before it, a row each.
    """
    if alternative not in ALTERNATIVES:
        raise ReportError(f"unknown alternative {alternative!r}")
    counts = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count("*").alias("t"))
    ranged = durable(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "ranked")
    inside = F.coalesce(F.sum("t").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = ranged.groupBy("part").agg(F.sum("t").alias("sum")).select("part", before.alias("before"))
    ranked = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank2", 2 * (F.col("inside") + F.col("before")) + F.col("t") + 1)  # twice the mean rank: whole numbers
    s = ranked.agg(F.sum("a").alias("n1"), (F.sum("t") - F.sum("a")).alias("n2"), F.sum(F.col("a") * F.col("rank2")).alias("r2"), F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    out = s.withColumn("u1", (F.col("r2") - n1 * (n1 + 1)) / 2)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    off = F.col("u1") - n1 * n2 / 2
    if alternative == "two-sided":
        out = out.withColumn("z", F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / sd)
        return out.select("n1", "n2", "u1", "z", F.least(_erfc(F.abs("z")), F.lit(1.0)).alias("p"))
    out = out.withColumn("z", (off + (0.5 if alternative == "less" else -0.5)) / sd)
    tail = _erfc(F.abs("z")) / 2
    beyond = F.col("z") > 0 if alternative == "greater" else F.col("z") < 0
    return out.select("n1", "n2", "u1", "z", F.when(beyond, tail).otherwise(1 - tail).alias("p"))


def _erfc(z: Column) -> Column:
    """Complementary error function of z / sqrt(2) for z >= 0 (Abramowitz and Stegun 7.1.26)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def _need(df: DataFrame, ok: bool, what: str) -> DataFrame:
    if not ok or df.isEmpty():
        raise ReportError(what)
    return df


def of_phase(s: DataFrame, phase: str | None) -> DataFrame:
    """Rows of one phase; all if none is named."""
    return s.where(F.col("phase") == phase) if phase else s


def shape_scaling(s: DataFrame, phase: str | None = None) -> DataFrame:
    """Mean time by tuples, where there are two sizes or more."""
    t = of_phase(s, phase).where("metric = 'time' and tuples is not null")
    return _need(t.groupBy("data_structure", "algorithm", "phase", "tuples").agg(F.avg("mean_ns").alias("mean_ns")).orderBy("data_structure", "algorithm", "phase", "tuples"), t.select("tuples").distinct().count() >= 2, "scaling needs two sizes")


def shape_bar_time(s: DataFrame, query: str | None = None, phase: str | None = None) -> DataFrame:
    t = of_phase(s, phase).where("metric = 'time'")
    t = t.where(F.col("query") == query) if query else t
    return _need(t.groupBy("query", "data_structure", "algorithm", "phase").agg(F.avg("mean_ns").alias("mean_ns"), F.min("mean_lo").alias("mean_lo"), F.max("mean_hi").alias("mean_hi")).orderBy("query", "data_structure", "algorithm"), True, "no times")


def shape_bar_space(s: DataFrame, phase: str | None = None) -> DataFrame:
    """Mean bytes of each structure; sizes have no phase."""
    return _need(s.where("metric = 'space'").groupBy("data_structure").agg(F.avg("mean_ns").alias("bytes")).orderBy("data_structure"), True, "no sizes")


def shape_tradeoff(s: DataFrame, phase: str | None = None) -> DataFrame:
    """Mean time against mean space of each report."""
    s = s.where(F.col("metric") != "time").unionByName(of_phase(s.where("metric = 'time'"), phase))
    keys = ["source_path", "data_structure", "algorithm"]
    part = lambda m, name: s.where(F.col("metric") == m).groupBy(*keys).agg(F.avg("mean_ns").alias(name))
    return _need(part("time", "time_ns").join(part("space", "bytes"), keys).orderBy(*keys), True, "a trade-off needs times and sizes")


def shape_dist(samples: DataFrame, phase: str | None = None) -> DataFrame:
    samples = of_phase(samples.withColumn("phase", phase_of(F.col("criterion_function"))), phase)
    return _need(samples.where("metric = 'time'").select("query", "data_structure", "algorithm", "criterion_function", "sample", "per_iter_ns").orderBy("criterion_function", "sample"), True, "no samples")


def shape_bar_queries(s: DataFrame, data_structure: str, algorithm: str, phase: str | None = None) -> DataFrame:
    t = of_phase(s, phase).where((F.col("metric") == "time") & (F.col("data_structure") == data_structure) & (F.col("algorithm") == algorithm))
    return _need(t.groupBy("query").agg(F.avg("mean_ns").alias("mean_ns")).orderBy("query"), True, "no times of this kind")


SHAPES = {"scaling": shape_scaling, "bar-time": shape_bar_time, "bar-space": shape_bar_space, "tradeoff": shape_tradeoff}


def render_all(summary: DataFrame, samples: DataFrame, phase: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every frame by name: the six shapes, bar-time for each query and bar-queries for each structure and algorithm. Shapes without data raise ReportError."""
    out: dict[str, Callable[[], DataFrame]] = {name: partial(SHAPES[name], summary, phase=phase) for name in ("scaling", "bar-space", "tradeoff")}
    out["dist"] = partial(shape_dist, samples, phase=phase)
    timed = summary.where("metric = 'time'")
    for (q,) in sorted(timed.select("query").where("query is not null").distinct().collect()):  # a person's runs
        out[f"bar-time-{_file_name(q)}"] = partial(shape_bar_time, summary, q, phase)
    for ds, algorithm in sorted(timed.select("data_structure", "algorithm").dropna().distinct().collect()):
        out[f"bar-queries-{_file_name(ds)}-{_file_name(algorithm)}"] = partial(shape_bar_queries, summary, ds, algorithm, phase)
    return out


def _file_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text)[:80]
