"""Timed runs and their reports, in the layout that analysis tools for criterion-style artefacts read."""

from __future__ import annotations

import json
import statistics
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Database
from .definition import Definition, ensure_cached

SCHEMA_VERSION = 2


def format_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} GiB"


def storage_bytes(df: DataFrame) -> int:
    """Estimated size of a frame's data by the optimizer's statistics; not comparable with heap sizes of other engines."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(action: Callable[[], None], samples: int, warmup: int, seconds: float = 0.0) -> list[int]:
    """Nanoseconds of each run: `samples` of them, and more until `seconds` have gone by."""
    for _ in range(warmup):
        action()
    out: list[int] = []
    while len(out) < samples or sum(out) < seconds * 1e9:
        began = time.perf_counter_ns()
        action()
        out.append(time.perf_counter_ns() - began)
    return out


def write_artefact(root: Path, group: str, function: str, values: list[int]) -> None:
    folder = root / group.replace("/", "_") / function.replace("/", "_") / "new"
    folder.mkdir(parents=True, exist_ok=True)
    n, mean = len(values), statistics.fmean(values)
    se = statistics.stdev(values) / n**0.5 if n > 1 else 0.0
    ordered = sorted(values)

    def estimate(point: float, low: float, high: float) -> dict:
        return {"confidence_interval": {"confidence_level": 0.95, "lower_bound": low, "upper_bound": high}, "point_estimate": point, "standard_error": se}

    files = {
        "benchmark.json": {"group_id": group, "function_id": function, "full_id": f"{group}/{function}"},
        "estimates.json": {"mean": estimate(mean, mean - 1.96 * se, mean + 1.96 * se), "median": estimate(statistics.median(values), ordered[n // 4], ordered[3 * n // 4])},
        "sample.json": {"sampling_mode": "Flat", "iters": [1.0] * n, "times": [float(v) for v in values]},
    }
    for name, content in files.items():
        (folder / name).write_text(json.dumps(content))


def report(kind: str, metadata: dict[str, str], axes: dict, groups: list[tuple[str, str, str]]) -> dict:
    return {"schema_version": SCHEMA_VERSION, "kind": kind, "metadata": [{"label": k, "value": str(v)} for k, v in metadata.items()], "axes": dict(sorted(axes.items())), "criterion_groups": [{"group": g, "function": f, "metric": m} for g, f, m in groups]}


def write_report(reports: list[dict], path: str | None = None) -> str:
    target = Path(path or f"bench-runs/{reports[0]['kind'] if reports else 'run'}-{int(time.time() * 1000)}.json")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(reports, indent=2))
    return str(target)


def run_benchmark(spark: SparkSession, definition: Definition, cache: str, artefacts: str, strategies: tuple[str, ...] = ("auto",), indexes: tuple[str, ...] = ("tree_trie",), metrics: tuple[str, ...] = ("insertion", "iteration", "space"), query: str | None = None, samples: int = 3, warmup: int = 1, seconds: float = 0.0, name: str | None = None) -> list[dict]:
    """One report for each query, storage mode and strategy: building all relations, running the query, bytes stored."""
    paths, reports, root = ensure_cached(definition, cache), [], Path(artefacts)
    for index in indexes:
        for strategy in strategies:
            for q in definition.queries:
                if query and q["name"] != query:
                    continue
                db = Database(spark, strategy=strategy, index=index)
                load = lambda db=db: [db.add_file(p) if p.endswith((".csv", ".parquet")) else db.add_df(n, spark.read.parquet(p)) for n, p in paths.items()]
                load()
                group, groups = f"{name or 'run'}/{definition.name}/{q['name']}", []
                prefix = f"{index}/{strategy}"
                if "insertion" in metrics:
                    write_artefact(root, group, f"{prefix}/insertion", measure(lambda db=db, load=load: (load(), [consume(r.df.distinct()) for r in db.relations.values()]), samples, warmup, seconds))
                    groups.append((group, f"{prefix}/insertion", "time"))
                if "iteration" in metrics:
                    write_artefact(root, group, f"{prefix}/iteration", measure(lambda db=db, q=q: consume(db.query(q["query"])), samples, warmup, seconds))
                    groups.append((group, f"{prefix}/iteration", "time"))
                size = sum(storage_bytes(r.df) for r in db.relations.values())
                if "space" in metrics:
                    write_artefact(root, group, f"{prefix}/space", [size])
                    groups.append((group, f"{prefix}/space", "space"))
                rows = db.query(q["query"]).count()
                axes = {"benchmark": definition.name, "query": q["name"], "data_structure": index, "algorithm": strategy, "tuples": rows, "relations": len(paths)}
                reports.append(report("run", {"benchmark": definition.name, "query": q["name"], "result": f"{rows} tuples", "storage": format_bytes(size)}, axes, groups))
    return reports


def run_join(spark: SparkSession, files: list[str], rule: str, artefacts: str, strategy: str = "auto", index: str = "tree_trie", samples: int = 3, warmup: int = 1, seconds: float = 0.0, name: str | None = None) -> list[dict]:
    """Time one rule over relation files."""
    db = Database(spark, strategy=strategy, index=index)
    for f in files:
        db.add_file(f)
    write_artefact(Path(artefacts), name or "join", f"{index}/{strategy}", measure(lambda: consume(db.query(rule)), samples, warmup, seconds))
    axes = {"query": rule, "data_structure": index, "algorithm": strategy, "relations": len(files), "tuples": db.query(rule).count()}
    return [report("join", {"query": rule}, axes, [(name or "join", f"{index}/{strategy}", "time")])]


def run_storage(spark: SparkSession, path: str, artefacts: str, index: str = "tree_trie", samples: int = 3, warmup: int = 1, seconds: float = 0.0, name: str | None = None, metrics: tuple[str, ...] = ("insertion", "iteration", "space")) -> list[dict]:
    """Time building and enumerating one relation, and its size; `metrics` says which."""
    db = Database(spark, index=index)
    relation = db.add_file(path)
    root, group, groups = Path(artefacts), name or "ds", []
    measured: dict[str, Callable[[], list[int]]] = {
        "insertion": lambda: measure(lambda: consume(db.add_file(path).df.distinct()), samples, warmup, seconds),
        "iteration": lambda: measure(lambda: consume(relation.df.distinct().orderBy(*relation.attrs)), samples, warmup, seconds),
        "space": lambda: [storage_bytes(relation.df)],
    }
    for metric in metrics:
        write_artefact(root, group, f"{index}/{metric}", measured[metric]())
        groups.append((group, f"{index}/{metric}", "space" if metric == "space" else "time"))
    axes = {"relation_path": path, "data_structure": index, "tuples": relation.df.distinct().count(), "arity": relation.arity}
    return [report("ds", {"relation": path}, axes, groups)]
