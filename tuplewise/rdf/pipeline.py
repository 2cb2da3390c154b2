"""From triples and SPARQL to a benchmark folder: relations, dictionary, rules, expected counts, provenance."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..catalog import Database
from ..errors import InvalidDataError
from ..rules import Rule
from ..storage import durable
from . import dictionary as dictionaries
from .entail import entail
from .ntriples import read_ntriples
from .partition import predicate_names, predicates, vertical, write_partitions
from .sparql import iris_of, parse_sparql, to_rule


@dataclass
class Store:
    """Encoded triples by predicate, their dictionary, and rules for queries over them."""

    spark: SparkSession
    dictionary: DataFrame
    encoded: DataFrame
    names: dict[str, str]
    ids: dict[str, int]
    stats: dict[str, int] = field(default_factory=dict)

    def relations(self) -> dict[str, DataFrame]:
        return vertical(self.encoded, self.names, self.ids)

    def database(self, strategy: str = "auto") -> Database:
        db = Database(self.spark, strategy=strategy)
        for name, df in self.relations().items():
            db.add_df(name, df)
        return db

    def rule(self, sparql: str, head: str = "Q") -> Rule:
        """The rule of a query; IRIs that the dictionary lacks get fresh ids."""
        self.dictionary, known = dictionaries.extend(self.dictionary, iris_of(parse_sparql(sparql)))
        return to_rule(sparql, known.__getitem__, self.names, head)

    def select(self, sparql: str, strategy: str = "auto") -> DataFrame:
        """The query's result as terms."""
        rule = self.rule(sparql)
        wanted = {a.name for a in rule.body}
        db = Database(self.spark, strategy=strategy)
        for name, df in self.relations().items():
            if name in wanted:
                db.add_df(name, df)
        return dictionaries.decode(db.query(rule), self.dictionary)


def build_store(triples: DataFrame, entailed: bool = False) -> Store:
    """Encode triples (s, p, o, pos), with the ontology's consequences if asked."""
    from pyspark.sql import functions as F

    spark, stats = triples.sparkSession, {}
    if entailed:
        closed, found = entail(triples)
        stats = {"input_triples": found.input, "entailed_triples": found.output, "iterations": found.iterations}
        place = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.xxhash64("s", "p", "o").alias("line"))
        triples = closed.withColumn("pos", place)
    dictionary = durable(dictionaries.build_dictionary(triples), "dictionary")
    ids = dictionaries.lookup(dictionary, predicates(triples))
    encoded = durable(dictionaries.encode(triples, dictionary, ids), "encoded")
    return Store(spark, dictionary, encoded, predicate_names(ids), ids, stats)


def write_expected(path: Path, counts: Mapping[str, int]) -> None:
    """A CSV `cardinality` and a number for each query, and all of them as JSON."""
    path.mkdir(parents=True, exist_ok=True)
    for name, n in counts.items():
        (path / f"{name}.csv").write_text(f"cardinality\n{n}\n")
    (path / "expected.json").write_text(json.dumps(dict(counts), indent=2, sort_keys=True))


def read_desc(path: str | Path) -> list[int]:
    """One count on each non-blank line."""
    out = []
    for i, line in enumerate(Path(path).read_text().splitlines(), 1):
        if line.strip():
            if not re.fullmatch(r"\+?[0-9]+", line.strip()):
                raise InvalidDataError(f"{path}:{i}: {line.strip()!r} isn't a count")
            out.append(int(line))
    return out


def build(store: Store, queries: Mapping[str, str], out_dir: str, name: str, description: str, expected: Mapping[str, int] | None = None, meta: Mapping[str, object] | None = None) -> dict:
    """Write a benchmark folder (local or shared): benchmark.yml, relations, dictionary, expected counts, meta.json.

    Queries are translated before the dictionary is written, so that it holds their IRIs; only relations that some query uses are listed.
    """
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    rules = {q: store.rule(text, f"Q_{q}") for q, text in queries.items()}
    used = sorted({a.name for r in rules.values() for a in r.body})
    folders = write_partitions(store.encoded, store.names, store.ids, f"file://{out.resolve()}/relations")
    missing = [u for u in used if u not in folders]
    if missing:
        raise InvalidDataError(f"rules use unknown relations {missing}")
    store.dictionary.write.mode("overwrite").parquet(f"file://{out.resolve()}/dict.parquet")
    spec = {"name": name, "description": description, "relations": [{"name": u, "url": folders[u]} for u in used], "queries": [{"name": q, "description": f"{name} {q}", "query": str(r)} for q, r in rules.items()]}
    text = yaml.safe_dump(spec, sort_keys=False, width=1000)
    (out / "benchmark.yml").write_text(text)
    if expected:
        write_expected(out / "expected", expected)
    about = {"name": name, "spec_sha256": hashlib.sha256(text.encode()).hexdigest(), "relations": len(folders), "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **store.stats, **(meta or {})}
    (out / "meta.json").write_text(json.dumps(about, indent=2, sort_keys=True))
    return about


def build_from_files(spark: SparkSession, triples_path: str, queries: Mapping[str, str], out_dir: str, name: str, entailed: bool = False, strict: bool = True) -> dict:
    """N-Triples files and SPARQL texts to a benchmark folder."""
    triples = read_ntriples(spark, triples_path, strict=strict, skip_empty_subject=entailed)
    return build(build_store(triples, entailed), queries, out_dir, name, f"{len(queries)} queries over {triples_path}")
