"""Relations and databases."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ArityMismatchError, InvalidDataError, UnsupportedFormatError
from .parser import parse_rule
from .plans.planner import DEFAULT, plan_rule
from .rules import Rule
from .sources.files import checked, integral, read_csv_relation, read_tbl

MAX_KEY = (1 << 63) - 1


def relation_schema(attrs: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(a, T.LongType(), False) for a in attrs])


@dataclass(frozen=True)
class Relation:
    """A set of tuples of non-negative integers. The frame may hold repeats; results never do."""

    name: str
    attrs: tuple[str, ...]
    df: DataFrame
    #: The same before its checks, where there are any: rules filter and prune this, and check what they read.
    raw: DataFrame | None = None

    @property
    def arity(self) -> int:
        return len(self.attrs)

    @classmethod
    def from_tuples(cls, spark: SparkSession, name: str, rows: Iterable[Sequence[int]], attrs: Sequence[str] | None = None, arity: int | None = None) -> Relation:
        """A relation of tuples in memory. Without attrs the columns are c0, c1, ..."""
        rows = [tuple(r) for r in rows]
        width = len(attrs) if attrs is not None else arity if arity is not None else len(rows[0]) if rows else 0
        attrs = tuple(attrs) if attrs is not None else tuple(f"c{i}" for i in range(width))
        for r in rows:
            if len(r) != width:
                raise ArityMismatchError(f"{name}: a tuple of {len(r)} in a relation of {width}")
            for v in r:
                if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= MAX_KEY:
                    raise InvalidDataError(f"{name}: {v!r} isn't a non-negative 63-bit integer")
        return cls(name, attrs, spark.createDataFrame(rows, relation_schema(attrs)))

    @classmethod
    def from_df(cls, name: str, df: DataFrame) -> Relation:
        """Integral columns, cast to BIGINT; others are rejected. Nulls and negative values fail the query that reads them."""
        raw = integral(df, name)
        return cls(name, tuple(df.columns), checked(raw), raw)

    def project(self, columns: Sequence[int], name: str = "") -> Relation:
        """Columns by place, in any order, repeats allowed; a set again."""
        for i in columns:
            if not 0 <= i < self.arity:
                raise IndexError(f"{self.name} has no column {i}")
        attrs: list[str] = []
        for i in columns:
            a, k = self.attrs[i], 1
            while a in attrs:
                a, k = f"{self.attrs[i]}_{k}", k + 1
            attrs.append(a)
        df = self.df.toDF(*[f"v{i}" for i in range(self.arity)])
        picked = df.select([df[f"v{i}"].alias(a) for i, a in zip(columns, attrs, strict=True)])
        return Relation(name, tuple(attrs), picked.distinct())

    def seek(self, prefix: Sequence[int], place: int, bound: int) -> DataFrame:
        """For each tuple of the columns `prefix`, the least key of column `place` at or above `bound`: what a sorted index answers to a seek.

        Prefixes without such a key are not there: that is the end of their keys.
        """
        df = self.df.toDF(*[f"v{i}" for i in range(self.arity)])
        return df.where(F.col(f"v{place}") >= bound).groupBy(*[f"v{i}" for i in prefix]).agg(F.min(f"v{place}").alias("least")).toDF(*[self.attrs[i] for i in prefix], self.attrs[place])

    def insert(self, rows: Iterable[Sequence[int]]) -> Relation:
        """A new relation with more tuples; those already there change nothing."""
        more = Relation.from_tuples(self.df.sparkSession, self.name, rows, self.attrs)
        return Relation(self.name, self.attrs, self.df.union(more.df).distinct())

    def stored(self, mode: str) -> Relation:
        """Storage by the names of the two index kinds: `column_trie`: cached, sorted within partitions, until released; `tree_trie`: as it is."""
        if mode.replace("-", "_") == "tree_trie":
            return self
        if mode.replace("-", "_") != "column_trie":
            raise UnsupportedFormatError(f"unknown index structure {mode!r}")
        return Relation(self.name, self.attrs, self.df.distinct().sortWithinPartitions(*self.attrs).persist())

    def release(self) -> None:
        """Free what `column_trie` holds; reading the relation afterwards computes it anew."""
        self.df.unpersist()


class Database:
    """Named relations, and rules over them."""

    def __init__(self, spark: SparkSession, name: str = "db", strategy: str = DEFAULT, index: str = "tree_trie"):
        self.spark, self.name, self.strategy, self.index = spark, name, strategy, index
        self.relations: dict[str, Relation] = {}

    def add(self, relation: Relation) -> Relation:
        if relation.name in self.relations and self.index.replace("-", "_") == "column_trie":
            self.relations[relation.name].release()
        self.relations[relation.name] = relation.stored(self.index)
        return self.relations[relation.name]

    def add_df(self, name: str, df: DataFrame) -> Relation:
        return self.add(Relation.from_df(name, df))

    def add_relation(self, name: str, arity: int) -> Relation:
        """An empty relation."""
        return self.add(Relation.from_tuples(self.spark, name, [], arity=arity))

    def add_tuples(self, name: str, rows: Iterable[Sequence[int]], attrs: Sequence[str] | None = None) -> Relation:
        return self.add(Relation.from_tuples(self.spark, name, rows, attrs))

    def add_keys(self, name: str, row: Sequence[int]) -> Relation:
        return self.add_keys_batch(name, [row])

    def add_keys_batch(self, name: str, rows: Iterable[Sequence[int]]) -> Relation:
        return self.add(self.relations[name].insert(rows))

    def add_file(self, path: str) -> Relation:
        """A `.csv`, `.parquet` or `.tbl` file, named by its stem."""
        p = PurePosixPath(str(path))
        kind = p.suffix.lower()
        if kind == ".parquet":
            return self.add(Relation.from_df(p.stem, self.spark.read.parquet(str(path))))
        if kind not in (".csv", ".tbl"):
            raise UnsupportedFormatError(f"Unsupported file extension: {p.suffix or p.name!r}")
        df = (read_csv_relation if kind == ".csv" else read_tbl)(self.spark, str(path))
        return self.add(Relation(p.stem, tuple(df.columns), df))

    def drop(self, name: str) -> None:
        """Forget a relation, and what its storage mode holds of it."""
        self.relations.pop(name).release()

    def query(self, rule: Rule | str, strategy: str | None = None, output: str = "head", ordered: bool = False) -> DataFrame:
        """The rule's result as a lazy DataFrame: distinct head tuples, or with output="bindings" all variables."""
        rule = parse_rule(rule) if isinstance(rule, str) else rule
        frames = {n: r.df if r.raw is None else r.raw for n, r in self.relations.items()}
        unchecked = {n for n, r in self.relations.items() if r.raw is not None}
        return plan_rule(self.spark, frames, rule, strategy or self.strategy, output, ordered, unchecked)


def compute_join(spark: SparkSession, inputs: Sequence[Sequence[Sequence[int]]], variables: Sequence[int], rel_variables: Sequence[Sequence[int]], strategy: str = DEFAULT) -> DataFrame:
    """Join tuples in memory: input i holds the variables rel_variables[i]; an empty list is one unnamed column."""
    db = Database(spark, strategy=strategy)
    body = []
    for i, (rows, names) in enumerate(zip(inputs, rel_variables, strict=False)):
        db.add(Relation.from_tuples(spark, f"R{i}", rows, arity=max(1, len(names))))
        body.append(f"R{i}({', '.join(f'V{v}' for v in names) or '_'})")
    head = ", ".join(f"V{v}" for v in variables)
    return db.query(f"Q({head}) :- {', '.join(body)}.")


def instantiate_database(spark: SparkSession, index: str = "tree_trie", algorithm: str = DEFAULT) -> Database:
    """An empty database by its storage mode and join strategy."""
    return Database(spark, strategy=algorithm, index=index)
