"""What the catalogues share: tables of fixed rows as SQL, and folders that Spark and this process both see."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .storage import new_path


#: Triples of the tables as SQL (subject, predicate, object, place), for Spark and DuckDB alike.
GEO = """
SELECT '<http://example.org/nation' || CAST(n_nationkey AS STRING) || '>' AS s, '<http://example.org/inRegion>' AS p, '<http://example.org/region' || CAST(n_regionkey AS STRING) || '>' AS o, CAST(n_nationkey AS BIGINT) AS pos FROM nation
UNION ALL SELECT '<http://example.org/nation' || CAST(n_nationkey AS STRING) || '>', '<http://example.org/ns#name>', '"' || n_name || '"', CAST(n_nationkey AS BIGINT) + 1000 FROM nation
UNION ALL SELECT '<http://example.org/region' || CAST(r_regionkey AS STRING) || '>', '<http://example.org/ns#name>', '"' || r_name || '"', CAST(r_regionkey AS BIGINT) + 2000 FROM region
"""


def literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"CAST({value} AS BIGINT)" if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def rows_sql(columns: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """Fixed rows as SQL."""
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT {names} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> Path:
    """A new folder under spark.checkpoint.dir that plain file functions reach too, as definitions and reports need."""
    path = new_path(spark, name)
    local = path.removeprefix("file:")
    local = "/" + local.lstrip("/") if path.startswith("file:") else local
    if "://" in local:
        raise EngineError(f"{path} isn't in a file system of this machine")
    Path(local).mkdir(parents=True)
    return Path(local)


def triples_of(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """A triple table from SQL over some tables, which are views only while the plan is made."""
    views = {t: f"{t}_{uuid.uuid4().hex}" for t in tables}
    for t, view in views.items():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
        sql = re.sub(rf"FROM {t}\b", f"FROM {view}", sql)
    df = spark.sql(sql)
    df.schema  # analysed while the views are there
    for view in views.values():
        spark.catalog.dropTempView(view)
    return df


def geo_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples_of(spark, sf_dir, GEO, ("nation", "region"))
