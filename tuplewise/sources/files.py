"""Relations in CSV, Parquet and .tbl files, and result sinks.

Checks of values are part of the plan (`raise_error` in a projection), so they run with the query and cost no scan of their own;
with eager=True readers look first, and that of CSV names the row and column.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidDataError, UnsupportedFormatError

_DIGITS = r"^\+?[0-9]+$"


def _checked(value: Column, ok: Column, message: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message).cast("bigint"))


def checked_key(value: Column, name: str) -> Column:
    """A column of keys that fails the query at a null or negative value."""
    return _checked(value, value.isNotNull() & (value >= 0), F.concat(F.lit(f"{name}: not a non-negative integer: "), F.coalesce(value.cast("string"), F.lit("missing"))))


def integral(df: DataFrame, what: str) -> DataFrame:
    """df with all columns as BIGINT; columns that aren't integral are errors."""
    for f in df.schema:
        if not isinstance(f.dataType, T.IntegralType):
            raise InvalidDataError(f"{what}: {f.name} is {f.dataType.simpleString()}, not integral")
    return df.select([F.col(f"`{c}`").cast("bigint").alias(c) for c in df.columns])


def checked(df: DataFrame) -> DataFrame:
    return df.select([checked_key(F.col(f"`{c}`"), c).alias(c) for c in df.columns])


#: Of a file's lines, those that aren't blank and no comment. The first is the header, whatever stands in it.
_CONTENT = "trim(value) <> '' and not startswith(value, '#')"


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).where(_CONTENT).first()
    if first is None:
        raise InvalidDataError(f"{path}: no header row")
    return next(csv.reader([first[0]], escapechar="\\", doublequote=False))


def read_csv_relation(spark: SparkSession, path: str, eager: bool = False) -> DataFrame:
    """A CSV file (or folder of such) with a header; `#` lines are comments; every field is a non-negative integer; ragged rows are errors.

    Checked with the query, or at once, naming row and column, if eager.
    """
    names = _csv_header(spark, path)
    if len(set(names)) != len(names):
        raise InvalidDataError(f"{path}: column names repeat")
    lines = spark.read.option("header", True).option("comment", "#")
    # one column more than the header has, to notice rows that are too long; Spark leaves out the first content line of each file
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(names) + 1)])
    fields = lines.schema(schema).csv(path, sep=",", escape="\\", enforceSchema=True, mode="PERMISSIVE")
    whole = F.lit(True)
    for i in range(len(names)):
        whole = whole & F.coalesce(F.col(f"f{i}").rlike(_DIGITS) & F.col(f"f{i}").try_cast("bigint").isNotNull(), F.lit(False))
    if eager:
        _first_bad(fields, names, whole, path)
    cells = []
    for i, n in enumerate(names):
        c = F.col(f"f{i}")
        ok = c.rlike(_DIGITS) & c.try_cast("bigint").isNotNull() & F.col(f"f{len(names)}").isNull()
        cells.append(_checked(c.try_cast("bigint"), F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{n}: not a non-negative integer: "), F.coalesce(c, F.lit("missing")))).alias(n))
    return fields.select(cells)


def _first_bad(fields: DataFrame, names: list[str], whole: Column, path: str) -> None:
    rows = fields.select("*", F.monotonically_increasing_id().alias("row"))
    found = rows.where(~whole | F.col(f"f{len(names)}").isNotNull()).orderBy("row").first()
    if found is None:
        return
    for i, n in enumerate(names):
        v = found[f"f{i}"]
        if v is None or not v.removeprefix("+").isdigit() or int(v) > (1 << 63) - 1:
            at = rows.where(F.col("row") < found["row"]).count()
            raise InvalidDataError(f"{path}: {v!r} isn't a non-negative integer: row {at}, column {i} ({n})")
    raise InvalidDataError(f"{path}: a row has more fields than the header")


def read_parquet_relation(spark: SparkSession, path: str, eager: bool = False) -> DataFrame:
    """A Parquet file of integral columns without nulls or negative values; BIGINT. Checked with the query, or at once if eager."""
    df = integral(spark.read.parquet(path), path)
    return validate(df, path) if eager else checked(df)


def validate(df: DataFrame, what: str) -> DataFrame:
    """df, after one aggregate over all columns has found no null and no negative value."""
    if not df.columns:
        raise InvalidDataError(f"{what}: no columns")
    row = df.agg(*[x for c in df.columns for x in (F.count_if(F.col(f"`{c}`").isNull()), F.min(F.col(f"`{c}`")))]).first()
    for i, c in enumerate(df.columns):
        if row[2 * i] or (row[2 * i + 1] is not None and row[2 * i + 1] < 0):
            raise InvalidDataError(f"{what}: column {c} has {'nulls' if row[2 * i] else 'negative values'}")
    return df


def read_tbl(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A .tbl file: no header, a comma after the last field, every row exactly as wide as `columns` (by default c0, c1, ... of the first row's width)."""
    if columns is None:
        first = spark.read.text(path).where("trim(value) <> ''").first()
        if first is None:
            raise InvalidDataError(f"{path}: no row to tell the width")
        columns = [f"c{i}" for i in range(first[0].count(","))]
    parts = F.split("value", ",")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p"))
    wide = (F.size("p") == len(columns) + 1) & (F.trim(F.element_at("p", -1)) == "")
    out = []
    for i, c in enumerate(columns):
        cell = F.trim(F.get("p", F.lit(i)))
        out.append(_checked(cell.try_cast("bigint"), F.coalesce(wide & cell.rlike(_DIGITS), F.lit(False)), F.concat(F.lit("malformed .tbl row: "), F.array_join("p", ","))).alias(c))
    return rows.select(out)


def write_csv(df: DataFrame, path: str | None = None, header: bool = True) -> None:
    """Rows as CSV to a local file, or to standard output; streamed a partition at a time."""
    out = open(path, "w", newline="") if path else sys.stdout  # noqa: SIM115
    try:
        w = csv.writer(out, lineterminator="\n")
        if header and df.columns:
            w.writerow(df.columns)
        for row in df.toLocalIterator():
            w.writerow(row)
    finally:
        if path:
            out.close()


def write_relation(df: DataFrame, path: str, format: str = "parquet") -> None:
    """A relation to a folder that any executor can write: parquet, or csv with a header in each part."""
    if format == "parquet":
        df.write.parquet(path)
    elif format == "csv":
        df.write.csv(path, header=True)
    else:
        raise UnsupportedFormatError(f"unknown format {format!r}")
