"""N-Triples as DataFrames of (s, p, o, pos); terms keep their surface form: <iri>, _:blank, "literal"..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NTriplesError

IRI, BLANK = r"<[^\x00-\x20<>\"{}|^`\\]*>", r"_:[A-Za-z0-9_][A-Za-z0-9_.\-]*"
LITERAL = r'"(?:[^"\\\n\r]|\\.)*"(?:\^\^' + IRI + r"|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
TRIPLE = rf"^\s*({IRI})\s*({IRI})\s*({IRI}|{BLANK}|{LITERAL})\s*\.\s*(?:#.*)?$"
#: The permissive form: two runs of white space part subject, predicate and the rest up to the last dot.
LOOSE = r"^\s*(\S+)\s+(\S+)\s+(.+?)\s*\.\s*$"


def _position() -> Column:
    """Order of lines: by file, block of the file, and line within the block; only comparable, not dense."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_ntriples(spark: SparkSession, path: str, strict: bool = True, skip_empty_subject: bool = False, eager: bool = False) -> DataFrame:
    """Triples of N-Triples files, plain or compressed. Blank and `#` lines are skipped; a malformed line is an error.

    strict=False: any tokens. skip_empty_subject: lines that begin with `<> ` are left out. eager: look for
    malformed lines now, and name the first.
    """
    lines = spark.read.text(path).select("value", _position().alias("pos")).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    if skip_empty_subject:
        lines = lines.where(~F.startswith("value", F.lit("<> ")))
    pattern = TRIPLE if strict else LOOSE
    ok = F.col("value").rlike(pattern)
    if eager:
        bad = lines.where(~ok).orderBy("pos").first()
        if bad is not None:
            raise NTriplesError(f"not a triple: {bad['value'][:200]!r}")
    term = lambda i: F.when(ok, F.regexp_extract("value", pattern, i)).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200))).cast("string"))
    return lines.select(term(1).alias("s"), term(2).alias("p"), term(3).alias("o"), "pos")


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def is_iri(term: Column) -> Column:
    return F.startswith(term, F.lit("<"))


def is_literal(term: Column) -> Column:
    return F.startswith(term, F.lit('"'))
