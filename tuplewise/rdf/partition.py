"""Vertical partitioning: a relation (s, o) for each predicate."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidDataError


def sanitize_predicate(iri: str) -> str:
    """A relation's name from a predicate: what follows the last `#`, else the last path segment, in lower-case letters, digits and `_`."""
    bare = iri.strip("<>")
    tail = bare.rsplit("#", 1)[-1] if "#" in bare else bare.rstrip("/").rsplit("/", 1)[-1]
    name = re.sub(r"[^A-Za-z0-9]", "_", tail).strip("_").lower()
    return f"p_{name}" if not name or name[0].isdigit() else name


def predicate_names(ids: Mapping[str, int]) -> dict[str, str]:
    """Names for predicates, given their ids: of those that would share one, later ids get theirs as a suffix."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for iri, i in sorted(ids.items(), key=lambda x: x[1]):
        name = sanitize_predicate(iri)
        if name in taken:
            name = f"{name}_{i}"
            while name in taken:
                name += "_"
        taken.add(name)
        out[iri] = name
    return out


#: More predicates than this are no schema; a relation for each would be of no use.
MOST_PREDICATES = 10_000


def predicates(triples: DataFrame) -> list[str]:
    """Distinct predicates."""
    found = sorted(r["p"] for r in triples.select("p").distinct().limit(MOST_PREDICATES + 1).collect())
    if len(found) > MOST_PREDICATES:
        raise InvalidDataError(f"more than {MOST_PREDICATES} predicates")
    return found


def vertical(encoded: DataFrame, names: Mapping[str, str], ids: Mapping[str, int]) -> dict[str, DataFrame]:
    """name: (s, o) for each predicate, each a filter of the encoded triples."""
    return {name: encoded.where(F.col("p") == F.lit(ids[iri])).select("s", "o") for iri, name in names.items()}


def write_partitions(encoded: DataFrame, names: Mapping[str, str], ids: Mapping[str, int], path: str) -> dict[str, str]:
    """Write all relations in one pass, `rel=<name>` folders under `path`; returns the folder of each."""
    label = F.create_map(*[F.lit(x) for iri, name in names.items() for x in (ids[iri], name)])
    encoded.select("s", "o", label[F.col("p")].alias("rel")).repartition("rel", F.pmod(F.xxhash64("s"), F.lit(64))).write.partitionBy("rel").parquet(path)
    return {name: f"{path}/rel={name}" for name in names.values()}
