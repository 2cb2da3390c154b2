"""Data for benchmarks, from Spark's ranges and hashes alone: the same parameters give the same rows on any cluster."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rdf import lubm
from ..rdf.pipeline import build, build_store
from .definition import Definition

#: Columns of the eight-relation suite, and its queries.
OXFORD = {
    "P": ("A",), "Q": ("A",), "R": ("A", "B", "X"), "S": ("A", "C", "Y"), "T": ("B", "C", "Z"), "U": ("X", "D"), "V": ("Y", "E"), "W": ("Z", "F"),
}
OXFORD_QUERIES = {
    "binary-join": "Result(A) :- P(A), Q(A).",
    "triangle": "Result(A, B, C) :- R(A, B, X), S(A, C, Y), T(B, C, Z).",
    "six-way": "Result(A, B, C, X, Y, Z) :- R(A, B, X), S(A, C, Y), T(B, C, Z), U(X, D), V(Y, E), W(Z, F).",
}


def _draw(seed: int, relation: str, column: str, domain: int, skewed: bool) -> Column:
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(relation), F.lit(column), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # an inverse-power draw: value v about as often as 1/v
    return (F.pow(F.lit(float(domain)), u) - 1).cast("long") if skewed else (u * domain).cast("long")


def oxford(spark: SparkSession, scale: int, distribution: str = "uniform", seed: int = 0) -> dict[str, DataFrame]:
    """The eight relations with 1,000 * 2^(scale-1) tuples each; uniform or zipf values."""
    n = 1000 << (scale - 1)
    return {name: spark.range(n).select(*[_draw(seed, name, c, max(2, n // 10), distribution == "zipf").alias(c) for c in columns]) for name, columns in OXFORD.items()}


def write_oxford(spark: SparkSession, out: str, scale: int, distribution: str = "uniform", seed: int = 0) -> Definition:
    """The relations as Parquet under `out`, and their benchmark.yml."""
    name = f"oxford-{distribution}-s{scale}"
    for r, df in oxford(spark, scale, distribution, seed).items():
        df.write.mode("overwrite").parquet(f"file://{Path(out).resolve()}/{r}.parquet")
    made = Definition(name, f"{distribution} values, scale {scale}", [{"name": r, "url": f"file://{Path(out).resolve()}/{r}.parquet"} for r in OXFORD], [{"name": q, "description": q, "query": text} for q, text in OXFORD_QUERIES.items()])
    made.validate()
    (Path(out) / f"{name}.yml").write_text(made.to_yaml())
    return made


def watdiv(spark: SparkSession, scale: int, seed: int = 0) -> DataFrame:
    """(s, p, o, pos): users, products, reviews, countries; star and snowflake shapes."""
    base, n = "http://db.uwaterloo.ca/~galuc/wsdbm/", 1000 * scale
    iri = lambda kind, k: F.concat(F.lit(f"<{base}{kind}"), k, F.lit(">"))
    pick = lambda m, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(m))
    p = lambda name: F.lit(f"<{base}{name}>")
    user, product, review = iri("User", F.col("id")), iri("Product", F.col("id")), iri("Review", F.col("id"))
    facts = [
        (n, user, "follows", iri("User", pick(n, "f1"))), (n, user, "follows", iri("User", pick(max(1, n // 50), "f2"))), (n, user, "likes", iri("Product", pick(max(1, n // 4), "l"))), (n, user, "nationality", iri("Country", pick(25, "n"))),
        (n // 4, product, "hasGenre", iri("Genre", pick(20, "g"))), (n // 4, product, "eligibleRegion", iri("Country", pick(25, "e"))), (n // 2, review, "reviewer", iri("User", pick(n, "r"))), (n // 2, review, "reviewFor", iri("Product", pick(max(1, n // 4), "p"))),
        (100, iri("City", F.col("id")), "parentCountry", iri("Country", pick(25, "c"))),
    ]
    out = None
    for k, (count, s, name, o) in enumerate(facts):
        part = spark.range(count).select(s.alias("s"), p(name).alias("p"), o.alias("o"), F.struct(F.lit("").alias("file"), F.lit(k).cast("long").alias("block"), F.col("id").alias("line")).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


def watdiv_queries(count: int, max_size: int, constants: int, seed: int = 0) -> dict[str, str]:
    """Connected patterns of up to max_size triples with at least one constant each."""
    import random

    rng, base = random.Random(seed), "http://db.uwaterloo.ca/~galuc/wsdbm/"
    edges = {"User": [("follows", "User"), ("likes", "Product"), ("nationality", "Country")], "Product": [("hasGenre", "Genre"), ("eligibleRegion", "Country")], "Review": [("reviewer", "User"), ("reviewFor", "Product")], "City": [("parentCountry", "Country")]}
    sizes = {"User": 1000, "Product": 250, "Country": 25, "Genre": 20}
    out = {}
    for i in range(count):
        kinds, triples = [rng.choice(list(edges))], []
        for _ in range(rng.randint(1, max_size)):
            starts = [k for k, kind in enumerate(kinds) if kind in edges]
            s = rng.choice(starts)
            prop, kind = rng.choice(edges[kinds[s]])
            kinds.append(kind)
            triples.append([s, prop, len(kinds) - 1])
        used = {t[0] for t in triples}
        leaves = [t[2] for t in triples if t[2] not in used]
        fixed = {v: f"<{base}{kinds[v]}{rng.randrange(sizes[kinds[v]])}>" for v in rng.sample(leaves, min(len(leaves), max(1, min(constants, len(triples)))))}
        name = lambda v, fixed=fixed: fixed.get(v, f"?v{v}")
        out[f"q{i:04d}"] = "SELECT * WHERE { " + " . ".join(f"{name(s)} <{base}{p}> {name(o)}" for s, p, o in triples) + " . }"
    return out


def generate(spark: SparkSession, definition: Definition, folder: Path) -> dict:
    """Make a generated benchmark's folder."""
    spec = definition.full_spec()
    if spec["kind"] == "lubm":
        names = spec["queries"] or lubm.query_names()
        store = build_store(lubm.generate(spark, spec["scale"], spec["seed"]), entailed=True)
        queries = {q: lubm.sparql(q) for q in names}
    else:
        stress = spec["stress"]
        store = build_store(watdiv(spark, spec["scale"], spec["seed"]))
        queries = watdiv_queries(stress["query_count"], stress["max_query_size"], stress["constants_per_query"], spec["seed"])
    return build(store, queries, str(folder), definition.name, definition.description, meta={"generator": spec})
