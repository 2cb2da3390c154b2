"""Registered queries over sources, sinks and the RDF front end, with their SQL."""

from __future__ import annotations

import http.server
import json
import threading
from collections.abc import Callable
from functools import partial
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bench.definition import Definition, ensure_cached
from .bench.generate import watdiv
from .catalog import Database
from .catalogue_sql import GEO, folder, geo_triples, rows_sql, table
from .rdf import dictionary, lubm
from .rdf.entail import RDF_TYPE, ub
from .rdf.ntriples import read_ntriples, write_ntriples
from .rdf.partition import predicate_names, sanitize_predicate, write_partitions
from .rdf.pipeline import Store, build, build_from_files, build_store, read_desc
from .rdf.sparql import split_blocks, split_lines, translate_all
from .sources.files import write_csv, write_relation
from .storage import new_path

NATION = 'SELECT CAST(n_nationkey AS BIGINT) AS "N", CAST(n_regionkey AS BIGINT) AS "R" FROM nation'
ORDERS = 'SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS "O", CAST(o_custkey AS BIGINT) AS "C" FROM orders'


def _dictionary_sql() -> str:
    return f"SELECT row_number() OVER (ORDER BY first) - 1 AS id, value FROM (SELECT v AS value, min(3 * pos + k) AS first FROM (SELECT s AS v, pos, 0 AS k FROM ({GEO}) UNION ALL SELECT p, pos, 1 FROM ({GEO}) UNION ALL SELECT o, pos, 2 FROM ({GEO})) GROUP BY v)"


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The 25 nations, for files that are written by hand."""
    return sorted((r[0], r[1]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("O"), F.col("o_custkey").cast("long").alias("C"))


def relation_file(spark: SparkSession, sf_dir: str, suffix: str, index: str = "tree_trie") -> DataFrame:
    """Orders written in a format, added by the file's name and read by a rule."""
    path = f"{new_path(spark, 'files')}/orders{suffix}"
    if suffix.lower() == ".tbl":
        _orders(spark, sf_dir).select(F.concat_ws(",", "O", "C", F.lit("")).alias("value")).write.text(path)
    else:
        write_relation(_orders(spark, sf_dir), path, suffix.lower()[1:])
    db = Database(spark, index=index)
    db.add_file(path)
    return db.query("Q(O,C) :- orders(O,C).")


def csv_numeric_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header that looks like a row, and a row that looks like the header."""
    path = folder(spark, "csv") / "rel.csv"
    path.write_text("# nations\n1,2\n" + "".join(f"{n},{r}\n" for n, r in [*_nations(spark, sf_dir), (1, 2)]))
    db = Database(spark)
    db.add_file(f"file://{path}")
    return db.query("Q(N,R) :- rel(N,R).")


def empty_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.add_df("n", table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    db.add_relation("none", 2)
    return db.query("Q(N) :- n(N,R), none(N,R).")


def tuples_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.add_tuples("n", [*_nations(spark, sf_dir), *_nations(spark, sf_dir)])
    return db.query("Q(N,R) :- n(N,R).")


def ntriples(spark: SparkSession, sf_dir: str, strict: bool = True, gzip: bool = False) -> DataFrame:
    """Triples written as N-Triples and read again, plain or compressed."""
    path, triples = new_path(spark, "triples"), geo_triples(spark, sf_dir)
    if gzip:
        lines = triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
        lines.unionByName(spark.createDataFrame([("<> <http://a> <http://b> .",), ("# a comment",), ("",)], "value string")).write.option("compression", "gzip").text(path)
    else:
        write_ntriples(triples, path)
    return read_ntriples(spark, path, strict=strict, skip_empty_subject=gzip).select("s", "p", "o")


REGION_QUERY = "SELECT ?x WHERE {{ ?x <http://example.org/inRegion> <http://example.org/region{}> . }}"


def sparql_file(spark: SparkSession, sf_dir: str, blocks: bool) -> DataFrame:
    """Queries of a file, one a line or in blocks, translated as a batch and counted."""
    store = build_store(geo_triples(spark, sf_dir))
    text = ("\n#end\n" if blocks else "\n\n").join(REGION_QUERY.format(r) for r in range(5)) + "\n"
    path = folder(spark, "sparql") / "q.sparql"
    path.write_text(text)
    found = (split_blocks if blocks else split_lines)(path.read_text())
    store.dictionary, ids = dictionary.extend(store.dictionary, [f"<http://example.org/region{r}>" for r in range(5)])
    rules = translate_all(found, ids.__getitem__, store.names, "Q")
    db = store.database()
    out = None
    for name, rule in rules:
        n = db.query(rule).agg(F.lit(name).alias("query"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


BY_REGION = "SELECT 'q000' || CAST(n_regionkey AS VARCHAR) AS query, count(*) AS n FROM nation GROUP BY n_regionkey"


def desc_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts: dict[int, int] = {}
    for _, r in _nations(spark, sf_dir):
        counts[r] = counts.get(r, 0) + 1
    path = folder(spark, "desc") / "q.desc"
    path.write_text("\n\n".join(str(counts[r]) for r in sorted(counts)) + "\n")
    return spark.createDataFrame(list(enumerate(read_desc(path))), "line long, n long")


def cached_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation fetched over HTTP into the cache once, and read from there twice."""
    root = folder(spark, "http")
    (root / "www").mkdir()
    (root / "www/nat.csv").write_text("N,R\n" + "".join(f"{n},{r}\n" for n, r in _nations(spark, sf_dir)))

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(root / "www")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        d = Definition("web", "", [{"name": "nat", "url": f"http://127.0.0.1:{server.server_port}/nat.csv"}], [{"name": "q", "query": "Q(N,R) :- nat(N,R)."}])
        ensure_cached(d, root / "cache")
    finally:
        server.shutdown()
        server.server_close()
    db = Database(spark)
    db.add_file("file://" + ensure_cached(d, root / "cache")["nat"])
    return db.query(d.queries[0]["query"])


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.add_df("n", table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    path = folder(spark, "sink") / "out.csv"
    write_csv(db.query("Q(R,N) :- n(N,R).", ordered=True), str(path))
    lines = path.read_text().splitlines()
    return spark.createDataFrame([tuple(map(int, x.split(","))) for x in lines[1:]], ", ".join(f"{c} long" for c in lines[0].split(",")))


def vertical_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation for each predicate, written and read by its folder."""
    store = build_store(geo_triples(spark, sf_dir))
    out = None
    for name, path in write_partitions(store.encoded, store.names, store.ids, new_path(spark, "relations")).items():
        part = dictionary.decode(spark.read.parquet(path).select("s", "o"), store.dictionary).select(F.lit(name).alias("rel"), "s", "o")
        out = part if out is None else out.unionByName(part)
    return out


def _built(spark: SparkSession, sf_dir: str) -> Path:
    out = folder(spark, "built")
    queries = {"by_region": REGION_QUERY.format(1), "names": "SELECT * WHERE { ?a <http://example.org/inRegion> ?b . ?b <http://example.org/ns#name> ?c }"}
    build(build_store(geo_triples(spark, sf_dir)), queries, str(out), "geo", "nations", expected={"by_region": 5, "names": 25})
    return out


def dictionary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"file://{_built(spark, sf_dir)}/dict.parquet")


def yaml_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = yaml.safe_load((_built(spark, sf_dir) / "benchmark.yml").read_text())
    return spark.createDataFrame([("relation", r["name"]) for r in spec["relations"]] + [("query", q["name"]) for q in spec["queries"]], "kind string, name string")


def expected_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _built(spark, sf_dir) / "expected"
    told = json.loads((out / "expected.json").read_text())
    return spark.createDataFrame([(q, n, int((out / f"{q}.csv").read_text().split()[1])) for q, n in told.items()], "query string, n long, csv long")


def meta_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = json.loads((_built(spark, sf_dir) / "meta.json").read_text())
    return spark.createDataFrame([(about["name"], about["relations"], len(about["spec_sha256"]))], "name string, relations long, digest_chars long")


def built_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Triples and SPARQL to a benchmark folder, whose rules then run over its relations."""
    path, out = new_path(spark, "triples"), folder(spark, "pipeline")
    write_ntriples(geo_triples(spark, sf_dir), path)
    build_from_files(spark, path, {f"r{r}": REGION_QUERY.format(r) for r in range(5)}, str(out), "geo")
    return _counts(spark, Definition.load(out / "benchmark.yml"))


def _counts(spark: SparkSession, d: Definition) -> DataFrame:
    db = Database(spark)
    for r in d.relations:
        db.add_df(r["name"], spark.read.parquet(r["url"]))
    out = None
    for q in d.queries:
        n = db.query(q["query"]).agg(F.lit(q["name"]).alias("query"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def dictionary_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a dictionary lacks get the ids behind its last."""
    grown, _ = dictionary.extend(dictionary.build_dictionary(geo_triples(spark, sf_dir)), ["<new:b>", "<http://example.org/inRegion>", "<new:a>", "<new:b>"])
    return grown


def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of relations for predicates made of nations' names."""
    rows = table(spark, sf_dir, "nation").select("n_name").collect()  # 25
    return spark.createDataFrame([(r[0], sanitize_predicate(f"<http://x/y#{r[0]}>"), sanitize_predicate(f"<http://x/7-{r[0]}/>")) for r in rows], "nation string, fragment string, segment string")


def relation_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates that share a name: the later ones carry their ids."""
    ids = {f"<http://r{r}#in>": n for n, r in _nations(spark, sf_dir)[::-1]}
    return spark.createDataFrame([(iri, name) for iri, name in predicate_names(ids).items()], "iri string, name string")


def lubm_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of one university by predicate."""
    return lubm.generate(spark, 1).groupBy("p").agg(F.count("*").alias("n"))


def watdiv_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watdiv(spark, 2).groupBy("p").agg(F.count("*").alias("n"))


def lubm_store(spark: SparkSession) -> Store:
    return build_store(lubm.generate(spark, 1), entailed=True)


def lubm_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 14 queries over one university with its consequences."""
    store, out = lubm_store(spark), None
    for q in lubm.query_names():
        n = store.select(lubm.sparql(q)).agg(F.lit(q).alias("query"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


#: Triples of a predicate in one university: departments x what the generator gives each.
_D = 15
LUBM_TRIPLES = {
    RDF_TYPE: 1 + _D * (1 + 30 + 60 + 100 + 400 + 12 + 90), ub("subOrganizationOf"): _D * (1 + 12), ub("worksFor"): _D * 30, ub("name"): _D * 30, ub("emailAddress"): _D * (30 + 100 + 400), ub("telephone"): _D * 30,
    ub("doctoralDegreeFrom"): _D * 30, ub("teacherOf"): _D * 60, ub("headOf"): _D, ub("memberOf"): _D * 500, ub("undergraduateDegreeFrom"): _D * 100, ub("takesCourse"): _D * 2 * 500, ub("advisor"): _D * 100, ub("publicationAuthor"): _D * 90,
}
_WD = "http://db.uwaterloo.ca/~galuc/wsdbm/"
WATDIV_TRIPLES = {"follows": 4000, "likes": 2000, "nationality": 2000, "hasGenre": 500, "eligibleRegion": 500, "reviewer": 1000, "reviewFor": 1000, "parentCountry": 100}
#: Results over the generator's one university with seed 0, as a plain evaluation gives them (tests/test_catalogue.py).
LUBM_COUNTS: dict[str, int] = {"q1": 5, "q2": 1500, "q3": 3, "q4": 26, "q5": 530, "q6": 7500, "q7": 47, "q8": 7500, "q9": 105, "q10": 5, "q11": 180, "q12": 15, "q13": 1950, "q14": 6000}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_file": partial(relation_file, suffix=".csv"),
    "parquet_file": partial(relation_file, suffix=".parquet"),
    "tbl_file": partial(relation_file, suffix=".tbl"),
    "suffix_in_capitals": partial(relation_file, suffix=".PARQUET"),
    "column_trie": partial(relation_file, suffix=".parquet", index="column-trie"),
    "csv_numeric_header": csv_numeric_header,
    "empty_relation": empty_relation,
    "tuples_in_memory": tuples_in_memory,
    "ntriples_strict": ntriples,
    "ntriples_loose": partial(ntriples, strict=False),
    "ntriples_gzip": partial(ntriples, gzip=True),
    "sparql_lines": partial(sparql_file, blocks=False),
    "sparql_blocks": partial(sparql_file, blocks=True),
    "desc_file": desc_file,
    "cached_source": cached_source,
    "csv_sink": csv_sink,
    "vertical_partitions": vertical_partitions,
    "dictionary_sink": dictionary_sink,
    "yaml_sink": yaml_sink,
    "expected_sink": expected_sink,
    "meta_sink": meta_sink,
    "built_benchmark": built_benchmark,
    "dictionary_growth": dictionary_growth,
    "relation_names": relation_names,
    "relation_name_collisions": relation_name_collisions,
    "lubm_data": lubm_data,
    "watdiv_data": watdiv_data,
    "lubm_queries": lubm_queries,
}


def _oracle() -> dict[str, str]:
    return {
        **dict.fromkeys(("csv_file", "parquet_file", "tbl_file", "suffix_in_capitals", "column_trie"), ORDERS),
        "csv_numeric_header": f"{NATION} UNION SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT)",
        "empty_relation": 'SELECT CAST(n_nationkey AS BIGINT) AS "N" FROM nation WHERE false',
        "tuples_in_memory": NATION,
        **dict.fromkeys(("ntriples_strict", "ntriples_loose", "ntriples_gzip"), f"SELECT s, p, o FROM ({GEO})"),
        "sparql_lines": BY_REGION,
        "sparql_blocks": BY_REGION,
        "desc_file": "SELECT CAST(n_regionkey AS BIGINT) AS line, count(*) AS n FROM nation GROUP BY n_regionkey",
        "cached_source": NATION,
        "csv_sink": NATION,
        "vertical_partitions": f"SELECT CASE WHEN p LIKE '%inRegion>' THEN 'inregion' ELSE 'name' END AS rel, s, o FROM ({GEO})",
        "dictionary_sink": _dictionary_sql(),
        "yaml_sink": rows_sql(("kind", "name"), [("relation", "inregion"), ("relation", "name"), ("query", "by_region"), ("query", "names")]),
        "expected_sink": "SELECT 'by_region' AS query, count(*) AS n, count(*) AS csv FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'names', count(*), count(*) FROM nation JOIN region ON n_regionkey = r_regionkey",
        "meta_sink": rows_sql(("name", "relations", "digest_chars"), [("geo", 2, 64)]),
        "built_benchmark": "SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS query, count(*) AS n FROM nation GROUP BY n_regionkey",
        "dictionary_growth": f"WITH d AS ({_dictionary_sql()}) SELECT id, value FROM d UNION ALL SELECT (SELECT max(id) FROM d) + 1, '<new:b>' UNION ALL SELECT (SELECT max(id) FROM d) + 2, '<new:a>'",
        "relation_names": "SELECT n_name AS nation, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) AS fragment, 'p_7_' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) AS segment FROM nation",
        "relation_name_collisions": "WITH i AS (SELECT n_regionkey AS r, min(n_nationkey) AS id FROM nation GROUP BY n_regionkey) SELECT '<http://r' || CAST(r AS VARCHAR) || '#in>' AS iri, CASE WHEN id = (SELECT min(id) FROM i) THEN 'in' ELSE 'in_' || CAST(id AS VARCHAR) END AS name FROM i",
        "lubm_data": rows_sql(("p", "n"), LUBM_TRIPLES.items()),
        "watdiv_data": rows_sql(("p", "n"), [(f"<{_WD}{p}>", n) for p, n in WATDIV_TRIPLES.items()]),
        "lubm_queries": rows_sql(("query", "n"), LUBM_COUNTS.items()),
    }


ORACLE_SQL: dict[str, str] = _oracle()
