"""The university benchmark: its 14 queries, published result counts, and a deterministic generator of like-shaped data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .entail import RDF_TYPE, UB, ub

#: The 14 queries and their published result counts over one university, seed 0, of the original generator.
PREFIX = f"PREFIX ub: <{UB}>"
QUERIES: dict[str, tuple[str, int]] = {
    "q1": (
        "SELECT ?X WHERE { ?X a ub:GraduateStudent ; ub:takesCourse <http://www.Department0.University0.edu/GraduateCourse0> . }",
        4,
    ),
    "q2": (
        "SELECT ?X ?Y ?Z WHERE { ?X a ub:GraduateStudent . ?Y a ub:University . ?Z a ub:Department . ?X ub:memberOf ?Z . ?Z ub:subOrganizationOf ?Y . ?X ub:undergraduateDegreeFrom ?Y . }",
        0,
    ),
    "q3": (
        "SELECT ?X WHERE { ?X a ub:Publication ; ub:publicationAuthor <http://www.Department0.University0.edu/AssistantProfessor0> . }",
        6,
    ),
    "q4": (
        "SELECT ?X ?Y1 ?Y2 ?Y3 WHERE { ?X a ub:Professor ; ub:worksFor <http://www.Department0.University0.edu> ; ub:name ?Y1 ; ub:emailAddress ?Y2 ; ub:telephone ?Y3 . }",
        34,
    ),
    "q5": (
        "SELECT ?X WHERE { ?X a ub:Person ; ub:memberOf <http://www.Department0.University0.edu> . }",
        719,
    ),
    "q6": (
        "SELECT ?X WHERE { ?X a ub:Student . }",
        7790,
    ),
    "q7": (
        "SELECT ?X ?Y WHERE { ?X a ub:Student . ?Y a ub:Course . ?X ub:takesCourse ?Y . <http://www.Department0.University0.edu/AssociateProfessor0> ub:teacherOf ?Y . }",
        67,
    ),
    "q8": (
        "SELECT ?X ?Y ?Z WHERE { ?X a ub:Student . ?Y a ub:Department . ?X ub:memberOf ?Y . ?Y ub:subOrganizationOf <http://www.University0.edu> . ?X ub:emailAddress ?Z . }",
        7790,
    ),
    "q9": (
        "SELECT ?X ?Y ?Z WHERE { ?X a ub:Student . ?Y a ub:Faculty . ?Z a ub:Course . ?X ub:advisor ?Y . ?Y ub:teacherOf ?Z . ?X ub:takesCourse ?Z . }",
        208,
    ),
    "q10": (
        "SELECT ?X WHERE { ?X a ub:Student ; ub:takesCourse <http://www.Department0.University0.edu/GraduateCourse0> . }",
        4,
    ),
    "q11": (
        "SELECT ?X WHERE { ?X a ub:ResearchGroup ; ub:subOrganizationOf <http://www.University0.edu> . }",
        224,
    ),
    "q12": (
        "SELECT ?X ?Y WHERE { ?X a ub:Chair . ?Y a ub:Department . ?X ub:worksFor ?Y . ?Y ub:subOrganizationOf <http://www.University0.edu> . }",
        15,
    ),
    "q13": (
        "SELECT ?X WHERE { ?X a ub:Person . <http://www.University0.edu> ub:hasAlumnus ?X . }",
        1,
    ),
    "q14": (
        "SELECT ?X WHERE { ?X a ub:UndergraduateStudent . }",
        5916,
    ),
}


def query_names() -> list[str]:
    return list(QUERIES)


def sparql(name: str) -> str:
    return f"{PREFIX} {QUERIES[name][0]}"


def expected(name: str) -> int:
    """The published count; says nothing about data made here."""
    return QUERIES[name][1]


def generate(spark: SparkSession, scale: int = 1, seed: int = 0, departments: int = 15) -> DataFrame:
    """(s, p, o, pos) of `scale` universities: departments, faculty, students, courses, publications, groups.

    Made by spark.range and hashes alone: the same (scale, seed) gives the same triples on any cluster.
    """
    n_faculty, n_grad, n_under, n_courses, n_groups = 30, 100, 400, 60, 12
    dep = spark.range(scale * departments).select((F.col("id") / departments).cast("long").alias("u"), (F.col("id") % departments).alias("d"))
    site = F.concat(F.lit("http://www.Department"), F.col("d"), F.lit(".University"), F.col("u"), F.lit(".edu"))
    univ = lambda u: F.concat(F.lit("<http://www.University"), u, F.lit(".edu>"))
    iri = lambda *parts: F.concat(F.lit("<"), site, *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(">"))
    text = lambda *parts: F.concat(F.lit('"'), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit('"'))

    def pick(n: int, *salt) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("u"), F.col("d"), F.col("k"), *map(F.lit, salt)), F.lit(n))

    def entities(n: int) -> DataFrame:
        return dep.select("u", "d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))

    def rank(k: Column) -> Column:
        return F.when(k < 8, F.concat(F.lit("FullProfessor"), k)).when(k < 18, F.concat(F.lit("AssociateProfessor"), k - 8)).when(k < 26, F.concat(F.lit("AssistantProfessor"), k - 18)).otherwise(F.concat(F.lit("Lecturer"), k - 26))

    def rows(df: DataFrame, *facts) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o")) for s, p, o in facts])))

    me = lambda kind: iri("/", kind, F.col("k"))
    teacher, k = iri("/", rank(F.col("k"))), F.col("k")
    kind = F.when(k < 8, ub("FullProfessor")).when(k < 18, ub("AssociateProfessor")).when(k < 26, ub("AssistantProfessor")).otherwise(ub("Lecturer"))
    course = lambda n: F.when(n < n_courses // 2, F.concat(F.lit("/Course"), n)).otherwise(F.concat(F.lit("/GraduateCourse"), n - n_courses // 2))
    other = univ(pick(max(1, scale), "degree"))
    parts = [
        rows(dep.where("d = 0"), (univ(F.col("u")), RDF_TYPE, ub("University"))),
        rows(dep, (iri(), RDF_TYPE, ub("Department")), (iri(), ub("subOrganizationOf"), univ(F.col("u")))),
        rows(
            entities(n_faculty), (teacher, RDF_TYPE, kind), (teacher, ub("worksFor"), iri()), (teacher, ub("name"), text(rank(k))), (teacher, ub("emailAddress"), text(rank(k), "@", site)), (teacher, ub("telephone"), text("xxx-xxx-xxxx")),
            (teacher, ub("doctoralDegreeFrom"), other), (teacher, ub("teacherOf"), iri(course(k))), (teacher, ub("teacherOf"), iri(course(k + 30))),
        ),
        rows(entities(1), (iri("/FullProfessor0"), ub("headOf"), iri())),
        rows(entities(n_courses).where(k < n_courses // 2), (iri(course(k)), RDF_TYPE, ub("Course"))),
        rows(entities(n_courses).where(k >= n_courses // 2), (iri(course(k)), RDF_TYPE, ub("GraduateCourse"))),
        rows(
            entities(n_grad), (me("GraduateStudent"), RDF_TYPE, ub("GraduateStudent")), (me("GraduateStudent"), ub("memberOf"), iri()), (me("GraduateStudent"), ub("undergraduateDegreeFrom"), other), (me("GraduateStudent"), ub("emailAddress"), text("GraduateStudent", k, "@", site)),
            (me("GraduateStudent"), ub("takesCourse"), iri(course(pick(30, "a") + 30))), (me("GraduateStudent"), ub("takesCourse"), iri(course(pick(30, "b") + 30))), (me("GraduateStudent"), ub("advisor"), iri("/", rank(pick(n_faculty, "advisor")))),
        ),
        rows(
            entities(n_under), (me("UndergraduateStudent"), RDF_TYPE, ub("UndergraduateStudent")), (me("UndergraduateStudent"), ub("memberOf"), iri()), (me("UndergraduateStudent"), ub("emailAddress"), text("UndergraduateStudent", k, "@", site)),
            (me("UndergraduateStudent"), ub("takesCourse"), iri(course(pick(30, "a")))), (me("UndergraduateStudent"), ub("takesCourse"), iri(course(pick(30, "b")))),
        ),
        rows(entities(n_groups), (me("ResearchGroup"), RDF_TYPE, ub("ResearchGroup")), (me("ResearchGroup"), ub("subOrganizationOf"), iri())),
        rows(entities(3 * n_faculty), (me("Publication"), RDF_TYPE, ub("JournalArticle")), (me("Publication"), ub("publicationAuthor"), iri("/", rank(k % n_faculty)))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("s", "p", "o", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.xxhash64("s", "p", "o").alias("line")).alias("pos"))
