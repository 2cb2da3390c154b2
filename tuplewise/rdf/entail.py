"""Inference of the Univ-Bench ontology: a semi-naive fixpoint over triples."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EntailmentError
from ..storage import durable
from .ntriples import is_iri, is_literal

UB = "http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"

#: The ontology's subclass edges (class, superclass).
SUBCLASSES = (
    ("UndergraduateStudent", "Student"),
    ("GraduateStudent", "Student"),
    ("Student", "Person"),
    ("FullProfessor", "Professor"),
    ("AssociateProfessor", "Professor"),
    ("AssistantProfessor", "Professor"),
    ("VisitingProfessor", "Professor"),
    ("Chair", "Professor"),
    ("Dean", "Professor"),
    ("Lecturer", "Faculty"),
    ("PostDoc", "Faculty"),
    ("Professor", "Faculty"),
    ("Faculty", "Employee"),
    ("AdministrativeStaff", "Employee"),
    ("ClericalStaff", "AdministrativeStaff"),
    ("SystemsStaff", "AdministrativeStaff"),
    ("Employee", "Person"),
    ("TeachingAssistant", "Person"),
    ("ResearchAssistant", "Person"),
    ("Director", "Person"),
    ("University", "Organization"),
    ("Department", "Organization"),
    ("College", "Organization"),
    ("Institute", "Organization"),
    ("Program", "Organization"),
    ("ResearchGroup", "Organization"),
    ("GraduateCourse", "Course"),
    ("Article", "Publication"),
    ("Book", "Publication"),
    ("ConferencePaper", "Article"),
    ("JournalArticle", "Article"),
    ("TechnicalReport", "Article"),
    ("Manual", "Publication"),
    ("Software", "Publication"),
    ("Specification", "Publication"),
    ("UnofficialPublication", "Publication"),
)
#: Subproperties, transitive properties, inverses, and classes that a property and its object's class imply.
SUBPROPERTIES = (
    ("worksFor", "memberOf"),
    ("headOf", "worksFor"),
    ("undergraduateDegreeFrom", "degreeFrom"),
    ("mastersDegreeFrom", "degreeFrom"),
    ("doctoralDegreeFrom", "degreeFrom"),
)
TRANSITIVE = ("subOrganizationOf",)
INVERSES = (("hasAlumnus", "degreeFrom"),)
REALISED = (("headOf", "Department", "Chair"),)


def ub(name: str) -> str:
    return f"<{UB}{name}>"


def reachability(edges: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    """All that each node reaches over one edge or more, sorted; for small graphs such as an ontology."""
    direct: dict[str, set[str]] = {}
    for a, b in edges:
        direct.setdefault(a, set()).add(b)
    out = {}
    for a in direct:
        seen: set[str] = set()
        stack = list(direct[a])
        while stack:
            b = stack.pop()
            if b not in seen:
                seen.add(b)
                stack.extend(direct.get(b, ()))
        out[a] = sorted(seen)
    return out


@dataclass(frozen=True)
class Ontology:
    """Terms in canonical form (<iri>)."""

    superclasses: dict[str, list[str]]
    superproperties: dict[str, list[str]]
    transitive: tuple[str, ...]
    inverses: dict[str, list[str]]
    #: (property, class of its object, class of its subject)
    realised: tuple[tuple[str, str, str], ...]


def univ_bench() -> Ontology:
    inverse: dict[str, list[str]] = {}
    for p, q in INVERSES:
        inverse.setdefault(ub(p), []).append(ub(q))
        inverse.setdefault(ub(q), []).append(ub(p))
    return Ontology(
        reachability((ub(a), ub(b)) for a, b in SUBCLASSES),
        reachability((ub(a), ub(b)) for a, b in SUBPROPERTIES),
        tuple(map(ub, TRANSITIVE)),
        inverse,
        tuple((ub(p), ub(c), ub(d)) for p, c, d in REALISED),
    )


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    """The values of an ontology table, as a constant map: some dozens of entries."""
    return F.create_map(*[x for k, vs in table.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])[key]


def subclass_step(t: DataFrame, o: Ontology) -> DataFrame:
    return t.where(F.col("p") == RDF_TYPE).where(F.col("o").isin(list(o.superclasses))).select("s", "p", F.explode(_lookup(o.superclasses, F.col("o"))).alias("o"))


def subproperty_step(t: DataFrame, o: Ontology) -> DataFrame:
    return t.where(F.col("p").isin(list(o.superproperties))).select("s", F.explode(_lookup(o.superproperties, F.col("p"))).alias("p"), "o")


def inverse_step(t: DataFrame, o: Ontology) -> DataFrame:
    some = t.where(F.col("p").isin(list(o.inverses)) & ~is_literal(F.col("o")))
    return some.select(F.col("o").alias("s"), F.explode(_lookup(o.inverses, F.col("p"))).alias("p"), F.col("s").alias("o"))


def transitive_step(new: DataFrame, all_: DataFrame, o: Ontology) -> DataFrame:
    edge = lambda t: t.where(F.col("p").isin(list(o.transitive)) & is_iri(F.col("o")))
    front, back = edge(new).select("s", "p", F.col("o").alias("m")), edge(all_).select(F.col("s").alias("m"), "p", "o")
    one = front.join(back, ["m", "p"]).select("s", "p", "o")
    if new is all_:
        return one
    front, back = edge(all_).select("s", "p", F.col("o").alias("m")), edge(new).select(F.col("s").alias("m"), "p", "o")
    return one.unionByName(front.join(back, ["m", "p"]).select("s", "p", "o"))


def realise_step(new: DataFrame, all_: DataFrame, o: Ontology) -> DataFrame:
    out = None
    for prop, cls, derived in o.realised:
        for a, b in ((new, all_), (all_, new))[: 1 if new is all_ else 2]:
            typed = b.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select(F.col("s").alias("o"))
            found = a.where(F.col("p") == prop).join(typed, "o", "left_semi").select("s", F.lit(RDF_TYPE).alias("p"), F.lit(derived).alias("o"))
            out = found if out is None else out.unionByName(found)
    return out if out is not None else new.limit(0)


def derived_predicates(o: Ontology) -> list[str]:
    """Predicates of the triples that rules can add."""
    found = {RDF_TYPE, *o.transitive}
    for table in (o.superproperties, o.inverses):
        found.update(b for bs in table.values() for b in bs)
    return sorted(found)


@dataclass(frozen=True)
class Stats:
    input: int
    output: int
    derived: int
    iterations: int


def entail(triples: DataFrame, ontology: Ontology | None = None, limit: int = 64) -> tuple[DataFrame, Stats]:
    """All triples (s, p, o) that follow; a set, with those given. Triples with an empty subject are left out.

    Each round works on what the one before found: ontology rules look at new triples alone, joins take new ones on one side.
    Rounds are written to the shared folder, so neither the plan nor the loss of an executor grows with their number.
    """
    o = ontology or univ_bench()
    everything = durable(triples.select("s", "p", "o").where("s <> '<>'").distinct(), "triples")
    given = total = everything.count()
    parts, new, rounds = [everything], everything, 0
    while True:
        rounds += 1
        found = subclass_step(new, o).unionByName(subproperty_step(new, o)).unionByName(inverse_step(new, o))
        found = found.unionByName(transitive_step(new, everything, o)).unionByName(realise_step(new, everything, o))
        # only triples of predicates that rules derive can be there already
        known = everything.where(F.col("p").isin(derived_predicates(o)))
        new = durable(found.distinct().join(known, ["s", "p", "o"], "left_anti"), "derived")
        n = new.count()
        if not n:
            return everything, Stats(given, total, total - given, rounds)
        if rounds >= limit:
            raise EntailmentError(f"not settled after {limit} rounds")
        parts.append(new)
        total += n
        everything = parts[0]
        for p in parts[1:]:
            everything = everything.unionByName(p)
