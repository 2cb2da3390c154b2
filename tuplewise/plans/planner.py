"""Rules to lazy DataFrames.

Every atom becomes a projection of the needed columns, renamed to internal variables, under its constant and equality filters
(which Catalyst pushes into the scan). Then, for each connected part of the body:

* ears without head variables of their own become left semi-joins of their witness, before anything expands;
* `binary` joins the rest: an acyclic body greedily along shared variables, filtered and small atoms first, with atoms that
  add no variable as semi-joins at the end; a cyclic one by measured sizes (see measured.py; one counting job runs while the plan is made);
* `yannakakis` first reduces an acyclic body by semi-joins up and down its join tree;
* `generic` extends one variable at a time (see generic.py), which bounds intermediates of cyclic bodies;
* `auto` is `binary`, but for cyclic bodies whose pairs would make far more rows than the body can yield: these are `generic`; and for those whose
  variables are all in the head and whose pairs would shuffle more than the atoms' rows do when dealt to cells: these are joined in cells (see cells.py).

Parts without head variables only guard the result. The head is projected, and made a set, last; bindings joined in cells are a set already. Physical join choice, skew
splitting and reuse of exchanges are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..rules import Rule
from ..sources.files import checked_key
from .analyze import BoundAtom, BoundRule, analyze, components, join_tree
from .cells import CELL_ROWS, GAIN, SKEWED, WORTH, join_cells, largest_cell, rows_sent, shares_of
from .generic import extend_all
from .measured import Node, expected_most, join_measured, measure, too_many

DEFAULT = "auto"


@dataclass
class Piece:
    """An atom's frame: its columns are exactly its variables."""

    vars: frozenset[str]
    df: DataFrame
    filtered: bool
    #: The frame may repeat rows because columns were dropped.
    loose: bool
    #: Another atom reads the same relation.
    shared: bool = False

    @property
    def size(self) -> int:
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass
class SetFrame:
    """A frame without repeats, so that no shuffle has to look for them."""

    df: DataFrame


def atom_frame(df: DataFrame, atom: BoundAtom, check: bool = False) -> DataFrame:
    """Columns of a relation by place as variables; constants and repeated variables as filters, which reach the scan. With `check`, the columns that are read fail at nulls and negative values."""
    names = df.columns
    df = df.toDF(*[f"a{i}" for i in range(len(df.columns))])
    for i, value in atom.where:
        df = df.where(F.col(f"a{i}") == F.lit(value).cast("bigint") if value < 1 << 63 else F.lit(False))
    for i, j in atom.same:
        df = df.where(F.col(f"a{i}") == F.col(f"a{j}"))
    return df.select([(checked_key(F.col(f"a{i}"), f"{atom.relation}.{names[i]}") if check else F.col(f"a{i}")).alias(v) for i, v in atom.columns])


def drop_private(pieces: list[Piece], needed: frozenset[str]) -> list[Piece]:
    """Without columns that stand in one atom only and that nobody asks for: existence is all that counts."""
    for p in pieces:
        keep = p.vars & (needed | frozenset().union(*(o.vars for o in pieces if o is not p)))
        if keep != p.vars and keep:
            p.df, p.vars, p.loose = p.df.select(*sorted(keep)), keep, True
    return pieces


def make_sets(pieces: list[Piece]) -> list[Piece]:
    """Repeats removed where they would multiply: in atoms that lost columns or share a relation.

    Joins on keys, the common acyclic case, go without: there the final set costs less than one more shuffle an atom.
    """
    for p in pieces:
        if len(pieces) > 1 and (p.loose or p.shared):
            p.df = p.df.distinct()
    return pieces


def absorb_ears(pieces: list[Piece], needed: frozenset[str]) -> list[Piece]:
    """Turn existential ears into semi-joins of their witnesses, as long as there are any.

    Ears of cyclic bodies are measured, as their atoms are: few keys are broadcast, so that the witness isn't shuffled for them.
    """
    pieces, cyclic = list(pieces), _cyclic(pieces)
    again = True
    while again and len(pieces) > 1:
        again = False
        for a in sorted(pieces, key=lambda p: len(p.vars)):
            others = [p for p in pieces if p is not a]
            shared = a.vars & frozenset().union(*(p.vars for p in others))
            if not shared or (a.vars - shared) & needed:
                continue
            witness = next((p for p in others if shared <= p.vars), None)
            if witness is not None:
                keys = a.df.select(*sorted(shared))
                if cyclic:
                    node = measure([(shared, keys)])[0]
                    keys = F.broadcast(node.df) if node.small else node.df
                witness.df = witness.df.join(keys, sorted(shared), "left_semi")
                witness.filtered |= a.filtered
                pieces = others
                again = True
                break
    return pieces


def _connected(pieces: list[Piece]) -> bool:
    return len(components([p.vars for p in pieces])) == 1


def split_filters(pieces: list[Piece], needed: frozenset[str]) -> tuple[list[Piece], list[Piece]]:
    """The core to join, and pieces that then only filter: they bring no variable that is needed and not in the core."""
    core, filters = list(pieces), []
    for a in sorted(pieces, key=lambda p: -p.size):
        rest = [p for p in core if p is not a]
        if not rest or not _connected(rest):
            continue
        there = frozenset().union(*(p.vars for p in rest))
        wanted = needed | frozenset().union(*(f.vars & frozenset().union(*(p.vars for p in core)) for f in filters)) if filters else needed
        # what only this piece has must not matter to the head or to a filter
        if (a.vars - there) & wanted or not a.vars & there:
            continue
        core, filters = rest, [*filters, a]
    return core, filters


def join_greedily(pieces: list[Piece], needed: frozenset[str]) -> DataFrame:
    """Inner joins along shared variables; columns that nothing needs any more are dropped as soon as possible."""
    core, filters = split_filters(pieces, needed)
    left = sorted(core, key=lambda p: (not p.filtered, p.size))
    first = left.pop(0)
    df, have = first.df, set(first.vars)
    while left:
        nxt = next(p for p in left if p.vars & have)
        left.remove(nxt)
        df = df.join(nxt.df, sorted(nxt.vars & have), "inner")
        have |= nxt.vars
        later = needed.union(*(p.vars for p in [*left, *filters]))
        if have - later and any(p.vars - have for p in left):
            # existential columns are gone and more rows come: fewer rows go on
            df, have = df.select(*sorted(have & later)).distinct(), have & later
    for f in sorted(filters, key=lambda p: p.size):
        on = sorted(f.vars & have)
        df = df.join(f.df.select(*on), on, "left_semi")
    return df


def reduce_fully(pieces: list[Piece]) -> list[Piece]:
    """Semi-joins up and down the join tree, so that no row of any piece is left without a partner; cyclic bodies stay as they are."""
    tree = join_tree([p.vars for p in pieces])
    if tree is None:
        return pieces
    for ear, witness in tree:
        on = sorted(pieces[ear].vars & pieces[witness].vars)
        pieces[witness].df = pieces[witness].df.join(pieces[ear].df.select(*on), on, "left_semi")
    for ear, witness in reversed(tree):
        on = sorted(pieces[ear].vars & pieces[witness].vars)
        pieces[ear].df = pieces[ear].df.join(pieces[witness].df.select(*on), on, "left_semi")
    return pieces


def _cyclic(pieces: list[Piece]) -> bool:
    return join_tree([p.vars for p in pieces]) is None


def _binary(pieces: list[Piece], needed: frozenset[str]) -> DataFrame:
    pieces = absorb_ears(drop_private(pieces, needed), needed)
    if _cyclic(pieces):
        return join_measured(measure([(p.vars, p.df) for p in pieces]), needed)
    return join_greedily(make_sets(pieces), needed)


def _in_cells(nodes: list[Node], needed: frozenset[str], most: float) -> dict[str, int] | None:
    """Shares of the variables where cells shuffle less than the largest intermediate result and no cell is too large."""
    if most < WORTH or frozenset().union(*(n.vars for n in nodes)) != needed:
        return None
    shares = shares_of(nodes, 2 * nodes[0].df.sparkSession.sparkContext.defaultParallelism)
    fits = GAIN * rows_sent(nodes, shares) <= most and largest_cell(nodes, shares) <= SKEWED * CELL_ROWS
    return shares if fits else None


def _auto(pieces: list[Piece], needed: frozenset[str]) -> DataFrame | SetFrame:
    pieces = absorb_ears(drop_private(pieces, needed), needed)
    if not _cyclic(pieces):
        return join_greedily(make_sets(pieces), needed)
    # what only an ear asked for is done with
    nodes = measure([(p.vars, p.df) for p in drop_private(pieces, needed)])
    most = expected_most(nodes, needed)
    if too_many(nodes, most):
        return extend_all([(n.vars, n.df) for n in nodes], needed)
    shares = _in_cells(nodes, needed, most)
    return SetFrame(join_cells(nodes, shares, needed)) if shares else join_measured(nodes, needed)


def _yannakakis(pieces: list[Piece], needed: frozenset[str]) -> DataFrame:
    return join_greedily(reduce_fully(make_sets(absorb_ears(drop_private(pieces, needed), needed))), needed)


def _generic(pieces: list[Piece], needed: frozenset[str]) -> DataFrame:
    pieces = absorb_ears(drop_private(pieces, needed), needed)
    if not _cyclic(pieces):
        return join_greedily(make_sets(pieces), needed)
    return extend_all([(p.vars, p.df) for p in pieces], needed)


#: How a connected body becomes a frame; more may be registered.
STRATEGIES: dict[str, Callable[[list[Piece], frozenset[str]], DataFrame | SetFrame]] = {"auto": _auto, "binary": _binary, "yannakakis": _yannakakis, "generic": _generic}
#: Names under which other engines know their one algorithm.
ALIASES = {"leapfrog_triejoin": "generic", "leapfrog-triejoin": "generic"}


def plan_rule(spark: SparkSession, relations: Mapping[str, DataFrame], rule: Rule, strategy: str = DEFAULT, output: str = "head", ordered: bool = False, unchecked: Collection[str] = ()) -> DataFrame:
    """The rule's result. Nothing runs before an action, but for cyclic bodies, whose atoms are counted."""
    strategy = ALIASES.get(strategy, strategy)
    if strategy not in STRATEGIES:
        raise EngineError(f"unknown strategy {strategy!r}")
    if output not in ("head", "bindings"):
        raise EngineError(f"unknown output {output!r}")
    bound = analyze(rule, {n: len(df.columns) for n, df in relations.items()})
    needed = frozenset(bound.names.values()) if output == "bindings" else frozenset(t for t in bound.head if isinstance(t, str))
    frames, guards, is_set = [], [], []
    for places in components([a.vars for a in bound.atoms]):
        atoms = [bound.atoms[i] for i in places]
        if not atoms[0].vars:
            guards.append(atom_frame(relations[atoms[0].relation], atoms[0], atoms[0].relation in unchecked))
            continue
        names = [a.relation for a in atoms]
        pieces = [Piece(a.vars, atom_frame(relations[a.relation], a, a.relation in unchecked), bool(a.where), a.dropped, names.count(a.relation) > 1) for a in atoms]
        wanted = needed & frozenset().union(*(a.vars for a in atoms))
        if wanted:
            made = STRATEGIES[strategy](pieces, wanted)
            # such a frame has exactly the wanted variables
            is_set.append(isinstance(made, SetFrame))
            frames.append((made.df if is_set[-1] else made).select(*sorted(wanted)))
        else:
            some = frozenset([min(pieces[0].vars)])
            made = STRATEGIES[strategy](pieces, some)
            guards.append(made.df if isinstance(made, SetFrame) else made)
    return _finish(spark, bound, frames, guards, output, ordered, is_set == [True])


def _finish(spark: SparkSession, bound: BoundRule, frames: list[DataFrame], guards: list[DataFrame], output: str, ordered: bool, is_set: bool) -> DataFrame:
    if frames:
        # parts of a product are sets first, so that repeats don't multiply
        df = frames[0] if len(frames) == 1 else frames[0].distinct()
        for f in frames[1:]:
            df = df.crossJoin(f.distinct())
    else:
        df = spark.range(1).select()
    for g in guards:
        df = df.crossJoin(g.select().limit(1))
    terms = list(bound.names.values()) if output == "bindings" else list(bound.head)
    names = list(bound.names) if output == "bindings" else list(bound.head_names)
    columns = [F.col(t) if isinstance(t, str) else F.lit(t).cast("bigint") for t in terms]
    df = df.select([c.alias(f"h{i}") for i, c in enumerate(columns)])
    df = df if is_set else df.distinct()
    if ordered:
        df = df.orderBy(*df.columns)
    return df.toDF(*names)
