"""Rules (conjunctive queries) as values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    """A constant by its name; `c<digits>` stands for a number."""

    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Wildcard:
    def __str__(self) -> str:
        return "_"


Term = Var | Const | Wildcard


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple[Term, ...]

    @property
    def variables(self) -> tuple[str, ...]:
        """Distinct variables in order."""
        return tuple(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.terms))})"


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]

    def to_datalog(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}."

    __str__ = to_datalog

    def head_names(self) -> list[str]:
        """A column name for each head term: repeated ones get _1, _2, ..."""
        seen: dict[str, int] = {}
        used = {str(t) for t in self.head.terms}
        out = []
        for t in map(str, self.head.terms):
            name = t
            while t in seen and (name := f"{t}_{seen[t]}") in used:
                seen[t] += 1
            if t in seen:
                seen[t] += 1
            else:
                seen[t] = 1
            used.add(name)
            out.append(name)
        return out
