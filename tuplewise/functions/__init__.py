"""Column functions: kinds of RDF terms, and the phase in a benchmark function's name."""

from ..lab import phase_of
from ..rdf.ntriples import is_iri, is_literal

__all__ = ["is_iri", "is_literal", "phase_of"]
