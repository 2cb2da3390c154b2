"""All errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class ParseError(EngineError):
    """A rule's text isn't a rule."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(f"{message} (at character {at})")
        self.at = at


class BadAtomError(EngineError):
    """A constant that isn't `c` and digits."""


class UnknownRelationError(EngineError):
    """A body atom names no relation of the database."""


class ArityMismatchError(EngineError):
    """An atom and its relation differ in width."""


class UnsafeRuleError(EngineError):
    """A head term isn't bound by the body."""


class InvalidDataError(EngineError):
    """A value that isn't a non-negative 63-bit integer."""


class UnsupportedFormatError(EngineError):
    """A file of a kind that can't be read."""


class UnsupportedSparql(EngineError):
    """A SPARQL query beyond basic graph patterns."""


class NTriplesError(EngineError):
    """A line that isn't an N-Triples statement."""


class EntailmentError(EngineError):
    """Inference didn't settle."""


class BenchmarkInvalid(EngineError):
    """A benchmark definition breaks a rule of the schema."""


class BenchmarkNotFound(EngineError):
    """No benchmark of this name."""


class SpecDrift(EngineError):
    """A generated benchmark was made from another specification."""


class ReportError(EngineError):
    """A report that can't be read or doesn't hold what is asked for."""
