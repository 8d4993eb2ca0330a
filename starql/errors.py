"""Error taxonomy.  Every error the engine raises on purpose is a ``QueryError``."""

from __future__ import annotations


class QueryError(Exception):
    """Base class; ``kind`` is a stable machine-readable name."""

    kind = "unknown"

    def wrap(self, context: str) -> QueryError:
        """The same error with outer context in front of its message."""
        return type(self)(f"{context}: {self}")


class SyntaxProblem(QueryError):
    kind = "syntax"


class ConversionError(QueryError):
    kind = "conversion"


class NotSupported(QueryError):
    kind = "not_supported"


class TypeMismatch(QueryError):
    kind = "type_mismatch"


class NameProblem(QueryError):
    kind = "name"
