"""Kinds of query errors."""


class CypherError(Exception):
    """Base of all query errors."""


class ParseError(CypherError):
    """The text is not a query."""


class Unsupported(CypherError):
    """A feature that this engine refuses instead of running it with other semantics."""


class InvalidQuery(CypherError):
    """A query that breaks a static rule."""


class TypeMismatch(CypherError):
    """A value of a type that the operation does not take."""


class DivisionByZero(CypherError):
    """Integer division by zero."""


class QueryRuntimeError(CypherError):
    """A failure while a query runs."""
