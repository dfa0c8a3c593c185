"""Error kinds of the query surface."""


class QueryError(Exception):
    kind = "internal"


class BadData(QueryError):
    """The request is malformed: syntax, times, label names."""

    kind = "bad_data"


class Unsupported(QueryError):
    """The request is well formed but outside what the engine evaluates."""

    kind = "unsupported"


class ExecutionError(QueryError):
    """Evaluation failed, as with duplicate series."""

    kind = "execution"
