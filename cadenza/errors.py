"""Errors a caller can act on."""


class CadenzaError(ValueError):
    """Base of all errors of definition or query."""


class UnknownName(CadenzaError):
    pass


class NotAllowed(CadenzaError):
    """An aggregation, function or clause that the definition doesn't admit."""


class JoinPathError(CadenzaError):
    pass


class PolicyError(CadenzaError):
    """A row-level rule that can't be applied to a table."""


class SchemaDrift(CadenzaError):
    """A query failed because models no longer fit the tables; `found` says where."""

    def __init__(self, message: str, found: list):
        super().__init__(message)
        self.found = found
