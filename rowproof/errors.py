"""Errors raised on the driver, before or instead of a job."""


class RowproofError(Exception):
    pass


class PredicateError(RowproofError):
    """A `where` text the dialect does not admit."""


class ContractError(RowproofError):
    """A table or a configuration does not meet a declared contract."""


class CardinalityError(RowproofError):
    """An enrich met a reference that repeats a key."""


class StepRefused(RowproofError):
    """A step declines its input for a stated reason; not a crash."""


class GrainError(RowproofError):
    """Two tables that must align row by row do not."""


class CitationMismatch(RowproofError):
    """A published value is not what the cited cell holds."""
