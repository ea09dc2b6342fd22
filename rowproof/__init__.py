"""Reviewable table workflows as Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

from rowproof.errors import (
    CardinalityError, CitationMismatch, ContractError, GrainError, PredicateError, StepRefused)
from rowproof.schema import Col, Signature, Table
from rowproof.session import configure
from rowproof.step import Step

__all__ = ["CardinalityError", "CitationMismatch", "Col", "ContractError", "GrainError",
           "PredicateError", "Signature", "Step", "StepRefused", "Table", "configure"]

# The little Python that runs inside tasks travels with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
