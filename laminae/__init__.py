"""Layered tables on Spark: a read-only source merged at read time with a base of local edits."""

from .errors import IntegrityViolation, LayerConfigError, MultipleRows, NotOverridable, RedundantUpdate, SwapRefused
from .operators.layer import LayeredTable
from .spec import LayerSpec, RedundantPolicy, Relation, SourceSpec, Strategy, Unique

__all__ = [
    "IntegrityViolation",
    "LayerConfigError",
    "LayerSpec",
    "LayeredTable",
    "MultipleRows",
    "NotOverridable",
    "RedundantPolicy",
    "RedundantUpdate",
    "Relation",
    "SourceSpec",
    "Strategy",
    "SwapRefused",
    "Unique",
]
