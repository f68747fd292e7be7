"""Join trees over DataFrames, their rewrites, and the named queries."""

from .spec import Edge, JoinSpec, Relation

__all__ = ["Edge", "JoinSpec", "Relation"]
