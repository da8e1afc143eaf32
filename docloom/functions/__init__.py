"""Scalar and predicate expressions on columns."""
