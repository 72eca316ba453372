"""Scalar expressions and predicates."""
