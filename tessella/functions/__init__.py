"""Scalar functions, predicates and programs as Columns."""
