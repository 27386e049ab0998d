"""Queries over the given tables: bindings to the operators, each with its SQL twin."""
