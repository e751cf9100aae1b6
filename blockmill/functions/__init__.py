"""Expressions, predicates and aggregators."""
