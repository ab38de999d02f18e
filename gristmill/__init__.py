"""Declarative predicates compiled to Spark plans, and operators for training data."""
