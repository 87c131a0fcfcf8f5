"""Scalar functions. Every one is a Catalyst expression; there is no Python UDF in this package."""
