"""Scalar and aggregate functions of the command language."""
