"""Scalar, time and vector functions on columns."""
