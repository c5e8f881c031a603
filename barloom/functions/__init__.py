"""Scalar functions and canonical JSON."""
