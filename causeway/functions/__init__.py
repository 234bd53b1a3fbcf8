"""Scalar functions and distributions."""
