"""Iterative fits and end-to-end evaluations."""
