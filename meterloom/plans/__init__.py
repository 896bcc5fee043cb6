"""Compositions of operators that answer one whole question."""
