"""Factorizations, cross interpolation and Krylov solvers over coordinate tables."""
