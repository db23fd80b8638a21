"""Relational operators: spatial joins, components, simplification, density, reports."""
