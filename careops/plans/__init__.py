"""Compositions of the operators, parameter sets and the query registry."""
