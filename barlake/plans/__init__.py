"""Compositions of operators: the scoring chain and the registered queries."""
