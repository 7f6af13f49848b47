"""Compositions of operators: whole dataset builds, training runs, registered queries."""
