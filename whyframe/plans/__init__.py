"""Flows that chain operators, the query catalogue and its SQL twins."""
