"""Compositions of operators: feature frames, scoring, training and the service calls."""
