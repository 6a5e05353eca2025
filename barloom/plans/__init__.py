"""Compositions of operators: features, models, metrics, the engine."""
