"""Operators of a training-data pipeline; see ``queries`` for how each is applied to its table."""
