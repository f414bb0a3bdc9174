"""Operators of the tick analytics engine."""
