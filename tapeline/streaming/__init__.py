"""Streaming of the tick analytics engine."""
