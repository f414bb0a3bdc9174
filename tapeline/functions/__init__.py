"""Functions of the tick analytics engine."""
