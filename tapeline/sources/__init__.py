"""Sources of the tick analytics engine."""
