"""Tapeline: tick-data analytics and symbol research on Spark DataFrames."""
