"""Declarative log summarisation on Spark: one JSON format is one parse, filter, group and aggregate query."""
