"""Operators on DataFrames: chunking, search, ranking, metrics, statistics, reports."""
