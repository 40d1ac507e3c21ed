"""Whole plans: experiments, the search service's requests, and the registry of queries with their SQL."""
