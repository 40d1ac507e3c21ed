"""Embedding retrieval, its evaluation and its service semantics as DataFrame plans."""
