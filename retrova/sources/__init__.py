"""Readers and writers of retrieval data sets, vector files and result logs."""
