"""Training-data operators: formatting, scanning, deduplication, mixing and decontamination of large corpora.

Nothing outside this subpackage imports it.
"""
