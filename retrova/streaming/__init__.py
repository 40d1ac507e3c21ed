"""Streams: token buckets, micro-batches and incremental ingest."""
